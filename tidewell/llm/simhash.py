"""SimHash near-duplicates found by the generalised pigeonhole principle.

Fingerprints: bit i of a document is set if it is set in more than half of the XXH64 values (seed 42) of its 4-word
shingles. Two fingerprints link at ``radius`` or fewer differing bits.

Search: the 64 bits are grouped into parts, correlated bits together, and part p gets a threshold t_p with
sum(t_p + 1) = radius + 1. If two fingerprints differ in at most ``radius`` bits, some part differs in at most t_p bits
(otherwise the differences add up to radius + 1), so probing every part's values within t_p flips loses no pair. The
number of parts and the unequal thresholds come from dynamic programming over estimated probe and candidate counts,
taken from a bounded sample of fingerprints; the sample steers cost only, never results.

Equal fingerprints are one node from the start. A bucket of more than ``hot`` fingerprints is not joined pair by pair:
its members and its probes are dealt into blocks of about ``block`` rows, each pair of blocks is compared in one task,
and the task reports a spanning star of what it linked instead of all pairs.

Defined results: null and empty texts have fingerprint zero; fewer than 4 words are one shingle; repeated rows and
repeated doc_ids are rows of their own and share a fingerprint's component; null doc_ids are never the smallest id;
extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import connected_components, map_columns, materialize

SHINGLE, SEED = 4, 42
#: Comparing two fingerprints of a bucket, against making, shuffling and sorting a probe.
PAIR_COST = 0.04
BROADCAST_ROWS = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text."""
    return fingerprint_of(words_of(text), shingle)


def fingerprint_of(words: list[bytes], shingle: int) -> int:
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], dtype=np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for every row."""

    def run(batches):
        for b in batches:
            yield {"fp": [fingerprint(t, shingle) for t in b["text"]]}

    return map_columns(documents.select("doc_id", "text"), "fp long", run, keep=("doc_id",))


def correlated_parts(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Bit positions in ``parts`` groups of near-equal size; a group grows by the bit most correlated with it."""
    scale = bits - bits.mean(axis=0)
    deviation = np.sqrt((scale**2).sum(axis=0)) + 1e-9
    likeness = np.abs(scale.T @ scale / np.outer(deviation, deviation))
    np.fill_diagonal(likeness, 0)
    free, groups = set(range(bits.shape[1])), []
    for left in range(parts, 0, -1):
        width = -(-len(free) // left)
        own = [max(sorted(free), key=lambda i: likeness[i, sorted(free)].sum())]
        free.discard(own[0])
        while len(own) < width and free:
            order = sorted(free)
            best = order[int(np.argmax(likeness[np.ix_(order, own)].sum(axis=1)))]
            own.append(best)
            free.discard(best)
        groups.append(sorted(own))
    return groups


def allocate(sample: np.ndarray, total: int, radius: int, parts: int) -> tuple[float, list[tuple[list[int], int]]]:
    """Least estimated cost and [(bits, threshold)] by dynamic programming; threshold -1 leaves a part out."""
    bits = np.unpackbits(sample.astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    groups = correlated_parts(bits, parts)
    pairs = max(1, len(sample) * (len(sample) - 1))
    cost = []
    for g in groups:
        masked = sample.astype(np.uint64) & np.uint64(mask_of(g))
        near = np.zeros(radius + 1)
        for at in range(0, len(masked), 256):
            counts = np.bitwise_count(masked[at : at + 256, None] ^ masked[None, :])
            near += [(counts <= t).sum() for t in range(radius + 1)]
        near = np.maximum(near - len(masked), 0) / pairs
        floor = [sum(comb(len(g), k) for k in range(t + 1)) / 2.0 ** len(g) for t in range(radius + 1)]
        probes = [sum(comb(len(g), k) for k in range(t + 1)) for t in range(radius + 1)]
        cost.append([0.0] + [float(total) * (2 + probes[t]) + PAIR_COST * float(total) ** 2 * max(near[t], floor[t]) for t in range(radius + 1)])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (spent, plan) in best.items():
            for units in range(radius + 2 - used):
                offer = (spent + c[units], [*plan, units - 1])
                if used + units not in step or offer[0] < step[used + units][0]:
                    step[used + units] = offer
        best = step
    spent, plan = best[radius + 1]
    return spent, list(zip(groups, plan))


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def flips_of(bits: list[int], threshold: int) -> list[int]:
    return [_signed(mask_of(list(c))) for k in range(threshold + 1) for c in combinations(bits, k)]


def probe_plan(values: DataFrame, total: int, radius: int, sample_rows: int = 4096) -> list[tuple[int, list[int], int]]:
    """(part, bits, threshold) of the cheapest parts for distinct values of column ``fp``, from a bounded sample."""
    taken = values.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).collect()
    sample = np.array([r.fp for r in taken], dtype=np.int64).view(np.uint64)
    _, plan = min((allocate(sample, total, radius, m) for m in range(2, radius + 2)), key=lambda x: x[0])
    return [(p, bits, t) for p, (bits, t) in enumerate(plan) if t >= 0]


def index_and_probes(rows: DataFrame, plan: list[tuple[int, list[int], int]]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with (part, value) of each part, and with (part, value) of everything within a part's threshold."""
    array = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    value = lambda bits: F.col("fp").bitwiseAND(F.lit(_signed(mask_of(bits))))
    own = F.array(*[F.struct(F.lit(p).alias("part"), value(bits).alias("value")) for p, bits, _ in plan])
    keys = lambda p, bits: lambda flip: F.struct(F.lit(p).alias("part"), value(bits).bitwiseXOR(flip).alias("value"))
    probes = F.concat(*[F.transform(array(flips_of(bits, t)), keys(p, bits)) for p, bits, t in plan])
    spread = lambda k: rows.select(*rows.columns, F.explode(k).alias("k")).select(*rows.columns, "k.part", "k.value")
    return spread(own), spread(probes)


def links(fingerprints: DataFrame, radius: int = 4, hot: int = 256, block: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct values of column ``fp`` that connect all pairs within ``radius`` bits.

    In buckets of up to ``hot`` values every linked pair is an edge, in larger ones a spanning star.
    """
    fps = materialize(fingerprints.select("fp").distinct(), "fps")
    total = fps.count()
    if total < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    index, probe = index_and_probes(fps, probe_plan(fps, total, radius))
    sizes = materialize(index.groupBy("part", "value").agg(F.count("*").alias("m")).where(F.col("m") > hot), "hot")
    cold = index.join(sizes.select("part", "value"), ["part", "value"], "left_anti")
    a, b = probe.withColumnRenamed("fp", "a"), cold.withColumnRenamed("fp", "b")
    pairs = a.join(b, ["part", "value"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    if sizes.isEmpty():
        return pairs.distinct()
    return pairs.union(_hot_links(index, probe, sizes, radius, block)).distinct()


def block_pairs(index: DataFrame, probe: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Members and askers of the large buckets, dealt into pairs of blocks: (part, value, i, j, member, input columns)."""
    key = F.xxhash64(*[c for c in index.columns if c not in ("part", "value")])
    columns = [c for c in index.columns if c not in ("part", "value")]
    asked = probe.join(sizes, ["part", "value"])
    counts = asked.groupBy("part", "value").agg(F.count("*").alias("q"), F.first("m").alias("m"))
    grid = materialize(counts.select("part", "value", F.ceil(F.col("m") / block).cast("int").alias("rows"), F.ceil(F.col("q") / block).cast("int").alias("cols")), "grid")
    slot = lambda n: F.pmod(key, F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = index.join(grid, ["part", "value"]).select("part", "value", slot("rows").alias("i"), every("cols").alias("j"), F.lit(True).alias("member"), *columns)
    askers = probe.join(grid, ["part", "value"]).select("part", "value", every("rows").alias("i"), slot("cols").alias("j"), F.lit(False).alias("member"), *columns)
    return members.union(askers)


def _hot_links(index: DataFrame, probe: DataFrame, sizes: DataFrame, radius: int, block: int) -> DataFrame:
    """Stars over the links between the members and the probes of large buckets, by pairs of blocks."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.loc[rows["member"], "fp"].to_numpy(np.int64)
        other = rows.loc[~rows["member"], "fp"].to_numpy(np.int64)
        return pd.DataFrame(stars(np.unique(np.concatenate([own, other])), own, other, radius), columns=["a", "b"])

    return block_pairs(index, probe, sizes, block).groupBy("part", "value", "i", "j").applyInPandas(compare, "a long, b long")


def stars(ids: np.ndarray, own: np.ndarray, other: np.ndarray, radius: int) -> np.ndarray:
    """(smallest id, id) of every component that links between ``own`` and ``other`` make."""
    root = np.arange(len(ids))
    at_own, at_other = np.searchsorted(ids, own), np.searchsorted(ids, other)
    x, y = own.view(np.uint64), other.view(np.uint64)
    neighbours_o, neighbours_q = [], []
    for at in range(0, len(x), 256):
        i, j = np.nonzero(np.bitwise_count(x[at : at + 256, None] ^ y[None, :]) <= radius)
        neighbours_o.append(at_own[i + at])
        neighbours_q.append(at_other[j])
        if sum(map(len, neighbours_o)) > 1 << 20 or at + 256 >= len(x):
            _unite(root, np.concatenate(neighbours_o), np.concatenate(neighbours_q))
            neighbours_o, neighbours_q = [], []
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return np.column_stack([ids[root[moved]], ids[moved]])


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Smallest-label propagation over the edges until labels settle, in place."""
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up
        if np.array_equal(before, root):
            return


def near_duplicates(fingerprinted: DataFrame, radius: int = 4, hot: int = 256, block: int = 4096) -> DataFrame:
    """``fingerprinted`` (with doc_id, fp) and component_id: the smallest doc_id reachable over links."""
    edges = links(fingerprinted, radius, hot, block)
    groups = materialize(connected_components(edges).select(F.col("node").alias("fp"), "component"), "groups")
    smallest = fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("smallest"))
    labelled = smallest.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = labelled.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = labelled.select("fp", "component").join(lowest, "component").select("fp", "component_id")
    return fingerprinted.join(materialize(named, "named"), "fp")


# --- verified near copies ---------------------------------------------------------------------------------------------
SIGNATURE = 64  # words of 64 bits


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; texts of fewer words are one shingle, texts without words have none."""
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + width])) for i in range(len(words) - width + 1)] if words else [], np.uint64))


def _near(fp, other, n, size, part, plan, radius: int, least: float):
    """Whether pairs are candidates, and first met in this part; for columns as well as for arrays."""
    bits = F.bit_count if isinstance(fp, Column) else np.bitwise_count
    differ = fp.bitwiseXOR(other) if isinstance(fp, Column) else fp ^ other
    inside = lambda mask: differ.bitwiseAND(F.lit(_signed(mask))) if isinstance(fp, Column) else differ & np.uint64(mask)
    near = (bits(differ) <= radius) & (n >= least * size) & (size >= least * n)
    for p, own, t in plan:
        met = bits(inside(mask_of(own))) <= t
        near = near & ~(met & (part > p))
    return near


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A bit for each of 64 * SIGNATURE cells that some shingle falls into."""
    cells = np.zeros((len(sets), 64 * SIGNATURE), bool)
    for i, s in enumerate(sets):
        cells[i, (s % np.uint64(64 * SIGNATURE)).astype(np.int64)] = True
    return np.packbits(cells, axis=1).view(np.uint64)


def verified_stars(own: pd.DataFrame, other: pd.DataFrame, part: int, plan: list, radius: int, least: float) -> np.ndarray:
    """(smallest hash, hash) of every component that verified links between ``own`` and ``other`` make.

    Pairs that are connected already are passed over. A shingle whose cell is empty on the other side is missing there,
    which refuses most pairs before their shingles are compared.
    """
    both = pd.concat([own, other]).drop_duplicates("th").sort_values("th", ignore_index=True)
    ids, fp, n = both["th"].to_numpy(np.int64), both["fp"].to_numpy(np.int64).view(np.uint64), both["n"].to_numpy(np.int64)
    sets = [np.asarray(s, np.int64).view(np.uint64) for s in both["s"]]
    marks = _signatures(sets)
    at_own, at_other = np.searchsorted(ids, own["th"].to_numpy(np.int64)), np.searchsorted(ids, other["th"].to_numpy(np.int64))
    root = np.arange(len(ids))
    for k in range(0, len(at_own), 64):
        rows = at_own[k : k + 64]
        near = _near(fp[rows, None], fp[None, at_other], n[rows, None], n[None, at_other], part, plan, radius, least)
        near &= at_other[None, :] < rows[:, None]
        for i, hits in zip(rows.tolist(), near):
            js = at_other[hits & (root[at_other] != root[i])]
            need = (least / (1 + least)) * (n[i] + n[js]) - 1e-9
            lost = np.bitwise_count(marks[i] & ~marks[js]).sum(axis=1, dtype=np.int64)
            gained = np.bitwise_count(marks[js] & ~marks[i]).sum(axis=1, dtype=np.int64)
            good = (n[i] - lost >= need) & (n[js] - gained >= need)
            for j, least_common in zip(js[good].tolist(), need[good].tolist()):
                if root[i] != root[j] and len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= least_common:
                    low, high = sorted((root[i], root[j]))
                    root[root == high] = low
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return np.column_stack([ids[root[moved]], ids[moved]])


def verified_links(texts: DataFrame, bodies: DataFrame, radius: int, shingle: int, least: float, hot: int = 16, block: int = 2048) -> DataFrame:
    """Edges (a, b) that connect all pairs of texts within ``radius`` bits that share ``least`` of their shingles.

    ``texts``: (th, fp, n) of distinct texts, n their number of distinct shingles; ``bodies``: (th, text), or other columns
    of ``texts`` in place of th that tell texts apart. In buckets of up to ``hot`` texts every candidate pair is verified by a join. Larger buckets are dealt into pairs of blocks: one
    task finds which texts have candidates there, gets their shingles, and reports a spanning star of what it verified.
    So rows grow with the texts, never with the pairs in a group, and no link is left unverified.
    """
    keys = [c for c in bodies.columns if c != "text"]
    names, texts = texts.select("th", *[c for c in keys if c != "th"]), materialize(texts.select("th", "fp", "n"), "nodes")
    total = texts.count()
    none = texts.select(F.col("th").alias("a"), F.col("th").alias("b")).limit(0)
    if total < 2:
        return none
    plan = probe_plan(texts.select("fp").distinct(), total, radius)
    index, probe = index_and_probes(texts, plan)
    sizes = materialize(index.groupBy("part", "value").agg(F.count("*").alias("m")).where(F.col("m") > hot), "hot")
    cold = index.join(sizes.select("part", "value"), ["part", "value"], "left_anti")
    left, right = (df.select("part", "value", *[F.col(c).alias(c + k) for c in ("th", "fp", "n")]) for df, k in ((probe, "a"), (cold, "b")))
    near = _near(F.col("fpa"), F.col("fpb"), F.col("na"), F.col("nb"), F.col("part"), plan, radius, least)
    pairs = left.join(right, ["part", "value"]).where((F.col("tha") < F.col("thb")) & near)
    pairs = materialize(pairs.select(F.col("tha").alias("a"), F.col("thb").alias("b"), (F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")) - 1e-9).alias("need")), "pairs")

    def candidates(rows: pd.DataFrame) -> pd.DataFrame:
        own, other = rows[rows["member"]], rows[~rows["member"]]
        x, y = (d["fp"].to_numpy(np.int64).view(np.uint64) for d in (own, other))
        n, m = own["n"].to_numpy(np.int64), other["n"].to_numpy(np.int64)
        hit_own, hit_other = np.zeros(len(own), bool), np.zeros(len(other), bool)
        for k in range(0, len(own), 256):
            at = slice(k, k + 256)
            hit = _near(x[at, None], y[None, :], n[at, None], m[None, :], int(rows["part"].iloc[0]), plan, radius, least)
            hit &= other["th"].to_numpy(np.int64)[None, :] < own["th"].to_numpy(np.int64)[at, None]
            hit_own[at] = hit.any(axis=1)
            hit_other |= hit.any(axis=0)
        return pd.concat([own[hit_own], other[hit_other]])

    kind = "part int, value long, i int, j int, member boolean, th long, fp long, n long"
    large = not sizes.isEmpty()
    if large:
        dealt = block_pairs(index, probe, sizes, block)
        asked = materialize(dealt.groupBy("part", "value", "i", "j").applyInPandas(candidates, kind), "asked")
    ends = pairs.select(F.col("a").alias("th")).union(pairs.select("b"))
    ends = (ends.union(asked.select("th")) if large else ends).distinct().join(names, "th")

    def shingles(batches):
        for b in batches:
            yield {"s": [shingle_hashes(words_of(t), shingle).view(np.int64) for t in b["text"]]}

    few = ends.count() <= BROADCAST_ROWS  # hashes alone; beyond that texts are shuffled
    named = bodies.join(F.broadcast(ends) if few else ends, keys).groupBy("th").agg(F.first("text").alias("text"))  # equal texts
    sets = materialize(map_columns(named, "s array<long>", shingles, keep=("th",)), "shingles")
    verified = pairs.join(sets.select(F.col("th").alias("b"), F.col("s").alias("y")), "b").join(sets.select(F.col("th").alias("a"), F.col("s").alias("x")), "a")
    verified = verified.where(F.size(F.array_intersect("x", "y")) >= F.col("need")).select("a", "b")
    if not large:
        return verified

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        found = verified_stars(rows[rows["member"]], rows[~rows["member"]], int(rows["part"].iloc[0]), plan, radius, least)
        return pd.DataFrame(found, columns=["a", "b"])

    return verified.union(asked.join(sets, "th").groupBy("part", "value", "i", "j").applyInPandas(verify, "a long, b long"))


def keep_one_of_each(documents: DataFrame, shingle: int = 5, radius: int = 7, least: float = 0.8) -> DataFrame:
    """``documents`` without near copies: of every group the row with the smallest doc_id (null last) stays.

    Fingerprints of a text's distinct words within ``radius`` bits are candidates, verified by Jaccard similarity of the
    ``shingle``-word shingles of at least ``least``; groups are the components of verified links. A changed word touches
    five shingles but one word, so word fingerprints of texts of that similarity are fewer bits apart than fingerprints
    of the shingles themselves. Equal texts are a group, and so are all texts without a word, null ones included. Equal
    are texts whose 128 bits of hash agree: at 10^11 texts some pairs of different ones agree in 64.
    """
    keyed = documents.select(F.struct("*").alias("document"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("dk"), F.col("doc_id").isNull().alias("late"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")

    def run(batches):
        for b in batches:
            words = [words_of(t) for t in b["text"]]
            yield {"fp": [fingerprint_of(list(dict.fromkeys(w)), 1) for w in words], "n": [len(shingle_hashes(w, shingle)) for w in words]}

    marked = materialize(map_columns(keyed.select("dk", "late", "h1", "h2", "text"), "fp long, n long", run, keep=("dk", "late", "h1", "h2")), "marked")
    texts = marked.groupBy("h1", "h2").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.min(F.struct("late", "dk")).alias("best"))
    texts = materialize(texts.withColumn("th", F.monotonically_increasing_id()), "distinct")  # numbered once, as written
    edges = verified_links(texts, keyed.select("h1", "h2", "text"), radius, shingle, least)
    parts = connected_components(edges).withColumnRenamed("node", "th")
    grouped = texts.join(parts, "th", "left").withColumn("component", F.coalesce("component", "th"))
    kept = grouped.groupBy("component").agg(F.min(F.struct("best.late", "best.dk", "h1", "h2")).alias("k"))
    kept = materialize(kept.select("k.dk", "k.h1", "k.h2"), "kept")
    same = ["dk", "h1", "h2"]
    return keyed.drop("text", "late").join(kept, same, "left_semi").dropDuplicates(same).select("document.*")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    marked = materialize(with_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")), "marked")
    return near_duplicates(marked).select("doc_id", F.format_string("%016x", "fp").alias("fingerprint"), "component_id")
