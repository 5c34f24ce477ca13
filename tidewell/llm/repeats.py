"""Exact removal of long repeated passages by a depth-limited radix sort of suffixes.

A suffix array orders suffixes completely; to find strings of ``length`` bytes that start at two places it is enough to
sort suffixes through their first ``length`` bytes, most significant digit first, and to stop splitting a bucket as soon
as it holds one suffix: buckets of two or more at full depth are exactly the repeated windows. The passes here are
shuffles, and only suffixes that can still have a partner go on to the next one:

1. *First digit.* Every window names one of its own positions, the one with the smallest hash of the ``GRAM`` bytes
   there, so equal windows name the same offset. Neighbouring windows that name the same position travel as one row.
   Rows are bucketed by the gram; a bucket of one holds no repeat.
2. *Whole row.* Rows of a bucket that agree on all bytes of all their windows are settled together.
3. *Runs of ``RUN`` offsets*, then 4. *single windows*, for the rows that disagree somewhere (the ends of repeats):
   bucketed by the bytes that the run's windows share, then by the complete windows.

A digit has 256**64 values or more, so a bucket is addressed by a hash of the digit's bytes: 64 bits for the first digit,
which only decides who goes on, and 128 bits from then on (beside those 64), which decide what is equal. The order of
buckets is used nowhere, so buckets aren't sorted among each other. Suffixes that start between two named positions are
not rows of their own before pass 4; one row for each byte of the input would be some 40 times as many. Rows of a bucket
are never brought together: each pass counts its digits with partial sums and joins the counts back, from a table of
their own, so a passage shared by a third of all documents is spread like any other.

Defined results: null and empty texts have 0 bytes; texts under ``length`` bytes lose nothing; equal texts of at least
``length`` bytes lose everything; repeated rows are copies of each other; extra columns are ignored.
"""

from __future__ import annotations


import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, map_columns, materialize

GRAM, RUN, SEGMENT = 64, 32, 1 << 19
_POSITION = 20  # bits; a segment with its overlap is shorter than 2**20 bytes
_KEYS = "doc long, th long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each position that has so many after it; by doubling."""
    h, width = _mix(data.astype(np.uint64) + np.uint64(0x1F3)), 1
    while width < GRAM:
        h = h[:-width] * np.uint64(0xD6E8FEB86659FD93) + h[width:]
        width *= 2
        if width in (4, 16, GRAM):
            h = _mix(h)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def rows_of(data: bytes, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(position named, first window, last window, gram hash) of texts joined in ``data``; text i ends at bounds[i]."""
    hashes = gram_hashes(np.frombuffer(data, np.uint8))
    low = (np.uint64(1) << np.uint64(_POSITION)) - np.uint64(1)
    ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    named = (_sliding_min(ranked, length - GRAM + 1) & low).astype(np.int64)
    starts = np.arange(len(named))
    text = np.searchsorted(bounds, starts, side="right")
    inside = starts + length <= bounds[text]
    change = np.flatnonzero((named[1:] != named[:-1]) | (inside[1:] != inside[:-1]) | (text[1:] != text[:-1])) + 1
    first, last = np.append(0, change), np.append(change, len(named)) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    at = named[first]
    return at, first, last, hashes[at].view(np.int64)


def _segments(texts: list[bytes], length: int):
    """Texts joined up to ``SEGMENT`` bytes; a longer text is cut into pieces that overlap by ``length - 1`` bytes."""
    group: list[tuple[int, int, bytes]] = []
    held = 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for at in range(0, len(t) - length + 1, SEGMENT):
            piece = t[at : at + SEGMENT + length - 1]
            if group and held + len(piece) > SEGMENT + length:
                yield group
                group, held = [], 0
            group.append((i, at, piece))
            held += len(piece)
    if group:
        yield group


def suffix_rows(keyed: DataFrame, length: int) -> DataFrame:
    """(doc, th, p, lo, hi, g, u, w): windows lo..hi name position p; g is its gram, u and w the digest of all their bytes."""

    def run(batches):
        for b in batches:
            texts = [t.encode("utf-8", "replace") if t else b"" for t in b["text"]]
            for group in _segments(texts, length):
                data = b"".join(piece for _, _, piece in group)
                bounds = np.cumsum([len(piece) for _, _, piece in group])
                at, first, last, gram = rows_of(data, bounds, length)
                piece = np.searchsorted(bounds, at, side="right")
                shift = np.array([a for _, a, _ in group]) - np.concatenate([[0], bounds[:-1]])
                who = np.array([i for i, _, _ in group])[piece]
                digest = xxhash.xxh3_128_digest
                halves = np.frombuffer(b"".join([digest(data[a : z + length], seed=p - a) for a, z, p in zip(first.tolist(), last.tolist(), at.tolist())]), np.int64).reshape(-1, 2)
                doc, th = b["doc"], b["th"]
                move = shift[piece]
                yield {
                    "doc": [doc[i] for i in who.tolist()], "th": [th[i] for i in who.tolist()], "p": (at + move).astype(np.int32),
                    "lo": (first + move).astype(np.int32), "hi": (last + move).astype(np.int32), "g": gram, "u": np.ascontiguousarray(halves[:, 0]), "w": np.ascontiguousarray(halves[:, 1]),
                }

    return map_columns(keyed, _KEYS + ", p int, lo int, hi int, g long, u long, w long", run)


def _contexts(keyed: DataFrame, members: DataFrame, length: int) -> DataFrame:
    """``members`` with the bytes of all their windows."""
    wanted = members.groupBy("doc", "th").agg(F.collect_list(F.struct("p", "lo", "hi", "pending")).alias("wanted"))  # a document's own rows
    joined = keyed.join(wanted, ["doc", "th"])

    def run(batches):
        for b in batches:
            out = []
            for doc, th, text, wanted in zip(b["doc"], b["th"], b["text"], b["wanted"]):
                data = text.encode("utf-8", "replace")
                out += [(doc, th, w["p"], w["lo"], w["hi"], w["pending"], data[w["lo"] : w["hi"] + length]) for w in wanted]
            if out:
                yield dict(zip(("doc", "th", "p", "lo", "hi", "pending", "data"), map(list, zip(*out))))

    return map_columns(joined.select("doc", "th", "text", "wanted"), _KEYS + ", p int, lo int, hi int, pending boolean, data binary", run)


def _runs(contexts: DataFrame, length: int) -> DataFrame:
    """One row for each run of ``RUN`` offsets that a member's windows touch; digit: bytes that all the run's windows have."""

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for b in batches:
            out = []
            for doc, th, p, lo, hi, pending, data in zip(*(b[c] for c in ("doc", "th", "p", "lo", "hi", "pending", "data"))):
                for k in range((p - hi) // RUN, (p - lo) // RUN + 1):
                    begin = p - k * RUN - lo
                    out.append((doc, th, p, lo, hi, pending, k, digest(data[begin : begin + length - RUN + 1], seed=k)))
            if out:
                yield dict(zip(("doc", "th", "p", "lo", "hi", "pending", "k", "digit"), map(list, zip(*out))))

    return map_columns(contexts, _KEYS + ", p int, lo int, hi int, pending boolean, k int, digit binary", run)


def _windows(contexts: DataFrame, length: int) -> DataFrame:
    """One row for each window of the runs listed in ``ks``."""

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for b in batches:
            out = []
            for doc, th, p, lo, hi, pending, data, ks in zip(*(b[c] for c in ("doc", "th", "p", "lo", "hi", "pending", "data", "ks"))):
                for k in ks:
                    for s in range(max(lo, p - k * RUN - RUN + 1), min(hi, p - k * RUN) + 1):
                        out.append((doc, th, s, pending, digest(data[s - lo : s - lo + length], seed=p - s)))
            if out:
                yield dict(zip(("doc", "th", "s", "pending", "digit"), map(list, zip(*out))))

    return map_columns(contexts, _KEYS + ", s int, pending boolean, digit binary", run)


def repeated_windows(keyed: DataFrame, length: int) -> DataFrame:
    """(doc, th, lo, hi): starts lo..hi of windows of ``length`` bytes that also start anywhere else."""
    rows = materialize(suffix_rows(keyed, length), "suffixes")
    # counts are tables of their own: a join with a table is split where a key is hot, one with an aggregation isn't
    buckets = rows.groupBy("g").agg(F.count("*").alias("n"), (F.min(F.struct("u", "w")) != F.max(F.struct("u", "w"))).alias("mixed")).where("n > 1").drop("n")
    buckets = materialize(buckets, "buckets")
    alive = materialize(rows.join(buckets, "g"), "alive")
    span = ["doc", "th", "lo", "hi"]
    settled = alive.where("not mixed").select(span)
    mixed = alive.where("mixed")
    kinds = mixed.groupBy("g", "u", "w").agg((F.count("*") == 1).alias("pending"), *[F.first(c).alias(c) for c in ("doc", "th", "p", "lo", "hi")])  # of one row
    kinds = materialize(kinds, "kinds")
    settled = settled.union(mixed.join(kinds.where("not pending").select("g", "u", "w"), ["g", "u", "w"]).select(span))
    settled = materialize(settled, "settled")
    discard(rows, alive, buckets)
    contexts = materialize(_contexts(keyed, kinds, length), "contexts")
    runs = materialize(_runs(contexts, length), "runs")
    place = F.xxhash64("doc", "th", "p", "lo")
    shared = runs.groupBy("digit").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.max("pending").alias("open")).where("x <> y and open").select("digit")
    shared = materialize(shared, "shared")
    left = runs.join(shared, "digit").groupBy("doc", "th", "p", "lo").agg(F.collect_list("k").alias("ks"))
    windows = materialize(_windows(contexts.join(left, ["doc", "th", "p", "lo"]).select(*contexts.columns, "ks"), length), "windows")
    place = F.xxhash64("doc", "th", "s")
    discard(contexts, runs)
    equal = windows.groupBy("digit").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.max("pending").alias("open")).where("x <> y and open").select("digit")
    equal = materialize(equal, "equal")
    single = windows.where("pending").join(equal, "digit").select("doc", "th", F.col("s").alias("lo"), F.col("s").alias("hi"))
    single = materialize(single, "single")
    discard(windows, shared, equal)
    return settled.union(single)


def remove_repeats(documents: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, kept binary, spans array<struct<first, stop>>) for every row."""
    keyed = documents.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("th"), "text")
    found = repeated_windows(keyed.where("text is not null").select("doc", "th", "text"), length)
    spans = found.groupBy("doc", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("windows"))  # a document's own rows
    joined = keyed.join(spans, ["doc", "th"], "left").select("doc_id", "text", "windows")

    def run(batches):
        for b in batches:
            out = {"doc_id": b["doc_id"], "n_bytes": [], "n_removed": [], "kept": [], "spans": []}
            for text, windows in zip(b["text"], b["windows"]):
                data = (text or "").encode("utf-8", "replace")
                cut: list[list[int]] = []
                for lo, hi in sorted((w["lo"], w["hi"]) for w in windows or ()):
                    if cut and lo <= cut[-1][1]:
                        cut[-1][1] = max(cut[-1][1], hi + length)
                    else:
                        cut.append([lo, hi + length])
                at, kept = 0, []
                for a, z in cut:
                    kept.append(data[at:a])
                    at = z
                kept.append(data[at:])
                out["n_bytes"].append(len(data))
                out["n_removed"].append(sum(z - a for a, z in cut))
                out["kept"].append(b"".join(kept))
                out["spans"].append([{"first": a, "stop": z} for a, z in cut])
            yield out

    return map_columns(joined, "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<first:int,stop:int>>", run)


def op5_repeats(spark, sf_dir: str) -> DataFrame:
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_removed") > 0).alias("has_repeats"), (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), F.try_validate_utf8(F.col("kept").cast("string")).alias("text"),  # null if a cut goes through a character
    )


ORACLE = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS MATERIALIZED (SELECT k, s, md5(b[s : s + 399]) AS h FROM (SELECT k, b, unnest(range(1, n - 398)) AS s FROM d WHERE n >= 400)),
r AS (SELECT k, s FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
j AS (SELECT k, s, CASE WHEN s <= lag(s) OVER (PARTITION BY k ORDER BY s) + 400 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT k, s, sum(fresh) OVER (PARTITION BY k ORDER BY s) AS i FROM j),
c AS (SELECT k, min(s) AS a, max(s) + 400 AS z FROM i GROUP BY k, i),
p AS (SELECT k, a AS place, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 1) AS f, a - 1 AS t FROM c UNION ALL SELECT k, max(z), max(z), NULL FROM c GROUP BY k),
e AS (SELECT k, unhex(string_agg(CASE WHEN f <= coalesce(t, n) THEN hex(b[f : coalesce(t, n)]) ELSE '' END, '' ORDER BY place)) AS left_over FROM p JOIN d USING (k) GROUP BY k),
m AS (SELECT k, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM c GROUP BY k)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(left_over, b)) AS kept_sha256,
       n_removed IS NOT NULL AS has_repeats, n - coalesce(n_removed, 0) AS n_kept, TRY(decode(coalesce(left_over, b))) AS text
FROM d LEFT JOIN m USING (k) LEFT JOIN e USING (k)
"""
