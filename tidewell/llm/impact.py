"""Ranked lexical search over impact-ordered postings, score at a time.

The index holds every row's terms and their counts, written once. A task builds the impact order of its rows in shards of
about ``SHARD`` postings: a term's postings, grouped by their exact integer impact, the highest first. Queries then take
segments from all their terms in descending order of what a segment adds to the score. After each level every term bounds
what it can still add by its next segment; a query stops only when these bounds prove that the best ``k`` are among few
rows, whose scores are then completed from the rows' own terms. A task carries each query's ``k`` best from shard to shard,
so later shards start with a threshold, and only these rows are shuffled. Postings never are.

All arithmetic after a term's weight is on integers, so that scores and ties are exact. Queries go in blocks of about
``BLOCK`` bytes of text, each with one pass over the index (not over the texts) for document frequencies and one for the
search; what goes to the tasks is such a block.

Defined results: null and empty texts have no terms and are never found; queries without terms find nothing; repeated
documents are rows of their own, repeated queries queries of their own; equal scores go by ascending doc_id, a null one
last; a query with fewer than ``k`` rows above 0 returns those; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import map_columns, materialize, pieces
from tidewell.llm.decontaminate import words_of

SHARD, BLOCK, STEP, FEW = 1 << 19, 4 << 20, 0.7, 8
#: Fixed values of the ranking: scale of weights and impacts, saturation, and the share of length in it (percent).
SCALE, TOP, ONE, SATURATION, LENGTH = 1000, 1_000_000_000, 1000, 12, 25


def term_counts(text: str | None) -> Counter:
    counts: Counter = Counter()
    for piece in pieces(text or ""):
        counts.update(words_of(piece))
    return counts


def index_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row; ``n`` counts terms with repeats."""

    def run(batches):
        for b in batches:
            counts = [term_counts(t) for t in b["text"]]
            ends = pa.array(np.cumsum([0, *map(len, counts)], dtype=np.int32))
            terms = pa.array([w for c in counts for w in c], pa.binary()).cast(pa.string())
            tfs = pa.array(np.fromiter((v for c in counts for v in c.values()), np.int64), pa.int64())
            yield {"n": [sum(c.values()) for c in counts], "terms": pa.ListArray.from_arrays(ends, terms), "tfs": pa.ListArray.from_arrays(ends, tfs)}

    return map_columns(documents.select("doc_id", "text"), "n long, terms array<string>, tfs array<long>", run, keep=("doc_id",))


def _coded(batch: dict, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, position in the flat list) of the terms in ``vocabulary``."""
    found = pc.index_in(batch["terms"].flatten(), value_set=vocabulary)
    at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    lengths = pc.fill_null(pc.list_value_length(batch["terms"]), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lengths)), lengths)[at], found.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64), at


def document_frequencies(index: DataFrame, vocabulary: pa.Array) -> np.ndarray:
    """Rows that hold each term of a block's vocabulary; a task sends at most one row for each term."""

    def run(batches):
        df = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            df += np.bincount(_coded(b, vocabulary)[1], minlength=len(df))
        seen = np.flatnonzero(df)
        yield {"term": seen.astype(np.int32), "df": df[seen]}

    rows = map_columns(index.select("terms"), "term int, df long", run, arrow=("terms",))
    table = rows.groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(vocabulary), np.int64)
    out[table["term"].to_numpy()] = table["df"].to_numpy()
    return out


def term_weights(df: np.ndarray, n_documents: int) -> np.ndarray:
    return np.array([math.floor(SCALE * math.log((2 * n_documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def length_factors(n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    distinct, back = np.unique(n, return_inverse=True)
    return np.array([100 - LENGTH + LENGTH * x * n_documents // n_terms for x in distinct.tolist()], np.int64)[back]  # Python's integers don't overflow


class Best:
    """A query's ``k`` best rows so far: score descending, then doc_id, null last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """What a row must reach to get in, by its id if it only ties."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = np.append(self.scores, scores), np.append(self.ids, ids), np.append(self.null, null)
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


class Shard:
    """Postings of some rows in impact order, and the same by row. ``row`` comes ascending."""

    def __init__(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, ids: np.ndarray, null: np.ndarray, n_terms: int):
        self.ids, self.null = ids, null
        self.own_term, self.own_impact, self.bounds = term, impact, np.searchsorted(row, np.arange(len(ids) + 1))
        order = np.lexsort((row, -impact, term))
        self.row, self.impact = row[order], impact[order]
        self.falling = -self.impact
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Adds what the shard has for a query of ``terms``, each with its weight above 0."""
        first, stop = self.starts[terms], self.starts[terms + 1]
        held = first < stop
        at, stop, weights_held = first[held].tolist(), stop[held].tolist(), weights[held].tolist()
        if not at:
            return
        sums, few = np.zeros(len(self.ids), np.int64), FEW * best.k
        following = [w * int(self.impact[a]) for w, a in zip(weights_held, at)]
        while True:
            level = int(max(following) * STEP)
            for i, w in enumerate(weights_held):
                if following[i] > level:
                    end = at[i] + int(np.searchsorted(self.falling[at[i] : stop[i]], -(level // w), side="left"))  # all segments that add more than the level
                    sums[self.row[at[i] : end]] += w * self.impact[at[i] : end]
                    at[i] = end
                    following[i] = w * int(self.impact[end]) if end < stop[i] else 0
            rest = sum(following)
            least = best.least
            if len(sums) > best.k:
                least = max(least, int(np.partition(sums, len(sums) - best.k)[len(sums) - best.k]))
            candidates = np.flatnonzero(sums + rest >= least)
            if not rest or len(candidates) <= few:
                break
        if rest and len(candidates):  # complete the scores of the rows that are left
            weight = dict(zip(terms.tolist(), weights.tolist()))
            totals = [sum(weight.get(t, 0) * i for t, i in zip(self.own_term[a:z].tolist(), self.own_impact[a:z].tolist())) for a, z in zip(self.bounds[candidates].tolist(), self.bounds[candidates + 1].tolist())]
            totals = np.array(totals, np.int64)
        else:
            totals = sums[candidates]
        good = totals >= least
        best.add(totals[good], self.ids[candidates[good]], self.null[candidates[good]])


def _block_search(index: DataFrame, queries: list[tuple], n_documents: int, n_terms: int, k: int) -> DataFrame:
    """(row, item_id, doc_id, score): each task's ``k`` best of each query; ``queries``: (row, item_id, text)."""
    asked = [(row, item, counts) for row, item, text in queries if (counts := term_counts(text))]
    vocabulary = pa.array(sorted({t for *_, c in asked for t in c}), pa.binary()).cast(pa.string())
    place = {t: i for i, t in enumerate(vocabulary.cast(pa.binary()).to_pylist())}
    weight = term_weights(document_frequencies(index, vocabulary), n_documents)
    coded = []
    for row, item, counts in asked:
        terms = np.fromiter((place[t] for t in counts), np.int64, len(counts))
        own = weight[terms] * np.fromiter(counts.values(), np.int64, len(counts))
        coded.append((row, item, terms[own > 0], own[own > 0]))
    shared = index.sparkSession.sparkContext.broadcast((coded, vocabulary))

    def run(batches):
        coded, vocabulary = shared.value
        best = [Best(k) for _ in coded]
        held: list[tuple] = []

        def settle():
            sizes = np.cumsum([0] + [len(h[3]) for h in held])
            row, term, impact, ids, null = (np.concatenate([h[i] + sizes[j] if i == 0 else h[i] for j, h in enumerate(held)]) for i in range(5))
            shard = Shard(row, term, impact, ids, null, len(vocabulary))
            for (_, _, terms, own), b in zip(coded, best):
                shard.search(terms, own, b)
            held.clear()

        for b in batches:
            row, term, at = _coded(b, vocabulary)
            tf = b["tfs"].flatten().to_numpy()[at]
            m = length_factors(b["n"].to_numpy(), n_documents, n_terms)[row]
            null = b["doc_id"].is_null().to_numpy(zero_copy_only=False)
            held.append((row, term, TOP * tf // (ONE * tf + SATURATION * m), pc.fill_null(b["doc_id"], 0).to_numpy(), null))
            if sum(len(h[0]) for h in held) >= SHARD:
                settle()
        if held:
            settle()
        for (row, item, *_), b in zip(coded, best):
            if len(b.ids):
                n = len(b.ids)
                yield {"row": [row] * n, "item_id": [item] * n, "doc_id": pa.array(b.ids, mask=b.null), "score": b.scores}

    return map_columns(index, "row long, item_id long, doc_id long, score long", run, arrow=("doc_id", "n", "terms", "tfs"))


def ranked_search(index: DataFrame, queries: DataFrame, k: int = 20, block_bytes: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``queries`` (item_id, text) its ``k`` best rows of ``index``."""
    totals = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = materialize(queries.select(F.col("item_id").cast("long").alias("item_id"), "text", F.monotonically_increasing_id().alias("row")), "queries")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0]
    blocks, found = math.ceil(size / block_bytes), None
    for b in range(blocks if totals[0] else 0):
        mine = [(r.row, r.item_id, r.text) for r in asked.where(F.pmod("row", F.lit(blocks)) == b).toLocalIterator()]  # about block_bytes
        hits = _block_search(index, mine, totals[0], totals[1], k)
        found = hits if found is None else found.union(hits)
    if found is None:
        return index.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_search(spark, sf_dir: str) -> DataFrame:
    index = materialize(index_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")), "terms")
    return ranked_search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS terms FROM documents),
a AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
t AS MATERIALIZED (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM d) GROUP BY k, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), a),
m AS (SELECT k, doc_id, 100 - 25 + ((25 * len(terms) * n_docs) // n_terms) AS m FROM d, a),
q AS (SELECT i, item_id, term, count(*) AS qf FROM (SELECT i, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark)) GROUP BY i, item_id, term),
s AS (SELECT i, item_id, k, CAST(sum(qf * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (k) GROUP BY i, item_id, k)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s JOIN d USING (k) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 20
"""
