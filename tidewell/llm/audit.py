"""How five document filters interact: what each removes, repeats and costs in every order of application.

Everything follows from counts of *failure masks* (one bit a filter) by part. Four bits depend on the text alone. The
fifth, "an equal text has a smaller doc_id", is found with RDDs routed by fingerprint: a task keeps collision chains, that
is for each xxhash64 value the different full texts with that value and for each text its smallest id. Whoever isn't the
smallest of its task is known to fail there and then, and only the smallest of each text and task travels, with its text,
to the partition of its fingerprint; there are as many partitions as keep these texts to ``SHARE`` bytes each. There records come sorted by fingerprint, so that one chain is in memory at a time, and
the same step settles the rest. A text that a third of all rows share thus arrives once a task (or ``HELD`` bytes of
different texts). Labels are joined to the settled (id, mask) rows, without texts, and ``combineByKey`` merges vectors of
mask counts by part. Tables of 32 masks by 600 (order, step) pairs turn a part's vector into its rows.

Defined results: null texts are empty ones; a null id never is smaller than another, and a row without id has no smaller
one; equal rows with the smallest id all stay; a null source and the empty one are one part; of several labels of an id
each counts as 1 if any is 1; rows without label count as neither; an empty table has no part; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
MASKS, HELD, LONG, SHARE = 1 << len(FILTERS), 32 << 20, 1 << 20, 64 << 20
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_UPPER, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


def text_failures(text: str, data: bytes, least_words: int = 200, distinct: int = 50, upper: int = 2) -> int:
    """Mask of A to D; ``distinct`` and ``upper`` in percent. ``data`` is ``text`` in UTF-8."""
    if len(data) <= LONG:
        words = data.split()
        n, different = len(words), len(set(words))
    else:  # a long text's words are never in memory at once, only the different ones
        n, seen = 0, set()
        for w in _WORD.finditer(data):
            n += 1
            seen.add(w[0])
        different = len(seen)
    n_upper = len(data) - len(data.translate(None, _UPPER))
    return (n < least_words) | (100 * different < distinct * n) << 1 | (100 * n_upper > upper * len(text)) << 2 | (len(data.translate(None, _MARKS)) < len(data)) << 3


class Chain:
    """Different texts of one fingerprint, each with its smallest id and the (part, mask) counts of the rows that have it."""

    def __init__(self):
        self.links: list[list] = []

    def add(self, data: bytes, doc_id: int, counts: dict) -> tuple[bool, tuple | None]:
        """Whether the text is new to the chain, and the (id, counts) that this addition shows not to be the smallest."""
        for link in self.links:
            if link[0] == data:
                if doc_id > link[1]:
                    return False, (doc_id, counts)
                if doc_id < link[1]:
                    beaten = (link[1], link[2])
                    link[1], link[2] = doc_id, counts
                    return False, beaten
                for k, n in counts.items():
                    link[2][k] = link[2].get(k, 0) + n
                return False, None
        self.links.append([data, doc_id, counts])
        return True, None


def _rows(doc_id: int | None, counts: dict, bit: int) -> Iterator[tuple]:
    return ((doc_id, part, mask | bit, n) for (part, mask), n in counts.items())


def screen(index: int, rows: Iterable) -> Iterator[tuple]:
    """Of each (doc_id, source, text): under a key below 0 rows that are settled, else a task's smallest of a text."""
    chains: dict[int, Chain] = {}
    held, settled = 0, index
    for doc_id, source, text in rows:
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        own = {(source or "", text_failures(text, data)): 1}
        beaten, bit = (doc_id, own), 0
        if doc_id is not None:
            fresh, beaten = chains.setdefault(xxhash.xxh64_intdigest(data), Chain()).add(data, doc_id, own)
            held, bit = held + (len(data) + 200 if fresh else 0), DUPLICATE
        if beaten:
            for row in _rows(*beaten, bit):
                settled += 1
                yield -settled, row
        if held >= HELD:
            yield from ((key, tuple(link)) for key, c in chains.items() for link in c.links)
            chains, held = {}, 0
    yield from ((key, tuple(link)) for key, c in chains.items() for link in c.links)


def settle(records: Iterable[tuple]) -> Iterator[tuple]:
    """(doc_id, part, mask, n) from records sorted by key; one chain is held at a time."""
    at, chain = -1, Chain()
    for key, record in records:
        if key < 0:
            yield record
            continue
        if key != at:
            for _, doc_id, counts in chain.links:
                yield from _rows(doc_id, counts, 0)
            at, chain = key, Chain()
        _, beaten = chain.add(*record)
        if beaten:
            yield from _rows(*beaten, DUPLICATE)
    for _, doc_id, counts in chain.links:
        yield from _rows(doc_id, counts, 0)


def failure_masks(documents: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): rows that an id has with these failures."""
    rows = documents.select("doc_id", F.col("source").cast("string"), "text").rdd
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = max(math.ceil(size / SHARE), int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    routed = rows.mapPartitionsWithIndex(screen).repartitionAndSortWithinPartitions(partitions, lambda key: key % partitions)
    return documents.sparkSession.createDataFrame(routed.mapPartitions(settle), "doc_id long, part string, mask int, n long")


def _vector(value: tuple) -> np.ndarray:
    return _counted(np.zeros((3, MASKS), np.int64), value)


def _counted(vector: np.ndarray, value: tuple) -> np.ndarray:
    mask, n, good, toxic = value
    vector[:, mask] += (n, n * good, n * toxic)
    return vector


def mask_vectors(masks: DataFrame, labels: DataFrame):
    """RDD of (part, vector): counts by mask of all rows, those of quality 1 and toxic ones."""
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = masks.where("doc_id is not null").join(known, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rows = joined.union(masks.where("doc_id is null").select("part", "mask", "n", F.lit(0), F.lit(0)))
    return rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(_vector, _counted, lambda a, b: a + b)


def step_tables() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) pairs and for each count a 0/1 table [pair, mask]; ``shapley`` sums removals over all orders."""
    pairs = [(o, s) for o in ORDERS for s in range(1, len(FILTERS) + 1)]
    bit = np.array([1 << FILTERS.index(o[s - 1]) for o, s in pairs])[:, None]
    before = np.array([sum(1 << FILTERS.index(f) for f in o[: s - 1]) for o, s in pairs])[:, None]
    mask = np.arange(MASKS)[None, :]
    fails, gone = (mask & bit) > 0, (mask & before) > 0
    removed = (fails & ~gone).astype(np.int64)
    by_filter = {b: removed[bit[:, 0] == b].sum(axis=0) for b in np.unique(bit).tolist()}
    tables = {
        "kept": (mask & (before | bit)) == 0, "removed": removed, "redundant": fails & gone, "unique_fails": (mask == bit) & fails,
        "shapley": np.stack([by_filter[b] for b in bit[:, 0].tolist()]),
    }
    return pairs, {name: t.astype(np.int64) for name, t in tables.items()}


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interactions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step; see ``RESULT``."""

    def rows(parts):
        pairs, tables = step_tables()
        for part, (every, good, toxic) in parts:
            counts = [tables["kept"] @ every, tables["removed"] @ every, tables["redundant"] @ every, tables["unique_fails"] @ every, tables["removed"] @ good, tables["removed"] @ toxic, tables["shapley"] @ every]
            for (order, step), values in zip(pairs, np.stack(counts, axis=1).tolist()):
                yield part, order, step, *values

    vectors = mask_vectors(failure_masks(documents), labels)
    return documents.sparkSession.createDataFrame(vectors.mapPartitions(rows), RESULT)


def op13_audit(spark, sf_dir: str) -> DataFrame:
    return interactions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(words) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER)
  + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INTEGER) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
  + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INTEGER) AS mask FROM t LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
k AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM k a, k b, k c, k d, k e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum([0] || bits[1 : step - 1]) AS gone FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & CAST(bit | gone AS BIGINT) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & CAST(gone AS BIGINT) = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit > 0 AND mask & CAST(gone AS BIGINT) > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit > 0 AND mask & CAST(gone AS BIGINT) = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & CAST(gone AS BIGINT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
