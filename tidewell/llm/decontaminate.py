"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the word windows of the test items. For each pattern length a *shift table* keyed by a block of two words
tells how far the search may jump, the blocks that end a pattern lead to a *suffix bucket*, and a bucket's patterns are
compared word by word. A text is therefore touched about once every ``window - 1`` words.

Defined results: null and empty texts have no words; items without words give no window; an empty benchmark hits
nothing; repeated documents are rows of their own; repeated items each count under their item_id; a null item_id is the
empty name; extra columns, whatever their names, are ignored, or kept in ``document`` as they came.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import LOWER, UPPER, map_columns, materialize, whole

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(ord(LOWER[b - 0x41]) if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first:int,last:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


def item_windows(words: list[bytes], window: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


class WuManber:
    """Shift tables and suffix buckets for patterns of one length each."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.groups = []
        by_length: dict[int, dict] = {}
        for pattern, items in patterns.items():
            by_length.setdefault(len(pattern), {})[pattern] = items
        for m, own in sorted(by_length.items()):
            block = min(2, m)
            shift: dict = {}
            buckets: dict = {}
            for pattern, items in own.items():
                for end in range(block, m + 1):
                    key = pattern[end - block : end]
                    if m - end < shift.get(key, m):
                        shift[key] = m - end
                buckets.setdefault(pattern[m - block :], {})[pattern] = items
            self.groups.append((m, block, shift, buckets))

    def find(self, words: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """(first word, last word, item ids) of every occurrence."""
        found, n = [], len(words)
        for m, block, shift, buckets in self.groups:
            furthest, last = m - block + 1, m - 1
            while last < n:
                key = tuple(words[last - block + 1 : last + 1])
                jump = shift.get(key, furthest)
                if jump:
                    last += jump
                    continue
                items = buckets[key].get(tuple(words[last - m + 1 : last + 1]))
                if items is not None:
                    found.append((last - m + 1, last, items))
                last += 1
        return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def _row(n_words: int, spans: list, items: set[str]) -> tuple:
    spans, names = _merged(spans), sorted(items)
    n_hit = sum(b - a + 1 for a, b in spans)
    return n_words, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0, [{"first": a, "last": b} for a, b in spans], names


def _columns(rows: list[tuple]) -> dict[str, list]:
    names = [f.split()[0] for f in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items")]
    return {n: list(v) for n, v in zip(names, zip(*rows))}


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = 4 << 20, keep_all: bool = False) -> DataFrame:
    """doc_id and per row the words hit, merged word spans and items found (``RESULT``).

    With ``keep_all`` a struct ``document`` of all input columns stands in place of doc_id. Only tables of at most
    ``shard_bytes`` of pattern text are broadcast (as built, with their shift keys, some 20 times that): a larger
    benchmark is dealt into shards by the hash of the window, each shard is searched in a pass of its own, and spans are
    merged by document.
    """
    spark = documents.sparkSession

    def explode(batches):
        for b in batches:
            rows = [(i, b" ".join(w), len(b" ".join(w))) for i, t in zip(b["item"], b["text"]) for w in item_windows(words_of(t), window)]
            if rows:
                yield dict(zip(("item", "pattern", "size"), map(list, zip(*rows))))

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    windows = map_columns(named, "item string, pattern binary, size int", explode)
    windows = materialize(windows.distinct(), "windows")
    total = windows.agg(F.sum(F.col("size") + 40)).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    first = "document" if keep_all else "doc_id"
    keyed = whole(documents).select("document", "document.text") if keep_all else documents.select("doc_id", "text")
    if shards > 1:
        keyed = materialize(keyed.withColumn("row", F.monotonically_increasing_id()), "texts")
    passes = []
    for k in range(shards):
        mine = windows if shards == 1 else windows.where(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == k)
        patterns: dict[tuple[bytes, ...], list[str]] = {}
        for r in mine.select("pattern", "item").collect():  # at most shard_bytes, checked above
            patterns.setdefault(tuple(bytes(r.pattern).split(b" ")), []).append(r.item)
        passes.append(_search(keyed, "row" if shards > 1 else first, spark.sparkContext.broadcast(patterns)))
    if shards == 1:
        return passes[0]
    merged = passes[0]
    for p in passes[1:]:
        merged = merged.union(p)
    return keyed.drop("text").join(_merge(merged), "row").drop("row")


def _search(keyed: DataFrame, first: str, shared) -> DataFrame:
    def search(batches):
        engine = WuManber(shared.value)
        for b in batches:
            rows = []
            for text in b["text"]:
                words = words_of(text)
                found = engine.find(words)
                rows.append(_row(len(words), [f[:2] for f in found], {i for f in found for i in f[2]}))
            yield _columns(rows)

    return map_columns(keyed.select(first, "text"), RESULT, search, keep=(first,))


def _merge(parts: DataFrame) -> DataFrame:
    """One row for each row number from its rows of all shards; at most one row a shard."""
    grouped = parts.groupBy("row", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def merge(batches):
        for b in batches:
            yield _columns([_row(n, [(s["first"], s["last"]) for s in spans], set(items)) for n, spans, items in zip(b["n_words"], b["spans"], b["items"])])

    return map_columns(grouped, RESULT, merge, keep=("row",))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans", "items")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM bi),
ms AS (SELECT DISTINCT m FROM iw),
di AS (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m),
dw AS (SELECT k, m, i, array_to_string(w[i : i + m - 1], ' ') AS s FROM di),
h AS (SELECT dw.k, dw.i, dw.m, iw.item_id FROM dw JOIN iw USING (m, s)),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + m)) AS p FROM h) GROUP BY k),
it AS (SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT k, coalesce(CAST(item_id AS VARCHAR), '') AS s FROM h) GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN it USING (k)
"""
