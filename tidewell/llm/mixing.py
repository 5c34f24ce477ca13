"""Mixing sources to target weights along a time-varying curriculum; DataFrame functions only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share ``share`` times all words; no
target exceeds ``cap`` times its source. The fixed point of "stop at the cap, reshare the excess by weight" is water
filling: with sources ordered by cap / weight, the level is (total - caps so far) / weight left at the first source
that it doesn't fill. Each source passes over its documents in the order of md5(doc_id) until its target is met, so the
source's n-th training word belongs to a fixed document; the boundary document is taken in part.

Curriculum: a source's weight moves linearly from ``a`` to ``b`` over training time 0..1. Its integral
a*t + (b-a)*t*t/2 (mean 1) is the share of the target due by t; inverting it at a document's word offset gives the
document's training position, and documents are range-sorted by position.

Running sums never gather a source in one task: sizes are summed by (source, 1/4096 of the hash range) before the
shuffle, a window runs over those at most 4096 sums of a source, and a second one inside each cell.

Defined results: null texts have size 0; null sources form one source, last; empty tables give empty results; repeated
rows are documents of their own (rows of one id and size go by the md5 of their texts, so reruns agree); a source without words has target 0; extra columns stay in ``document`` as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import materialize

#: weight, curriculum weight at the start and at the end of training, by the source's rank modulo 3
SCHEDULE = ((5.0, 1.5, 0.5), (2.0, 1.0, 1.0), (1.0, 0.5, 1.5))


def n_words(text: Column) -> Column:
    """Maximal runs of characters other than space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, share: float = 1.5, cap: int = 2) -> DataFrame:
    """(no_source, src) -> source_size, weight, start, finish, target; one row a source.

    The windows without partition run over one row for each source: names of sources, not documents.
    """
    by_source = sized.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"))
    rank = F.pmod(F.row_number().over(W.orderBy("no_source", "src")) - 1, F.lit(len(SCHEDULE)))
    pick = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in SCHEDULE]), rank.cast("int") + 1)
    ranked = by_source.select("*", pick(0).alias("weight"), pick(1).alias("start"), pick(2).alias("finish"))
    ranked = ranked.withColumn("full", F.col("source_size") * F.lit(cap) / F.col("weight"))
    order = W.orderBy("full", "no_source", "src")
    filled = F.coalesce(F.sum(F.col("source_size") * cap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    level = (F.sum("source_size").over(W.partitionBy()) * F.lit(share) - filled) / left
    levels = ranked.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "no_source", "src", "level"))).over(W.partitionBy())
    target = F.least(F.coalesce(first["level"], F.lit(float("inf"))) * F.col("weight"), (F.col("source_size") * F.lit(cap)).cast("double"))
    return levels.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target)).drop("full", "level")


def _position(offset: Column) -> Column:
    """Training time at which the source's cumulative demand reaches ``offset`` words."""
    u, a, b = offset / F.col("target"), F.col("start"), F.col("finish")
    return F.when(a == b, u).otherwise((F.sqrt(F.greatest(a * a + 2 * (b - a) * u, F.lit(0.0))) - a) / (b - a) + F.lit(0.0))


def curriculum_mix(documents: DataFrame, share: float = 1.5, cap: int = 2, keep: list[str] | None = None) -> DataFrame:
    """``document`` (a struct of the columns ``keep``, or of all), size, source_size, target, taken and ``passes`` by row.

    ``passes``: (position, words) of each time that the mix takes the document, in order of training position.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    document = F.struct("*") if keep is None else F.struct(*keep)
    sized = documents.select(
        document.alias("document"), n_words(F.col("text")).alias("size"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"), F.col("doc_id").alias("id"), key.alias("key"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"),
    ).withColumn("cell", F.substring("key", 1, 3))
    # at most 4096 rows a source; written once, so that texts are read twice in all: for the sums and for the result
    cells = materialize(sized.groupBy("no_source", "src", "cell").agg(F.sum("size").alias("words")), "cells")
    targets = source_targets(cells.withColumnRenamed("words", "size"), share, cap)
    running = W.partitionBy("no_source", "src").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("no_source", "src", "cell", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("before")).join(targets, ["no_source", "src"])
    inner = W.partitionBy("no_source", "src", "cell").orderBy("key", "id", "size", "content").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.join(cells, ["no_source", "src", "cell"]).withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    due, size, whole_size = F.floor("target").cast("long"), F.col("size"), F.col("source_size")
    full = F.when(whole_size > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    rest = F.greatest(F.lit(0), F.least(size, due - full * whole_size - F.col("before")))
    taken = lambda i: F.struct(_position(i * whole_size + F.col("before")).alias("position"), F.when(i < full, size).otherwise(rest).cast("long").alias("words"))
    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(cap)), lambda i: F.when(((i < full) & (size > 0)) | ((i == full) & (rest > 0)), taken(i))), lambda x: x.isNotNull())
    return placed.select("document", "size", "source_size", "target", (full * size + rest).cast("long").alias("taken"), passes.alias("passes"))


def training_order(mixed: DataFrame) -> DataFrame:
    """The training sequence: a row for each time that the mix takes a document, range-sorted by training ``position``.

    The input's columns under their names, then size, source_size, target, taken, words (what this pass takes of the
    document) and position; of these a name that the input has too is written ``mix_...``.
    """
    taken = mixed.select("*", F.explode("passes").alias("pass"))
    used = mixed.schema["document"].dataType.names

    def named(column, name: str):
        while name in used:
            name = "mix_" + name
        return column.alias(name)

    # one exchange before the explosion and one after it: no text is shuffled to join or to count anything
    rows = taken.orderBy("pass.position", "document.doc_id", "size")
    return rows.select("document.*", *[named(F.col(c), c) for c in ("size", "source_size", "target", "taken")], named(F.col("pass.words"), "words"), named(F.col("pass.position"), "position"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    position = F.try_element_at("passes", F.lit(1))["position"]
    mixed = curriculum_mix(docs, keep=["doc_id"]).select("document.doc_id", "size", "source_size", "target", "taken", position.alias("position"))
    return mixed.orderBy("position", "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS ns, coalesce(source, '') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key, md5(coalesce(text, '')) AS content FROM documents),
s AS (SELECT ns, src, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY ns, src) - 1) % 3 AS r FROM d GROUP BY ns, src),
w AS (SELECT *, CASE r WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
f AS (SELECT *, source_size * 2 / weight AS full_at FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2) OVER (ORDER BY full_at, ns, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY full_at, ns, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
c AS (SELECT level FROM l WHERE level <= full_at ORDER BY full_at, ns, src LIMIT 1),
t AS (SELECT ns, src, r, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least(weight * coalesce((SELECT level FROM c), 'infinity'::DOUBLE), CAST(source_size * 2 AS DOUBLE)) END AS target FROM l),
p AS (SELECT d.*, t.r, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.ns, d.src ORDER BY key, doc_id, size, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.ns = t.ns AND d.src = t.src),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS passes FROM p)
, z AS (SELECT *, CAST(passes * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - passes * source_size - before)) AS BIGINT) AS taken,
         before / target AS u, CASE r WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS a, CASE r WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS b FROM q)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken,
       CASE WHEN taken = 0 THEN NULL WHEN a = b THEN u ELSE (sqrt(greatest(a * a + 2 * (b - a) * u, 0)) - a) / (b - a) + 0 END AS position FROM z
"""
