"""Bounded working memory per session, and promotion of candidates to long-term memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.columns import is_blank, strip

CAPACITY = 50


def bounded(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The newest ``capacity`` items of every session, with their place (1: oldest kept)."""
    newest = W.partitionBy("session_id").orderBy(F.desc("seq"))
    kept = items.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= capacity)
    return kept.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy("seq"))).drop("back")


def observation(items: DataFrame, source: str = "", confidence: float = 0.5, importance: float = 0.5) -> DataFrame:
    return items.select("session_id", "seq", F.lit("observation").alias("item_type"), "content", F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), F.lit(importance).alias("importance"))


def evidence_item(items: DataFrame, source: str = "retrieval") -> DataFrame:
    return items.select("session_id", "seq", F.lit("retrieved_evidence").alias("item_type"), "content", F.lit(source).alias("source"), "evidence_memory_ids")


def of_type(items: DataFrame, item_type: str) -> DataFrame:
    return items.where(F.col("item_type") == item_type)


def cleared(items: DataFrame, session_id: object) -> DataFrame:
    return items.where(F.col("session_id") != F.lit(session_id))


def sizes(items: DataFrame) -> DataFrame:
    return items.groupBy("session_id").agg(F.count("*").alias("n"))


def should_promote(min_confidence: float = 0.6, min_importance: float = 0.4) -> Column:
    return ~is_blank("title") & ~is_blank("content") & F.coalesce((F.col("confidence") >= min_confidence) & (F.col("importance") >= min_importance), F.lit(False))


def page_promotes(min_confidence: float = 0.6, min_importance: float = 0.4) -> Column:
    """The review page's variant: no title, but more than ten characters of content."""
    return F.coalesce((F.col("confidence") >= min_confidence) & (F.col("importance") >= min_importance) & (F.length(strip("content")) > 10), F.lit(False))


def promoted(candidates: DataFrame, **thresholds: float) -> DataFrame:
    """Create rows of the candidates that pass; reason and evidence ids are merged into the metadata, replacing equal keys."""
    extra = F.map_from_arrays(F.array(F.lit("promotion_reason"), F.lit("evidence_memory_ids")), F.array(F.col("promotion_reason"), F.array_join("evidence_memory_ids", ",")))
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("promotion_reason", "evidence_memory_ids"))
    return candidates.where(should_promote(**thresholds)).withColumn("metadata", F.map_concat(kept, extra)).drop("promotion_reason", "evidence_memory_ids").withColumn("status", F.lit("active"))
