"""Hybrid retrieval: vector hits and graph neighbours, merged, ranked and joined to the canonical rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.columns import hash_embedding
from tidewell.operators.graph import related
from tidewell.operators.vector import build_index, search
from tidewell.schemas import MAX_HOPS
from tidewell.session import settle

MODES = ("semantic", "graph", "hybrid")


BOUNDS = {"limit": 50, "hops": MAX_HOPS, "context": 10, "related_limit": 100}


def check_request(mode: str, **values: int) -> None:
    """Bounds of a request: limit 1-50, hops 1-5, context 1-10, related_limit 1-100."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    for name, value in values.items():
        if not 1 <= value <= BOUNDS[name]:
            raise ValueError(f"{name} must be between 1 and {BOUNDS[name]}")


def request_errors(requests: DataFrame) -> DataFrame:
    """``requests`` (mode and any of the bounded values) with ``error``, null for those that can be served."""
    rules = [F.when(~F.coalesce(F.col("mode").isin(*MODES), F.lit(False)), F.lit("mode"))]
    rules += [F.when(~F.coalesce(F.col(c).between(1, most), F.lit(False)), F.lit(c)) for c, most in BOUNDS.items() if c in requests.columns]
    return requests.withColumn("error", F.coalesce(*rules))


def merge_hits(semantic: DataFrame | None, graph: DataFrame | None, final_limit: int) -> DataFrame:
    """(query_id, memory_id, score, retrieval_source, graph_path, rank) of hits on either side; a missing side has none.

    A score of exactly 0 ranks like a missing one, -1; ties: scored hits first, then by id.
    """
    left = semantic.select("query_id", "memory_id", "score", F.lit(True).alias("s")) if semantic is not None else None
    right = graph.select("query_id", "memory_id", F.lit(True).alias("g")) if graph is not None else None
    if left is None and right is None:
        raise ValueError("no hits to merge")
    if left is None:
        both = right.withColumn("score", F.lit(None).cast("double")).withColumn("s", F.lit(None).cast("boolean"))
    elif right is None:
        both = left.withColumn("g", F.lit(None).cast("boolean"))
    else:
        both = left.join(right, ["query_id", "memory_id"], "full")
    source = F.when(F.col("s") & F.col("g"), "hybrid").when(F.col("s"), "semantic").otherwise("graph")
    key = F.coalesce(F.nullif(F.col("score"), F.lit(0.0)), F.lit(-1.0))
    order = W.partitionBy("query_id").orderBy(key.desc(), F.col("score").isNull(), "memory_id")
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= final_limit)
    return ranked.select("query_id", "memory_id", "score", source.alias("retrieval_source"), F.when(F.col("g"), "graph_expansion").alias("graph_path"), "rank")


def hydrate(hits: DataFrame, memories: DataFrame) -> DataFrame:
    """Hits with their canonical rows; a hit without one keeps nulls and ``hydrated`` false."""
    record = memories.select(F.col("id").alias("memory_id"), "memory_type", "status", "title", "content", "asset_id", "facility_id", "confidence", "importance", F.lit(True).alias("_there"))
    return hits.join(record, "memory_id", "left").withColumn("hydrated", F.coalesce("_there", F.lit(False))).drop("_there")


def retrieve(
    queries: DataFrame, memories: DataFrame, mode: str = "hybrid", semantic_limit: int = 10, graph_limit: int = 50, final_limit: int = 20, hops: int = 2, index: DataFrame | None = None, missing: tuple[str, ...] = (), searcher: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Ranked hits for queries (query_id, text, anchor or null): the anchor is given or the best vector hit.

    A leg named in ``missing`` ("semantic", "graph") is out of order: the other one answers alone, and a mode that has
    no other leg finds nothing. ``searcher`` (queries, k) stands in place of the exact search over ``index``.
    """
    check_request(mode, limit=final_limit, hops=hops, related_limit=graph_limit)
    semantic = None
    if mode != "graph" and "semantic" not in missing:
        asked = queries.select("query_id", hash_embedding("text", 32).alias("v"))
        # read by the anchors, the traversal and the merge: one search for all of them, k rows a query
        semantic = settle(searcher(asked, semantic_limit) if searcher else search(asked, build_index(memories) if index is None else index, semantic_limit))
    neighbours = None
    if mode != "semantic" and "graph" not in missing:
        anchors = queries.where("anchor is not null").select("query_id", "anchor")
        if semantic is not None:
            best = semantic.where("rank = 1").select("query_id", F.col("memory_id").alias("_best"))
            anchors = queries.join(best, "query_id", "left").select("query_id", F.coalesce("anchor", "_best").alias("anchor")).where("anchor is not null")
        neighbours = related(anchors, memories, hops, graph_limit)
    if semantic is None and neighbours is None:
        neighbours = queries.select("query_id", F.col("anchor").alias("memory_id")).limit(0)
    return merge_hits(semantic, neighbours, final_limit)
