"""Question answering and the four-step workflow, over whole tables of tasks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.graph import related
from tidewell.operators.rag import evidence, prompts, template_answer, verify
from tidewell.operators.retrieval import check_request, hydrate, retrieve
from tidewell.session import settle


def answer(queries: DataFrame, memories: DataFrame, context: int = 5, mode: str = "hybrid") -> DataFrame:
    """(query_id, prompts, evidence ids, answer, tokens) for queries (query_id, text, anchor)."""
    check_request(mode, context=context)
    hits = hydrate(retrieve(queries, memories, mode, final_limit=context), memories)
    return answer_from(queries, hits, context)


def answer_from(queries: DataFrame, hits: DataFrame, context: int = 5) -> DataFrame:
    """As ``answer``, from hits that were retrieved and hydrated before."""
    return template_answer(prompts(queries, evidence(hits, context)))


def retrieval_tool(queries: DataFrame, memories: DataFrame, mode: str = "hybrid", limit: int = 5) -> DataFrame:
    hits = hydrate(retrieve(queries, memories, mode, final_limit=limit), memories)
    return hits.where("hydrated").select("query_id", "memory_id", "title", F.substring("content", 1, 300).alias("content"), "retrieval_source", "score", "rank")


def graph_tool(anchors: DataFrame, memories: DataFrame, max_hops: int = 2, limit: int = 20) -> DataFrame:
    return related(anchors, memories, max_hops, limit)


def run_workflow(tasks: DataFrame, memories: DataFrame) -> DataFrame:
    """One trace a task: steps (retrieve, graph, answer, critic) with counts, evidence ids, answer and verdict."""
    hits = settle(hydrate(retrieve(tasks, memories, "hybrid", final_limit=10), memories).where("hydrated"))
    found = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.min_by("memory_id", "rank").alias("anchor"), F.sort_array(F.collect_list(F.struct("rank", "memory_id")))["memory_id"].alias("evidence_ids"))  # 10 at most
    near = graph_tool(found.select("query_id", "anchor"), memories).groupBy("query_id").agg(F.count("*").alias("n_related"))
    told = verify(answer_from(tasks, hits).drop("evidence_ids"))  # its five hits are the first of the ten
    joined = tasks.select("query_id").join(found, "query_id", "left").join(near, "query_id", "left").join(told, "query_id", "left")
    step = lambda kind, n: F.struct(F.lit(kind).alias("step"), F.coalesce(n, F.lit(0)).cast("long").alias("n"))
    steps = F.array(step("retrieval", F.col("n_hits")), step("graph_traversal", F.col("n_related")), step("generation", F.col("completion_tokens")), step("critic", F.col("n_cited")))
    return joined.select("query_id", steps.alias("steps"), F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), "answer", "is_supported", "confidence")


def recent(traces: DataFrame, n: int = 5) -> DataFrame:
    """The newest ``n`` traces (created_at, then query_id)."""
    return traces.orderBy(F.desc("created_at"), F.desc("query_id")).limit(n)


def store_traces(traces: DataFrame, path: str) -> DataFrame:
    """Appends traces to the table at ``path``, a folder a day of ``created_at``; the table."""
    rows = traces.withColumn("day", F.to_date("created_at"))
    rows.write.mode("append").partitionBy("day").parquet(path)
    return traces.sparkSession.read.schema(rows.schema).parquet(path)


def recent_stored(stored: DataFrame, n: int = 5) -> DataFrame:
    """The newest ``n`` traces of a stored table; whole rows are read from the folders of their days alone."""
    days = {r.day for r in recent(stored.select("query_id", "created_at", "day"), n).collect()}  # n rows at most
    return recent(stored.where(F.col("day").isin(*days)), n).drop("day")


def append_step(traces: DataFrame, kind: str, n: int) -> DataFrame:
    return traces.withColumn("steps", F.array_append("steps", F.struct(F.lit(kind).alias("step"), F.lit(n).cast("long").alias("n"))))
