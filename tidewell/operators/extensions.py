"""Where a deployment puts its own parts: registries by name, and adapters for plain Python functions.

Indexes (``ann.INDEXES``), providers (``rag.PROVIDERS``) and projections (``sink.PROJECTIONS``) are registries of their own
modules; here are embedders, promotion policies, graph traversals, retrievers and tools. All take and give DataFrames or
columns. A Python function comes in as an Arrow-batched column function (``embedder``) or as a table function over the rows
of each partition key (``tool_function``), so Spark still deals out the work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.columns import hash_embedding
from tidewell.operators import agent, ann, graph, rag, retrieval, sink, vector, working
from tidewell.session import settle

#: (text column, dimension) -> vector column.
EMBEDDERS: dict[str, Callable[[Column, int], Column]] = {"hash": hash_embedding}
#: Predicates over title, content, confidence and importance.
POLICIES: dict[str, Callable[[], Column]] = {"threshold": working.should_promote, "page": working.page_promotes}
#: (anchors, memories, hops, limit) -> (query_id, memory_id, rank).
GRAPHS: dict[str, Callable[[DataFrame, DataFrame, int, int], DataFrame]] = {"entities": graph.related}
#: (queries, memories, limit) -> hits.
RETRIEVERS: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {mode: (lambda q, m, n, mode=mode: retrieval.retrieve(q, m, mode, final_limit=n)) for mode in retrieval.MODES}
#: (tasks, memories) -> rows with a query_id.
TOOLS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"retrieval": agent.retrieval_tool, "graph": agent.graph_tool}

REGISTRIES: dict[str, dict] = {"embedder": EMBEDDERS, "policy": POLICIES, "graph": GRAPHS, "retriever": RETRIEVERS, "tool": TOOLS, "index": ann.INDEXES, "provider": rag.PROVIDERS, "projection": sink.PROJECTIONS}


def named(kind: str, name: str):
    """The registered part; an error that lists the names there are if it isn't."""
    registry = REGISTRIES[kind]
    if name not in registry:
        raise ValueError(f"no {kind} {name}; there are {', '.join(sorted(registry))}")
    return registry[name]


def embedder(embed: Callable[[list[str]], list[list[float]]], dim: int) -> Callable[[Column, int], Column]:
    """A column function of a Python one that embeds a batch of texts; null texts are embedded as empty ones.

    A vector that hasn't ``dim`` numbers is an error, before it gets into an index.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = embed(texts.fillna("").tolist())
            if len(vectors) != len(texts) or any(len(v) != dim for v in vectors):
                raise ValueError(f"vectors of {dim} numbers were promised")
            yield pd.Series(vectors)

    def column(text: Column, asked: int = dim) -> Column:
        if asked != dim:
            raise ValueError(f"this embedder makes vectors of {dim} numbers, not {asked}")
        return run(text)

    return column


def tool_function(spark: SparkSession, name: str, schema: str, step: Callable[[dict, object], object], end: Callable[[dict], Iterator[tuple]]) -> None:
    """Registers a table function ``name`` for SQL: ``step`` (state, row) for every row of a partition, then ``end`` (state).

    ``SELECT * FROM name(TABLE(rows) PARTITION BY query_id ORDER BY rank)``: the rows of a key come in order and one by one,
    so the tool holds its state only.
    """

    class Tool:
        def __init__(self):
            self.state: dict = {}

        def eval(self, row):
            step(self.state, row)

        def terminate(self):
            yield from end(self.state)

    spark.udtf.register(name, F.udtf(Tool, returnType=schema))


def evaluate_indexes(queries: DataFrame, memories: DataFrame, names: list[str], k: int = 10) -> DataFrame:
    """(index, query_id, memory_id, score, rank): the same semantic search under each of the registered indexes."""
    # vectors are made of whole texts, and every index reads them several times
    corpus, out = settle(vector.build_index(memories).select("memory_id", "v")), None
    asked = settle(queries.select("query_id", hash_embedding("text", 32).alias("v")))
    for name in names:
        hits = named("index", name)(corpus)(asked, k).withColumn("index", F.lit(name))
        out = hits if out is None else out.unionByName(hits)
    return out
