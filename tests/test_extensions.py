"""Parts by name, Python functions as parts, and the relational source."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions.columns import hash_embedding
from tidewell.operators import extensions
from tidewell.sources import relational
from tidewell.streaming.jobs import run_available


def test_parts_by_name():
    for kind in extensions.REGISTRIES:
        assert extensions.REGISTRIES[kind]
        with pytest.raises(ValueError):
            extensions.named(kind, "nowhere")
    assert extensions.named("embedder", "hash") is hash_embedding


def test_embedding_functions_keep_their_dimension(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    embed = extensions.embedder(lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    assert [r.v for r in rows.select("id", embed(F.col("text"), 2).alias("v")).orderBy("id").collect()] == [[3.0, 1.0], [0.0, 1.0]]
    with pytest.raises(ValueError):
        embed(F.col("text"), 3)
    with pytest.raises(Exception, match="promised"):
        rows.select(extensions.embedder(lambda texts: [[1.0]] * len(texts), 2)(F.col("text"), 2)).collect()


def test_tools_see_each_key_in_order(spark):
    rows = spark.createDataFrame([(q, r, f"m{q}{r}") for q in range(5) for r in (3, 1, 2)], "query_id long, rank int, memory_id string")

    def step(state, row):
        state["id"] = row["query_id"]
        state["text"] = state.get("text", "") + row["memory_id"]

    extensions.tool_function(spark, "joined_up", "query_id long, text string", step, lambda state: iter([(state["id"], state["text"])] if state else []))
    got = spark.sql("SELECT * FROM joined_up(TABLE(SELECT * FROM {rows}) PARTITION BY query_id ORDER BY rank)", rows=rows).collect()
    assert {r.query_id: r.text for r in got} == {q: f"m{q}1m{q}2m{q}3" for q in range(5)}


SCHEMA = "k long, name string, `odd \"name` double"


def written(spark, path, rows):
    relational.write_table(spark.createDataFrame(rows, SCHEMA), path, "t", "k")


def test_ranges_cover_all_keys():
    for low, high, parts in ((0, 0, 4), (5, 6, 8), (-10, 99, 3)):
        found = relational.ranges(low, high, parts)
        assert found[0].low is None and found[-1].high is None and all(a.high == b.low for a, b in zip(found, found[1:]))


def test_relational_reads_and_pushes_filters(spark, tmp_path):
    path = str(tmp_path / "a file?.db")
    rows = [(i, f"n{i % 7}" if i % 5 else None, i / 2) for i in range(100)] + [(None, "none", 0.5), (10**9, "far", None)]
    written(spark, path, rows)
    d = relational.read_table(spark, path, "t", "k", 5)
    assert sorted(d.collect(), key=str) == sorted([tuple(r) for r in rows], key=str) and d.rdd.getNumPartitions() == 5
    for where in ("k > 10 and k <= 40", "name = 'n3'", "name is null", "k is null", "name like 'n1%' or k = 3"):
        assert d.where(where).count() == spark.createDataFrame(rows, SCHEMA).where(where).count(), where
    some = relational.read_table(spark, path, "t", "k", 3, [("k", ">=", 10), ("name", "<>", "n3"), ('odd "name', "<", 20.5)])
    assert sorted(r.k for r in some.collect()) == [i for i, n, x in rows if i and i >= 10 and n and n != "n3" and x is not None and x < 20.5]
    with pytest.raises(Exception, match="filters are"):
        relational.read_table(spark, path, "t", "k", 3, [("k", "; DROP", 10)]).count()
    with pytest.raises(Exception, match="no table"):
        relational.read_table(spark, path, "nowhere", "k")


def test_relational_streams_go_on_at_their_offset(spark, tmp_path):
    path, out = str(tmp_path / "s.db"), f"file://{tmp_path}/out"
    relational.register(spark)
    for part in (range(10), range(10, 25), range(0)):
        if part:
            written(spark, path, [(i, "x", 0.0) for i in part])
        run_available(spark.readStream.format(relational.NAME).options(path=path, table="t", key="k", partitions=3).load(), lambda b: b, out)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == list(range(25))
