"""Literal expectations and invariants of the operators."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.functions import columns as C
from tidewell.operators import agent, evaluation, graph, lifecycle, listing, outbox, rag, retrieval, vector, working
from tidewell.sources import store


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_hash_embedding(spark):
    for text in ("word " * 10000, "", "short"):
        v = one(spark, C.hash_embedding(F.lit(text)))
        assert len(v) == 128 and all(-1 <= x < 1 for x in v) and v[:32] == v[32:64]
        assert v == one(spark, C.hash_embedding(F.lit(text)))


def test_keys(spark):
    assert one(spark, C.entity_key(F.lit(None).cast("string"), "asset", F.lit("7"))) == "global:asset:7"
    assert one(spark, C.source_key(F.lit("t"), F.lit("sensor"), F.lit(""))) == "t:source:sensor"
    assert one(spark, C.source_key(F.lit("t"), F.lit("sensor"), F.lit("9"))) == "t:source:sensor:9"


def test_metrics(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    assert one(spark, evaluation.recall_at_k(a("a", "b"), a("a", "c"))) == 0.5
    assert one(spark, evaluation.recall_at_k(a("a"), a())) == 1.0
    assert one(spark, evaluation.recall_at_k(a(*"abcdef"), a("f"))) == 0.0
    assert one(spark, evaluation.reciprocal_rank(a("x", "a"), a("a"))) == 0.5
    assert one(spark, evaluation.reciprocal_rank(a("x"), a("a"))) == 0.0
    assert one(spark, evaluation.citation_accuracy(F.lit("[Memory 1] [Memory 9]"), F.lit(2))) == 0.5
    assert one(spark, evaluation.groundedness(F.lit("Short. This sentence is long enough to count [Memory 1]"))) == 1.0


def test_empty_run_is_zero(spark):
    rows = spark.createDataFrame([], "case_id int, mode string, recall double, mrr double, groundedness double, citation_accuracy double, success boolean")
    r = evaluation.summary(rows).first()
    assert r.total_cases == 0 and r.success_rate == 0 and r.mean_recall == 0


def test_critic(spark):
    rows = spark.createDataFrame([("Fine [Memory 1] and [Memory 2].", 2), ("Bad [Memory 99].", 2), ("No citation here.", 2), ("[Memory 1]", 0)], "answer string, n_evidence int")
    got = [(r.is_supported, round(r.confidence, 2)) for r in rag.verify(rows).collect()]
    assert got == [(True, 1.0), (False, 0.7), (False, 0.8), (False, 0.0)]


def test_provider_faults_are_rows(spark):
    asked = spark.createDataFrame([(1, "s", "u"), (2, "s", "boom")], "query_id int, system_prompt string, user_prompt string")

    def provider(system, user):
        if user == "boom":
            raise ValueError("down")
        return system + user

    got = {r.query_id: (r.answer, r.error) for r in rag.generate(asked, provider, "m").collect()}
    assert got == {1: ("su", None), 2: (None, "down")}


def memory(i, **more):
    row = {"id": f"m{i}", "status": "active", "tenant_id": "t", "asset_id": None, "component_id": None, "incident_id": None, "facility_id": None, "team_id": None, "source_type": "sensor", "source_id": f"s{i}", "supersedes_memory_id": None}
    return row | more


SCHEMA = ", ".join(f"{k} string" for k in memory(0))


def test_traversal(spark):
    rows = [memory(0, incident_id="i"), memory(1, incident_id="i", facility_id="f"), memory(2, facility_id="f"), memory(3), memory(4, supersedes_memory_id="m3"), memory(5, supersedes_memory_id="m4", asset_id="")]
    m = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    found = lambda a, hops, limit=50: [r.memory_id for r in graph.related(spark.createDataFrame([(1, a)], "query_id int, anchor string"), m, hops, limit).orderBy("rank").collect()]
    assert found("m0", 1) == ["m1"] and found("m0", 2) == ["m1", "m2"] and found("m0", 2, 1) == ["m1"]
    assert found("m3", 1) == ["m4"] and found("m3", 2) == ["m4", "m5"] and found("nowhere", 2) == []
    for hops, limit in ((0, 5), (6, 5), (1, 0)):
        with pytest.raises(ValueError):
            graph.check_bounds(hops, limit)
    assert {r.id: r.depth for r in graph.lineage_depth(m).collect()} == {"m4": 1, "m5": 2}


def test_merge_ranks_zero_like_missing(spark):
    left = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.0), (1, "c", -0.5)], "query_id int, memory_id string, score double")
    right = spark.createDataFrame([(1, "a"), (1, "d")], "query_id int, memory_id string")
    got = [(r.memory_id, r.retrieval_source) for r in retrieval.merge_hits(left, right, 10).orderBy("rank").collect()]
    assert got == [("a", "hybrid"), ("c", "semantic"), ("b", "semantic"), ("d", "graph")]


def test_search_ties_blocks_and_odd_vectors(spark):
    corpus = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [0.0, 0.0], None, [1.0]])], "memory_id long, v array<double>")
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 2.0])], "query_id long, v array<double>")
    for size in (1 << 20, 8):
        got = sorted((r.query_id, r.rank, r.memory_id) for r in vector.search(queries, corpus, 2, size).collect())
        assert got == [(1, 1, 0), (1, 2, 1), (3, 1, 2), (3, 2, 0)]
    assert vector.search(queries.where("false"), corpus).count() == 0


def test_outbox_steps(spark):
    rows = spark.createDataFrame([(1, 0, True), (2, 0, False), (3, 2, False), (4, 3, True)], "id int, retry_count int, succeeds boolean").withColumns({"max_retries": F.lit(3), "status": F.lit("pending"), "projection_type": F.lit("vector"), "created_at": F.lit(0)})
    got = [(r.id, r.new_status, r.new_retry_count) for r in outbox.process(outbox.take_batch(rows)).orderBy("id").collect()]
    assert got == [(1, "completed", 0), (2, "retrying", 1), (3, "failed", 3), (4, "failed", 3)]
    assert outbox.process(rows, projections=()).where("id = 2").first().new_status == "completed"


def test_recent_traces_are_read_from_their_days(spark, tmp_path):
    at = F.timestamp_add("DAY", F.lit(-1) * F.col("id"), F.lit(datetime(2024, 5, 9)))
    traces = spark.range(9).select(F.col("id").alias("query_id"), at.alias("created_at"), F.lit("a").alias("answer"))
    stored = agent.store_traces(traces, f"file://{tmp_path}/t")
    newest = agent.recent_stored(stored, 3)
    assert [r.query_id for r in newest.collect()] == [0, 1, 2] and newest.columns == traces.columns
    assert "PartitionFilters: [day" in newest._jdf.queryExecution().executedPlan().toString()  # other days' folders aren't read
    assert agent.recent_stored(agent.store_traces(traces.limit(0), f"file://{tmp_path}/none")).isEmpty()


def test_health_by_group_and_missing_times(spark):
    rows = spark.createDataFrame([("a", "healthy"), ("a", None), ("b", "healthy"), ("b", "down")], "g string, status string")
    assert {tuple(r) for r in listing.health(rows, "g").collect()} == {("a", "healthy"), ("b", "degraded")}
    assert listing.health(rows).first().status == "degraded"
    assert one(spark, C.time_or_now(F.lit(None).cast("timestamp"), datetime(2030, 1, 1))) == datetime(2030, 1, 1)
    assert abs(one(spark, C.time_or_now(F.lit(None).cast("timestamp"))) - datetime.now(timezone.utc).replace(tzinfo=None)) < timedelta(minutes=5)


def test_working_memory_is_bounded(spark):
    items = spark.createDataFrame([(1, i) for i in range(5)], "session_id int, seq int")
    assert [r.seq for r in working.bounded(items, 3).orderBy("place").collect()] == [2, 3, 4]


def test_validation(spark):
    ok = ("observation", " t ", "c", "sensor", 0.5, 0.5, "2024-01-01T00:00:00Z")
    bad = [ok, (*ok[:1], " ", *ok[2:]), (*ok[:4], 1.5, *ok[5:]), ("rumour", *ok[1:]), (*ok[:6], "2024-01-01T00:00:00")]
    rows = spark.createDataFrame(bad, "memory_type string, title string, content string, source_type string, confidence double, importance double, observed_at string")
    got = lifecycle.validated(rows).collect()
    assert [r.error is None for r in got] == [True, False, False, False, False] and got[0].title == "t" and got[0].status == "active"


def test_store_versions(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", "id string, status string, note string"
    store.ensure(spark, path, schema + ", version long, deleted boolean")
    log = store.ensure(spark, path, schema + ", version long, deleted boolean")
    assert store.latest(log).count() == 0
    put = lambda rows: rows.write.mode("append").parquet(path)
    read = lambda: spark.read.parquet(path)
    put(store.versions(spark.createDataFrame([("a", "active", "x"), ("b", "active", "y")], schema), 1))
    put(store.patched(read(), spark.createDataFrame([("a", "archived", None), ("zz", "archived", None)], schema), 2))
    put(store.tombstones(read(), spark.createDataFrame([("b",), ("zz",)], "id string"), 3))
    assert [tuple(r) for r in store.latest(read()).collect()] == [("a", "archived", "x")]
    assert store.lookup(read(), ["b"]).count() == 0 and store.matching(read(), status="archived", note=None).count() == 1


def test_bounds_and_providers():
    for mode, values in (("semantic", {"limit": 0}), ("other", {}), ("graph", {"related_limit": 101}), ("hybrid", {"hops": 6}), ("hybrid", {"context": 11})):
        with pytest.raises(ValueError):
            retrieval.check_request(mode, **values)
    retrieval.check_request("hybrid", limit=50, hops=5, context=10, related_limit=100)
    with pytest.raises(ValueError):
        rag.provider("nowhere")


def test_no_leg_left_finds_nothing(spark):
    m = spark.createDataFrame([("a", "active", "t", "c")], "id string, status string, title string, content string")
    q = spark.createDataFrame([(1, "x", None)], "query_id long, text string, anchor string")
    assert retrieval.retrieve(q, m, "semantic", missing=("semantic",)).count() == 0


def test_work_folder_must_be_shared(monkeypatch):
    from types import SimpleNamespace

    from tidewell.session import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(cluster)


def test_lsh_forms_no_rows_of_pairs(spark):
    """Candidates are told inside the tasks; bad vectors match nothing and repeated rows count once."""
    x = np.random.default_rng(2).normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (900, None), (901, [0.0] * 8), (902, [1.0]), (903, [None] * 8)]
    corpus = spark.createDataFrame(rows, "memory_id long, v array<double>")
    asked = corpus.where("memory_id % 30 = 0").withColumnRenamed("memory_id", "query_id")
    found = vector.approximate_search(asked, corpus, bucket_length=20.0, tables=16)
    assert "Join" not in found._jdf.queryExecution().toString()
    exact = vector.search(asked.distinct(), corpus.distinct())
    told = lambda df: sorted(tuple(r) for r in df.select("query_id", "memory_id", F.round("score", 9), "rank").collect())
    assert told(found) == told(exact) and len(told(found)) == 100  # with such wide buckets only a far pair shares none
    few = vector.approximate_search(asked, corpus, bucket_length=0.05, tables=1)
    assert 10 <= few.count() < 100 and few.where("rank = 1 and query_id <> memory_id").count() == 0


def test_nearest_keeps_equal_ones_by_id():
    rng = np.random.default_rng(3)
    few = rng.normal(size=(6, 5))
    v, q = few[rng.integers(6, size=500)], rng.normal(size=(7, 5))
    v, q = v / np.linalg.norm(v, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
    ids = [f"m{i:03d}" for i in rng.permutation(500)]
    best = vector.Nearest(q, 8)
    for at in range(0, 500, 37):  # equal vectors in every batch
        best.add(pa.array(ids[at : at + 37]), v[at : at + 37])
    got = sorted((r["q"], -r["s"], r["m"]) for b in best.batches(pa.array(range(7)), ["q", "m", "s"]) for r in b.to_pylist())
    s = np.round(q @ v.T, 12)
    assert got == [(i, -s[i, j], ids[j]) for i in range(7) for j in sorted(range(500), key=lambda j: (-s[i, j], ids[j]))[:8]]
    assert (best.pairs == 500).all()
