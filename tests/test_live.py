"""Indexes, sinks, commits, kept-up projections and streams with state: what must hold while they change."""

import re
import time
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from compare import same
from tidewell.operators import ann, evaluation, graph, incremental, lifecycle, rag, sink, vector
from tidewell.plans.catalog import ORACLES, QUERIES
from tidewell.sources.manifest import Conflict, Table
from tidewell.streaming import jobs, stateful

NOW = datetime(2030, 1, 1)


@pytest.fixture
def base(tmp_path):
    return f"file://{tmp_path}"


# --- approximate search -----------------------------------------------------------------------------------------------
def test_ivf_scores_a_fifth_at_most(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("memory_id"), F.col("embedding").alias("v"))
    asked = v.where("memory_id % 50 = 0").withColumnRenamed("memory_id", "query_id")
    exact = {(r.query_id, r.memory_id) for r in vector.search(asked, v).collect()}
    seen = Observation()
    found = {(r.query_id, r.memory_id) for r in ann.search_index(asked, ann.build(v), observed=seen).collect()}
    assert len(found & exact) >= 0.95 * len(exact)
    assert seen.get["pairs"] < 0.2 * asked.count() * v.count()


def test_ivf_query_misses_none_of_the_nearest(spark, base):
    """Vectors without structure, more than the given tables have: shortlists by code miss some of the ten nearest."""
    x = np.random.default_rng(5).normal(size=(6000, 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{base}/embeddings.parquet")
    told = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, base).collect())
    assert told("vec_topk_ivf") == told("vec_topk_batched") and len(told("vec_topk_ivf")) == 1200


def test_guaranteed_search_scans_the_index_once(spark):
    """Without look-up tables 1200 queries are one block, and its result is the exact search's."""
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(7).normal(size=(1200, 32)))]
    corpus = spark.createDataFrame(rows, "memory_id long, v array<double>")
    asked = corpus.withColumnRenamed("memory_id", "query_id")
    found = ann.search_index(asked, ann.build(corpus), guaranteed=True)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow nearest") == 1
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, vector.search(asked, corpus).collect()))


def test_ivf_prunes_lists_and_grows(spark, base):
    """Vectors in groups: few lists are read, their files only, and added vectors are found."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(16, 12))
    rows = [(i, (centers[i % 16] + rng.normal(size=12) * 0.2).tolist()) for i in range(1600)]
    corpus = spark.createDataFrame(rows, "memory_id long, v array<double>")
    odd = spark.createDataFrame([(9000, None), (9001, [0.0] * 12), (9002, [1.0]), (9003, [None] * 12)], corpus.schema)
    path = ann.build(corpus.union(odd), base + "/ivf", lists=16)
    index = spark.read.parquet(f"{path}/lists")
    assert index.count() == 1600
    asked = spark.createDataFrame([(1, rows[3][1]), (2, None), (3, [1.0, 2.0])], "query_id long, v array<double>")
    want = [(r.query_id, r.memory_id) for r in vector.search(asked, corpus).orderBy("query_id", "rank").collect()]
    for more in ({"probes": 2}, {"probes": 2, "guaranteed": True}, {"guaranteed": True}):
        assert [(r.query_id, r.memory_id) for r in ann.search_index(asked, path, **more).orderBy("query_id", "rank").collect()] == want
    read = {f.split("list=")[1].split("/")[0] for f in ann.search_index(asked, path, probes=2).inputFiles() if "list=" in f}
    assert len(read) <= 16
    ann.append(path, spark.createDataFrame([(5000, rows[3][1])], corpus.schema))
    assert {r.memory_id for r in ann.search_index(asked, path, k=2, probes=2).collect()} == {3, 5000}
    with pytest.raises(ValueError):
        ann.index_named("nowhere")


def test_ivf_of_nothing(spark):
    none = spark.createDataFrame([], "memory_id long, v array<double>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, v array<double>")
    assert ann.search_index(asked, ann.build(none)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], none.schema)
    assert ann.search_index(asked.limit(0), ann.build(one)).count() == 0


# --- sink -------------------------------------------------------------------------------------------------------------
MEMORY = "id string, status string, title string, content string, memory_type string, tenant_id string, asset_id string, component_id string, incident_id string, facility_id string, team_id string, source_type string, source_id string, created_at timestamp_ntz, confidence double, importance double"


def memories(spark, n, **more):
    row = lambda i: ({c.split()[0]: None for c in MEMORY.split(", ")} | {"id": f"m{i}", "status": "active", "title": f"t{i}", "asset_id": f"a{i % 3}"} | {k: f(i) for k, f in more.items()})
    return spark.createDataFrame([tuple(row(i).values()) for i in range(n)], MEMORY)


def events(spark, rows):
    return spark.createDataFrame([(i, m, p, "pending", c, 3, NOW) for i, m, p, c in rows], "id long, memory_id string, projection_type string, status string, retry_count int, max_retries int, created_at timestamp_ntz")


def test_a_batch_has_its_effect_once(spark, base, monkeypatch):
    m, e = memories(spark, 4), events(spark, [(1, "m0", "vector", 0), (2, "m1", "graph", 0), (3, "gone", "vector", 2), (4, "m2", "vector", 3), (5, "m3", "mail", 0)])

    class Crash(BaseException):
        pass

    def crash(memories):
        raise Crash

    with pytest.raises(Crash):  # breaks off between two projections: nothing shows
        sink.run_batch(base, 0, e, m, NOW, {"vector": sink.build_index, "graph": crash})
    assert sink.states(spark, base).isEmpty() and sink.due(spark, base, NOW).isEmpty()
    assert sink.run_batch(base, 0, e, m, NOW) and not sink.run_batch(base, 0, e, memories(spark, 0), NOW)
    got = {r.id: (r.status, r.retry_count, r.error_message) for r in sink.states(spark, base).collect()}
    assert got == {1: ("completed", 0, None), 2: ("completed", 0, None), 3: ("failed", 3, "memory gone not found"), 4: ("failed", 3, sink.SPENT), 5: ("completed", 0, None)}
    assert [r.memory_id for r in sink.projected(spark, base, "vector").collect()] == ["m0"]


def test_retries_wait_and_later_batches_replace(spark, base):
    def down(memories):
        raise ValueError("down\nmore")

    m, e = memories(spark, 2), events(spark, [(1, "m0", "graph", 0), (2, "m0", "vector", 0)])
    sink.run_batch(base, 0, e, m, NOW, {"vector": sink.build_index, "graph": down}, delay_s=60)
    assert sink.due(spark, base, NOW + timedelta(seconds=59)).isEmpty()
    again = sink.due(spark, base, NOW + timedelta(seconds=60))
    sink.run_batch(base, 1, again, m, NOW + timedelta(seconds=60), {"graph": down}, delay_s=60)
    row = sink.states(spark, base).where("id = 1").first()
    assert (row.retry_count, row.error_message, row.next_attempt_at) == (2, "down", NOW + timedelta(seconds=180))
    changed = m.withColumn("asset_id", F.lit("new")).withColumn("component_id", F.lit("c")).withColumn("status", F.lit("superseded"))
    sink.run_batch(base, 2, sink.due(spark, base, NOW + timedelta(hours=1)).unionByName(events(spark, [(3, "m0", "vector", 0)]), allowMissingColumns=True), changed, NOW + timedelta(hours=1))
    assert {(r.rel, r.batch) for r in sink.projected(spark, base, "graph").collect()} == {("ABOUT_ASSET", 2), ("ABOUT_COMPONENT", 2)}
    assert sink.projected(spark, base, "vector").isEmpty()  # superseded by now, so its vector is gone
    assert {r.status for r in sink.states(spark, base).collect()} == {"completed"}


def test_events_due_after_a_step_are_not_given_up(spark, base):
    """Three attempts, 60 and 120 s apart, though a step is a second; then no event is left to try."""

    def down(memories):
        raise ValueError("down")

    m, e = memories(spark, 1), events(spark, [(1, "m0", "graph", 0), (2, "m0", "vector", 0)])
    made = {"vector": sink.build_index, "graph": down}
    assert sink.run_until_done(base, e, m, NOW, timedelta(seconds=1), made, delay_s=60) == 3
    got = {r.id: (r.status, r.retry_count, r.attempted_at) for r in sink.states(spark, base).collect()}
    assert got == {1: ("failed", 3, NOW + timedelta(seconds=180)), 2: ("completed", 0, NOW)}
    with pytest.raises(RuntimeError, match="left to try"):
        sink.run_until_done(base + "/other", e, m, NOW, timedelta(seconds=1), made, delay_s=60, most=2)


# --- commits ----------------------------------------------------------------------------------------------------------
def table(spark, base, rows="a b c d", **columns):
    t = Table(spark, base + "/t", "id string, status string, note string", buckets=16)
    t.commit(spark.createDataFrame([(k, "active", "x") for k in rows.split()], "id string, status string, note string"))
    return t


def test_readers_see_a_commit_whole_or_not_at_all(spark, base):
    t = table(spark, base)
    pair = spark.createDataFrame([("a", "superseded", "x"), ("e", "active", "follows a")], "id string, status string, note string")
    staged = t.stage(pair, 2)  # both rows lie in the folder, and neither is seen
    assert {r.id: r.status for r in t.read().collect()} == dict.fromkeys("abcd", "active")
    before = t.version()
    t.publish([*t.folders(), staged], 2)
    assert {r.id: r.status for r in t.read().collect()} == dict.fromkeys("bcde", "active") | {"a": "superseded"}
    assert {r.id for r in t.read(before).collect()} == set("abcd") and {r.id for r in t.changes(before).collect()} == {"a", "e"}
    with pytest.raises(Conflict):
        t.publish(t.folders(), 2)
    with pytest.raises(Conflict):
        t.commit(pair, on=1)
    assert t.version() == 2


def test_lookups_read_few_files_and_compaction_changes_nothing(spark, base):
    t = Table(spark, base + "/t", "id string, n long")
    for v in range(3):
        t.commit(spark.range(2000).select(F.concat(F.lit("k"), "id").alias("id"), (F.col("id") + v).alias("n")).where(f"n % {v + 1} = 0"))
    t.commit(spark.createDataFrame([("k7", 0, True)], "id string, n long, deleted boolean"))
    files = lambda path: sum(1 for f in Path(path.removeprefix("file://")).rglob("*.parquet"))
    plan = t.lookup(["k4"])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*bucket", plan)) == 4  # every folder's scan is pruned
    bucket = spark.range(1).select(F.lit("k4").alias("id")).select(t.bucket()).first()[0]
    assert 1 <= t.log().where(F.col("bucket") == bucket).select(F.input_file_name()).distinct().count() <= 0.1 * files(base + "/t/data")
    rows = lambda: sorted(tuple(r) for r in t.read().select("id", "n").collect())
    want, since = rows(), t.version()
    assert [r.n for r in t.lookup(["k4", "nowhere"]).collect()] == [6] and t.lookup(["k7"]).isEmpty()
    t.compact()
    assert rows() == want and len(t.folders()) == 1 and {r.id for r in t.changes(3).collect()} == {"k7"} and t.changes(since).isEmpty()
    assert len(t.vacuum()) == 4 and rows() == want


def test_conflicting_patches(spark, base):
    t = table(spark, base)
    changes = lambda *rows: spark.createDataFrame(rows, "id string, expected long, note string")
    assert t.patch(changes(("a", 1, "first"), ("nowhere", 1, "x")))[0] == 2
    version, refused = t.patch(changes(("a", 1, "stale"), ("b", 1, None), ("c", 1, "one"), ("c", 1, "two")))
    assert version == 3 and {(r.id, r.error, r.code) for r in refused.collect()} == {("a", "conflict", 409), ("c", "conflict", 409)}
    got = {r.id: (r.note, r.version) for r in t.read().collect()}
    assert got["a"] == ("first", 2) and got["b"] == ("x", 3) and got["c"][0] in ("one", "two") and got["d"] == ("x", 1)


def test_claimers_share_nothing(spark, base, monkeypatch):
    t = Table(spark, base + "/t", "id long, status string, created_at timestamp_ntz, claimed_by string, lease_until timestamp_ntz")
    t.commit(spark.range(10).select("id", F.lit("pending").alias("status"), F.lit(NOW).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("string").alias("claimed_by"), F.lit(None).cast("timestamp_ntz").alias("lease_until")))
    other, commit = Table(spark, t.path, t.schema), t.commit
    taken = []

    def late(rows, on=None):  # another claimer is faster, once
        if not taken:
            taken.extend(r.id for r in other.claim("b", NOW, 60, 4).collect())
        return commit(rows, on)

    monkeypatch.setattr(t, "commit", late)
    mine = [r.id for r in t.claim("a", NOW, 60, 4).collect()]
    assert sorted(taken) == [0, 1, 2, 3] and sorted(mine) == [4, 5, 6, 7]
    assert sorted(r.id for r in t.claim("c", NOW, 60, 9).collect()) == [8, 9] and t.claim("d", NOW, 60, 9).isEmpty()
    assert sorted(r.id for r in t.claim("d", NOW + timedelta(seconds=60), 60, 3).collect()) == [0, 1, 2]


def test_bad_batches_are_not_published(spark, base):
    t = table(spark, base)
    bad = lambda rows: rows.where("note = 'bad'").select("id", F.lit("note").alias("rule"))
    batch = spark.createDataFrame([("a", "active", "bad"), ("b", "active", "good")], "id string, status string, note string")
    version, found = t.audited(batch, bad)
    assert version is None and [r.id for r in found.collect()] == ["a"] and {r.note for r in t.read().collect()} == {"x"} and t.version() == 1
    assert t.audited(batch.where("id = 'b'"), bad)[0] == 2 and {r.note for r in t.read().collect()} == {"x", "good"}


# --- kept-up projections ----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("make, columns", [(graph.edges, ["asset_id", "component_id"]), (vector.build_index, None)])
def test_only_changed_buckets_are_written(spark, base, make, columns):
    m = memories(spark, 300)
    t = Table(spark, base + "/m", MEMORY)
    t.commit(m)
    path = base + "/p"
    rebuilt = lambda: sorted(str(tuple(r)) for r in make(t.read().drop("version")).collect())
    shown = lambda: sorted(str(tuple(r)) for r in incremental.projection(spark, path).collect())
    files = lambda: {str(f): f.parent.name for f in Path(f"{path}/rows".removeprefix("file://")).rglob("*.parquet")}
    assert incremental.refresh(t, path, make, columns) == 300 and shown() == rebuilt()
    before = files()
    t.commit(m.where("id in ('m7', 'm8')").withColumn("asset_id", F.lit("moved")))
    t.commit(m.where("id = 'm9'").withColumn("deleted", F.lit(True)))
    t.commit(memories(spark, 301).where("id = 'm300'"))
    t.compact()
    assert incremental.refresh(t, path, make, columns) == 4 and shown() == rebuilt()
    gone = {b for f, b in before.items() if f not in files()}
    assert 1 <= len(gone) <= 4 and incremental.refresh(t, path, make, columns) == 0
    t.commit(m.where("id = 'm10'").withColumn("confidence", F.lit(0.5)))
    assert incremental.refresh(t, path, make, columns) == (0 if columns else 1) and shown() == rebuilt()


# --- streams with state -----------------------------------------------------------------------------------------------
def test_fold_goes_on_after_a_restart(spark, base):
    schema = "seq long, id string, op string"
    m = spark.createDataFrame([("a", "active"), ("b", "archived")], "id string, status string")
    commands = [(1, "a", "dispute"), (2, "b", "restore"), (3, "a", "restore"), (4, "a", "supersede"), (5, "a", "archive"), (6, "a", "nonsense")]
    for part in (commands[:1], commands[1:4], commands[4:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(base + "/in")
        told = stateful.stream_fold(spark.readStream.schema(schema).parquet(base + "/in"), m, base + "/out")
    want = lifecycle.fold(m, spark.createDataFrame(commands, schema))
    rows = lambda df: sorted((r.seq, r.id, r.op, r.before, r.after, r.accepted) for r in df.collect())
    assert rows(told) == rows(want)


def test_retries_come_back_when_their_time_is_over(spark, base):
    schema = "id long, retry_count int, max_retries int, delay_ms long"
    spark.createDataFrame([(1, 0, 3, 500), (2, 3, 3, 0), (3, 1, 3, 3_600_000)], schema).write.parquet(base + "/in")
    stream = stateful.delayed_retries(spark.readStream.schema(schema).parquet(base + "/in"))
    query = stream.writeStream.outputMode("append").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{base}/out/batch={n}")).option("checkpointLocation", base + "/progress").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            got = [tuple(r) for r in spark.read.schema("id long, retry_count int").parquet(base + "/out").select("id", "retry_count").collect()] if Path(f"{base}/out".removeprefix("file://")).exists() else []
            if got:
                break
    finally:
        query.stop()
    assert got == [(1, 1)]


def test_sessions_are_bounded_across_batches(spark, base):
    schema = "session_id long, seq long, item_type string"
    for part in ([(1, 1, "a"), (1, 2, "b"), (2, 1, "z")], [(1, 3, "c"), (1, 4, "d")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(base + "/in")
        told = stateful.stream_sessions(spark.readStream.schema(schema).parquet(base + "/in"), base + "/out", 3)
    assert sorted((r.session_id, r.seq, r.place) for r in told.collect()) == [(1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 1, 1)]


def test_outbox_stream_runs_on_the_sink(spark, base):
    m = memories(spark, 3)
    rows = events(spark, [(1, "m0", "vector", 0), (2, "gone", "graph", 0)])
    for k, part in enumerate((rows.where("id = 1"), rows.where("id = 2"), rows.where("id = 1").withColumn("id", F.lit(3).cast("long")).withColumn("memory_id", F.lit("m1")))):
        part.write.mode("append").parquet(base + "/in")
        told = jobs.drain_outbox(spark.readStream.schema(rows.schema).parquet(base + "/in"), m, base + "/sink", lambda n, k=k: NOW + timedelta(hours=k))
    assert {(r.id, r.status, r.retry_count, r.batch) for r in told.collect()} == {(1, "completed", 0, 0), (2, "retrying", 2, 2), (3, "completed", 0, 2)}


# --- measures ---------------------------------------------------------------------------------------------------------
def test_latency_is_measured(spark):
    def slow(system, user):
        time.sleep(0.05)
        return "x"

    asked = spark.createDataFrame([(i, "semantic", "", "q") for i in range(4)], "case_id int, mode string, system_prompt string, user_prompt string")
    found = evaluation.measured(asked.select("case_id"), asked)
    assert found.first().retrieval_ms > 0
    told = rag.generate(asked, slow, "m").select("*", F.array(F.lit("a")).alias("retrieved"), F.array(F.lit("a")).alias("expected"), F.col("elapsed_ms").alias("latency_ms"))
    assert 50 <= evaluation.summary(evaluation.evaluate(told)).first().mean_latency_ms < 500


def test_cases_tell_the_time_of_their_answers(spark):
    """Failed cases too; the provider's clock goes on by case % 50 ms a call."""
    rows = QUERIES["eval_recall_mrr"](spark, "/root/testdata/sf0.001").collect()
    items = [r.item_id for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert sorted((r.case_id, r.mode, r.latency_ms) for r in rows) == sorted((i, mode, i % 50) for i in items for mode in ("semantic", "hybrid"))
    assert any(r.failure_category == "provider_failure" and r.latency_ms > 0 for r in rows)


def test_run_summary_has_the_mean_time_of_an_answer(spark):
    items = [r.item_id for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert QUERIES["eval_run_summary"](spark, "/root/testdata/sf0.001").first().mean_latency_ms == pytest.approx(sum(i % 50 for i in items) / len(items))


def test_long_chains_and_circles(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(1000)] + [("x", "y"), ("y", "x"), ("z", "y")]
    m = spark.createDataFrame(rows, "id string, supersedes_memory_id string")
    got = {r.id: r.depth for r in graph.lineage_depth(m).collect()}
    assert got["n999"] == 999 and got["n1"] == 1 and got["x"] is got["y"] is got["z"] is None and len(got) == 1002


def test_queries_over_larger_tables(spark):
    for name in ("vec_topk_ivf", "vec_topk_ivf_guaranteed"):
        assert same(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.01") == 100


# --- hubs -------------------------------------------------------------------------------------------------------------
def reach_of(spark, rows, anchors, hops, limit, **how):
    schema = "id string, " + ", ".join(f"{c} string" for c in ("tenant_id", "asset_id", "component_id", "incident_id", "facility_id", "team_id", "source_type", "source_id", "supersedes_memory_id"))
    m = spark.createDataFrame(rows, schema)
    asked = spark.createDataFrame(list(enumerate(anchors)), "query_id int, anchor string")
    return sorted((r.query_id, r.rank, r.memory_id) for r in graph.related(asked, m, hops, limit, **how).collect())


def test_lists_by_node_equal_frontiers_by_query(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pick = lambda n, p: f"x{rng.integers(n)}" if rng.random() < p else None
    rows = [(f"m{i:03d}", None, pick(20, 0.5), pick(9, 0.3), None, pick(4, 0.2), None, None, None, f"m{rng.integers(i):03d}" if i and rng.random() < 0.2 else None) for i in range(120)]
    anchors = [f"m{i:03d}" for i in range(0, 120, 7)] + ["nowhere"]
    for hops in (1, 2, 3):
        for limit in (1, 5, 200):
            by_query = reach_of(spark, rows, anchors, hops, limit)
            assert reach_of(spark, rows, anchors, hops, limit, hub=0, spread=0.0) == by_query
    monkeypatch.setattr(graph, "HELD", 2)  # lists leave the task early
    assert reach_of(spark, rows, anchors, 3, 5, hub=0, spread=0.0) == reach_of(spark, rows, anchors, 3, 5)


def test_ranges_of_memories_equal_frontiers_by_query(spark, monkeypatch):
    """All neighbours: several ranges and blocks of queries, nodes of few and of many members, no shuffle of the result."""
    rng = np.random.default_rng(8)
    pick = lambda n, p: f"x{rng.integers(n)}" if rng.random() < p else None
    rows = [(f"m{i:03d}", None, pick(20, 0.5), pick(9, 0.3), None, pick(40, 0.2), None, None, None, f"m{rng.integers(i):03d}" if i and rng.random() < 0.2 else None) for i in range(120)]
    anchors = [f"m{i:03d}" for i in range(0, 120, 7)] + ["nowhere"]
    want = {hops: reach_of(spark, rows, anchors, hops, 500) for hops in (1, 2, 3)}
    for name, value in (("LISTED", 1), ("RANGE", 30), ("PAIRS", 60), ("FEW", 3)):
        monkeypatch.setattr(graph, name, value)
    plans, whole = [], graph._whole
    monkeypatch.setattr(graph, "_whole", lambda *a: plans.append(whole(*a)) or plans[-1])
    for hops in want:
        assert reach_of(spark, rows, anchors, hops, 500) == want[hops]
        assert reach_of(spark, rows, anchors, hops, 3) == [x for x in want[hops] if x[1] <= 3]
    assert len(plans) == 6 and all("Exchange" not in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    frame = type(spark.range(0))
    by_range = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda df, n, *c: by_range(df, 2 * n + 3, *c))  # a platform may deal more partitions
    assert reach_of(spark, rows, anchors, 2, 500) == want[2]
    twice = spark.createDataFrame([(1, "m000"), (1, "m007")], "query_id int, anchor string")
    m = spark.createDataFrame(rows, "id string, " + ", ".join(f"{c} string" for c in ("tenant_id", "asset_id", "component_id", "incident_id", "facility_id", "team_id", "source_type", "source_id", "supersedes_memory_id")))
    assert graph.related(twice, m, 2, 500).count() > 0 and len(plans) == 7
    assert graph.related(twice, m.limit(0), 2, 500).count() == 0 == graph.related(twice.limit(1), m.limit(0), 2, 500).count()


def test_a_hub_of_half_the_memories(spark, monkeypatch):
    n = 4000
    rows = [(f"m{i:05d}", None, "hub" if i % 2 else None, f"c{i // 4}", None, None, None, None, None, None) for i in range(n)]
    anchors = [f"m{i:05d}" for i in range(1, n, 50)]
    made, merged = [], graph._merged

    def counted(rows, by, k):
        made.append(rows.count())
        return merged(rows, by, k)

    monkeypatch.setattr(graph, "_merged", counted)
    got = reach_of(spark, rows, anchors, 3, 10)
    assert made and sum(made) < 20 * n  # by query it would be 80 anchors times 2000 members in the first step alone
    everything = [f"m{i:05d}" for i in range(n)]
    for q, anchor in enumerate(anchors):
        assert [m for a, _, m in got if a == q] == [m for m in everything[:11] if m != anchor][:10]
