"""Queries over tables that change: indexes, sinks, streams with state, commits; each with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewell.operators import ann, evaluation, extensions, graph, incremental, lifecycle, listing, sink, vector
from tidewell.plans.catalog import _PASS, _SUP, ANC, ASK, BROKEN, EDG, EVAL, IDX, MEM, ORACLES, OUT, QUERIES, SEM, VEC, WRK, _asked, _questions, _replacements, _results, _rounded, _vectors, mem, query, reach_sql
from tidewell.sources import derived, relational
from tidewell.sources.manifest import Table
from tidewell.streaming import jobs, stateful

NOW = datetime(2030, 1, 1)


# --- approximate search -----------------------------------------------------------------------------------------------
@query(VEC.format(where="q.vec_id % 50 = 0"))
def vec_topk_ivf(s, d):
    """The codes' shortlists first; then every list that their tenth best doesn't rule out is scored, so that none is missed."""
    v = _vectors(s, d)
    return _rounded(ann.search_index(_asked(v, 50), ann.build(v), shortlist=100, guaranteed=True))


@query(VEC.format(where="q.vec_id % 50 = 0"))
def vec_topk_ivf_guaranteed(s, d):
    """All lists probed, and as many vectors scored as the codes' errors ask for: exact by proof."""
    v = _vectors(s, d)
    return _rounded(ann.search_index(_asked(v, 50), ann.build(v), guaranteed=True))


# --- projection sink --------------------------------------------------------------------------------------------------
def _down(memories):
    raise RuntimeError("graph is down")


def _sunk(s, d) -> str:
    """Two thirds of the ready events while the graph is down, the same batch again with the graph up, then the rest and what is due."""
    base, events, m = jobs.scratch(s, "sink"), derived.outbox(s, d), mem(s, d)
    sink.run_batch(base, 0, events.where("id % 3 <> 0"), m, NOW, {"vector": sink.build_index, "graph": _down})
    sink.run_batch(base, 0, events.where("id % 3 <> 0"), m, NOW)
    later = NOW + timedelta(hours=1)
    columns = sink.due(s, base, later)
    sink.run_batch(base, 1, events.where("id % 3 = 0").select(*[F.col(c) if c in events.columns else F.lit(None).alias(c) for c in columns.columns]).unionByName(columns), m, later)
    return base


SUNK = f"""{MEM}, {OUT}, r AS (SELECT o.id, o.memory_id, projection_type, retry_count, max_retries, o.id % 3 <> 0 AS early, m.id IS NULL AS missing, 'memory ' || o.memory_id || ' not found' AS lost FROM outbox o LEFT JOIN memories m ON m.id = o.memory_id WHERE o.status IN ('pending', 'retrying')),
a AS (SELECT *, CASE WHEN NOT early THEN NULL WHEN retry_count >= max_retries THEN 'max retries exceeded' WHEN projection_type = 'graph' THEN 'graph is down' WHEN missing THEN lost END AS e0 FROM r),
b AS (SELECT *, retry_count + CASE WHEN e0 IS NOT NULL AND retry_count < max_retries THEN 1 ELSE 0 END AS c0 FROM a),
c AS (SELECT *, CASE WHEN NOT early THEN 'pending' WHEN retry_count >= max_retries THEN 'failed' WHEN e0 IS NULL THEN 'completed' WHEN c0 >= max_retries THEN 'failed' ELSE 'retrying' END AS s0 FROM b),
t AS (SELECT *, s0 IN ('pending', 'retrying') AS again FROM c),
f AS (SELECT *, CASE WHEN NOT again THEN NULL WHEN c0 >= max_retries THEN 'max retries exceeded' WHEN missing THEN lost END AS e1 FROM t),
z AS (SELECT id, memory_id, projection_type, CASE WHEN again THEN 1 ELSE 0 END AS batch, CASE WHEN e1 IS NOT NULL AND c0 < max_retries THEN c0 + 1 ELSE c0 END AS retry_count, coalesce(e1, e0) AS error_message,
CASE WHEN NOT again THEN s0 WHEN c0 >= max_retries THEN 'failed' WHEN e1 IS NULL THEN 'completed' WHEN c0 + 1 >= max_retries THEN 'failed' ELSE 'retrying' END AS status FROM f)"""


@query(f"WITH {SUNK} SELECT id, CAST(batch AS BIGINT) AS batch, status, CAST(retry_count AS INT) AS retry_count, error_message, CASE WHEN status = 'completed' THEN TIMESTAMP '2030-01-01 00:00:00' + batch * INTERVAL 1 HOUR END AS completed_at, CASE WHEN status = 'retrying' THEN TIMESTAMP '2030-01-01 00:00:00' + batch * INTERVAL 1 HOUR + CAST(power(2, retry_count - 1) AS BIGINT) * INTERVAL 1 SECOND END AS next_attempt_at FROM z")
def sink_events(s, d):
    return sink.states(s, _sunk(s, d)).select("id", "batch", "status", "retry_count", "error_message", "completed_at", "next_attempt_at")


@query(f"""WITH {SUNK}, {EDG}, w AS (SELECT projection_type, memory_id, max(batch) AS batch FROM z WHERE status = 'completed' GROUP BY ALL)
SELECT 'vector' AS projection, memory_id, CAST(batch AS BIGINT) AS batch, CAST(1 AS BIGINT) AS n FROM w JOIN memories m ON m.id = memory_id WHERE projection_type = 'vector' AND m.status <> 'superseded'
UNION ALL SELECT 'graph', w.memory_id, CAST(batch AS BIGINT), count(*) FROM w JOIN edges USING (memory_id) WHERE projection_type = 'graph' GROUP BY ALL""")
def sink_rows(s, d):
    base = _sunk(s, d)
    count = lambda name: sink.projected(s, base, name).groupBy("memory_id", "batch").agg(F.count("*").alias("n")).select(F.lit(name).alias("projection"), "memory_id", "batch", "n")
    return count("vector").union(count("graph"))


# --- streams with state -----------------------------------------------------------------------------------------------
def stream_in_parts(s, rows, name: str, key: str, parts: int, handle):
    """Runs ``handle`` (stream, out) after each part of ``rows`` in the order of ``key``: a new query goes on from the last one's state."""
    base, out, told = jobs.scratch(s, name), jobs.scratch(s, f"{name}-out"), None
    edges = [x for x in rows.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10000)).first()[0] or []]
    for low, high in zip([None, *edges], [*edges, None]):
        part = rows.where((F.lit(True) if low is None else F.col(key) > low) & (F.lit(True) if high is None else F.col(key) <= high))
        part.write.mode("append").parquet(base)
        told = handle(s.readStream.schema(rows.schema).parquet(base), out)
    return told


@query(ORACLES["lifecycle_fold"])
def stream_lifecycle_fold(s, d):
    """Commands in three parts; each part's stream is a new query that takes up the state of the one before."""
    m = mem(s, d).select("id", "status")
    return stream_in_parts(s, derived.commands(s, d), "commands", "seq", 3, lambda stream, out: stateful.stream_fold(stream, m, out))


@query(ORACLES["wm_bounded"])
def stream_sessions(s, d):
    items = derived.working_items(s, d).select("session_id", "seq", "item_type")
    return stream_in_parts(s, items, "items", "seq", 3, lambda stream, out: stateful.stream_sessions(stream, out, 3))


# --- tables with commits ----------------------------------------------------------------------------------------------
def _table(s, rows, name: str, **more: str) -> Table:
    """A table of these rows as its first version; ``more``: columns that begin as null."""
    schema = ", ".join([f"{n} {t}" for n, t in rows.dtypes] + [f"{n} {t}" for n, t in more.items()])
    table = Table(s, jobs.scratch(s, name), schema)
    table.commit(rows.select("*", *[F.lit(None).cast(t).alias(n) for n, t in more.items()]))
    return table


def _moved(s, d):
    """(table, changed rows, deleted rows): some memories change asset and title, some go."""
    m = mem(s, d)
    table = _table(s, m, "memories")
    return table, m.where("doc_id % 50 = 7").withColumn("asset_id", F.lit("asset-moved")).withColumn("title", F.concat(F.lit("moved "), "title")), m.where("doc_id % 90 = 11").withColumn("deleted", F.lit(True))


def _kept_up(s, d, make, columns=None):
    table, changed, gone = _moved(s, d)
    path = jobs.scratch(s, "projection")
    incremental.refresh(table, path, make, columns)
    table.commit(changed)
    table.commit(gone)
    incremental.refresh(table, path, make, columns)
    return incremental.projection(s, path)


MOVED = f"base AS MATERIALIZED ({derived.MEMORIES_SQL}), memories AS MATERIALIZED (SELECT * REPLACE (CASE WHEN doc_id % 50 = 7 THEN 'asset-moved' ELSE asset_id END AS asset_id, CASE WHEN doc_id % 50 = 7 THEN 'moved ' || title ELSE title END AS title) FROM base WHERE doc_id % 90 <> 11)"


@query(f"WITH {MOVED}, {EDG} SELECT memory_id, rel, entity_key FROM edges")
def graph_kept_up(s, d):
    """Edges after a delta, of which only the buckets of changed memories were written again."""
    owned = ["asset_id", "component_id", "incident_id", "facility_id", "team_id", "tenant_id", "source_type", "source_id"]
    return _kept_up(s, d, graph.edges, owned).select("memory_id", "rel", "entity_key")


@query(f"WITH {MOVED}, {IDX} SELECT memory_id, round(v[1], 6) AS v1, round(v[32], 6) AS v32, m.asset_id FROM idx JOIN memories m ON m.id = memory_id")
def vectors_kept_up(s, d):
    out = _kept_up(s, d, vector.build_index)
    return out.select("memory_id", F.round(F.col("v")[0], 6).alias("v1"), F.round(F.col("v")[31], 6).alias("v32"), "asset_id")


@query(f"WITH {MOVED} SELECT id, title, asset_id FROM memories WHERE doc_id IN (7, 11, 12, 57)")
def table_lookup(s, d):
    """Keys of a table of four folders, and the same after compaction: one bucket's files for each key."""
    table, changed, gone = _moved(s, d)
    table.commit(changed)
    table.commit(gone)
    table.compact()
    table.vacuum()
    return table.lookup([f"00000000-0000-4000-8000-{i:012d}" for i in (7, 11, 12, 57)]).select("id", "title", "asset_id")


@query(_SUP + " SELECT m.id, CASE WHEN r.old_id IS NULL THEN m.status ELSE 'superseded' END AS status, m.supersedes_memory_id FROM memories m LEFT JOIN r ON r.old_id = m.id AND r.error IS NULL UNION ALL SELECT id, 'active', old_id FROM r WHERE error IS NULL")
def table_supersession(s, d):
    """Both rows of every supersession in one commit."""
    m = mem(s, d)
    table = _table(s, m, "memories")
    table.commit(lifecycle.supersede(m, _replacements(m))[0])
    return table.read().select("id", "status", "supersedes_memory_id")


@query(f"WITH {OUT}, r AS (SELECT id, row_number() OVER (ORDER BY created_at, id) AS k FROM outbox WHERE status IN ('pending', 'retrying')) SELECT id, CASE WHEN k <= 50 THEN 'c' ELSE 'b' END AS claimed_by, TIMESTAMP '2030-01-01 00:00:00' + CASE WHEN k <= 50 THEN 121 ELSE 60 END * INTERVAL 1 SECOND AS lease_until FROM r WHERE k <= 80")
def outbox_claims(s, d):
    """Two claimers get different events; a third takes those whose leases have run out."""
    table = _table(s, derived.outbox(s, d).drop("succeeds"), "outbox", claimed_by="string", lease_until="timestamp_ntz")
    for who, after, n in (("a", 0, 40), ("b", 0, 40), ("c", 61, 50)):
        table.claim(who, NOW + timedelta(seconds=after), 60.0, n)
    return table.read().where("claimed_by is not null").select("id", "claimed_by", "lease_until")


@query(f"WITH {MEM}, k AS (SELECT id, CASE WHEN doc_id % 7 = 0 THEN 'conflict' END AS error, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS version FROM memories WHERE doc_id % 3 = 0) SELECT id, error, CAST(version AS BIGINT) AS version, CAST(409 AS INT) AS code FROM k WHERE error IS NOT NULL UNION ALL SELECT 'nowhere', 'not_found', 0, 404")
def patch_conflicts(s, d):
    """Patches that expect a version which another patch has replaced since."""
    m = mem(s, d).select("id", "doc_id", "title")
    table = _table(s, m, "memories")
    table.patch(m.where("doc_id % 7 = 0").select("id", F.lit(1).alias("expected"), F.concat(F.lit("first "), "title").alias("title")))
    late = m.where("doc_id % 3 = 0").select("id", F.lit(1).alias("expected"), F.concat(F.lit("second "), "title").alias("title"))
    refused = table.patch(late.union(s.sql("select 'nowhere', 1, 'x'")))[1]
    return refused.select("id", "error", F.coalesce("version", F.lit(0)).alias("version"), "code")


@query(ORACLES["mem_violations"])
def audited_violations(s, d):
    """What keeps a staged batch from being published."""
    m = mem(s, d)
    rows = s.sql(BROKEN.replace("FROM memories", "FROM {memories}"), memories=m)
    return Table(s, jobs.scratch(s, "audited"), ", ".join(f"{n} {t}" for n, t in rows.dtypes)).audited(rows, listing.violations)[1]


@query(f"WITH {MEM} SELECT id, CASE WHEN doc_id % 4 = 2 THEN 'checked ' || title ELSE title END AS title FROM memories WHERE trim(coalesce(content, '')) <> ''")
def audited_table(s, d):
    """A batch with bad rows leaves the table as it was; a clean one is published."""
    rows = mem(s, d).select("doc_id", "id", "title", "content", "source_type", F.col("confidence").cast("double"), F.col("importance").cast("double"), "memory_type").withColumn("supersedes_memory_id", F.lit(None).cast("string")).where("trim(coalesce(content, '')) <> ''")
    table = _table(s, rows, "audited")
    changed = rows.where("doc_id % 4 = 2").withColumn("title", F.concat(F.lit("checked "), "title"))
    table.audited(changed.withColumn("title", F.when(F.col("doc_id") % 8 == 2, " ").otherwise(F.lit("wrong"))), listing.violations)
    table.audited(changed, listing.violations)
    return table.read().select("id", "title")


HALL = f"base AS MATERIALIZED ({derived.MEMORIES_SQL}), memories AS MATERIALIZED (SELECT * REPLACE (CASE WHEN doc_id % 2 = 0 THEN 'hall' ELSE facility_id END AS facility_id, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE tenant_id END AS tenant_id) FROM base)"


@query(f"WITH {HALL}, {EDG}, {ANC}, {reach_sql(2, 50)} SELECT query_id, memory_id, rank FROM rel")
def graph_related_hub(s, d):
    """Two hops where one facility stands on half of the memories."""
    half = F.col("doc_id") % 2 == 0
    m = mem(s, d).withColumn("facility_id", F.when(half, "hall").otherwise(F.col("facility_id"))).withColumn("tenant_id", F.when(~half, F.col("tenant_id")))
    anchors = m.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("id").alias("anchor"))
    return graph.related(anchors, m, 2, 50, hub=50, spread=0.5).select("query_id", "memory_id", "rank")


# --- health, explorer, latency ----------------------------------------------------------------------------------------
@query(f"""WITH {MEM}, {OUT}, t AS (SELECT 'memories' AS name, count(*) AS n, max(created_at) AS newest FROM memories UNION ALL SELECT 'stuck', count(*), max(created_at) FROM outbox WHERE status = 'processing' UNION ALL SELECT 'outbox', count(*), max(created_at) FROM outbox),
h AS (SELECT name, n, CASE WHEN n = 0 THEN 'empty' WHEN newest < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 20 DAY THEN 'stale' ELSE 'healthy' END AS status FROM t)
SELECT name, n, status FROM h UNION ALL SELECT 'all', CAST(sum(n) AS BIGINT), CASE WHEN bool_and(status = 'healthy') THEN 'healthy' ELSE 'degraded' END FROM h""")
def table_health(s, d):
    """Rows and age of each table at a given time, and the roll-up."""
    events = derived.outbox(s, d)
    tables = {"memories": mem(s, d), "stuck": events.where("status = 'processing'"), "outbox": events}
    each = listing.table_health(tables, timedelta(days=20), datetime(2024, 1, 20))
    both = each.agg(F.lit("all").alias("name"), F.sum("n").alias("n")).crossJoin(listing.health(each))  # one row each
    return each.select("name", "n", "status").union(both.select("name", "n", "status"))


@query(f"SELECT r.query_id, r.memory_id, r.rank, m.title, m.status FROM ({ORACLES['graph_related_1hop']}) r JOIN ({derived.MEMORIES_SQL}) m ON m.id = r.memory_id WHERE r.rank <= 10")
def explorer_first_ten(s, d):
    """The explorer shows the records of an anchor's first ten neighbours."""
    return listing.explorer_records(QUERIES["graph_related_1hop"](s, d), mem(s, d), 10).select("query_id", "memory_id", "rank", "title", "status")


@query("SELECT md.mode, count(*) AS cases, count(*) AS measured FROM benchmark, (VALUES ('semantic'), ('hybrid')) md(mode) GROUP BY md.mode")
def eval_latency(s, d):
    """Cases whose latency was measured: the share of the mode's retrieval, and the provider's call."""
    return _results(s, d, timed=True).groupBy("mode").agg(F.count("*").alias("cases"), F.count_if(F.col("latency_ms") > 0).alias("measured"))


# --- parts by name ----------------------------------------------------------------------------------------------------
@query(f"WITH {MEM}, {IDX}, {ASK}, {SEM} SELECT name AS index, query_id, memory_id, round(score, 6) AS score, rank FROM sem, (VALUES ('exact'), ('ivf-guaranteed')) v(name)")
def search_by_index(s, d):
    """One search under two registered indexes."""
    m = mem(s, d)
    hits = extensions.evaluate_indexes(_questions(m), m, ["exact", "ivf-guaranteed"])
    return hits.select("index", "query_id", "memory_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {EVAL} SELECT name AS index, count(*) AS total_cases, round(avg(recall), 6) AS mean_recall, round(avg(mrr), 6) AS mean_mrr FROM res, (VALUES ('exact'), ('ivf-guaranteed')) v(name) WHERE mode = 'semantic' GROUP BY name")
def eval_by_index(s, d):
    """The evaluation's semantic mode under two registered indexes."""
    m, out = mem(s, d), None
    corpus = vector.build_index(m).select("memory_id", "v")
    for name in ("exact", "ivf-guaranteed"):
        told = evaluation.summary(_results(s, d, searcher=extensions.named("index", name)(corpus), modes=("semantic",)))
        own = told.select(F.lit(name).alias("index"), "total_cases", F.round("mean_recall", 6).alias("mean_recall"), F.round("mean_mrr", 6).alias("mean_mrr"))
        out = own if out is None else out.union(own)
    return out


@query(ORACLES["index_own_embedding"])
def index_function_embedding(s, d):
    """An index whose vectors a Python function makes, batch by batch."""
    embed = extensions.embedder(lambda texts: [[float(len(t))] for t in texts], 1)
    return vector.build_index(mem(s, d), 1, embed).select("memory_id", F.col("v")[0].alias("v1"))


@query(f"WITH {MEM}, {IDX}, {ASK}, {SEM} SELECT query_id, CAST(count(*) AS INT) AS n, string_agg(rank || ':' || memory_id, ',' ORDER BY rank) AS listed FROM sem GROUP BY query_id")
def tool_table_function(s, d):
    """A tool over the hits of each query, in their order."""

    def step(state, row):
        state["id"] = row["query_id"]
        state.setdefault("listed", []).append(f"{row['rank']}:{row['memory_id']}")

    extensions.tool_function(s, "list_hits", "query_id long, n int, listed string", step, lambda state: iter([(state["id"], len(state["listed"]), ",".join(state["listed"]))] if state else []))
    hits = QUERIES["hash_embedding_topk"](s, d)
    return s.sql("SELECT * FROM list_hits(TABLE(SELECT * FROM {hits}) PARTITION BY query_id ORDER BY rank)", hits=hits)


@query(rf"WITH {WRK} SELECT policy, count(*) AS promoted FROM items, (VALUES ('threshold', 0), ('page', 10)) p(policy, above) WHERE {_PASS} AND length(regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g')) > above GROUP BY policy")
def promoted_by_policy(s, d):
    rows, out = derived.working_items(s, d).withColumn("title", F.col("item_type")), None
    for name in ("threshold", "page"):
        own = rows.where(extensions.named("policy", name)()).groupBy().agg(F.lit(name).alias("policy"), F.count("*").alias("promoted")).where("promoted > 0")
        out = own if out is None else out.union(own)
    return out


# --- relational source ------------------------------------------------------------------------------------------------
def _file(s, rows) -> str:
    path = f"{jobs.scratch(s, 'relational')}.db"
    relational.write_table(rows.orderBy("event_id"), path, "events", "event_id")
    return path


_EVENTS = ["event_id", "user_id", "event_type", "value"]


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> 'view' AND event_id >= 17")
def relational_scan(s, d):
    """All events in a relational table, read by key ranges with filters at the source."""
    path = _file(s, s.read.parquet(f"{d}/events.parquet").select(*_EVENTS))
    return relational.read_table(s, path, "events", "event_id", where=[("event_type", "<>", "view"), ("event_id", ">=", 17)])


@query("SELECT event_id, user_id, event_type, value FROM events")
def relational_stream(s, d):
    """A relational table as a stream: what came after the first run is read by the second, and nothing twice."""
    rows, out = s.read.parquet(f"{d}/events.parquet").select(*_EVENTS), jobs.scratch(s, "relational-out")
    middle = rows.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    path = _file(s, rows.where(F.col("event_id") <= middle))
    relational.register(s)
    for more in (None, rows.where(F.col("event_id") > middle)):
        if more is not None:
            relational.write_table(more.orderBy("event_id"), path, "events", "event_id")
        jobs.run_available(s.readStream.format(relational.NAME).options(path=path, table="events", key="event_id").load(), lambda batch: batch, out)
    return s.read.parquet(out).select(*_EVENTS)
