"""Registry of the engine's queries over the derived tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import session
from tidewell.functions import columns as C
from tidewell.operators import agent, evaluation, graph, lifecycle, listing, outbox, projection, rag, retrieval, sink, vector, working
from tidewell.schemas import MEMORY_SCHEMA, OUTBOX_SCHEMA
from tidewell.sources import derived, store
from tidewell.streaming import jobs, stateful

QUERIES: dict = {}
ORACLES: dict = {}
MEM = f"memories AS MATERIALIZED ({derived.MEMORIES_SQL})"
OUT = f"outbox AS ({derived.OUTBOX_SQL})"
WRK = f"items AS ({derived.WORKING_SQL})"
CMD = f"commands AS ({derived.COMMANDS_SQL})"


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def register(function):
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


mem = derived.memories

# --- listing and statistics -------------------------------------------------------------------------------------------
LISTED = "id, memory_type, status, title, asset_id, facility_id, source_type, CAST(confidence AS DOUBLE) AS confidence"
_listed = lambda df: df.select("id", "memory_type", "status", "title", "asset_id", "facility_id", "source_type", F.col("confidence").cast("double").alias("confidence"))


@query(f"WITH {MEM} SELECT {LISTED} FROM memories WHERE status = 'active' AND source_type = 'sensor'")
def mem_list_filtered(s: SparkSession, d: str) -> DataFrame:
    return _listed(listing.list_memories(mem(s, d), status="active", source_type="sensor", asset_id=""))


@query(f"WITH {MEM} SELECT {LISTED} FROM memories WHERE status = 'active' ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def mem_list_page(s, d):
    return _listed(listing.list_memories(mem(s, d), status="active", limit=20, offset=40))


@query(f"WITH {MEM} SELECT {LISTED} FROM memories WHERE id = '00000000-0000-4000-8000-000000000017'")
def mem_get(s, d):
    return _listed(listing.get_memory(mem(s, d), "00000000-0000-4000-8000-000000000017"))


@query(f"WITH {MEM} SELECT {LISTED} FROM memories ORDER BY created_at DESC, id LIMIT 5")
def mem_recent5(s, d):
    return _listed(listing.list_memories(mem(s, d), limit=5))


@query(f"WITH {MEM} SELECT id, substr(content, 1, 300) AS content FROM memories")
def mem_search_view(s, d):
    return listing.search_view(mem(s, d)).select("id", "content")


@query(f"WITH {MEM} SELECT id AS memory_id, memory_type, status, asset_id, facility_id, source_type, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, CAST(importance AS DOUBLE) AS importance, CAST(confidence AS DOUBLE) AS confidence FROM memories")
def vec_payload(s, d):
    return listing.vector_payload(mem(s, d))


@query(f"""WITH {MEM} SELECT CASE grouping(status, memory_type) WHEN 1 THEN 'status' WHEN 2 THEN 'memory_type' ELSE 'total' END AS grouping, coalesce(status, memory_type, '') AS value, count(*) AS n
FROM memories GROUP BY GROUPING SETS ((status), (memory_type), ())""")
def mem_stats(s, d):
    return listing.stats(mem(s, d))


@query(f"WITH {MEM} SELECT status, count(*) AS n FROM memories GROUP BY status")
def mem_by_status(s, d):
    return listing.count_by(mem(s, d), "status")


@query(f"WITH {MEM} SELECT memory_type, count(*) AS n FROM memories GROUP BY memory_type")
def mem_by_type(s, d):
    return listing.count_by(mem(s, d), "memory_type")


BROKEN = """SELECT id, CASE WHEN doc_id % 40 = 1 THEN '  ' ELSE title END AS title, CASE WHEN doc_id % 50 = 2 THEN '' ELSE content END AS content, CASE WHEN doc_id % 60 = 3 THEN NULL ELSE source_type END AS source_type,
CAST(confidence AS DOUBLE) + CASE WHEN doc_id % 30 = 4 THEN 1 ELSE 0 END AS confidence, CAST(importance AS DOUBLE) - CASE WHEN doc_id % 35 = 5 THEN 1 ELSE 0 END AS importance,
CASE WHEN doc_id % 45 = 6 THEN 'rumour' ELSE memory_type END AS memory_type, CASE WHEN doc_id % 55 = 7 THEN 'gone' ELSE supersedes_memory_id END AS supersedes_memory_id FROM memories"""


@query(f"""WITH {MEM}, b AS ({BROKEN})
SELECT id, 'blank_title' AS rule FROM b WHERE trim(coalesce(title, '')) = '' UNION ALL SELECT id, 'blank_content' FROM b WHERE trim(coalesce(content, '')) = '' UNION ALL SELECT id, 'blank_source_type' FROM b WHERE trim(coalesce(source_type, '')) = ''
UNION ALL SELECT id, 'range_confidence' FROM b WHERE NOT coalesce(confidence BETWEEN 0 AND 1, false) UNION ALL SELECT id, 'range_importance' FROM b WHERE NOT coalesce(importance BETWEEN 0 AND 1, false)
UNION ALL SELECT id, 'type_domain' FROM b WHERE memory_type = 'rumour' UNION ALL SELECT id, 'orphan_link' FROM b WHERE supersedes_memory_id IS NOT NULL AND supersedes_memory_id NOT IN (SELECT id FROM b)""")
def mem_violations(s, d):
    return listing.violations(s.sql(BROKEN.replace("FROM memories", "FROM {memories}"), memories=mem(s, d)))


@query(f"WITH {MEM} SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['ops', 'eng'] WHEN doc_id % 3 = 1 THEN ['eng'] ELSE [] END AS access_roles FROM memories) WHERE list_contains(access_roles, 'ops')")
def mem_role_filter(s, d):
    roles = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("ops"), F.lit("eng"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("eng"))).otherwise(F.array().cast("array<string>"))
    return listing.with_role(mem(s, d).withColumn("access_roles", roles), "ops").select("doc_id")


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7")
def mem_json_filter(s, d):
    return listing.json_equals(s.read.parquet(f"{d}/events.parquet"), "props", "$.k", "long", 7).select("event_id")


@query(f"WITH {MEM}, {OUT} SELECT id FROM outbox WHERE memory_id NOT IN (SELECT id FROM memories WHERE status <> 'archived')")
def outbox_orphans(s, d):
    return listing.orphans(derived.outbox(s, d), mem(s, d).where("status <> 'archived'"), "memory_id").select("id")


@query(f"""WITH {MEM} SELECT id, memory_type, status, title, content, asset_id, component_id, incident_id, source_type, source_id, created_at, CAST(confidence AS DOUBLE) AS confidence, CAST(importance AS DOUBLE) AS importance,
is_synthetic, tenant_id, facility_id, team_id, CASE WHEN doc_id % 3 = 0 THEN 'ops,eng' ELSE '' END AS access_roles, supersedes_memory_id, CAST(NULL AS TIMESTAMP) AS observed_at, CAST(NULL AS TIMESTAMP) AS updated_at, CAST(NULL AS VARCHAR) AS memory_metadata FROM memories""")
def mem_response(s, d):
    roles = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("ops"), F.lit("eng")))
    return listing.response(mem(s, d).withColumn("access_roles", roles)).withColumn("access_roles", F.array_join("access_roles", ","))


@query(f"WITH {MEM} SELECT id, CAST(2 AS BIGINT) AS n FROM memories WHERE doc_id % 9 = 0")
def mem_duplicates(s, d):
    m = mem(s, d).select("id", "doc_id")
    return listing.duplicates(m.union(m.where("doc_id % 9 = 0")), "id")


@query(f"WITH {MEM} SELECT memory_type, count(*) AS n FROM memories GROUP BY memory_type ORDER BY n DESC, memory_type LIMIT 3")
def mem_top_types(s, d):
    return listing.count_by(mem(s, d), "memory_type").orderBy(F.desc("n"), "memory_type").limit(3)


@query(f"WITH {MEM} SELECT id FROM memories WHERE memory_type = 'incident' AND facility_id = 'facility-en'")
def mem_explorer(s, d):
    return listing.explorer(mem(s, d), memory_type="incident", facility_id="facility-en", status="", asset_id=None).select("id")


@query(f"""WITH {OUT}, c AS (SELECT memory_id, projection_type, CASE WHEN count_if(status IN ('completed', 'failed')) > 0 THEN CASE WHEN count_if(status = 'failed') = 0 THEN 'healthy' ELSE 'down' END END AS status FROM outbox GROUP BY ALL)
SELECT memory_id, CASE WHEN bool_and(coalesce(status = 'healthy', true)) THEN 'healthy' ELSE 'degraded' END AS status FROM c GROUP BY memory_id""")
def mem_health(s, d):
    """Each memory's projections by what became of their events; one without an event that is through has no status."""
    ended, failed = (F.count_if(F.col("status").isin(*of)) for of in (("completed", "failed"), ("failed",)))
    status = F.when(ended > 0, F.when(failed == 0, "healthy").otherwise("down"))
    parts = derived.outbox(s, d).groupBy("memory_id", F.col("projection_type").alias("name")).agg(status.alias("status"))
    return listing.health(parts, "memory_id")


@query(rf"""WITH {MEM} SELECT doc_id, regexp_matches(lower(id), '^[0-9a-f]{{8}}-([0-9a-f]{{4}}-){{3}}[0-9a-f]{{12}}$') AS id_is_uuid, false AS title_is_uuid, 'a|' || title AS ids, doc_id % 3 <> 0 AS zoned, CASE WHEN doc_id % 2 = 0 THEN created_at ELSE TIMESTAMP '2030-01-01 00:00:00' END AS stamped FROM memories""")
def text_functions(s, d):
    at = F.concat(F.lit("2024-01-01T00:00:00"), F.when(F.col("doc_id") % 3 == 1, "Z").when(F.col("doc_id") % 3 == 2, "+02:00").otherwise(""))
    ids = F.array_join(C.split_ids(F.concat(F.lit(" a, ,"), "title", F.lit(" ,"))), "|")
    stamped = C.time_or_now(F.when(F.col("doc_id") % 2 == 0, F.col("created_at")), datetime(2030, 1, 1))
    return mem(s, d).select("doc_id", C.is_uuid("id").alias("id_is_uuid"), C.is_uuid("title").alias("title_is_uuid"), ids.alias("ids"), C.is_tz_aware(at).alias("zoned"), stamped.alias("stamped"))


@query("SELECT 'memories' AS name, CAST(22 AS BIGINT) AS n_columns, count(*) AS n_rows FROM documents UNION ALL SELECT 'outbox', 9, count(*) FROM events")
def ddl_tables(s, d):
    """Tables made by their schema, twice, then filled with the derived rows and read by that schema."""
    base, told = jobs.scratch(s, "ddl"), []
    for name, schema, rows in (("memories", MEMORY_SCHEMA, mem(s, d)), ("outbox", OUTBOX_SCHEMA, derived.outbox(s, d))):
        for _ in range(2):  # the second call finds the table
            table = store.ensure(s, f"{base}/{name}", schema)
        own = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema])
        own.write.mode("append").parquet(f"{base}/{name}")
        told.append(store.ensure(s, f"{base}/{name}", schema).agg(F.lit(name).alias("name"), F.lit(len(table.columns)).cast("long").alias("n_columns"), F.count("*").alias("n_rows")))
    return told[0].union(told[1])


# --- versioned records ------------------------------------------------------------------------------------------------
LATEST = """lt AS (SELECT id, CASE WHEN doc_id % 7 = 0 THEN concat('second ', title) ELSE title END AS title, CASE WHEN doc_id % 5 = 0 THEN 'archived' ELSE status END AS status FROM memories WHERE doc_id % 11 <> 0)"""


def _log(s, d) -> DataFrame:
    """A log on disk: inserts, then updates, a partial update and deletes."""
    path, m = jobs.scratch(s, "log"), mem(s, d).select("id", "title", "status", "doc_id")
    store.ensure(s, path, "id string, title string, status string, version long, deleted boolean")
    rows = lambda df: df.select("id", "title", "status")
    put = lambda df: df.write.mode("append").parquet(path)
    put(store.versions(rows(m), 1))
    put(store.versions(rows(m.where("doc_id % 7 = 0").withColumn("title", F.concat(F.lit("second "), "title"))), 2))
    put(store.patched(s.read.parquet(path), m.where("doc_id % 5 = 0").select("id", F.lit("archived").alias("status"), F.lit(None).cast("string").alias("title")), 3))
    put(store.tombstones(s.read.parquet(path), m.where("doc_id % 11 = 0").select("id").union(s.sql("select 'nowhere'")), 4))
    return s.read.parquet(path)


@query(f"WITH {MEM}, {LATEST} SELECT * FROM lt")
def store_latest(s, d):
    return store.latest(_log(s, d))


@query(f"WITH {MEM}, {LATEST} SELECT * FROM lt WHERE id IN ('00000000-0000-4000-8000-000000000007', '00000000-0000-4000-8000-000000000010', '00000000-0000-4000-8000-000000000011')")
def store_lookup(s, d):
    return store.lookup(_log(s, d), [f"00000000-0000-4000-8000-{i:012d}" for i in (7, 10, 11)])


@query(f"WITH {MEM}, {LATEST} SELECT * FROM lt WHERE status = 'archived'")
def store_matching(s, d):
    return store.matching(_log(s, d), status="archived", title=None)


@query(f"WITH {MEM} SELECT CAST(v AS BIGINT) AS version, v = 4 AS deleted, count(*) AS n FROM (SELECT doc_id, unnest([1, 2, 3, 4]) AS v FROM memories) WHERE v = 1 OR (v = 2 AND doc_id % 7 = 0) OR (v = 3 AND doc_id % 5 = 0) OR (v = 4 AND doc_id % 11 = 0) GROUP BY v")
def store_versions(s, d):
    return _log(s, d).groupBy("version", "deleted").agg(F.count("*").alias("n"))


@query("SELECT event_id AS id, user_id, event_type FROM events")
def jdbc_roundtrip(s, d):
    """A JDBC table written and read in ranges; the embedded database lives in the driver, so local mode only."""
    url, driver = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("ID"), F.col("user_id").alias("USER_ID"), F.col("event_type").alias("EVENT_TYPE"))
    rows.write.format("jdbc").option("url", url).option("dbtable", "EVENTS").options(**driver).save()
    low, high = rows.agg(F.min("ID"), F.max("ID")).first()
    back = store.read_jdbc(s, url, "EVENTS", "ID", 4, low, high + 1, **driver)
    return back.toDF("id", "user_id", "event_type")


# --- lifecycle --------------------------------------------------------------------------------------------------------
_OPS = "(VALUES ('archive', 'archived'), ('dispute', 'disputed'), ('supersede', 'superseded'), ('restore', 'active')) o(op, target)"
_OK = "((status = 'active' AND target IN ('archived', 'disputed', 'superseded')) OR (status = 'disputed' AND target IN ('archived', 'active')))"


@query(f"WITH {MEM} SELECT id, status, op, CASE WHEN {_OK} THEN target ELSE status END AS new_status, {_OK} AS accepted, CAST(CASE WHEN {_OK} THEN 200 ELSE 409 END AS INT) AS code FROM memories, {_OPS}")
def lifecycle_transitions(s, d):
    ops = F.explode(F.array(*[F.lit(o) for o in ("archive", "dispute", "supersede", "restore")]))
    return lifecycle.transition(mem(s, d).select("id", "status", ops.alias("op"))).select("id", "status", "op", "new_status", "accepted", "code")


@query(f"""WITH RECURSIVE {MEM}, {CMD}, c AS (SELECT commands.id, seq, op, target, row_number() OVER (PARTITION BY commands.id ORDER BY seq) AS k FROM commands JOIN {_OPS} USING (op)),
r AS (SELECT id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, '' AS op, status AS before, status AS after, false AS accepted FROM memories
UNION ALL SELECT c.id, c.k, c.seq, c.op, r.after, CASE WHEN {_OK.replace('status', 'r.after').replace('target', 'c.target')} THEN c.target ELSE r.after END, {_OK.replace('status', 'r.after').replace('target', 'c.target')} FROM r JOIN c ON c.id = r.id AND c.k = r.k + 1)
SELECT seq, id, op, before, after, accepted FROM r WHERE k > 0""")
def lifecycle_fold(s, d):
    return lifecycle.fold(mem(s, d), derived.commands(s, d))


PATCHES = "SELECT id, CASE WHEN doc_id % 3 = 0 THEN concat('renamed ', title) END AS title, CASE WHEN doc_id % 4 = 0 THEN 'asset-new' END AS asset_id FROM {m} WHERE doc_id % 2 = 0"


@query(f"""WITH {MEM}, p AS ({PATCHES.format(m='memories')}) SELECT memories.id, coalesce(p.title, memories.title) AS title, coalesce(p.asset_id, memories.asset_id) AS asset_id, p.title IS NOT NULL AS needs_reembed
FROM memories LEFT JOIN p ON p.id = memories.id""")
def patch_apply(s, d):
    m = mem(s, d)
    return lifecycle.apply_patch(m, s.sql(PATCHES.format(m="{m}"), m=m)).select("id", "title", "asset_id", "needs_reembed")


@query(f"""WITH {MEM} SELECT id, field, CASE WHEN field = 'status' THEN 'lifecycle' ELSE 'invalid_data' END AS error, CAST(CASE WHEN field = 'status' THEN 409 ELSE 422 END AS INT) AS code
FROM (SELECT id, unnest(CASE WHEN doc_id % 2 = 0 THEN ['title', 'status'] ELSE ['nonsense'] END) AS field FROM memories) WHERE field <> 'title'""")
def patch_errors(s, d):
    fields = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("title"), F.lit("x"), F.lit("status"), F.lit("archived"))).otherwise(F.create_map(F.lit("nonsense"), F.lit("1")))
    return lifecycle.patch_errors(mem(s, d).select("id", fields.alias("fields")))


_CAND = """c AS (SELECT doc_id, concat('c', substr(id, 2, 35)) AS id, CASE WHEN doc_id % 12 = 1 THEN '  ' ELSE concat(' ', title, ' ') END AS title, text AS content, 'operator' AS source_type, CAST(confidence AS DOUBLE) + CASE WHEN doc_id % 30 = 4 THEN 1 ELSE 0 END AS confidence, CAST(importance AS DOUBLE) AS importance, memory_type, created_at FROM memories JOIN documents USING (doc_id))"""
_BAD = r"CASE WHEN trim(title) = '' THEN 'title is blank' WHEN regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') = '' THEN 'content is blank' WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence is out of range' END"


def _created(s, d):
    title = F.when(F.col("doc_id") % 12 == 1, "  ").otherwise(F.concat(F.lit(" "), "title", F.lit(" ")))
    extra = F.when(F.col("doc_id") % 30 == 4, 1).otherwise(0)
    rows = mem(s, d).select(F.concat(F.lit("c"), F.substring("id", 2, 35)).alias("id"), title.alias("title"), "content", F.lit("operator").alias("source_type"), (F.col("confidence").cast("double") + extra).alias("confidence"), F.col("importance").cast("double").alias("importance"), "memory_type", "created_at")
    return lifecycle.create(rows)


@query(rf"WITH {MEM}, {_CAND} SELECT id, trim(title) AS title, 'active' AS status, created_at AS updated_at FROM c WHERE {_BAD} IS NULL")
def create_rows(s, d):
    return _created(s, d)[0].select("id", "title", "status", "updated_at")


@query(rf"WITH {MEM}, {_CAND} SELECT id AS memory_id, unnest(['vector', 'graph']) AS projection_type, 'pending' AS status, CAST(0 AS INT) AS retry_count FROM c WHERE {_BAD} IS NULL")
def create_outbox(s, d):
    return _created(s, d)[1].select("memory_id", "projection_type", "status", "retry_count")


@query(rf"WITH {MEM}, {_CAND} SELECT id, {_BAD} AS error, CAST(422 AS INT) AS code FROM c WHERE {_BAD} IS NOT NULL")
def create_refused(s, d):
    return _created(s, d)[2]


@query(rf"WITH {MEM} SELECT id, CASE WHEN doc_id % 6 = 0 THEN 'title is blank' WHEN regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') = '' THEN 'content is blank' ELSE 'importance is out of range' END AS error FROM memories WHERE doc_id % 2 = 0 AND (doc_id % 6 = 0 OR doc_id % 10 = 0 OR regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') = '')")
def patch_validation(s, d):
    m = mem(s, d).withColumn("importance", F.col("importance").cast("double"))
    patches = m.where("doc_id % 2 = 0").select("id", F.when(F.col("doc_id") % 6 == 0, " ").alias("title"), F.when(F.col("doc_id") % 10 == 0, 1.5).alias("importance"))
    return lifecycle.patched_errors(m, patches)


def _replacements(m: DataFrame) -> DataFrame:
    new = m.where("doc_id % 4 = 1").select(F.col("id").alias("old_id"), F.concat(F.lit("f"), F.substring("id", 2, 35)).alias("id"), "memory_type", F.when(F.col("doc_id") % 12 == 1, " ").otherwise(F.concat(F.lit(" new "), "title")).alias("title"), "content", "source_type", "confidence", "importance")
    return new


_SUP = f"""WITH {MEM}, r AS (SELECT id AS old_id, concat('f', substr(id, 2, 35)) AS id, status, CASE WHEN doc_id % 12 = 1 OR trim(coalesce(content, '')) = '' THEN 'invalid_data' WHEN status <> 'active' THEN 'lifecycle' END AS error, concat('new ', title) AS title FROM memories WHERE doc_id % 4 = 1)"""


@query(_SUP + " SELECT id, 'active' AS status, title, old_id AS supersedes_memory_id FROM r WHERE error IS NULL UNION ALL SELECT m.id, 'superseded', m.title, m.supersedes_memory_id FROM memories m JOIN r ON r.old_id = m.id WHERE r.error IS NULL")
def supersede_rows(s, d):
    m = mem(s, d)
    return lifecycle.supersede(m, _replacements(m))[0].select("id", "status", "title", "supersedes_memory_id")


@query(_SUP + " SELECT old_id, id, error, CAST(CASE error WHEN 'lifecycle' THEN 409 ELSE 422 END AS INT) AS code FROM r WHERE error IS NOT NULL")
def supersede_errors(s, d):
    m = mem(s, d)
    return lifecycle.supersede(m, _replacements(m))[1]


@query(f"WITH {MEM} SELECT n.id AS new_id, o.id AS old_id, o.status AS old_status FROM memories n JOIN memories o ON n.supersedes_memory_id = o.id")
def supersede_lineage(s, d):
    m = mem(s, d)
    old = m.select(F.col("id").alias("old_id"), F.col("status").alias("old_status"))
    return lifecycle.lineage(m).join(old, "old_id").select("new_id", "old_id", "old_status")


@query(f"WITH RECURSIVE {MEM}, c AS (SELECT id, supersedes_memory_id AS at, 1 AS depth FROM memories WHERE supersedes_memory_id IS NOT NULL UNION ALL SELECT c.id, m.supersedes_memory_id, depth + 1 FROM c JOIN memories m ON m.id = c.at WHERE m.supersedes_memory_id IS NOT NULL) SELECT id, CAST(max(depth) AS INT) AS depth FROM c GROUP BY id")
def lineage_chain_depth(s, d):
    return graph.lineage_depth(mem(s, d))


# --- vectors ----------------------------------------------------------------------------------------------------------
HASH = "list_transform(range(32), lambda i: CAST(CAST(concat('0x', substr(sha256({t}), CAST(2 * i + 1 AS BIGINT), 2)) AS INTEGER) AS DOUBLE) / CAST(128 AS DOUBLE) - 1)"
IDX = "idx AS MATERIALIZED (SELECT id AS memory_id, " + HASH.format(t="concat_ws(' ', nullif(title, ''), nullif(content, ''))") + " AS v FROM memories WHERE status <> 'superseded')"
ASK = "ask AS MATERIALIZED (SELECT doc_id AS query_id, " + HASH.format(t="coalesce(content, '')") + " AS v FROM memories WHERE doc_id % 50 = 0)"
SEM = "sem AS MATERIALIZED (SELECT query_id, memory_id, list_cosine_similarity(ask.v, idx.v) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(ask.v, idx.v) DESC, memory_id) AS INT) AS rank FROM ask, idx QUALIFY rank <= 10)"
VEC = "SELECT q.vec_id AS query_id, c.vec_id AS memory_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) DESC, c.vec_id) AS INT) AS rank FROM embeddings q, embeddings c WHERE {where} QUALIFY rank <= 10"
_rounded = lambda df: df.withColumn("score", F.round("score", 6)).select("query_id", "memory_id", "score", "rank")


def _vectors(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("memory_id"), F.col("embedding").alias("v"), "label")


def _asked(vectors, every):
    return vectors.where(F.col("memory_id") % every == 0).select(F.col("memory_id").alias("query_id"), "v")


@query(VEC.format(where="q.vec_id = 0"))
def vec_topk(s, d):
    v = _vectors(s, d)
    return _rounded(vector.search(v.where("memory_id = 0").select(F.col("memory_id").alias("query_id"), "v"), v))


@query(VEC.format(where="q.vec_id % 50 = 0"))
def vec_topk_batched(s, d):
    v = _vectors(s, d)
    return _rounded(vector.search(_asked(v, 50), v))


@query(VEC.format(where="q.vec_id % 50 = 0 AND c.label IN (1, 2, 3)"))
def vec_topk_filtered(s, d):
    v = _vectors(s, d)
    return _rounded(vector.search(_asked(v, 50), vector.filtered(v, among={"label": [1, 2, 3]})))


@query()
def vec_topk_lsh(s, d):
    v = _vectors(s, d)
    return _rounded(vector.approximate_search(_asked(v, 50), v))


def _questions(m: DataFrame) -> DataFrame:
    return m.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("content").alias("text"), F.lit(None).cast("string").alias("anchor"))


@query(f"WITH {MEM}, {IDX}, {ASK}, {SEM} SELECT query_id, memory_id, round(score, 6) AS score, rank FROM sem")
def hash_embedding_topk(s, d):
    m = mem(s, d)
    asked = _questions(m).select("query_id", C.hash_embedding("text", 32).alias("v"))
    return _rounded(vector.search(asked, vector.build_index(m)))


@query(f"WITH {MEM} SELECT id AS memory_id FROM memories WHERE status <> 'superseded' AND (doc_id % 6 = 0 OR doc_id % 25 = 1)")
def index_changed(s, d):
    m = mem(s, d)
    later = m.withColumn("title", F.when(F.col("doc_id") % 6 == 0, F.concat("title", F.lit(" again"))).otherwise(F.col("title")))
    return vector.changed_since(vector.build_index(m.where("doc_id % 25 <> 1")), later).select("memory_id")


@query(f"WITH {MEM} SELECT id AS memory_id, CAST(length(concat_ws(' ', nullif(title, ''), nullif(content, ''))) AS DOUBLE) AS v1 FROM memories WHERE status <> 'superseded'")
def index_own_embedding(s, d):
    lengths = lambda text, dim: F.array(F.length(text).cast("double"))
    return vector.build_index(mem(s, d), 1, lengths).select("memory_id", F.col("v")[0].alias("v1"))


# --- graph ------------------------------------------------------------------------------------------------------------
_TENANT = "coalesce(nullif(tenant_id, ''), 'global')"
EDG = "edges AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT id AS memory_id, '{rel}' AS rel, '{label}' AS label, concat({_TENANT}, ':{kind}:', {c}) AS entity_key, {c} AS external_id FROM memories WHERE nullif({c}, '') IS NOT NULL" for rel, label, kind, c in graph.OWNED_EDGES
) + f" UNION ALL SELECT id, 'SOURCED_FROM', 'Source', concat({_TENANT}, ':source:', source_type, coalesce(concat(':', nullif(source_id, '')), '')), coalesce(nullif(source_id, ''), source_type) FROM memories WHERE nullif(source_type, '') IS NOT NULL)"
# concat skips nulls there, so the source's tail is spelled with ||
EDG = EDG.replace("coalesce(concat(':', nullif(source_id, '')), '')", "coalesce(':' || nullif(source_id, ''), '')")


@query(f"WITH {MEM}, {EDG} SELECT rel, count(*) AS n, count(DISTINCT entity_key) AS keys FROM edges GROUP BY rel")
def graph_edges_by_rel(s, d):
    return graph.edges(mem(s, d)).groupBy("rel").agg(F.count("*").alias("n"), F.countDistinct("entity_key").alias("keys"))


@query(f"WITH {MEM}, {EDG} SELECT entity_key, arg_min(label, memory_id) AS label, arg_min(external_id, memory_id) AS external_id, count(DISTINCT memory_id) AS members FROM edges GROUP BY entity_key")
def graph_entities(s, d):
    return graph.entities(graph.edges(mem(s, d)))


@query(f"WITH {MEM}, {EDG} SELECT memory_id, count(*) AS degree FROM edges GROUP BY memory_id")
def graph_degree(s, d):
    return graph.edges(mem(s, d)).groupBy("memory_id").agg(F.count("*").alias("degree"))


@query(f"WITH {MEM} SELECT id AS memory_id, memory_type, status, tenant_id, created_at FROM memories")
def graph_nodes(s, d):
    return graph.nodes(mem(s, d))


def reach_sql(hops: int, limit: int, anchors: str = "anchors", x: str = "") -> str:
    """CTEs that end in rel(query_id, memory_id, rank); ``x`` ends their names."""
    parts = [f"lk{x} AS MATERIALIZED (SELECT DISTINCT memory_id, 'e' || entity_key AS node FROM edges UNION SELECT unnest([id, supersedes_memory_id]), 's' || id || supersedes_memory_id FROM memories WHERE supersedes_memory_id IS NOT NULL)", f"f0{x} AS MATERIALIZED (SELECT DISTINCT query_id, anchor AS memory_id, unnest(['e', 's']) AS kind FROM {anchors} WHERE anchor IN (SELECT id FROM memories))"]
    for h in range(1, hops + 1):
        parts.append(f"f{h}{x} AS MATERIALIZED (SELECT DISTINCT query_id, b.memory_id, kind FROM f{h - 1}{x} f JOIN lk{x} a ON a.memory_id = f.memory_id AND a.node[1] = kind JOIN lk{x} b ON b.node = a.node)")
    union = " UNION ".join(f"SELECT query_id, memory_id FROM f{h}{x}" for h in range(1, hops + 1))
    parts.append(f"rel{x} AS MATERIALIZED (SELECT u.query_id, u.memory_id, CAST(row_number() OVER (PARTITION BY u.query_id ORDER BY u.memory_id) AS INT) AS rank FROM ({union}) u JOIN {anchors} n ON n.query_id = u.query_id WHERE u.memory_id <> n.anchor QUALIFY rank <= {limit})")
    return ", ".join(parts)


ANC = "anchors AS (SELECT doc_id AS query_id, id AS anchor FROM memories WHERE doc_id % 50 = 0)"


def _related(hops: int, limit: int):
    def run(s: SparkSession, d: str) -> DataFrame:
        m = mem(s, d)
        return graph.related(m.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("id").alias("anchor")), m, hops, limit)

    return run


for _name, _hops, _limit in (("graph_related_1hop", 1, 50), ("graph_related_2hop", 2, 50), ("graph_related_3hop", 3, 100), ("graph_related_batched", 2, 1_000_000_000)):
    QUERIES[_name] = _related(_hops, _limit)
    ORACLES[_name] = f"WITH {MEM}, {EDG}, {ANC}, {reach_sql(_hops, _limit)} SELECT query_id, memory_id, rank FROM rel"

# --- retrieval --------------------------------------------------------------------------------------------------------
BEST = "best AS MATERIALIZED (SELECT query_id, memory_id AS anchor FROM sem WHERE rank = 1)"
MERGED = """merged AS (SELECT coalesce(sem.query_id, rel.query_id) AS query_id, coalesce(sem.memory_id, rel.memory_id) AS memory_id, score,
CASE WHEN sem.memory_id IS NOT NULL AND rel.memory_id IS NOT NULL THEN 'hybrid' WHEN sem.memory_id IS NOT NULL THEN 'semantic' ELSE 'graph' END AS retrieval_source, CASE WHEN rel.memory_id IS NOT NULL THEN 'graph_expansion' END AS graph_path
FROM sem FULL JOIN rel ON sem.query_id = rel.query_id AND sem.memory_id = rel.memory_id),
hits AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(nullif(score, 0), -1) DESC, score IS NULL, memory_id) AS INT) AS rank FROM merged QUALIFY rank <= {n})"""
HYBRID = f"{MEM}, {EDG}, {IDX}, {ASK}, {SEM}, {BEST}, {reach_sql(2, 50, 'best')}"
SHOWN = "SELECT query_id, memory_id, round(score, 6) AS score, retrieval_source, graph_path, rank, title IS NOT NULL AS hydrated, title FROM hits LEFT JOIN memories ON id = memory_id"


def _retrieved(m: DataFrame, queries: DataFrame, mode: str) -> DataFrame:
    hits = retrieval.hydrate(retrieval.retrieve(queries, m, mode), m)
    return hits.select("query_id", "memory_id", F.round("score", 6).alias("score"), "retrieval_source", "graph_path", "rank", "hydrated", "title")


@query(f"WITH {HYBRID}, {MERGED.format(n=20)} {SHOWN}")
def retrieve_hybrid(s, d):
    m = mem(s, d)
    return _retrieved(m, _questions(m), "hybrid")


@query(f"WITH {MEM}, {IDX}, {ASK}, {SEM}, hits AS (SELECT query_id, memory_id, score, 'semantic' AS retrieval_source, CAST(NULL AS VARCHAR) AS graph_path, rank FROM sem) {SHOWN}")
def retrieve_semantic(s, d):
    m = mem(s, d)
    return _retrieved(m, _questions(m), "semantic")


@query(f"WITH {MEM}, {EDG}, {ANC}, {reach_sql(2, 50)}, hits AS (SELECT query_id, memory_id, CAST(NULL AS DOUBLE) AS score, 'graph' AS retrieval_source, 'graph_expansion' AS graph_path, rank FROM rel WHERE rank <= 20) {SHOWN}")
def retrieve_graph(s, d):
    m = mem(s, d)
    return _retrieved(m, _questions(m).withColumn("anchor", F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("query_id").cast("string"), 12, "0"))), "graph")


@query(f"WITH {MEM}, {IDX}, {ASK}, {SEM}, hits AS (SELECT query_id, memory_id, score, 'semantic' AS retrieval_source, CAST(NULL AS VARCHAR) AS graph_path, rank FROM sem) {SHOWN}")
def retrieve_without_graph(s, d):
    m = mem(s, d)
    hits = retrieval.hydrate(retrieval.retrieve(_questions(m), m, "hybrid", missing=("graph",)), m)
    return hits.select("query_id", "memory_id", F.round("score", 6).alias("score"), "retrieval_source", "graph_path", "rank", "hydrated", "title")


@query(f"WITH {MEM}, {EDG}, {ANC}, {reach_sql(1, 20)}, hits AS (SELECT query_id, memory_id, CAST(NULL AS DOUBLE) AS score, 'graph' AS retrieval_source, 'graph_expansion' AS graph_path, rank FROM rel) {SHOWN}")
def retrieve_without_vectors(s, d):
    m = mem(s, d)
    asked = m.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("content").alias("text"), F.col("id").alias("anchor"))
    hits = retrieval.hydrate(retrieval.retrieve(asked, m, "hybrid", graph_limit=20, hops=1, missing=("semantic",)), m)
    return hits.select("query_id", "memory_id", F.round("score", 6).alias("score"), "retrieval_source", "graph_path", "rank", "hydrated", "title")


@query("""SELECT *, CASE WHEN mode NOT IN ('semantic', 'graph', 'hybrid') THEN 'mode' WHEN "limit" NOT BETWEEN 1 AND 50 THEN 'limit' WHEN hops NOT BETWEEN 1 AND 5 THEN 'hops' WHEN context NOT BETWEEN 1 AND 10 THEN 'context' WHEN related_limit NOT BETWEEN 1 AND 100 THEN 'related_limit' END AS error
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'semantic' WHEN 1 THEN 'graph' WHEN 2 THEN 'hybrid' ELSE 'other' END AS mode, event_id % 60 AS "limit", event_id % 7 AS hops, event_id % 13 AS context, event_id % 110 AS related_limit FROM events)""")
def request_bounds(s, d):
    mode = F.get(F.array(*[F.lit(x) for x in ("semantic", "graph", "hybrid", "other")]), (F.col("event_id") % 4).cast("int"))
    rows = s.read.parquet(f"{d}/events.parquet").select("event_id", mode.alias("mode"), *[(F.col("event_id") % n).alias(c) for c, n in (("limit", 60), ("hops", 7), ("context", 13), ("related_limit", 110))])
    return retrieval.request_errors(rows)


@query(f"WITH {HYBRID}, {MERGED.format(n=5)} SELECT query_id, memory_id, title, substr(content, 1, 300) AS content, retrieval_source, round(score, 6) AS score, rank FROM hits JOIN memories ON id = memory_id")
def tool_retrieval(s, d):
    m = mem(s, d)
    return agent.retrieval_tool(_questions(m), m).withColumn("score", F.round("score", 6))


@query(f"WITH {MEM}, {EDG}, {ANC}, {reach_sql(2, 20)} SELECT query_id, memory_id, rank FROM rel")
def tool_graph(s, d):
    m = mem(s, d)
    return agent.graph_tool(m.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("id").alias("anchor")), m)


EVI = "ev AS (SELECT * FROM (SELECT hits.*, m.memory_type, m.title, m.content, m.asset_id, m.facility_id, m.confidence, m.importance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS n FROM hits JOIN memories m ON m.id = memory_id) WHERE n <= 5)"
_BLOCK = r"concat('[Memory ', n, ': ', memory_id, ']', chr(10), 'Type: ', memory_type, ' | Source: ', retrieval_source, ' | Confidence: ', format('{:.2f}', CAST(confidence AS DOUBLE)), ' | Importance: ', format('{:.2f}', CAST(importance AS DOUBLE)), chr(10), 'Asset: ', coalesce(nullif(asset_id, ''), 'N/A'), ' | Facility: ', coalesce(nullif(facility_id, ''), 'N/A'), chr(10), 'Title: ', coalesce(title, ''), chr(10), 'Content: ', coalesce(content, ''))"
_Q = lambda t: t.replace("'", "''").replace("\n", "' || chr(10) || '")
PROMPT = f"""pr AS (SELECT q.doc_id AS query_id, q.content AS user_prompt, '{_Q(rag.PREAMBLE)}' || coalesce(b, '{rag.NO_EVIDENCE}') || '{_Q(rag.CLOSING)}' AS system_prompt, CAST(coalesce(k, 0) AS INT) AS n_evidence
FROM memories q LEFT JOIN (SELECT query_id, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY n) AS b, count(*) AS k FROM ev GROUP BY query_id) e ON e.query_id = q.doc_id WHERE q.doc_id % 50 = 0)"""
RAG = f"{HYBRID}, {MERGED.format(n=5)}, {EVI}, {PROMPT}"


def _evidence(m: DataFrame, queries: DataFrame) -> DataFrame:
    return rag.evidence(retrieval.hydrate(retrieval.retrieve(queries, m, final_limit=5), m))


@query(f"WITH {RAG} SELECT query_id, n, memory_id, retrieval_source, round(score, 6) AS score, title, asset_id, facility_id, CAST(confidence AS DOUBLE) AS confidence FROM ev")
def rag_evidence(s, d):
    m = mem(s, d)
    rows = _evidence(m, _questions(m))
    return rows.select("query_id", "n", "memory_id", "retrieval_source", F.round("score", 6).alias("score"), "title", "asset_id", "facility_id", F.col("confidence").cast("double").alias("confidence"))


@query(f"WITH {RAG} SELECT query_id, n, memory_id, memory_type, title, substr(content, 1, 300) AS preview, retrieval_source, round(score, 6) AS score FROM ev")
def rag_evidence_view(s, d):
    m = mem(s, d)
    return rag.evidence_view(_evidence(m, _questions(m))).withColumn("score", F.round("score", 6))


@query(f"WITH {RAG} SELECT query_id, length(system_prompt) || ':' || substr(coalesce(user_prompt, ''), 1, 40) AS answer, CAST(NULL AS VARCHAR) AS error, 'echo' AS model_name, true AS timed FROM pr")
def rag_provider(s, d):
    m = mem(s, d)
    told = rag.generate(rag.prompts(_questions(m), _evidence(m, _questions(m))).drop("evidence_ids"), rag.provider("echo"), "echo")
    return told.select("query_id", "answer", "error", "model_name", (F.col("elapsed_ms") >= 0).alias("timed"))


@query(f"WITH {RAG} SELECT query_id, user_prompt, system_prompt, n_evidence FROM pr")
def rag_prompt(s, d):
    m = mem(s, d)
    return rag.prompts(_questions(m), _evidence(m, _questions(m))).drop("evidence_ids")


@query(f"""WITH {RAG} SELECT query_id, CAST((length(system_prompt) - length(replace(system_prompt, '[Memory', ''))) // 7 + (length(system_prompt) - length(replace(system_prompt, 'Memory ID', ''))) // 9 AS INT) AS mentions,
CAST(len(list_filter(regexp_split_to_array(system_prompt, '\\s+'), lambda x: x <> '')) + len(list_filter(regexp_split_to_array(coalesce(user_prompt, ''), '\\s+'), lambda x: x <> '')) AS INT) AS prompt_tokens FROM pr""")
def rag_answer_tokens(s, d):
    m = mem(s, d)
    told = agent.answer(_questions(m), m)
    mentions = F.regexp_extract("answer", r"Based on (\d+) ", 1).cast("int")
    return told.select("query_id", mentions.alias("mentions"), "prompt_tokens")


_NS = "len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda x: x <> ''))"
_ANSWER = "'[SYNTHETIC RESPONSE] Based on ' || CAST((length(system_prompt) - length(replace(system_prompt, '[Memory', ''))) // 7 + (length(system_prompt) - length(replace(system_prompt, 'Memory ID', ''))) // 9 AS INT) || ' retrieved memory records, this addresses: ' || substr(coalesce(user_prompt, ''), 1, 200) || chr(10) || 'Findings are deterministic and derive from the context alone.'"
TRACES = rf"""{HYBRID}, {MERGED.format(n=10)}, {EVI}, {PROMPT}, first AS MATERIALIZED (SELECT query_id, memory_id AS anchor FROM hits WHERE rank = 1), {reach_sql(2, 20, "first", "w")},
told AS (SELECT query_id, n_evidence, {_ANSWER} AS answer FROM pr), ci AS (SELECT *, len(regexp_extract_all(answer, '\[Memory\s+(\d+)\]', 1)) AS nc, len(list_filter(list_transform(regexp_extract_all(answer, '\[Memory\s+(\d+)\]', 1), lambda x: CAST(x AS BIGINT)), lambda x: x < 1 OR x > n_evidence)) AS nb FROM told),
tr AS (SELECT query_id, n_evidence > 0 AND nb = 0 AND nc > 0 AS is_supported, CASE WHEN n_evidence = 0 THEN 0 ELSE greatest(0, least(1, 1 - nb * CAST(0.3 AS DOUBLE) - CASE WHEN nc = 0 THEN CAST(0.2 AS DOUBLE) ELSE 0 END)) END AS confidence,
{{'retrieval': (SELECT count(*) FROM hits h WHERE h.query_id = ci.query_id), 'graph_traversal': (SELECT count(*) FROM relw r WHERE r.query_id = ci.query_id), 'generation': CAST({_NS.format(t='answer')} AS BIGINT), 'critic': CAST(CASE WHEN n_evidence = 0 THEN 0 ELSE nc END AS BIGINT)}} AS ns,
(SELECT string_agg(memory_id, ',' ORDER BY rank) FROM hits h WHERE h.query_id = ci.query_id) AS evidence_ids FROM ci)"""


@query(f"WITH {TRACES} SELECT query_id, step, CASE step WHEN 'retrieval' THEN ns.retrieval WHEN 'graph_traversal' THEN ns.graph_traversal WHEN 'generation' THEN ns.generation ELSE ns.critic END AS n, is_supported, confidence FROM tr, (VALUES ('retrieval'), ('graph_traversal'), ('generation'), ('critic')) k(step)")
def agent_trace_steps(s, d):
    m = mem(s, d)
    return agent.run_workflow(_questions(m), m).withColumn("step", F.explode("steps")).select("query_id", "step.step", "step.n", "is_supported", "confidence")


@query(f"WITH {TRACES} SELECT query_id, coalesce(evidence_ids, '') AS evidence_ids, CAST(5 AS INT) AS n_steps, 'review' AS last_step FROM tr")
def agent_trace_evidence(s, d):
    m = mem(s, d)
    traces = agent.append_step(agent.run_workflow(_questions(m), m), "review", 1)
    return traces.select("query_id", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.size("steps").alias("n_steps"), F.element_at("steps", -1)["step"].alias("last_step"))


@query(f"WITH {MEM} SELECT doc_id AS query_id FROM memories WHERE doc_id % 50 = 0 ORDER BY created_at DESC, doc_id DESC LIMIT 5")
def agent_recent_traces(s, d):
    m = mem(s, d)
    when = m.select(F.col("doc_id").alias("query_id"), "created_at")
    stored = agent.store_traces(agent.run_workflow(_questions(m), m).join(when, "query_id"), jobs.scratch(s, "traces"))
    return agent.recent_stored(stored).select("query_id")


# --- critic and evaluation --------------------------------------------------------------------------------------------
ANSWERS = "SELECT doc_id, concat(content, ' This first claim is backed by [Memory ', CAST(doc_id % 7 AS STRING), ']. This second claim is not backed by anything at all! See [Memory 1]?') AS answer, CAST(doc_id % 6 AS INT) AS n_evidence FROM {m} WHERE content IS NOT NULL"
_SENT = r"list_filter(list_transform(regexp_split_to_array(answer, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_CITED = r"list_transform(regexp_extract_all(answer, '\[Memory\s+(\d+)\]', 1), lambda x: CAST(x AS BIGINT))"
ANS = f"a AS ({ANSWERS.format(m='memories')}), t AS (SELECT *, {_SENT} AS st, {_CITED} AS ci FROM a)"


def _answers(s, d):
    return s.sql(ANSWERS.format(m="{m}"), m=mem(s, d))


@query(rf"""WITH {MEM}, {ANS}, u AS (SELECT *, len(ci) AS nc, len(list_filter(ci, lambda x: x < 1 OR x > n_evidence)) AS nb, list_filter(st, lambda x: length(x) > 30 AND NOT regexp_matches(x, '\[Memory\s+\d+\]') AND NOT regexp_matches(lower(x), 'insufficient|not provided|synthetic|deterministic')) AS cl FROM t)
SELECT doc_id, CAST(CASE WHEN n_evidence = 0 THEN 0 ELSE nc END AS INT) AS n_cited, CAST(CASE WHEN n_evidence = 0 THEN 0 ELSE nb END AS INT) AS n_invalid, n_evidence = 0 OR nb = 0 AS citations_valid, n_evidence > 0 AND nb = 0 AND nc > 0 AS is_supported,
round(CASE WHEN n_evidence = 0 THEN 0 ELSE greatest(0, least(1, 1 - nb * CAST(0.3 AS DOUBLE) - CASE WHEN nc = 0 THEN CAST(0.2 AS DOUBLE) ELSE 0 END)) END, 6) AS confidence,
CASE WHEN n_evidence = 0 THEN '' ELSE array_to_string(list_transform(cl[1:5], lambda x: substr(x, 1, 100)), '|') END AS claims FROM u""")
def critic_verify(s, d):
    v = rag.verify(_answers(s, d))
    return v.select("doc_id", "n_cited", "n_invalid", "citations_valid", "is_supported", F.round("confidence", 6).alias("confidence"), F.array_join("unsupported_claims", "|").alias("claims"))


@query(rf"WITH {MEM}, {ANS}, g AS (SELECT doc_id, list_filter(st, lambda x: length(x) > 30) AS l FROM t) SELECT doc_id, round(CASE WHEN len(l) = 0 THEN 1 ELSE len(list_filter(l, lambda x: regexp_matches(x, '\[Memory\s+\d+\]'))) / CAST(len(l) AS DOUBLE) END, 6) AS groundedness FROM g")
def eval_groundedness(s, d):
    return _answers(s, d).select("doc_id", F.round(evaluation.groundedness("answer"), 6).alias("groundedness"))


@query(f"WITH {MEM}, {ANS} SELECT doc_id, round(CASE WHEN n_evidence = 0 OR len(ci) = 0 THEN 1 ELSE len(list_filter(ci, lambda x: x BETWEEN 1 AND n_evidence)) / CAST(len(ci) AS DOUBLE) END, 6) AS accuracy FROM t")
def eval_citation(s, d):
    return _answers(s, d).select("doc_id", F.round(evaluation.citation_accuracy("answer", "n_evidence"), 6).alias("accuracy"))


CASES = f"""ask AS MATERIALIZED (SELECT item_id AS query_id, {HASH.format(t="coalesce(text, '')")} AS v FROM benchmark), {SEM}, {BEST}, {reach_sql(2, 50, 'best')}, {MERGED.format(n=10)},
found AS (SELECT 'semantic' AS mode, query_id, memory_id, rank FROM sem UNION ALL SELECT 'hybrid', query_id, memory_id, rank FROM hits),
ret AS MATERIALIZED (SELECT mode, query_id, list(memory_id ORDER BY rank) AS retrieved FROM found GROUP BY mode, query_id),
ex AS (SELECT query_id, retrieved AS r FROM ret WHERE mode = 'semantic'),
cs AS (SELECT b.item_id AS case_id, md.mode, coalesce(b.text, '') || ' See [Memory 2] and [Memory 99].' AS answer, coalesce(retrieved, []) AS retrieved,
CASE WHEN b.item_id % 4 = 0 THEN [] WHEN b.item_id % 4 = 1 THEN [r[3], 'x'] WHEN b.item_id % 4 = 2 THEN ['x'] ELSE [r[7], r[1]] END AS expected, b.item_id % 9 = 8 AS failed
FROM benchmark b CROSS JOIN (VALUES ('semantic'), ('hybrid')) md(mode) LEFT JOIN ret ON ret.query_id = b.item_id AND ret.mode = md.mode LEFT JOIN ex ON ex.query_id = b.item_id)"""
EVAL = rf"""{MEM}, {EDG}, {IDX}, {CASES}, w AS (SELECT *, {_SENT} AS st, {_CITED} AS ci FROM cs),
e AS (SELECT case_id, mode, expected, failed,
CASE WHEN failed THEN 0 WHEN len(expected) = 0 THEN 1 ELSE len(list_filter(expected, lambda x: list_contains(retrieved[1:5], x))) / CAST(len(expected) AS DOUBLE) END AS recall,
CASE WHEN failed THEN 0 ELSE coalesce(CAST(1 AS DOUBLE) / list_min(list_filter(list_transform(expected, lambda x: list_position(retrieved, x)), lambda p: p > 0)), 0) END AS mrr,
CASE WHEN failed THEN 0 WHEN len(list_filter(st, lambda x: length(x) > 30)) = 0 THEN 1 ELSE len(list_filter(st, lambda x: length(x) > 30 AND regexp_matches(x, '\[Memory\s+\d+\]'))) / CAST(len(list_filter(st, lambda x: length(x) > 30)) AS DOUBLE) END AS groundedness,
CASE WHEN failed THEN 0 WHEN len(retrieved) = 0 THEN 1 ELSE len(list_filter(ci, lambda x: x BETWEEN 1 AND len(retrieved))) / CAST(len(ci) AS DOUBLE) END AS citation_accuracy FROM w),
f AS (SELECT *, NOT failed AND (recall > 0 OR len(expected) = 0) AS success FROM e),
res AS (SELECT case_id, mode, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(groundedness, 6) AS groundedness, round(citation_accuracy, 6) AS citation_accuracy, success, CASE WHEN success THEN 'no_failure' WHEN failed THEN 'provider_failure' ELSE 'retrieval_failure' END AS failure_category FROM f)"""


#: The same with the time that each case's answer took, by the provider's clock.
TIMED = EVAL.replace("md.mode, coalesce(b.text", "md.mode, CAST(b.item_id % 50 AS DOUBLE) AS latency_ms, coalesce(b.text").replace("SELECT case_id, mode, ", "SELECT case_id, mode, latency_ms, ")


class _Provider:
    """Of a prompt "case|text": the text with two citations, after case % 50 ms of a clock of its own, so that what is
    measured can be told beforehand; every ninth case finds the provider down."""

    now = 0.0

    def clock(self) -> float:
        return self.now

    def __call__(self, system: str, user: str) -> str:
        case, _, text = user.partition("|")
        self.now += int(case) % 50 / 1000
        if int(case) % 9 == 8:
            raise RuntimeError("provider is down")
        return text + " See [Memory 2] and [Memory 99]."


def _results(s, d, timed: bool = False, searcher=None, modes: tuple[str, ...] = ("semantic", "hybrid")):
    """Every case retrieved and answered under each mode. Latencies are of the answers, by the provider's clock; with
    ``timed`` they are of retrieval and answer, by this machine's."""
    b, m = s.read.parquet(f"{d}/benchmark.parquet"), mem(s, d)
    asked = b.select(F.col("item_id").alias("query_id"), "text", F.lit(None).cast("string").alias("anchor"))
    listed = lambda mode: retrieval.retrieve(asked, m, mode, final_limit=10, searcher=searcher).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "memory_id")))["memory_id"].alias("retrieved"))  # noqa: E731  10 at most
    found = {mode: evaluation.measured(listed(mode), asked) for mode in modes}
    r, kind, x = (lambda i: F.get("r", F.lit(i))), F.col("item_id") % 4, F.lit("x")
    expected = F.when(kind == 0, F.array().cast("array<string>")).when(kind == 1, F.array(r(2), x)).when(kind == 2, F.array(x)).otherwise(F.array(r(6), r(0)))
    wanted = b.join(found["semantic"].select(F.col("query_id").alias("item_id"), F.col("retrieved").alias("r")), "item_id", "left").select("item_id", "text", expected.alias("expected"))
    cases = None
    for mode, rows in found.items():
        own = wanted.join(rows.withColumnRenamed("query_id", "item_id"), "item_id", "left").select(
            F.col("item_id").alias("case_id"), F.lit(mode).alias("mode"), F.lit("").alias("system_prompt"), F.concat_ws("|", F.col("item_id").cast("string"), F.coalesce("text", F.lit(""))).alias("user_prompt"),
            F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"), "expected", F.coalesce("retrieval_ms", F.lit(0.0)).alias("retrieval_ms"),
        )
        cases = own if cases is None else cases.union(own)
    provider = _Provider()
    told = rag.generate(cases, provider, "cited") if timed else rag.generate(cases, provider, "cited", provider.clock)
    out = evaluation.evaluate(told.withColumn("latency_ms", F.col("elapsed_ms") + F.col("retrieval_ms") if timed else F.col("elapsed_ms")))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" and not (timed and c == "latency_ms") else F.col(c) for c, t in out.dtypes])


@query(f"WITH {TIMED} SELECT * FROM res")
def eval_recall_mrr(s, d):
    return _results(s, d)


@query(f"WITH {TIMED} SELECT count(*) AS total_cases, CAST(count_if(NOT success) AS BIGINT) AS failed_cases, round(1 - count_if(NOT success) / CAST(count(*) AS DOUBLE), 6) AS success_rate, round(avg(recall), 6) AS mean_recall, round(avg(mrr), 6) AS mean_mrr, round(avg(groundedness), 6) AS mean_groundedness, round(avg(citation_accuracy), 6) AS mean_citation_accuracy, round(avg(latency_ms), 6) AS mean_latency_ms FROM res")
def eval_run_summary(s, d):
    out = evaluation.summary(_results(s, d))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(f"WITH {EVAL} SELECT failure_category, count(*) AS n FROM res GROUP BY failure_category")
def eval_taxonomy(s, d):
    return evaluation.taxonomy(_results(s, d))


# --- working memory and promotion -------------------------------------------------------------------------------------
@query(f"WITH {WRK} SELECT session_id, seq, item_type, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS b FROM items) WHERE b <= 3")
def wm_bounded(s, d):
    return working.bounded(derived.working_items(s, d), 3).select("session_id", "seq", "item_type", "place")


@query(f"WITH {WRK} SELECT session_id, seq FROM items WHERE item_type = 'agent_step'")
def wm_by_type(s, d):
    return working.of_type(derived.working_items(s, d), "agent_step").select("session_id", "seq")


@query(f"WITH {WRK} SELECT session_id, count(*) AS n FROM items GROUP BY session_id")
def wm_sizes(s, d):
    return working.sizes(derived.working_items(s, d))


_PASS = "confidence >= CAST(0.6 AS DOUBLE) AND importance >= CAST(0.4 AS DOUBLE)"


@query(rf"WITH {WRK} SELECT session_id, seq, {_PASS} AND regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') <> '' AS promote, {_PASS} AND length(regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g')) > 10 AS page_promote FROM items")
def promotion_decisions(s, d):
    rows = derived.working_items(s, d).withColumn("title", F.col("item_type"))
    return rows.select("session_id", "seq", working.should_promote().alias("promote"), working.page_promotes().alias("page_promote"))


@query(rf"WITH {WRK} SELECT session_id, seq, item_type AS title, 'active' AS status, 'threshold' AS reason, concat('m', seq, ',', 'm0') AS evidence, 'chat' AS origin FROM items WHERE {_PASS} AND regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') <> ''")
def promotion_records(s, d):
    rows = derived.working_items(s, d).withColumn("title", F.col("item_type")).withColumn("promotion_reason", F.lit("threshold"))
    rows = rows.withColumn("evidence_memory_ids", F.array(F.concat(F.lit("m"), "seq"), F.lit("m0"))).withColumn("metadata", F.create_map(F.lit("origin"), F.lit("chat"), F.lit("promotion_reason"), F.lit("old")))
    out = working.promoted(rows)
    return out.select("session_id", "seq", "title", "status", F.col("metadata")["promotion_reason"].alias("reason"), F.col("metadata")["evidence_memory_ids"].alias("evidence"), F.col("metadata")["origin"].alias("origin"))


@query(f"WITH {WRK} SELECT session_id, seq, 'observation' AS item_type, 'radio' AS source, CAST(0.7 AS DOUBLE) AS confidence, CAST(0.5 AS DOUBLE) AS importance FROM items WHERE item_type = 'user_input' UNION ALL SELECT session_id, seq, 'retrieved_evidence', 'retrieval', NULL, NULL FROM items WHERE item_type = 'agent_step' AND session_id <> 1")
def wm_typed(s, d):
    items = derived.working_items(s, d)
    seen = working.observation(working.of_type(items, "user_input"), "radio", 0.7).drop("content")
    ids = F.array(F.concat(F.lit("m"), "seq"))
    told = working.evidence_item(working.cleared(working.of_type(items, "agent_step"), 1).withColumn("evidence_memory_ids", ids))
    return seen.unionByName(told.drop("content", "evidence_memory_ids"), allowMissingColumns=True)


# --- outbox -----------------------------------------------------------------------------------------------------------
_DONE = "CASE WHEN retry_count >= max_retries THEN 'failed' WHEN succeeds THEN 'completed' WHEN retry_count + 1 >= max_retries THEN 'failed' ELSE 'retrying' END"
_COUNT = "CAST(CASE WHEN retry_count < max_retries AND NOT succeeds THEN retry_count + 1 ELSE retry_count END AS INT)"
_READY = "SELECT * FROM outbox WHERE status IN ('pending', 'retrying')"
BATCH = f"b AS (SELECT id, projection_type, {_DONE} AS new_status, {_COUNT} AS new_retry_count FROM ({_READY} ORDER BY created_at, id LIMIT 50)), p AS (SELECT *, CASE WHEN new_status = 'retrying' THEN 'skipped' ELSE new_status END AS outcome FROM b)"


@query(f"WITH {OUT}, {BATCH} SELECT id, projection_type, new_status, new_retry_count, outcome FROM p")
def outbox_batch(s, d):
    return outbox.process(outbox.take_batch(derived.outbox(s, d))).select("id", "projection_type", "new_status", "new_retry_count", "outcome")


@query(f"WITH {OUT}, {BATCH} SELECT CAST(count_if(outcome = 'completed') AS BIGINT) AS completed, CAST(count_if(outcome = 'failed') AS BIGINT) AS failed, CAST(count_if(outcome = 'skipped') AS BIGINT) AS skipped FROM p")
def outbox_batch_summary(s, d):
    return outbox.summary(outbox.process(outbox.take_batch(derived.outbox(s, d))))


_THERE = f"o AS (SELECT outbox.* EXCLUDE (succeeds), m.id IS NOT NULL AS succeeds, CASE WHEN m.id IS NULL THEN 0 WHEN projection_type = 'vector' THEN CAST(m.status <> 'superseded' AS BIGINT) ELSE coalesce(g.n, 0) END AS written FROM ({_READY}) outbox LEFT JOIN memories m ON m.id = outbox.memory_id LEFT JOIN (SELECT memory_id, count(*) AS n FROM edges GROUP BY memory_id) g ON g.memory_id = outbox.memory_id)"


@query(f"WITH {MEM}, {EDG}, {OUT}, {_THERE} SELECT id, memory_id, projection_type, written, succeeds FROM o")
def outbox_dispatch(s, d):
    return projection.dispatch(outbox.take_batch(derived.outbox(s, d), None), mem(s, d)).select("id", "memory_id", "projection_type", "written", "succeeds")


@query(f"WITH {MEM}, {EDG}, {OUT}, {_THERE} SELECT id, CASE WHEN retry_count >= max_retries THEN 'failed' WHEN succeeds THEN 'completed' ELSE 'failed' END AS status, CAST(CASE WHEN retry_count >= max_retries OR succeeds THEN retry_count ELSE max_retries END AS INT) AS retry_count FROM o")
def outbox_drained(s, d):
    """Batches of the sink, an hour apart, until nothing is due; every attempt looks the memory up and projects it."""
    base = jobs.scratch(s, "drained")
    sink.run_until_done(base, derived.outbox(s, d), mem(s, d), datetime(2030, 1, 1), timedelta(hours=1))
    return sink.states(s, base).select("id", "status", "retry_count")


@query(f"WITH {MEM}, c AS (SELECT * FROM memories WHERE doc_id % 3 = 0) SELECT 'vector' AS projection, true AS ok, NULL AS error, count(*) AS n FROM c WHERE status <> 'superseded' UNION ALL SELECT 'graph', false, 'graph is down', 0 UNION ALL SELECT 'audit', true, NULL, count(*) FROM c")
def projections_apart(s, d):
    """What each projection left, read back, when one of them is down."""

    def down(changes):
        raise RuntimeError("graph is down")

    base = jobs.scratch(s, "projected")
    put = lambda make, name: lambda rows: make(rows).write.parquet(f"{base}/{name}")
    made = {"vector": put(vector.build_index, "vector"), "graph": down, "audit": put(lambda rows: rows.select("id"), "audit")}
    outcome = projection.project_apart(mem(s, d).where("doc_id % 3 = 0"), made)
    read = lambda name: s.read.parquet(f"{base}/{name}").agg(F.lit(name).alias("projection"), F.count("*").alias("n"))
    return outcome.join(read("vector").union(read("audit")), "projection", "left").select("projection", "ok", "error", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {OUT} SELECT status, count(*) AS n FROM outbox GROUP BY status")
def outbox_stats(s, d):
    return listing.count_by(derived.outbox(s, d), "status")


@query(f"WITH {OUT} SELECT status, projection_type, count(*) AS n FROM outbox GROUP BY status, projection_type")
def outbox_stats_by_projection(s, d):
    return listing.count_by(derived.outbox(s, d), "status", "projection_type")


@query(f"WITH {OUT} SELECT count(*) AS total, CAST(count_if(status IN ('pending', 'retrying')) AS BIGINT) AS pending, CAST(count_if(status = 'failed') AS BIGINT) AS failed, CAST(count_if(status = 'completed') AS BIGINT) AS completed FROM outbox")
def outbox_totals(s, d):
    return listing.outbox_totals(derived.outbox(s, d))


@query(f"WITH {MEM}, {OUT}, o AS (SELECT outbox.* REPLACE (outbox.memory_id IN (SELECT id FROM memories) AS succeeds) FROM outbox) SELECT id, {_DONE} AS new_status, {_COUNT} AS new_retry_count FROM o WHERE status IN ('pending', 'retrying')")
def stream_outbox(s, d):
    events = jobs.read_stream(s, d, "events").selectExpr(*[f"{e} AS {n}" for n, e in derived.OUTBOX_COLUMNS.items()]).drop("succeeds")
    told = jobs.drain_outbox(events, mem(s, d), jobs.scratch(s, "outbox"), lambda batch: datetime(2030, 1, 1))
    return told.select("id", F.col("status").alias("new_status"), F.col("retry_count").alias("new_retry_count"))


@query(f"WITH {WRK} SELECT session_id, seq, item_type, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS b FROM items) WHERE b <= 3")
def stream_working_memory(s, d):
    items = jobs.read_stream(s, d, "conversations").selectExpr(*[f"{e} AS {n}" for n, e in derived.WORKING_COLUMNS.items()])
    return stateful.stream_sessions(items, jobs.scratch(s, "working"), 3).select("session_id", "seq", "item_type", "place")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_windows(s, d):
    events = jobs.read_stream(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = jobs.windowed_counts(events, jobs.scratch(s, "windows"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
