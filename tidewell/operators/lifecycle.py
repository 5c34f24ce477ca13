"""Lifecycle: validation, patches, transitions, supersession, and the fold of command sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.columns import is_blank, is_tz_aware, strip
from tidewell.operators.outbox import enqueue
from tidewell.schemas import ERROR_CODES, ERROR_OTHER, LIFECYCLE_FIELDS, MEMORY_TYPES, MUTABLE, OPERATIONS, REEMBED_FIELDS, TRANSITIONS

STRIPPED = ("title", "content", "source_type")


def transition_table(spark: SparkSession) -> DataFrame:
    """The allowed (status, target) pairs."""
    return spark.createDataFrame(list(TRANSITIONS), "status string, target string")


def target_of(op: Column) -> Column:
    return F.coalesce(*[F.when(op == name, F.lit(status)) for name, status in OPERATIONS.items()])


def allowed(status: Column, target: Column) -> Column:
    pairs = [(status == a) & (target == b) for a, b in TRANSITIONS]
    out = F.lit(False)
    for p in pairs:
        out = out | p
    return F.coalesce(out, F.lit(False))


def http_code(kind: Column) -> Column:
    """200 for no error, else the code of the error's kind."""
    out = F.when(kind.isNull(), F.lit(200))
    for name, code in ERROR_CODES.items():
        out = out.when(kind == name, F.lit(code))
    return out.otherwise(F.lit(ERROR_OTHER))


def transition(rows: DataFrame) -> DataFrame:
    """``rows`` (status, op) with the new status, whether the step is accepted, its error kind and code."""
    target = target_of(F.col("op"))
    ok = allowed(F.col("status"), target)
    kind = F.when(~ok, F.lit("lifecycle"))
    return rows.select("*", F.when(ok, target).otherwise(F.col("status")).alias("new_status"), ok.alias("accepted"), http_code(kind).alias("code"))


def validated(candidates: DataFrame) -> DataFrame:
    """Create commands with stripped texts, forced status and link, and ``error`` (null: fine)."""
    bad = F.coalesce(
        *[F.when(is_blank(c), F.lit(f"{c} is blank")) for c in STRIPPED],
        *[F.when(~F.coalesce(F.col(c).between(0, 1), F.lit(False)), F.lit(f"{c} is out of range")) for c in ("confidence", "importance")],
        *([F.when(~is_tz_aware("observed_at"), F.lit("observed_at has no zone"))] if dict(candidates.dtypes).get("observed_at") == "string" else []),
        F.when(~F.coalesce(F.col("memory_type").isin(*MEMORY_TYPES), F.lit(False)), F.lit("memory_type is unknown")),
    )
    shown = [strip(c).alias(c) if c in STRIPPED else F.col(c) for c in candidates.columns if c not in ("status", "supersedes_memory_id")]
    return candidates.select(*shown, F.lit("active").alias("status"), F.lit(None).cast("string").alias("supersedes_memory_id"), bad.alias("error"))


def apply_patch(memories: DataFrame, patches: DataFrame) -> DataFrame:
    """``memories`` with the non-null columns of ``patches`` (id, ...), and ``needs_reembed``.

    Null can't be written; an unchanged record keeps its row.
    """
    own = [c for c in patches.columns if c != "id"]
    joined = memories.join(patches.select("id", *[F.col(c).alias(f"_{c}") for c in own]), "id", "left")
    touched = F.lit(False)
    for c in own:
        if c in REEMBED_FIELDS:
            touched = touched | F.col(f"_{c}").isNotNull()
    shown = [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in own else F.col(c) for c in memories.columns]
    return joined.select(*shown, touched.alias("needs_reembed"))


def patched_errors(memories: DataFrame, patches: DataFrame) -> DataFrame:
    """(id, error) of the records that a patch would leave invalid: the whole patched record is validated."""
    touched = memories.join(patches.select("id"), "id", "left_semi")
    return validated(apply_patch(touched, patches)).where("error is not null").select("id", "error")


def create(candidates: DataFrame, projections: tuple[str, ...] = ("vector", "graph")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records to write, outbox events to write with them, refused candidates with error and code)."""
    checked = validated(candidates)
    fine = checked.where("error is null").drop("error")
    refused = checked.where("error is not null").select("id", "error", http_code(F.lit("invalid_data")).alias("code"))
    stamped = fine if "updated_at" in fine.columns else fine.withColumn("updated_at", F.col("created_at"))
    return stamped, enqueue(stamped, projections), refused


def patch_errors(patches: DataFrame) -> DataFrame:
    """(id, field, error, code) of a patch given as (id, fields map): lifecycle fields and unknown ones are refused."""
    fields = patches.select("id", F.explode(F.map_keys("fields")).alias("field"))
    kind = F.when(F.col("field").isin(*LIFECYCLE_FIELDS), F.lit("lifecycle")).when(~F.col("field").isin(*MUTABLE), F.lit("invalid_data"))
    return fields.withColumn("error", kind).where("error is not null").withColumn("code", http_code(F.col("error")))


def supersede(memories: DataFrame, replacements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed rows, errors) of replacements (old_id, id and create columns).

    An accepted replacement changes two rows at once: itself, active with a link, and the old row, superseded.
    """
    checked = validated(replacements)
    old = memories.select(F.col("id").alias("old_id"), F.col("status").alias("old_status"))
    found = checked.join(old, "old_id", "left")
    kind = F.when(F.col("error").isNotNull(), "invalid_data").when(F.col("old_status").isNull(), "not_found").when(F.col("old_status") != "active", "lifecycle")
    # of several replacements of one memory the first is taken
    rank = F.row_number().over(W.partitionBy("old_id", kind.isNull()).orderBy("id"))
    judged = found.withColumn("kind", F.coalesce(kind, F.when(rank > 1, "lifecycle")))
    good = judged.where("kind is null")
    columns = memories.columns
    new = good.withColumn("supersedes_memory_id", F.col("old_id"))
    new_rows = new.select(*[F.col(c) if c in new.columns else F.lit(None).alias(c) for c in columns])
    old_rows = memories.join(good.select(F.col("old_id").alias("id")), "id", "left_semi").withColumn("status", F.lit("superseded"))
    errors = judged.where("kind is not null").select("old_id", "id", F.col("kind").alias("error"), http_code(F.col("kind")).alias("code"))
    return new_rows.unionByName(old_rows.select(*columns)), errors


def fold(memories: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands (seq, id, op) in sequence over each memory's status: seq, id, op, before, after, accepted.

    The transition table needs no loop: until a command ends a memory (archive always, supersede while active), its
    status is what the last dispute or restore asked for; from then on nothing is accepted. Windows stream a key's rows
    and spill, so a key with very many commands isn't collected.
    """
    start = memories.select("id", F.col("status").alias("start"))
    rows = commands.join(start, "id")
    past = W.partitionBy("id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    asked = F.when(F.col("op") == "dispute", "disputed").when(F.col("op") == "restore", "active")
    open_start = F.col("start").isin("active", "disputed")
    running = F.coalesce(F.last(asked, ignorenulls=True).over(past), F.col("start"))
    rows = rows.withColumn("running", F.when(open_start, running).otherwise(F.col("start")))
    ends = F.when(open_start & ((F.col("op") == "archive") | ((F.col("op") == "supersede") & (F.col("running") == "active"))), target_of(F.col("op")))
    ended = F.first(ends, ignorenulls=True).over(past)
    before = F.coalesce(ended, F.col("running"))
    rows = rows.withColumn("ends", ends).withColumn("before", before)
    ok = allowed(F.col("before"), target_of(F.col("op")))
    return rows.select("seq", "id", "op", "before", F.when(ok, target_of(F.col("op"))).otherwise(F.col("before")).alias("after"), ok.alias("accepted"))


def final_status(memories: DataFrame, folded: DataFrame) -> DataFrame:
    """(id, status, steps taken) of the memories that had commands."""
    return folded.groupBy("id").agg(F.max_by("after", "seq").alias("status"), F.count_if("accepted").alias("steps"))


def lineage(memories: DataFrame) -> DataFrame:
    """(new_id, old_id) of every supersession."""
    return memories.where("supersedes_memory_id is not null").select(F.col("id").alias("new_id"), F.col("supersedes_memory_id").alias("old_id"))
