"""Projections that are kept up: only the rows of changed memories are deleted and made anew.

A projection is a Parquet table partitioned by a hash bucket of memory_id. After a commit the change feed names the changed
memories; their buckets' rows are read, those of changed memories left out, new ones added, and just these buckets are
overwritten. Files of other buckets stay as they are. The version up to which a projection has followed is written last, so
an update that broke off is simply done again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import settle
from tidewell.sources.manifest import Table

BUCKETS = 64


def bucket():
    return F.pmod(F.xxhash64("memory_id"), F.lit(BUCKETS)).cast("int")


def followed(spark: SparkSession, path: str) -> int:
    """The version of the memories that the projection at ``path`` shows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/followed")
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return 0
    return spark.read.parquet(f"{path}/followed").agg(F.max("version")).first()[0]


def refresh(table: Table, path: str, make: Callable[[DataFrame], DataFrame], columns: list[str] | None = None) -> int:
    """Brings the projection at ``path`` up to the table's last version; the number of memories that changed.

    ``make`` is the projection, from memories to rows with a memory_id. ``columns``: it depends on these of a memory only,
    so a change of others (a status for edges, say) leaves its rows alone.
    """
    spark, now, before = table.spark, table.version(), followed(table.spark, path)
    if now == before:
        return 0
    changed = table.changes(before).select(F.col(table.key).alias("id"))
    if columns is not None and before:
        told = lambda version, name: table.read(version).select("id", F.xxhash64(*columns).alias(name)).join(changed, "id", "left_semi")
        changed = told(now, "_new").join(told(before, "_old"), "id", "full").where(~F.col("_new").eqNullSafe(F.col("_old"))).select("id")
    changed = settle(changed)
    rows = make(table.read(now).drop("version").join(changed, "id", "left_semi")).withColumn("bucket", bucket())
    if before:
        buckets = [r.bucket for r in changed.select(F.col("id").alias("memory_id")).select(bucket().alias("bucket")).distinct().collect()]  # at most BUCKETS
        old = spark.read.schema(rows.schema).parquet(f"{path}/rows").where(F.col("bucket").isin(buckets))
        # settled: these buckets are about to be overwritten, and a bucket all of whose rows went must go too
        rows = settle(old.join(changed.select(F.col("id").alias("memory_id")), "memory_id", "left_anti").unionByName(rows))
        left = {r.bucket for r in rows.select("bucket").distinct().collect()}
        fs_path = spark._jvm.org.apache.hadoop.fs.Path
        for b in set(buckets) - left:
            where = fs_path(f"{path}/rows/bucket={b}")
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
    spark.createDataFrame([(now,)], "version int").coalesce(1).write.mode("append").parquet(f"{path}/followed")
    return changed.count()


def projection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("bucket")
