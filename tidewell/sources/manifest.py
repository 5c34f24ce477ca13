"""Tables of snapshots and deltas, committed by one rename.

A table is a folder of data folders, each written once and partitioned by a hash bucket of the key, and of numbered
manifests. Manifest n lists the data folders that version n of the table consists of, the oldest first. A commit writes its
data folder, then a manifest under a temporary name, and renames that to n + 1, which fails if another writer was there
first. Readers take the highest manifest, so they see all rows of a commit or none, and two writers never both succeed from
the same version.

Rows carry ``version``, the number of the commit that wrote them; the row of a key with the highest version counts. A
look-up reads the key's bucket only, and Parquet's bloom filters on the key skip row groups there. Compaction merges all
folders into one snapshot of the last versions; ``vacuum`` removes folders that no kept manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.lifecycle import http_code
from tidewell.session import settle

BUCKETS = 32


class Conflict(Exception):
    """Another commit has the number that this one needed."""


class Table:
    """A table at ``path`` with rows of ``schema``, keyed by ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _manifests(self) -> list[int]:
        where = self._fs_path(f"{self.path}/manifests")
        if not self._fs.exists(where):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max(self._manifests(), default=0)

    def folders(self, version: int | None = None) -> list[str]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._fs_path(f"{self.path}/manifests/{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["folders"]
        finally:
            stream.close()

    def bucket(self, column="key"):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string") if isinstance(column, str) else column), F.lit(self.buckets)).cast("int")

    def stage(self, rows: DataFrame, version: int) -> str:
        """Writes ``rows`` as a data folder of commit ``version``, which nobody sees yet."""
        name = f"data/{version}-{uuid.uuid4().hex}"
        told = rows if "deleted" in rows.columns else rows.withColumn("deleted", F.lit(False))
        told = told.withColumn("version", F.lit(version).cast("long")) if "version" not in rows.columns else told
        told.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").option("parquet.bloom.filter.enabled#" + self.key, "true").parquet(f"{self.path}/{name}")
        return name

    def publish(self, folders: list[str], version: int) -> int:
        """Makes manifest ``version``; raises ``Conflict`` if there is one."""
        jvm, name = self.spark._jvm, f"{self.path}/manifests/{version}.json"
        part = self._fs_path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(part)
        out.write(bytearray(json.dumps({"version": version, "folders": folders}).encode()))
        out.close()
        try:
            # unlike FileSystem.rename, this fails if the target is there
            none = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf()).rename(part, self._fs_path(name), none)
        except Exception as e:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} is taken") from None
            raise
        return version

    def commit(self, rows: DataFrame, on: int | None = None) -> int:
        """Adds ``rows`` to version ``on`` (the last one for None); raises ``Conflict`` if that isn't the last one."""
        on = self.version() if on is None else on
        return self.publish([*self.folders(on), self.stage(rows, on + 1)], on + 1)

    def log(self, version: int | None = None) -> DataFrame:
        """All row versions, with version, deleted and bucket."""
        folders = [f"{self.path}/{f}" for f in self.folders(version)]
        schema = f"{self.schema}, version long, deleted boolean, bucket int"
        if not folders:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(f) for f in folders]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _last(self, log: DataFrame) -> DataFrame:
        columns = [c for c in log.columns if c not in (self.key, "bucket")]
        return log.groupBy(self.key).agg(F.max_by(F.struct(*columns), "version").alias("r")).where("not r.deleted").select(self.key, *[f"r.{c}" for c in columns if c != "deleted"])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, with the ``version`` that wrote each."""
        return self._last(self.log(version))

    def changes(self, since: int) -> DataFrame:
        """The change feed: keys that commits after ``since`` wrote or deleted."""
        return self.log().where(F.col("version") > since).select(self.key).distinct()

    def lookup(self, keys: list, version: int | None = None) -> DataFrame:
        """The rows of some keys; other buckets' files aren't read."""
        own = self.spark.createDataFrame([(k,) for k in keys], f"{self.key} {dict(self.log(0).dtypes)[self.key]}").select(self.bucket().alias("b")).distinct().collect()
        return self._last(self.log(version).where(F.col("bucket").isin([r.b for r in own]) & F.col(self.key).isin(keys)))

    def compact(self) -> int:
        """One snapshot of the last versions in place of all folders; a commit meanwhile is a ``Conflict``.

        Deletions stay in it, so that the change feed goes on naming them.
        """
        on = self.version()
        log = self.log(on).drop("bucket")
        last = log.groupBy(self.key).agg(F.max_by(F.struct(*log.columns), "version").alias("r")).select("r.*")
        return self.publish([self.stage(last, on + 1)], on + 1)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes data folders that none of the last ``keep`` manifests names, and the manifests before these."""
        numbers = self._manifests()
        kept = {f for n in numbers[-keep:] for f in self.folders(n)}
        for n in numbers[:-keep]:
            self._fs.delete(self._fs_path(f"{self.path}/manifests/{n}.json"), False)
        where = self._fs_path(f"{self.path}/data")
        gone = [f"data/{s.getPath().getName()}" for s in self._fs.listStatus(where) if f"data/{s.getPath().getName()}" not in kept] if self._fs.exists(where) else []
        for name in gone:
            self._fs.delete(self._fs_path(f"{self.path}/{name}"), True)
        return gone

    # --- writes that check ---------------------------------------------------------------------------------------------
    def audited(self, rows: DataFrame, violations: Callable[[DataFrame], DataFrame]) -> tuple[int | None, DataFrame]:
        """Write, audit, publish: (version, violations). Staged rows are checked as they lie there; any violation leaves the table as it was."""
        on = self.version()
        name = self.stage(rows, on + 1)
        staged = self.spark.read.schema(f"{self.schema}, version long, deleted boolean, bucket int").parquet(f"{self.path}/{name}").drop("version", "deleted", "bucket")
        bad = settle(violations(staged))
        if not bad.isEmpty():
            self._fs.delete(self._fs_path(f"{self.path}/{name}"), True)
            return None, bad
        return self.publish([*self.folders(on), name], on + 1), bad

    def patch(self, changes: DataFrame) -> tuple[int | None, DataFrame]:
        """Compare and set: (version, refused) for ``changes`` (key, expected, any columns).

        A change is made to a row whose version is ``expected``; else it is refused as a ``conflict`` (409), or as
        ``not_found``. Of several changes of one row one is taken. Columns that are null stay as they are.
        """
        on = self.version()
        own = [c for c in changes.columns if c not in (self.key, "expected")]
        first = changes.withColumn("_order", F.xxhash64(*changes.columns)).groupBy(self.key).agg(F.min_by(F.struct(*changes.columns), "_order").alias("c"), F.count("*").alias("n"))
        now = self.read(on)
        judged = settle(first.join(now.select(self.key, F.col("version").alias("_version")), self.key, "left"))
        kind = F.when(F.col("_version").isNull(), "not_found").when(F.col("_version") != F.col("c.expected"), "conflict")
        told = judged.select(self.key, kind.alias("error"), F.col("_version").alias("version"), "n", "c")
        good = told.where("error is null").select(self.key, *[F.col(f"c.{c}").alias(f"_{c}") for c in own])
        again = told.where("error is null and n > 1").select(self.key, F.lit("conflict").alias("error"), (F.col("version") + 1).alias("version"), (F.col("n") - 1).alias("n"))
        refused = told.where("error is not null").select(self.key, "error", "version", "n").unionByName(again).withColumn("code", http_code(F.col("error")))
        if good.isEmpty():
            return None, refused
        rows = now.drop("version").join(good, self.key).select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in own else F.col(c) for c in now.columns if c != "version"])
        return self.commit(rows, on), refused

    def claim(self, who: str, now: datetime, lease_s: float, n: int, attempts: int = 20) -> DataFrame:
        """The ``n`` oldest ready rows that nobody has leased, leased to ``who``; for tables with status, created_at, claimed_by and lease_until.

        Another claimer's commit in between makes this one look again, so no row is leased twice at a time. A lease that
        has run out is taken again.
        """
        at = F.lit(now).cast("timestamp_ntz")
        for _ in range(attempts):
            on = self.version()
            free = self.read(on).drop("version").where(F.col("status").isin("pending", "retrying") & (F.col("lease_until").isNull() | (F.col("lease_until") <= at)))
            mine = free.orderBy("created_at", self.key).limit(n).withColumn("claimed_by", F.lit(who)).withColumn("lease_until", at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease_s).cast("decimal(18,6)")))
            mine = settle(mine)
            if mine.isEmpty():
                return mine
            try:
                self.commit(mine, on)
                return mine
            except Conflict:
                continue
        raise Conflict(f"{attempts} other commits came first")
