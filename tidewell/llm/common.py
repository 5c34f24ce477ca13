"""Helpers the training-data operators share: shared work folder, materialised tables, Arrow maps, components."""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.session import shared_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SLICE_BYTES = 4 << 20
_WHITE = re.compile("[\x20\x09-\x0d]")
#: ASCII upper case folded, all other bytes kept.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages survive lost executors and don't recompute it.

    The shuffle files behind the table are dropped once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that no later result reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._work_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def whole(df: DataFrame) -> DataFrame:
    """All columns of ``df`` in one struct column ``document``: working names beside it can't clash with them."""
    return df.select(F.struct("*").alias("document"))


def map_columns(df: DataFrame, schema: str, function: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, object]]], keep: tuple[str, ...] = (), arrow: tuple[str, ...] = (), slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over plain column lists: ``function`` gets {column: list} batches and yields {column: values}.

    Lists hold about ``slice_bytes`` of Arrow data at a time, so that memory doesn't follow the length of the texts.
    Columns in ``arrow`` come as Arrow arrays instead. Columns in ``keep`` go around the function as they are; it then has to yield a row for each row it gets, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around: deque[list[pa.Array]] = deque()

        def lists():
            for b in batches:
                if not b.num_rows:
                    continue
                step = max(1, b.num_rows * slice_bytes // (b.nbytes + 1))
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    around.append([part.column(c) for c in keep])
                    yield {n: c if n in arrow else c.to_pylist() for n, c in zip(part.schema.names, part.columns) if n not in keep}

        for out in function(lists()):
            kept = around.popleft() if keep else []
            yield pa.RecordBatch.from_arrays(kept + [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(out.values(), types)], names=[*keep, *out])
            if not keep:
                around.clear()

    own, types = arrow_types(schema)
    return df.mapInArrow(run, StructType([df.schema[c] for c in keep] + own.fields))


def pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut before white space."""
    at = 0
    while at < len(text):
        cut = _WHITE.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def arrow_types(schema: str) -> tuple[StructType, list[pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    return parsed, [to_arrow_type(f.dataType) for f in parsed.fields]


def crc_bucket(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``edges`` (a, b long) -> (node, component): the smallest node reachable, for every node with an edge to another.

    Alternating large-star and small-star rounds: each halves the depth of the label trees, so rounds grow with the
    logarithm of the longest chain, and every star is built from the minimum over a node's neighbours (combined before
    the shuffle) and a join, never from a collected neighbour list. Each round is written to the shared folder.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    current = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    signature = None
    for _ in range(max_rounds):
        both = current.union(current.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        own = low.where("m < a").select("a", F.col("m").alias("b"))
        star = large.union(own).distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        small = star.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, current = current, materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
        discard(last)
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.countDistinct("a")).first()
        if now[0] == now[2] and now == signature:
            break
        signature = now
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
