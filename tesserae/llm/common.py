"""Helpers that several operators share: written tables, row keys and connected components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.functions.batches import small_batches as small_batches  # the operators' own


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local mode, where it may be unset, one of this process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + os.path.join(tempfile.gettempdir(), f"tesserae-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(place)
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any] = dict) -> Any:
    """What a reused Python worker keeps from one task to the next: only the cache of the operator that ran last.

    Operators without a cache call it as well, so that a worker lets go of what an earlier stage left.
    """
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            _returned()
        _HELD[key] = make()
    return _HELD[key]


def _returned() -> None:
    """Gives freed memory back to the system, which a worker else keeps beside what the next operator needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Shuffle files that only this table needed go once the driver's JVM has collected what refers to them.
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.tesserae_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later plan reads."""
    for df in tables:
        jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df.tesserae_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table, by way of Arrow.

    Spark would read a list in Python workers of its own on every executor, which then stay beside those of the operators.
    """
    kind = StructType.fromDDL(schema)
    columns = zip(*rows, strict=True) if rows else ([] for _ in kind.names)
    return spark.createDataFrame(pa.table(dict(zip(kind.names, map(pa.array, columns), strict=True))), kind)


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def hash_sample(column, share):
    """True for about ``share`` (0 to 1) of the values of ``column``, by hash: no sort, no shuffle, the same each time."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 40)) < F.lit(share) * float(1 << 40)


#: Rows of two numbers that may be broadcast: 32 MB.
SMALL = 2_000_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge table.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type. Returns ``node`` and ``root``, the smallest
    node that it can reach, for every node of an edge. Alternating large-star and small-star rounds until nothing
    changes, a number that grows with the logarithm of the longest path. Each needs a grouped minimum, which is
    combined before the shuffle, and an equi-join: a broadcast one while there are at most SMALL minima, else one
    of two written tables, which adaptive execution splits where a node has very many edges. Every round is
    written to the shared folder.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def lowest(e: DataFrame, rows: int) -> DataFrame:
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        return F.broadcast(least) if rows <= SMALL else written(least, "least")

    now, before = written(tidy(edges), "edges"), None
    rows = now.count()
    while rows:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(lowest(both, 2 * rows), "a").where("b > a")
        large = written(tidy(large.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))), "large")
        least = lowest(large, rows)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(tidy(small.union(large.groupBy("a").agg(F.min("b").alias("b")))), "small")
        discard(now, large)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        rows = state[0]
        # a star forest: each node points once, and nothing points at a node that points on
        if state == before or rows == state[2] and not now.select("b").distinct().join(
            now.select(F.col("a").alias("b")), "b", "left_semi"
        ).take(1):
            break
        before = state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
