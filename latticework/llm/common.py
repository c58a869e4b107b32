"""Shared plumbing: table reads, word splitting, and lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where `spark.checkpoint.dir` is unset (tests, a single machine) a temporary folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="latticework-")
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small or medium result by a reliable checkpoint (never a local one).

    A checkpoint is a file for each partition, and making a file costs more than a few rows do, so rows
    are gathered in two partitions a core if shuffles have more. The files go when the returned DataFrame
    is garbage-collected and `spark.cleaner.referenceTracking.cleanCheckpoints` is on.
    """
    spark = df.sparkSession
    shared_dir(spark)
    few = max(2, 2 * spark.sparkContext.defaultParallelism)
    if int(spark.conf.get("spark.sql.shuffle.partitions")) > few:
        df = df.repartition(few)
    return df.checkpoint(eager=True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage of a large result: write Parquet in the shared folder and read it back.

    Compared with `cut`, later reads are columnar and pruned. The caller may drop the folder with
    `drop_written` once every result that reads it has been written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/latticework-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._latticework_path = path  # noqa: SLF001
    return out


def drop_written(df: DataFrame) -> None:
    path = getattr(df, "_latticework_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


class _Tidy:
    """A kernel after which a worker gives memory back, as idle workers stay beside the next stages."""

    def __init__(self, kernel: Callable, tokens: bool):
        self.kernel, self.tokens = kernel, tokens

    def __call__(self, batches):
        if not self.tokens and (module := sys.modules.get(f"{__package__}.tokens")):
            module.Encoder.forget()
        yield from self.kernel(batches)
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def map_arrow(df: DataFrame, kernel: Callable, schema: str, tokens: bool = False) -> DataFrame:
    """`mapInArrow` with this package at hand on the executors; `tokens` says that the kernel uses an `Encoder`."""
    ship(df.sparkSession)
    return df.mapInArrow(_Tidy(kernel, tokens), schema)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files and checkpoints of finished rounds.

    It drops what the driver no longer refers to, but only after a garbage collection there, which a
    driver with little to do may not start for a long time.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hash128(*cols: Column) -> list[Column]:
    """Two 64-bit hashes; together they identify a value among 10^12 others for all purposes."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(0x5BD1E995), *cols).alias("h2")]


def row_key(*cols: Column) -> list[Column]:
    """128-bit hash of a row's columns in which null and empty differ, as `_r1` and `_r2`."""
    safe = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in cols]
    return [h.alias(n) for h, n in zip(hash128(F.struct(*safe)), ("_r1", "_r2"))]


def without(df: DataFrame, gone: DataFrame, *cols: Column, most: int = 200_000) -> DataFrame:
    """df without the rows whose `row_key(*cols)` is in `gone` (_r1, _r2), which goes out if it is small by count."""
    gone = cut(gone.select("_r1", "_r2").distinct())
    own = row_key(*cols)
    return df.join(F.broadcast(gone) if gone.count() <= most else gone, (own[0] == gone["_r1"]) & (own[1] == gone["_r2"]), "left_anti")


def words_of(text: Column) -> Column:
    """All words `[^\\x20\\x09-\\x0D]+` of a text, in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), "")


