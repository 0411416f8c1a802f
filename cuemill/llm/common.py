"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import ship

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch, where the session has Spark's own number: texts may be long, and a batch is held several times over.
BATCH_ROWS, SPARKS_BATCH_ROWS = 1000, "10000"
#: What makes Python workers give freed memory back at once, Arrow's buffers too.
LEAN = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, and Arrow batches that long texts fit."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == SPARKS_BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    ship.ship_package(spark)


def lean_workers(spark: SparkSession) -> None:
    """Have Python workers of what is planned from now on hold no freed memory; what the environment sets itself stays."""
    for key, value in LEAN.items():
        spark.sparkContext.environment.setdefault(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach, as ``spark.checkpoint.dir`` names it.

    Where a session on one machine names none (as in tests), a temporary
    folder is set; on a cluster that is an error, as other machines would not see it.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not known:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cuemill-"))
            known = spark.sparkContext.getCheckpointDir()
        root = known
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/cuemill-{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Spark's own setting by which a query's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage and survives the loss of executors; used where a costly
    result feeds several later jobs. With ``tidy`` the shuffle files that were
    made for it go once it is written.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(CLEANUP, None) if tidy else None
    if before is not None:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again, rather than when the application ends."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)
            df._scratch = None


def sweep(spark: SparkSession) -> None:
    """Have the shuffle files go that nothing can read again: Spark deletes them when its driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores put before those that ``df`` has as columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def give_back() -> None:
    """Return a Python worker's freed memory to the system, where its C library can; workers outlive their tasks."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def doc_hash(seed: str, *cols: str) -> Column:
    """A 64-bit hash that deals rows out evenly and alike in every run."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string")) % modulus


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
