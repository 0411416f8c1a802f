"""Which items of a batch are worked on, in which order, and where their outputs go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..operators.scans import ranked


def skip_done(items: DataFrame, outputs: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """Items without all their ``required`` outputs (``key, output``) among the existing ``outputs``."""
    missing = required.join(outputs, [key, "output"], "left_anti").select(key).distinct()
    return items.join(missing, key, "left_semi")


def limit_pending(items: DataFrame, order: list[str], limit: int, by: list[str] | None = None, large: int | None = None) -> DataFrame:
    """Marks pending rows after the first ``limit`` ones as skipped; other rows neither count nor change."""
    if limit <= 0:
        return items
    waits = F.coalesce(F.col("status") == "pending", F.lit(False))
    left = ranked(items.filter(waits), by or [], order, "_seen", large)
    left = left.withColumn("status", F.when(F.col("_seen") > limit, "skipped").otherwise(F.col("status"))).drop("_seen")
    return left.unionByName(items.filter(~waits))


def output_names(items: DataFrame, folder: str, stem: str, order: list[str], large: int | None = None) -> DataFrame:
    """Adds ``output``: the stem, and from the second item of a folder with that stem (case aside) on with _0002 and so on."""
    placed = ranked(items.withColumn("_fold", X.fold(stem)), [folder, "_fold"], order, "_place", large)
    return placed.withColumn("output", F.when(F.col("_place") == 1, F.col(stem)).otherwise(F.concat(F.col(stem), F.format_string("_%04d", "_place")))).drop("_fold", "_place")


def round_robin(items: DataFrame, order: list[str], shares: int, by: list[str] | None = None, large: int | None = None) -> DataFrame:
    """Adds ``share``: rows dealt in turn."""
    return ranked(items, by or [], order, "_place", large).withColumn("share", ((F.col("_place") - 1) % shares).cast("int")).drop("_place")


def failed_first_seen(results: DataFrame, path: str, order: str) -> DataFrame:
    """Paths that failed, each once, in the order they were first seen."""
    bad = results.filter(F.col("status").isin("failed", "unsupported", "error"))
    return bad.groupBy(path).agg(F.min(order).alias("first")).orderBy("first")


def next_run(names: DataFrame, name: str = "name") -> DataFrame:
    """``next``: one more than the highest run number in folder names such as 0007_model or batch_0012_model."""
    number = F.regexp_extract(name, r"^(?:batch_)?(\d{4,})_.+", 1).try_cast("long")
    return names.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def last_status(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last status of each key and its total seconds."""
    return events.groupBy(key).agg(F.max_by("status", order).alias("status"), F.sum("seconds").alias("seconds"))


def progress(items: DataFrame, total: Column, by: list[str] | None = None) -> DataFrame:
    """``processed, skipped, failed, remaining, fraction, eta_s`` of ``status, seconds``: skipped ones don't count for the time."""
    done, skipped, failed = (F.count_if(F.col("status") == s) for s in ("done", "skipped", "failed"))
    mean = F.avg(F.when(F.col("status") != "skipped", F.col("seconds")))
    left = F.greatest(total - (done + skipped + failed), F.lit(0))
    return items.groupBy(*(by or [])).agg(done.alias("processed"), skipped.alias("skipped"), failed.alias("failed"), left.alias("remaining"), F.least(F.lit(1.0), (done + skipped + failed) / total).alias("fraction"), (mean * left).alias("eta_s"))


def keep_newest(files: DataFrame, by: list[str], order: str, keep: int = 14) -> DataFrame:
    """The newest ``keep`` files."""
    return files.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).filter(F.col("_n") <= keep).drop("_n")


def export_outcome(approved: Column, has_media: Column, caption: Column, only_approved: bool = True) -> Column:
    """What becomes of an item in an export: rejected, no_media, skipped (no caption) or exported."""
    first = F.when(~F.coalesce(approved, F.lit(False)), "rejected") if only_approved else F.when(F.lit(False), "")
    return first.when(~has_media, "no_media").when(~F.coalesce(caption, F.lit("")).rlike(r"(?U)\S"), "skipped").otherwise("exported")
