"""Which clips a trainer takes, what it makes of them, and the plan that says so."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numeric as N


def checked_target(name: str, custom_fps: float = 24.0, custom_frames: int = 81) -> dict[str, Any]:
    """A trainer's target by name; ``custom`` takes its rate and its frames from the caller."""
    key = name.strip().lower()
    if key not in N.TRAINER_TARGETS:
        raise ValueError(f"unknown target: {name}")
    known = dict(N.TRAINER_TARGETS[key])
    return known | {"fps": max(0.01, float(custom_fps)), "frames": max(1, int(custom_frames))} if key == "custom" else known


def _size_of(bucket: str | tuple[int, int], target: dict[str, Any]) -> tuple[int, int]:
    if isinstance(bucket, str):
        if bucket.lower() not in target["buckets"]:
            raise ValueError(f"unknown bucket: {bucket}")
        return target["buckets"][bucket.lower()]
    return int(bucket[0]), int(bucket[1])


def clip_fitness(clips: DataFrame, target: str, bucket: str | tuple[int, int], policy: str = "keep_ar", custom_fps: float = 24.0, custom_frames: int = 81) -> DataFrame:
    """Clips (``frames, duration_s, fps, width, height``) with ``available, needed, suggested, ok, pieces, verdict, warnings`` and their ``bucket``.

    A clip with fewer frames than the target needs is dropped; one with twice as many
    or more could be cut; else it is taken with the most frames that the target
    can use. Clips of unknown size have the bucket's own.
    """
    t = checked_target(target, custom_fps, custom_frames)
    key, needed = target.strip().lower(), t["frames"]
    rate = F.coalesce(F.when(F.col("fps") > 0, F.col("fps").cast("double")), F.lit(t["fps"]))
    counted = F.greatest(F.floor(F.coalesce(F.col("duration_s").cast("double"), F.lit(0.0)) * rate + 1e-9), F.lit(0)).cast("long")
    rows = clips.withColumn("available", F.when(F.col("frames") > 0, F.col("frames").cast("long")).otherwise(counted)).withColumn("needed", F.lit(needed).cast("long"))
    rows = rows.withColumn("suggested", N.valid_floor("available", key)).withColumn("ok", F.col("available") >= F.col("needed"))
    rows = rows.withColumn("pieces", F.floor(F.col("available") / needed).cast("long"))
    text = lambda c: c.cast("string")
    a, s = F.col("available"), F.col("suggested")
    verdict = F.when(~F.col("ok"), F.concat(F.lit("will be dropped: "), text(a), F.lit(f"f < {needed}f")))
    verdict = verdict.when(F.col("pieces") >= 2, F.concat(F.lit("sub-split ×"), text(F.col("pieces")), F.lit(" suggested"))).otherwise(F.concat(F.lit("OK "), text(F.coalesce(s, F.col("needed"))), F.lit("f")))
    dropped = F.concat(F.lit("will be dropped by trainer: only "), text(a), F.lit(f" frames, needs {needed}"))
    fewer = F.concat(F.lit("trainer will use "), text(s), F.lit(" valid frames from "), text(a), F.lit(" available"))
    warning = F.when(~F.col("ok"), dropped).when(s.isNotNull() & (s != a), fewer)
    size = _size_of(bucket, t)
    own = F.struct(F.lit(size[0]).cast("long").alias("width"), F.lit(size[1]).cast("long").alias("height"))
    return rows.withColumns({"verdict": verdict, "warnings": F.array_compact(F.array(warning)), "bucket": F.coalesce(N.bucket_size("width", "height", size, policy, t["pixels"]), own)})


def fitness_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by, clips, ready, dropped, split, line`` of checked clips."""
    ready, dropped, split = F.count_if(F.col("ok") & (F.col("pieces") < 2)), F.count_if(~F.col("ok")), F.count_if(F.col("pieces") >= 2)
    out = rows.groupBy(*by).agg(F.count("*").alias("clips"), ready.alias("ready"), dropped.alias("dropped"), split.alias("split"))
    return out.withColumn("line", F.format_string("**%d clips** · %d ready · %d will be dropped · %d sub-split suggestions", "clips", "ready", "dropped", "split"))


def fitness_plan(rows: DataFrame, folder: Column, target: str, bucket: str, policy: str, form: str, version: int = 1) -> DataFrame:
    """``source_folder, json``: the plan of each folder's clips (``path``, relative to it) in order of their paths. A folder's clips make one document: a dataset, not a corpus."""
    item = F.struct(F.col("path").alias("file"), "duration_s", F.col("fps").alias("source_fps"), F.col("available").alias("frames_available"), F.col("needed").alias("frames_needed"), F.col("suggested").alias("suggested_frames"), "verdict", F.array("bucket.width", "bucket.height").alias("bucket"), "warnings")
    items = F.sort_array(F.collect_list(item))
    head = [F.lit(form).alias("format"), F.lit(version).alias("version"), F.col("source_folder"), F.lit(target).alias("trainer_target"), F.lit(bucket).alias("resolution_bucket"), F.lit(policy).alias("resize_policy")]
    grouped = rows.withColumn("source_folder", folder).groupBy("source_folder").agg(items.alias("items"))
    return grouped.select("source_folder", F.to_json(F.struct(*head, "items")).alias("json"))
