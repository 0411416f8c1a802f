"""Pictures and sound as arrays: quality of clips, cuts between scenes, sample rates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import ColumnOrName, col
from .scans import repeated


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(values)


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of one length."""
    return mean_of(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def laplacian_variance(pixels: Column, width: int) -> Column:
    """Variance of a picture's Laplacian (rows of ``width`` grey values; edges mirrored)."""
    n = F.size(pixels)
    at = lambda i: F.get(pixels, i).cast("double")

    def laplace(x: Column, i: Column) -> Column:
        row, column = F.floor(i / width), i % width
        left, right = F.when(column == 0, i + 1).otherwise(i - 1), F.when(column == width - 1, i - 1).otherwise(i + 1)
        up, down = F.when(row == 0, i + width).otherwise(i - width), F.when(i + width >= n, i - width).otherwise(i + width)
        return at(left.cast("int")) + at(right.cast("int")) + at(up.cast("int")) + at(down.cast("int")) - 4 * x.cast("double")

    edges = F.transform(pixels, laplace)
    square = F.aggregate(edges, F.lit(0.0), lambda a, x: a + x * x) / F.size(edges)
    mean = F.aggregate(edges, F.lit(0.0), lambda a, x: a + x) / F.size(edges)
    return square - mean * mean


def frame_features(frames: DataFrame, key: str, order: str, pixels: str, width: int, black: float = 16) -> DataFrame:
    """``key, order, luma, black, sharpness, change`` of grey frames; ``change`` is the mean difference from the frame before, null for the first."""
    before = F.lag(pixels).over(Window.partitionBy(key).orderBy(order))
    p = F.col(pixels)
    dark = F.size(F.filter(p, lambda x: x <= black)) / F.size(p)
    return frames.select(key, order, mean_of(p).alias("luma"), dark.alias("black"), laplacian_variance(p, width).alias("sharpness"), F.when(before.isNotNull(), mean_difference(before, p)).alias("change"))


def clip_quality(features: DataFrame, key: str) -> DataFrame:
    """``mean_luma, black_ratio, static_score, sharpness`` of each clip's frames; a clip of one frame has a static score of 0."""
    return features.groupBy(key).agg(F.avg("luma").alias("mean_luma"), F.avg("black").alias("black_ratio"), F.coalesce(F.avg("change"), F.lit(0.0)).alias("static_score"), F.avg("sharpness").alias("sharpness"))


def scene_cuts(features: DataFrame, key: str, order: str, threshold: float) -> DataFrame:
    """``key, scene, first, last, frames``: runs of frames parted where ``change`` reaches the threshold."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = features.withColumn("scene", F.sum(F.when(F.col("change") >= threshold, 1).otherwise(0)).over(w))
    return numbered.groupBy(key, "scene").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("frames"))


def rolling_ratio(features: DataFrame, key: str, order: str, change: str, width: int = 2) -> DataFrame:
    """Adds ``ratio``: ``change`` over the mean change of the ``width`` frames on either side, 255 at most; null where there are fewer.

    Over neighbours without any change the ratio is 255 for a change and 0 for none.
    """
    w = Window.partitionBy(key).orderBy(order)
    c = F.coalesce(F.col(change), F.lit(0.0))
    near = [f(c, i).over(w) for i in range(1, width + 1) for f in (F.lag, F.lead)]
    mean = sum(near[1:], near[0]) / len(near)
    ratio = F.when(F.abs(mean) < 1e-5, F.when(c > 0, 255.0).otherwise(0.0)).otherwise(F.least(c / mean, F.lit(255.0)))
    return features.withColumn("ratio", F.when(mean.isNotNull(), ratio))


def _folded(rows: DataFrame, key: str, fold: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    """``key, cut`` from a fold over a clip's candidate rows in order: few, as most frames are none."""
    kind = rows.schema[key].dataType.simpleString()

    def one(part: pd.DataFrame) -> pd.DataFrame:
        cuts = fold(part)
        return pd.DataFrame({key: repeated(part[key].iat[0], len(cuts)), "cut": cuts})

    return rows.groupBy(key).applyInPandas(one, f"`{key}` {kind}, cut long")


def spaced(at: list[int], cut: list[int], first: int, least: int) -> tuple[list[int], int]:
    """The cuts whose frames ``at`` are ``least`` or more after that of the cut before (or the first frame), and the last such frame."""
    out, last = [], first
    for a, c in zip(at, cut, strict=True):
        if a - last >= least:
            out.append(c)
            last = a
    return out, last


def merged_flashes(at: list[int], first: int, end: int, least: int) -> list[int]:
    """Cuts at frames of a large change; changes that follow within ``least`` frames of the one before count as one.

    A change that comes ``least`` or more after the last is a cut of its own.
    One that comes earlier begins a run (once there was a cut); the run lasts
    until ``least`` frames after its last change have passed, and is a cut at
    that change if it took ``least`` frames or more, else it goes on.
    """
    if least <= 0:
        return list(at)
    out: list[int] = []
    last, run = first, None
    for a in [*at, None]:
        over = end - last >= least if a is None else a - last > least
        if run is not None and over and last - run >= least:
            out.append(last)
            run = None
        if a is None:
            break
        if run is None and a - last >= least:
            out.append(a)
        elif run is None and out:
            run = a
        last = a
    return out


def _with_ends(rows: DataFrame, features: DataFrame, key: str, order: str) -> DataFrame:
    ends = features.groupBy(key).agg(F.min(order).alias("_first"), F.max(order).alias("_end"))
    return rows.join(ends, key)


def content_cuts(features: DataFrame, key: str, order: str, threshold: float, least: int) -> DataFrame:
    """``key, cut``: frames whose ``change`` reaches the threshold, flashes within ``least`` frames merged."""
    rows = _with_ends(features.filter(F.col("change") >= threshold).select(key, F.col(order).alias("at")), features, key, order)
    return _folded(rows, key, lambda p: merged_flashes(sorted(p["at"]), int(p["_first"].iat[0]), int(p["_end"].iat[0]), least))


def adaptive_cuts(features: DataFrame, key: str, order: str, threshold: float, least: int, width: int = 2, least_change: float = 15.0) -> DataFrame:
    """``key, cut``: frames whose change is ``threshold`` times that of their neighbours, and ``least_change``; ``least`` frames or more apart."""
    rows = rolling_ratio(features, key, order, "change", width).filter((F.col("ratio") >= threshold) & (F.col("change") >= least_change))
    rows = _with_ends(rows.select(key, F.col(order).alias("at")), features, key, order)
    return _folded(rows, key, lambda p: spaced(sorted(p["at"]), sorted(p["at"]), int(p["_first"].iat[0]), least)[0])


def fade_cuts(features: DataFrame, key: str, order: str, threshold: float, least: int, bias: float = 0.0, final: bool = True) -> DataFrame:
    """``key, cut``: the middle (moved by ``bias``, -1 to 1) between a fade to below ``threshold`` of ``luma`` and the return above it.

    Cuts whose returns are not ``least`` frames apart are left out. A clip that
    ends in the dark is cut where that began, if ``final`` and long enough
    after the last return.
    """
    w = Window.partitionBy(key).orderBy(order)
    dark = F.col("luma") < threshold
    before = F.lag(dark).over(w)
    turned = features.select(key, F.col(order).alias("at"), dark.alias("dark"), before.alias("_before"))
    turned = turned.filter((F.col("_before").isNull() & F.col("dark")) | (F.col("dark") != F.col("_before")))
    rows = _with_ends(turned.drop("_before"), features, key, order)

    def fold(p: pd.DataFrame) -> list[int]:
        p = p.sort_values("at")
        first, end, at = int(p["_first"].iat[0]), int(p["_end"].iat[0]), [int(a) for a in p["at"]]
        fades = [(a, b) for a, b, d in zip(at, at[1:], p["dark"], strict=False) if d]
        middle = [int((b + a + int(bias * (b - a))) / 2) for a, b in fades]
        cuts, last = spaced([b for _, b in fades], middle, first, least)
        return cuts + [at[-1]] * bool(final and p["dark"].iat[-1] and end - last >= least)

    return _folded(rows, key, fold)


def scenes(features: DataFrame, key: str, order: str, cuts: DataFrame) -> DataFrame:
    """``key, scene, first, last, frames`` of clips parted before the frames ``cut``; the same cut found twice counts once."""
    marked = features.select(key, order).join(cuts.select(key, F.col("cut").cast(features.schema[order].dataType).alias(order)).distinct().withColumn("_cut", F.lit(1)), [key, order], "left")
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1  # nothing is parted before the first frame
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("_new", F.when(first, 0).otherwise(F.coalesce("_cut", F.lit(0)))).withColumn("scene", F.sum("_new").over(w))
    return numbered.groupBy(key, "scene").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("frames"))


#: The bounds of a fade's threshold beside another detector.
FADE_LEAST, FADE_MOST = 1.0, 100.0


def detect_scenes(features: DataFrame, key: str, order: str, detector: str = "content", threshold: float = 27.0, least: int = 15, fades: float | None = None) -> DataFrame:
    """``scenes`` by the content, adaptive or threshold (fade) detector; with ``fades`` also at fades below that luma, unless they are looked for anyway."""
    found = {"content": content_cuts, "adaptive": adaptive_cuts, "threshold": fade_cuts}
    if detector not in found:
        raise ValueError(f"unknown detector: {detector}")
    cuts = found[detector](features, key, order, max(0.0, threshold), max(1, least))
    if fades is not None and detector != "threshold":
        cuts = cuts.unionByName(fade_cuts(features, key, order, min(max(fades, FADE_LEAST), FADE_MOST), max(1, least)))
    return scenes(features, key, order, cuts)


def resampled(samples: Column, source: int, target: int) -> Column:
    """A waveform at another rate, straight lines between samples, as long as before to the nearest sample."""
    n = F.size(samples)
    size = F.greatest(F.lit(1), F.bround(n * float(target) / source).cast("int"))

    def value(i: Column) -> Column:
        at = F.least(i * float(source) / target, (n - 1).cast("double"))
        low = F.floor(at).cast("int")
        a, b = F.get(samples, low).cast("double"), F.get(samples, F.least(low + 1, n - 1)).cast("double")
        return a + (b - a) * (at - low)

    return samples if source == target else F.when(n > 0, F.transform(F.sequence(F.lit(0), size - 1), value)).otherwise(F.array().cast("array<double>"))


def is_silent(samples: ColumnOrName, peak: float = 0.0) -> Column:
    """Whether no sample of a window is louder than ``peak``."""
    return ~F.exists(col(samples), lambda x: F.abs(x) > peak)
