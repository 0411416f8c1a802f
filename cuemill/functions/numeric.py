"""Frame counts, resolutions and token budgets as column arithmetic. Rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import ColumnOrName, col, let
from .timecode import fixed

#: Trainer targets. Frame counts are ``multiple * k + offset``.
TRAINER_TARGETS = {
    "wan": {"multiple": 4, "offset": 1, "frames": 81, "fps": 16.0, "min": 5, "max": 129, "recommended": [17, 33, 49, 65, 81, 97, 113, 129], "buckets": {"480p": (832, 480), "720p": (1280, 720)}, "pixels": 16},
    "hunyuan": {"multiple": 4, "offset": 1, "frames": 129, "fps": 24.0, "min": 5, "max": 257, "recommended": [49, 65, 81, 97, 113, 129, 161, 193, 225, 257], "buckets": {"480p": (848, 480), "720p": (1280, 720), "1080p": (1920, 1088)}, "pixels": 16},
    "ltx2": {"multiple": 8, "offset": 1, "frames": 121, "fps": 25.0, "min": 9, "max": 257, "recommended": [9, 17, 25, 33, 41, 49, 65, 81, 97, 121, 129, 161, 193, 225, 257], "buckets": {"480p": (832, 480), "720p": (1280, 720), "1080p": (1920, 1080)}, "pixels": 8},
    "minimax_h3": {"multiple": 17, "offset": 5, "frames": 124, "fps": 24.0, "min": 124, "max": 345, "recommended": list(range(124, 346, 17)), "buckets": {"480p": (832, 480), "720p": (1280, 736), "1080p": (1920, 1088)}, "pixels": 32},
    "custom": {"multiple": 1, "offset": 0, "frames": 1, "fps": 24.0, "min": 1, "max": 100_000, "recommended": [1], "buckets": {"480p": (854, 480), "720p": (1280, 720), "1080p": (1920, 1080)}, "pixels": 2},
}
#: Heights in tiles that are all tried, at most.
FEW_TILES = 100
#: Memory tiers in GB.
MEMORY_TIERS = (6, 8, 10, 12, 16, 24, 32, 48, 80, 96)


def valid_floor(frames: ColumnOrName, target: str) -> Column:
    """The most frames that the target takes out of ``frames``; null below its least."""
    t = TRAINER_TARGETS[target]
    v = F.least(col(frames).cast("long"), F.lit(t["max"]))
    out = F.floor((v - t["offset"]) / t["multiple"]) * t["multiple"] + t["offset"]
    return F.when((v >= t["min"]) & (out >= t["min"]), out)


def frames_available(frames: ColumnOrName, duration_s: ColumnOrName, fps: ColumnOrName, target: str) -> Column:
    """Counted frames if known, else those of the duration at the rate (the target's if unknown)."""
    rate = F.coalesce(F.when(col(fps) > 0, col(fps).cast("double")), F.lit(TRAINER_TARGETS[target]["fps"]))
    return F.when(col(frames) > 0, col(frames)).otherwise(F.greatest(F.floor(F.coalesce(col(duration_s).cast("double"), F.lit(0.0)) * rate + 1e-9), F.lit(0))).cast("long")


def round_dimension(value: Column, multiple: int, most: Column | None = None) -> Column:
    out = F.greatest(F.lit(multiple), F.bround(value / multiple).cast("long") * multiple)
    return out if most is None else F.greatest(F.lit(multiple), F.floor(F.least(out, most) / multiple) * multiple)


def bucket_size(width: ColumnOrName, height: ColumnOrName, bucket: tuple[int, int], policy: str, multiple: int = 2) -> Column:
    """``width, height`` that an image comes to in a resolution bucket, which turns to its orientation.

    keep_ar fits inside, area keeps the bucket's area, letterbox and crop fill the bucket exactly.
    """
    if policy not in {"keep_ar", "letterbox", "crop", "area"}:
        raise ValueError("policy must be 'keep_ar', 'letterbox', 'crop' or 'area'")
    w, h = col(width).cast("double"), col(height).cast("double")
    turned = (w < h) != F.lit(bucket[0] < bucket[1])
    tw, th = F.when(turned, bucket[1]).otherwise(bucket[0]), F.when(turned, bucket[0]).otherwise(bucket[1])
    if policy in {"letterbox", "crop"}:
        ow, oh = tw.cast("long"), th.cast("long")
    elif policy == "area":
        scale = F.sqrt((tw * th) / (w * h))
        ow, oh = round_dimension(w * scale, multiple), round_dimension(h * scale, multiple)
    else:
        scale = F.least(tw / w, th / h)
        ow, oh = round_dimension(w * scale, multiple, tw), round_dimension(h * scale, multiple, th)
    return F.when((w > 0) & (h > 0), F.struct(ow.cast("long").alias("width"), oh.cast("long").alias("height")))


def bucket_padding(width: ColumnOrName, height: ColumnOrName, bucket: tuple[int, int], policy: str, multiple: int = 2) -> Column:
    """``left, top, right, bottom`` that letterbox adds and crop takes; zeros for the other policies."""
    w, h = col(width).cast("double"), col(height).cast("double")
    turned = (w < h) != F.lit(bucket[0] < bucket[1])
    tw, th = F.when(turned, bucket[1]).otherwise(bucket[0]), F.when(turned, bucket[0]).otherwise(bucket[1])
    if policy == "letterbox":
        scale = F.least(tw / w, th / h)
        dx, dy = tw - F.least(tw, round_dimension(w * scale, multiple, tw)), th - F.least(th, round_dimension(h * scale, multiple, th))
    elif policy == "crop":
        scale = F.greatest(tw / w, th / h)
        dx, dy = F.greatest(tw, round_dimension(w * scale, multiple)) - tw, F.greatest(th, round_dimension(h * scale, multiple)) - th
    else:
        dx = dy = F.lit(0)
    left, top = F.floor(dx / 2), F.floor(dy / 2)
    return F.struct(left.cast("long").alias("left"), top.cast("long").alias("top"), (dx - left).cast("long").alias("right"), (dy - top).cast("long").alias("bottom"))


def smart_resize(height: ColumnOrName, width: ColumnOrName, factor: int = 28, min_pixels: int | None = None, max_pixels: int | None = None) -> Column:
    """``height, width`` as multiples of ``factor`` with the pixels in bounds and the shape kept; null beyond a ratio of 200."""
    low, high = min_pixels or 4 * factor * factor, max_pixels or 16384 * factor * factor
    h, w = col(height).cast("double"), col(width).cast("double")
    rh, rw = (F.greatest(F.lit(factor), F.bround(x / factor).cast("long") * factor) for x in (h, w))
    down, up = F.sqrt(h * w / high), F.sqrt(F.lit(float(low)) / (h * w))
    size = [F.when(rh * rw > high, F.greatest(F.lit(factor), F.floor(x / down / factor) * factor)).when(rh * rw < low, F.greatest(F.lit(factor), F.ceil(x * up / factor) * factor)).otherwise(r) for x, r in ((h, rh), (w, rw))]
    fits = (h > 0) & (w > 0) & (F.greatest(h, w) / F.least(h, w) <= 200)
    return F.when(fits, F.struct(size[0].cast("long").alias("height"), size[1].cast("long").alias("width")))


def frame_count(wanted: Column, least: int, most: int, factor: int = 1) -> Column:
    """``wanted`` within bounds, floored to a multiple of ``factor`` (raised to the least one where that falls below)."""
    most = max(least, most)
    n = F.least(F.lit(most), F.greatest(F.lit(least), wanted.cast("long")))
    down = F.floor(n / factor) * factor
    up = min(most, max(least, -(-least // factor) * factor))
    return F.when(down >= least, F.least(F.lit(most), down)).otherwise(up).cast("long")


def sample_times(duration_s: ColumnOrName, source_fps: ColumnOrName, *, fps: float = 2.0, least: int = 4, most: int = 768, factor: int = 2, strategy: str = "fps") -> Column:
    """``n, fps, times``: how many frames are sampled, at what rate and where; null without a duration."""
    d, s = col(duration_s).cast("double"), col(source_fps).cast("double")
    rate = F.least(s, F.lit(max(1e-9, fps)))
    n = frame_count(F.lit(most) if strategy == "uniform" else F.ceil(d * rate), least, most, factor)
    times = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.least(d - 1e-9, i / (n / d)))
    return F.when((d > 0) & (s > 0), F.struct(n.alias("n"), (n / d).alias("fps"), times.alias("times")))


def uniform_indexes(length: ColumnOrName, count: int) -> Column:
    """``count`` evenly spaced places of ``length``, first and last included."""
    n = col(length).cast("long")
    k = F.least(F.lit(count).cast("long"), n)
    return F.when(k <= 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.bround(i * (n - 1) / (k - 1)).cast("long")))


#: Pixels of a token's side and audio tokens a second.
FAMILIES = {"qwen2.5-omni": (28, 25.0), "qwen3-omni": (32, 13.0)}


def token_budget(family: str, frames: ColumnOrName, height: ColumnOrName, width: ColumnOrName, audio_s: ColumnOrName) -> Column:
    """``video, audio, total`` tokens of a clip: two frames make a group of height * width / side² tokens."""
    side, rate = FAMILIES[family]
    groups = F.ceil(F.greatest(col(frames), F.lit(0)) / 2)
    area = F.greatest(col(height), F.lit(1)).cast("double") * F.greatest(col(width), F.lit(1))
    video = F.ceil(groups * (area / float(side * side))).cast("long")
    audio = F.ceil(F.greatest(col(audio_s).cast("double"), F.lit(0.0)) * rate).cast("long")
    return F.struct(video.alias("video"), audio.alias("audio"), (video + audio).alias("total"))


def fits_context(total: Column, context: int, reserve: int) -> Column:
    return total + max(0, reserve) <= max(0, context)


def memory_tier(gb: ColumnOrName) -> Column:
    """The highest tier not above the whole GB (half up); the lowest for less."""
    whole = F.floor(col(gb).cast("double") + 0.5)
    out = F.lit(MEMORY_TIERS[0])
    for tier in MEMORY_TIERS[1:]:
        out = F.when(whole >= tier, tier).otherwise(out)
    return out


def reject_reasons(duration: ColumnOrName, black: ColumnOrName, static: ColumnOrName, sharpness: ColumnOrName, silence: ColumnOrName, has_video: Column, has_audio: Column, *, min_duration: float = 1.0, max_black: float = 0.8, max_static: float = -1.0, min_sharpness: float = 0.0, require_audio: bool = False, max_silence: float = 1.0) -> Column:
    """Why a clip is rejected, with what was measured and the bound, in a fixed order; empty if it is not. Picture rules need a picture, the silence rule sound."""
    d, b, s, h, q = (col(c) for c in (duration, black, static, sharpness, silence))
    measured = lambda said, value, bound, digits=2: F.format_string(said, fixed(value, digits), F.lit(f"{float(bound):.{digits}f}"))
    share = lambda said, value, bound: measured(said, value * 100, 100 * bound, 1)
    none = F.lit(None).cast("string")
    rules = [
        F.when(d + 1e-9 < max(0.0, min_duration), measured("too short (%ss < %ss)", d, min_duration)),
        F.when(has_video & (b > max_black), share("mostly black (%s%% > %s%%)", b, max_black)),
        F.when(has_video & (s <= max_static), measured("too static (frame difference %s <= %s)", s, max_static, 3)) if max_static >= 0 else none,
        F.when(has_video & (h < max(0.0, min_sharpness)), measured("low sharpness (%s < %s)", h, min_sharpness)),
        F.when(~has_audio, "audio track required") if require_audio else none,
        F.when(has_audio & (q > max_silence), share("mostly silent (%s%% > %s%%)", q, max_silence)),
    ]
    return F.array_compact(F.array(*rules))


def silence_ratio(samples: ColumnOrName, window: int, threshold: float = 0.001) -> Column:
    """Share of windows of samples (the last one filled with zeros) whose root mean square is below the threshold; 1 if empty."""
    s = F.coalesce(col(samples), F.array().cast("array<double>"))
    n = F.ceil(F.size(s) / window)
    energy = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda i: F.sqrt(F.aggregate(F.slice(s, (i * window + 1).cast("int"), window), F.lit(0.0), lambda a, x: a + x * x) / window))
    return F.when(F.size(s) == 0, 1.0).otherwise(F.size(F.filter(energy, lambda e: e < threshold)) / n)


def fraction(text: ColumnOrName) -> Column:
    """``30000/1001`` or ``25`` as a number; null for anything else and for a zero below."""
    a, b = F.split(col(text), "/")[0].try_cast("double"), F.get(F.split(col(text), "/"), F.lit(1))
    return F.when(b.isNull(), a).otherwise(F.try_divide(a, b.try_cast("double")))


def _tiles_at(h: Column, least: Column, most: Column, ratio: Column) -> Column:
    """The width in tiles that goes with a height: that of the ratio, within what the areas allow; null where nothing is."""
    low, high = F.greatest(F.lit(1.0), F.ceil(least / h).cast("double")), F.floor(most / h).cast("double")
    return F.when((h >= 1) & (low <= high), F.least(high, F.greatest(low, F.bround(ratio * h))))


def best_tiles(least: Column, most: Column, ratio: Column, area: Column) -> Column:
    """``h, w``: the pair of heights and widths in tiles, of ``least`` to ``most`` in all, that drifts least from a ratio of width to height and an area (in tiles).

    For one width the drift falls towards the height ``width / ratio`` and
    rises beyond it, and no more than the root of ``most`` heights or widths are
    small. So the heights up to that root are tried, and for each width up to it
    the heights around the ideal one and at the ends of those at which a bound
    gives that width; besides those where the bounds begin to hold. That is a few times the root, not all heights;
    where these are no more than FEW_TILES, all are tried. Drifts are rounded where they may tie.
    """
    root = F.ceil(F.sqrt(most)).cast("int") + 1
    one_to = F.transform(F.sequence(F.lit(1), root), lambda i: i.cast("double"))

    def around(w: Column) -> Column:
        ideal = w / ratio
        near = [F.floor(ideal).cast("double") + d for d in (-1, 0, 1)] + [F.floor((w + d) / ratio).cast("double") + e for d in (-0.5, 0.5) for e in (-1, 0, 1)]
        ends = [F.floor(most / w).cast("double"), F.floor(most / (w + 1)).cast("double") + 1, F.ceil(least / w).cast("double"), F.ceil(least / F.greatest(w - 1, F.lit(0.5))).cast("double") - 1]
        return F.array(*near, *ends)

    turning = F.array(*[F.floor(F.sqrt(a / ratio)).cast("double") + d for a in (least, most) for d in range(-3, 5)])
    every = F.transform(F.sequence(F.lit(1), most.cast("int")), lambda i: i.cast("double"))
    heights = F.when(most <= FEW_TILES, every).otherwise(F.array_distinct(F.concat(one_to, F.flatten(F.transform(one_to, around)), turning)))

    def drift(h: Column, w: Column) -> Column:
        score = F.abs(F.log(w / h / ratio)) * 10.0 + F.abs(F.log(h * w / area))
        return F.when(w.isNotNull(), F.struct(score.alias("s"), h.cast("int").alias("h"), w.cast("int").alias("w")))

    def least_drift(found: Column) -> Column:
        near = let(F.array_min(found)["s"] + 2e-10, lambda bound: F.filter(found, lambda x: x["s"] <= bound))
        return F.array_min(F.transform(near, lambda x: F.struct(F.round(x["s"], 10).alias("s"), x["h"].alias("h"), x["w"].alias("w"))))

    return let(F.array_compact(F.transform(F.filter(heights, lambda h: (h >= 1) & (h <= most)), lambda h: let(_tiles_at(h, least, most, ratio), lambda w: drift(h, w)))), least_drift)


def fitted_size(height: ColumnOrName, width: ColumnOrName, factor: int, min_pixels: int | None, max_pixels: int | None) -> Column:
    """``height, width``, multiples of ``factor`` within the pixel bounds, near a picture's own: rounded and scaled, or, where that leaves the bounds, the best pair of tiles; null where there is none."""
    if max_pixels is not None and (max_pixels < factor * factor or (min_pixels or 1) > max_pixels):
        raise ValueError("max_pixels holds no tile, or less than min_pixels")
    h, w = col(height).cast("double"), col(width).cast("double")
    whole = lambda v, how: F.greatest(F.lit(float(factor)), how(v / factor).cast("double") * factor)

    def bounded(s: Column) -> Column:
        if max_pixels is None:
            return s
        scale = F.sqrt(h * w / max_pixels)
        down = F.struct(*[whole(F.greatest(F.lit(1.0), F.floor(v / scale).cast("double")), F.floor).alias(n) for n, v in (("h", h), ("w", w))])
        return F.when(s["h"] * s["w"] > max_pixels, down).otherwise(s)

    def raised(s: Column) -> Column:
        if min_pixels is None:
            return s
        scale = F.sqrt(min_pixels / (h * w))
        up = F.struct(*[whole(F.greatest(F.lit(1.0), F.ceil(v * scale).cast("double")), F.ceil).alias(n) for n, v in (("h", h), ("w", w))])
        return F.when(s["h"] * s["w"] < min_pixels, up).otherwise(s)

    def chosen(s: Column) -> Column:
        area, tile = s["h"] * s["w"], float(factor * factor)
        fine = (area >= (min_pixels or 0)) & (area <= (max_pixels if max_pixels is not None else float("inf")))
        least = F.lit(float(max(1, -(-(min_pixels or 1) // (factor * factor)))))
        most = F.lit(float(max_pixels // (factor * factor))) if max_pixels is not None else F.floor(F.greatest(area, F.lit(float(min_pixels or 0))) / tile).cast("double")
        wanted = F.greatest(h * w, F.lit(float(min_pixels or 1)))
        wanted = F.least(wanted, F.lit(float(max_pixels))) if max_pixels is not None else F.least(wanted, h * w)
        best = best_tiles(least, most, w / F.greatest(h, F.lit(1.0)), wanted / tile)
        tiles = lambda x: F.when(x.isNotNull(), F.struct((x["h"] * factor).cast("int").alias("height"), (x["w"] * factor).cast("int").alias("width")))
        return F.when(fine, F.struct(s["h"].cast("int").alias("height"), s["w"].cast("int").alias("width"))).otherwise(let(best, tiles))

    start = F.struct(whole(h, F.bround).alias("h"), whole(w, F.bround).alias("w"))
    return F.when((h > 0) & (w > 0), let(start, lambda a: let(bounded(a), lambda b: let(raised(b), chosen))))
