"""Timelines: windows, overlaps, islands and gaps of half-open intervals in seconds."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import ColumnOrName, col, collapse, let
from . import scans

EPS = 1e-9


def window_count(duration: Column, length: Column, overlap: Column) -> Column:
    """How many windows ``windows_of`` gives a duration above 0."""
    return 1 + F.greatest(F.lit(0), F.ceil((duration - length - EPS) / (length - overlap))).cast("int")


def windows_of(duration: Column, length: Column, overlap: Column) -> Column:
    """``windows`` with a length and an overlap of each row; none for a length of 0 or less, or one not above the overlap."""
    n = window_count(duration, length, overlap)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * (length - overlap)).alias("start_s"), F.least(duration, i * (length - overlap) + length).alias("end_s")))
    fit = (duration > EPS) & (length > 0) & (length > overlap)
    return F.when(fit, each).otherwise(F.array().cast("array<struct<start_s:double,end_s:double>>"))


def windows(duration: ColumnOrName, length: float, overlap: float = 0.0) -> Column:
    """Array of ``start_s, end_s``: windows of ``length`` that cover [0, duration), each ``overlap`` into the last; none without a duration."""
    if length <= 0:
        raise ValueError("length must be positive")
    if overlap >= length:
        raise ValueError("overlap must be less than length")
    return windows_of(col(duration).cast("double"), F.lit(float(length)), F.lit(max(0.0, float(overlap))))


def cap_lengths(start: ColumnOrName, end: ColumnOrName, longest: float, overlap: float = 0.0) -> Column:
    """Windows of at most ``longest`` that cover a range; the range itself if there is no limit or it is short enough."""
    s, e = col(start).cast("double"), col(end).cast("double")
    whole = F.array(F.struct(s.alias("start_s"), e.alias("end_s")))
    if longest <= 0:
        return whole
    pieces = F.transform(windows(e - s, longest, overlap), lambda w: F.struct((s + w["start_s"]).alias("start_s"), F.least(e, s + w["end_s"]).alias("end_s")))
    return F.when(e - s <= longest + EPS, whole).otherwise(pieces)


def limit_warning(start: ColumnOrName, end: ColumnOrName, longest: float, overlap: float = 0.0) -> Column:
    """What is said of a range that had to be cut; null for the others."""
    d = col(end).cast("double") - col(start).cast("double")
    n = window_count(d, F.lit(float(longest)), F.lit(max(0.0, float(overlap))))
    return F.when(d > longest + EPS, F.format_string("exceeds the limit, split into %d clips", n))


def cap_ranges(df: DataFrame, start: str, end: str, longest: float, overlap: float = 0.0) -> DataFrame:
    """A row for each window that ``cap_lengths`` gives, with ``start`` and ``end`` its own: plain arithmetic on exploded numbers."""
    s, e, step = F.col(start).cast("double"), F.col(end).cast("double"), longest - max(0.0, overlap)
    n = F.when(e - s <= longest + EPS, 1).otherwise(window_count(e - s, F.lit(float(longest)), F.lit(max(0.0, float(overlap)))))
    cut = df.withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("_n", n)
    first = F.when(F.col("_n") == 1, s).otherwise(s + F.col("_i") * step)
    return cut.withColumns({start: first, end: F.when(F.col("_n") == 1, e).otherwise(F.least(e, s + F.col("_i") * step + longest))}).drop("_i", "_n")


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: float | None = None) -> DataFrame:
    """Pairs of one ``key`` whose ``start_s, end_s`` and ``o_start, o_end`` overlap (both strictly).

    With ``width``, both sides are cut into cells of that many seconds, and pairs
    meet in the first cell that both touch: keys with very long timelines are
    then spread over tasks.
    """
    meet = (F.col("end_s") > F.col("o_start")) & (F.col("start_s") < F.col("o_end"))
    if width is None:
        return left.join(right, key).filter(meet)
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.greatest(F.floor(F.col(a) / width), F.ceil(F.col(b) / width) - 1)))
    cut_l, cut_r = left.withColumn("_cell", cells("start_s", "end_s")), right.withColumn("_cell", cells("o_start", "o_end"))
    first = F.greatest(F.floor(F.col("start_s") / width), F.floor(F.col("o_start") / width))
    return cut_l.join(cut_r, [key, "_cell"]).filter(meet & (F.col("_cell") == first)).drop("_cell")


def text_between(windows_: DataFrame, words: DataFrame, key: str, window: list[str], width: float | None = None) -> DataFrame:
    """Words (``o_start, o_end, word``) that overlap each window, in order, as one collapsed text; ``width`` as for ``overlap_join``."""
    pairs = overlap_join(windows_, words, key, width)
    ordered = F.array_sort(F.collect_list(F.struct("o_start", "o_end", "word")))
    return pairs.groupBy(key, *window).agg(collapse(F.array_join(F.transform(ordered, lambda x: x["word"]), " ")).alias("text"))


def islands(df: DataFrame, key: list[str], start: str = "start_s", end: str = "end_s", large: int | None = None) -> DataFrame:
    """Ranges that overlapping or touching ranges of a key make together, with how many went in; a large key is cut (see ``scans``)."""
    return scans.islands(df, key, start, end, large)


def gaps(df: DataFrame, key: list[str], low: Column, high: Column, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Ranges of [low, high) of each key that its ranges leave open. ``low`` and ``high`` may use the key's columns."""
    merged = islands(df, key, start, end)
    w = Window.partitionBy(*key).orderBy(start)
    open_ = merged.select(*key, F.coalesce(F.lag(end).over(w), low).alias("gap_start"), F.col(start).alias("gap_end"))
    last = merged.groupBy(*key).agg(F.max(end).alias("gap_start")).select(*key, "gap_start", high.alias("gap_end"))
    both = open_.unionByName(last).withColumns({"gap_start": F.greatest("gap_start", low), "gap_end": F.least("gap_end", high)})
    return both.filter("gap_end > gap_start")


def clamp_cue(start: ColumnOrName, end: ColumnOrName, low: ColumnOrName, high: ColumnOrName, least: float = 0.5) -> Column:
    """A cue's ``start_s, end_s`` within a window, stretched to ``least`` forwards, then backwards; null if it isn't in it."""
    s, e, a, b = (col(c).cast("double") for c in (start, end, low, high))
    least = max(0.0, least)
    out = (b <= a) | (e < s) | (s >= b) | (e < a) | ((e == a) & (s < a))
    cs, ce = F.greatest(a, s), F.least(b, e)
    out = out | (ce <= cs) if least <= 0 else out
    short = ce - cs < least
    ce2 = F.when(short, F.least(b, cs + least)).otherwise(ce)
    cs2 = F.when(short & (ce2 - cs < least), F.greatest(a, ce2 - least)).otherwise(cs)
    return F.when(~out & (ce2 > cs2), F.struct(cs2.alias("start_s"), ce2.alias("end_s")))


def _snap(seconds: Column, fps: float) -> Column:
    """The time of the nearest frame in microseconds, or the nearest microsecond without a rate."""
    s = F.greatest(F.lit(0.0), seconds)
    return F.bround(F.bround(s * fps) * (1_000_000.0 / fps)).cast("long") if fps > 0 else F.bround(s * 1_000_000.0).cast("long")


def _frame_us(fps: float) -> int:
    return round(1_000_000.0 / fps) if fps > 0 else 1000


def snap_ranges(ranges: Column, fps: float, before: Column | None = None) -> Column:
    """Sorted ranges in whole frames, each begun where the last ended (the first at ``before``) if that is within half a frame, a frame long at least."""
    half = 0.5 / fps if fps > 0 else 0.0005
    least = F.lit(_frame_us(fps)).cast("long")
    kind = "struct<start_us:long,end_us:long>"
    none = F.lit(None).cast("long")
    state = F.struct((none if before is None else before).alias("last"), F.array().cast(f"array<{kind}>").alias("done"))

    def add(x: Column, r: Column) -> Column:
        last = x["last"]
        s = F.when(last.isNotNull() & (F.abs(r["start_s"] - last / 1_000_000.0) <= half + 1e-6), last).otherwise(_snap(r["start_s"], fps))
        e = _snap(r["end_s"], fps)
        end = F.when(e <= s, s + least).otherwise(e)
        return F.struct(end.alias("last"), F.concat(x["done"], F.array(F.struct(s.alias("start_us"), end.alias("end_us")))).alias("done"))

    return F.aggregate(F.array_sort(ranges), state, add, lambda x: x["done"])


def snap_rows(df: DataFrame, key: list[str], fps: float) -> DataFrame:
    """``key, start_us, end_us``: ``snap_ranges`` on rows of ``start_s, end_s``.

    A range of two frames or more ends at its own last frame, wherever it
    begins; so what follows it can be gone through without what came before,
    and an array holds short ranges one after another, not a key.
    """
    w = Window.partitionBy(*key).orderBy("start_s", "end_s")
    end = _snap(F.col("end_s"), fps)
    sure = end - _snap(F.col("start_s"), fps) >= 2 * _frame_us(fps)
    rows = df.select(*key, F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"))
    rows = rows.withColumns({"_before": F.lag(F.when(sure, end)).over(w), "_n": F.row_number().over(w)})
    rows = rows.withColumn("_part", F.sum(F.when(F.col("_before").isNotNull() | (F.col("_n") == 1), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*key, "_part").agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s"))).alias("_r"), F.max("_before").alias("_before"))
    return parts.select(*key, F.explode(snap_ranges(F.col("_r"), fps, F.col("_before"))).alias("_s")).select(*key, "_s.start_us", "_s.end_us")


def _merged_short(left: list[tuple[float, float]], least: float) -> list[tuple[float, float]]:
    rows, i = [], 0
    while i < len(left):  # rows: what is long enough; left[i:]: what is to come
        s, e = left[i]
        i += 1
        while e - s + EPS < least and i < len(left) and (not rows or abs(s - rows[-1][1]) > abs(left[i][0] - e)):
            s, e = min(s, left[i][0]), max(e, left[i][1])
            i += 1
        if e - s + EPS < least and rows:
            s, e = min(rows[-1][0], s), max(rows[-1][1], e)
            rows.pop()
        rows.append((s, e))
    return rows


def merge_short(df: DataFrame, key: str, least: float) -> DataFrame:
    """``key, start_s, end_s``: the first range shorter than ``least`` joins its nearer neighbour (the one before in a tie), again and again.

    Each merge depends on the last, but none reaches over two ranges that are
    long enough side by side: what comes before ends with the first of them or
    before, what follows begins with the second. A key is cut there, and a
    group is what lies between two such places.
    """
    clean = df.select(key, F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"))
    clean = clean.filter("end_s > start_s AND NOT isnan(start_s) AND NOT isnan(end_s)")
    w = Window.partitionBy(key).orderBy("start_s", "end_s")
    long = F.col("end_s") - F.col("start_s") + EPS >= least
    cut = F.when(long & F.coalesce(F.lag(long).over(w), F.lit(False)), 1).otherwise(0)
    parts = clean.withColumn("_cut", cut).withColumn("_part", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    @F.pandas_udf("start_s array<double>, end_s array<double>")
    def merged(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        found = [_merged_short(list(zip(s.tolist(), e.tolist(), strict=True)), least) for s, e in zip(starts, ends, strict=True)]
        return pd.DataFrame({c: [[r[i] for r in rows] for rows in found] for i, c in enumerate(("start_s", "end_s"))})

    lists = scans.stretches_of(parts, [key, "_part"], ["start_s", "end_s"]).select(key, merged("start_s", "end_s").alias("_m"))
    return lists.select(key, F.explode(F.arrays_zip("_m.start_s", "_m.end_s")).alias("_r")).select(key, "_r.start_s", "_r.end_s")


@dataclass
class Hearing:
    """Where speech begins and ends, frame by frame. ``begun`` is None in silence, which is also how a recording starts.

    While speech lasts, ``quiet`` is since when it is below ``off`` without a
    frame at ``on``, ``cut`` the last silence at which a speech that grows too
    long may be parted, and ``resume`` where speech went on after it.
    """

    on: float
    off: float
    least_speech: float
    least_silence: float
    longest: float
    edge: float
    begun: float | None = None
    quiet: float | None = None
    cut: float | None = None
    resume: float | None = None
    found: list[tuple[float, float]] = field(default_factory=list)

    def close(self, end: float, begun: float | None = None) -> None:
        self.found.append((self.begun, end))
        self.begun, self.quiet, self.cut, self.resume = begun, None, None, None

    def hear(self, t: float, p: float) -> None:
        if p >= self.on:
            if self.quiet is not None and self.cut is not None and (self.resume is None or self.resume < self.cut):
                self.resume = t
            self.quiet = None
            if self.begun is None:
                self.begun = t
                return
        if self.begun is None:
            return
        if t - self.begun > self.longest:
            if self.cut is None:
                self.close(t)
                return
            self.close(self.cut, self.resume if self.resume is not None and self.resume >= self.cut else None)
        if p < self.off and self.begun is not None:
            self.quiet = t if self.quiet is None else self.quiet
            if t - self.quiet > self.edge:
                self.cut = self.quiet
            if t - self.quiet >= self.least_silence:
                kept = len(self.found) + (self.quiet - self.begun > self.least_speech)
                self.close(self.quiet)
                del self.found[kept:]


def speech_ranges(df: DataFrame, key: str, step_s: float, on: float = 0.5, off: float | None = None, least_speech_s: float = 0.25, least_silence_s: float = 0.1, pad_s: float = 0.03, longest_s: float = float("inf"), edge_s: float = 0.098, large: int | None = None) -> DataFrame:
    """``key, start_s, end_s`` of speech in frames of ``key, frame, p``, one a step.

    Speech begins at ``on`` and ends once ``p`` has stayed below ``off`` (0.15
    less, if not given) for the least silence; shorter ones than the least
    speech go. One longer than ``longest_s`` is parted at its last silence of
    over ``edge_s``, without any where it is. Ranges are padded, half the
    silence at most. After twice the least silence below ``off`` nothing of
    what came before counts: recordings are cut there, large ones looked
    through in buckets (see ``scans``), and each stretch is heard on its own.
    """
    off = max(on - 0.15, 0.01) if off is None else off
    reset = 2 * math.ceil(least_silence_s / step_s) + 3
    limit = longest_s - step_s - 2 * pad_s
    rows = df.select(key, F.col("frame").cast("long").alias("frame"), F.col("p").cast("double").alias("p"))
    loud = F.when(~(F.col("p") < off), F.col("frame"))
    few, cut = scans.split_keys(rows, [key], "frame", large)

    def stretches(rows: DataFrame, by: list[str], loud_before: Column) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("_loud", F.coalesce(F.max(loud).over(w), loud_before)).withColumn("_reset", F.when(F.col("frame") - F.col("_loud") == reset, F.col("frame")))

    last = lambda by: F.max("_reset").over(Window.partitionBy(*by).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))
    parts = stretches(few, [key], F.lit(None).cast("long")).withColumn("_part", last([key])).select(key, "frame", "p", "_part")
    if cut is not None:
        cut = scans.handed_on(cut, [key], {"loud": F.max(loud)}, {"loud": F.max("loud")})
        cut = stretches(cut, [key, "_bucket"], F.col("_before_loud")).drop("_before_loud")
        cut = scans.handed_on(cut, [key], {"reset": F.max("_reset")}, {"reset": F.max("reset")})
        parts = parts.unionByName(cut.withColumn("_part", F.coalesce(last([key, "_bucket"]), F.col("_before_reset"))).select(key, "frame", "p", "_part"))

    def heard(frames: list[int], loudness: list[float]) -> list[tuple[float, float]]:
        ear = Hearing(on, off, least_speech_s, least_silence_s, limit, edge_s)
        for f, p in zip(frames, loudness, strict=True):
            ear.hear(f * step_s, p)
        end = (frames[-1] + 1) * step_s
        if ear.begun is not None and end - ear.begun > least_speech_s:
            ear.close(end)
        return ear.found

    @F.pandas_udf("start_s array<double>, end_s array<double>")
    def speech(frames: pd.Series, loudness: pd.Series) -> pd.DataFrame:
        found = [heard(f.tolist(), p.tolist()) for f, p in zip(frames, loudness, strict=True)]
        return pd.DataFrame({c: [[r[i] for r in ranges] for ranges in found] for i, c in enumerate(("start_s", "end_s"))})

    lists = scans.stretches_of(parts, [key, "_part"], ["frame"], "p").select(key, speech("frame", "p").alias("_s"))
    found = lists.select(key, F.explode(F.arrays_zip("_s.start_s", "_s.end_s")).alias("_r")).select(key, "_r.start_s", "_r.end_s")
    ends = rows.groupBy(F.col(key).alias("_key")).agg(((F.max("frame") + 1) * step_s).alias("_end"))
    found = found.join(ends, F.col(key).eqNullSafe(F.col("_key")))
    w = Window.partitionBy(key).orderBy("start_s")
    left, right = (F.col("start_s") - F.lag("end_s").over(w)) / 2, (F.lead("start_s").over(w) - F.col("end_s")) / 2
    start = F.greatest(F.lit(0.0), F.col("start_s") - F.least(F.lit(pad_s), F.coalesce(left, F.lit(pad_s))))
    end = F.col("end_s") + F.least(F.lit(pad_s), F.coalesce(right, F.col("_end") - F.col("end_s")))
    return found.select(key, start.alias("start_s"), end.alias("end_s"))


def kept_frames(frames: Column, distance: Callable[[Column, Column], Column], threshold: float) -> Column:
    """Places of an array of frames that differ from the last kept one by the threshold or more; the first is kept, and the last if nothing else is."""
    start = F.struct(F.get(frames, F.lit(0)).alias("last"), F.array(F.lit(0).cast("long")).alias("kept"))

    def add(state: Column, x: Column) -> Column:
        far = distance(state["last"], x["frame"]) >= threshold
        return F.struct(F.when(far, x["frame"]).otherwise(state["last"]).alias("last"), F.when(far, F.concat(state["kept"], F.array(x["i"]))).otherwise(state["kept"]).alias("kept"))

    numbered = F.transform(frames, lambda f, i: F.struct(i.cast("long").alias("i"), f.alias("frame")))
    kept = F.aggregate(F.slice(numbered, F.lit(2), F.greatest(F.size(frames) - 1, F.lit(0))), start, add, lambda s: s["kept"])
    last = F.array((F.size(frames) - 1).cast("long"))
    both = lambda k: F.when((F.size(k) < 2) & (F.size(frames) >= 2), F.concat(k, last)).otherwise(k)
    return F.when(F.size(frames) > 0, let(kept, both)).otherwise(F.array().cast("array<long>"))


def sliding_rate(df: DataFrame, key: list[str], ts: str, amount: str, seconds: int) -> DataFrame:
    """Adds ``rate``: the amounts of the last ``seconds`` over the time between their first and last row; 0 for one row."""
    w = Window.partitionBy(*key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    span = (F.unix_micros(F.col(ts).cast("timestamp")) - F.min(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)) / 1e6
    return df.withColumn("rate", F.when(span > 0, F.sum(amount).over(w) / span).otherwise(0.0))


def source_times(df: DataFrame, chunks: DataFrame, key: str, large: int | None = None) -> DataFrame:
    """Times in speech-only audio (``at_s``) moved to the source: the offset of the chunk (``c_start, c_end`` in the source) that holds them.

    A time past the last chunk counts from that chunk; one below 0 is in none
    and left out. Rows meet chunks in one order of both (``asof_join``), not in pairs.
    """
    w = Window.partitionBy(key).orderBy("c_start")
    before = F.coalesce(F.sum(F.col("c_end") - F.col("c_start")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = chunks.filter("c_end > c_start").select(key, before.alias("_p_start"), F.col("c_start").alias("_c_start"))
    joined = scans.asof_join(df, placed, [key], "at_s", "_p_start", large).filter("_c_start IS NOT NULL")
    return joined.withColumn("source_s", F.col("at_s") - F.col("_p_start") + F.col("_c_start")).drop("_p_start", "_c_start")
