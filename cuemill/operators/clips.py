"""Transcripts of clips, and what runs report about themselves.

A transcript is an array of ``start_s, end_s, text, words``, its words an array
of ``start_s, end_s, word`` (and ``probability``), null or empty where they are not known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..functions.text import ColumnOrName, col
from . import scans
from .timeline import overlap_join


def _arrowless(c: Column) -> Column:
    return F.replace(c, F.lit("-->"), F.lit("->"))


def _joined(words: Column) -> Column:
    return X.strip(F.array_join(F.transform(words, lambda w: w["word"]), ""))


def clip_segments(segments: Column, start: ColumnOrName, end: ColumnOrName | None = None) -> Column:
    """The speech in a window in the window's own time: segments are cut to their words that overlap it, and to its ends."""
    a = F.greatest(F.lit(0.0), F.coalesce(col(start).cast("double"), F.lit(0.0)))
    b = F.lit(float("inf")) if end is None else F.coalesce(F.greatest(a, col(end).cast("double")), F.lit(float("inf")))

    def one(s: Column) -> Column:
        begin = F.greatest(F.lit(0.0), F.coalesce(s["start_s"], F.lit(0.0)))
        stop = F.greatest(begin, F.coalesce(s["end_s"], begin))
        spoken = F.filter(F.coalesce(s["words"], F.array()), lambda w: (w["end_s"] > a) & (w["start_s"] < b))
        worded = F.size(F.coalesce(s["words"], F.array())) > 0
        text = F.when(worded, _joined(spoken)).otherwise(X.strip(F.coalesce(s["text"], F.lit(""))))
        own_begin = F.when(worded, F.greatest(F.lit(0.0), F.get(spoken, F.lit(0))["start_s"])).otherwise(begin)
        own_stop = F.when(worded, F.greatest(own_begin, F.get(spoken, F.size(spoken) - 1)["end_s"])).otherwise(stop)
        local = F.greatest(own_begin, a) - a
        meets = (X.strip(F.coalesce(s["text"], F.lit(""))) != "") & (stop > a) & (begin < b) & (text != "")
        return F.when(meets, F.struct(local.alias("start_s"), F.greatest(local, F.least(own_stop, b) - a).alias("end_s"), text.alias("text")))

    return F.array_compact(F.transform(segments, one))


def clip_speech(clips: DataFrame, speech: DataFrame, key: str, width: float) -> DataFrame:
    """Rows of ``speech`` (``o_start, o_end`` and more) in each clip (``start_s, end_s``) of their key, with ``at_s, to_s`` in the clip's own time.

    Meets by cells of ``width`` seconds, so that long timelines are spread over tasks.
    """
    met = overlap_join(clips, speech, key, width)
    at = F.greatest("o_start", "start_s") - F.col("start_s")
    return met.withColumns({"at_s": at, "to_s": F.greatest(at, F.least("o_end", "end_s") - F.col("start_s"))})


def word_cues(segments: Column) -> Column:
    """Cues of segments, those with words from their first to their last."""

    def one(s: Column) -> Column:
        words = F.coalesce(s["words"], F.array())
        worded = F.size(words) > 0
        text = _arrowless(F.when(worded, _joined(words)).otherwise(X.strip(F.coalesce(s["text"], F.lit("")))))
        begin = F.when(worded, F.get(words, F.lit(0))["start_s"]).otherwise(s["start_s"])
        stop = F.when(worded, F.get(words, F.size(words) - 1)["end_s"]).otherwise(s["end_s"])
        return F.when(text != "", F.struct(begin.alias("start_s"), stop.alias("end_s"), text.alias("text")))

    return F.array_compact(F.transform(segments, one))


def segment_probability(probabilities: Column, log_probability: Column) -> Column:
    """The mean of the words' probabilities, else that of the segment's log probability, to four places."""
    known = F.array_compact(F.coalesce(probabilities, F.array().cast("array<double>")))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return F.when(F.size(known) > 0, F.bround(mean, 4)).otherwise(F.bround(F.exp(log_probability), 4))


def transcript_rows(segments: DataFrame, key: str, limit: int) -> DataFrame:
    """``key, place, start_s, end_s, text``: the first ``limit`` segments (``i``) of each key, and a row that says how many there are beyond."""
    total = segments.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    shown = segments.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("i"))).filter(F.col("place") <= limit)
    shown = shown.select(key, "place", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), X.strip("text").alias("text"))
    none = F.lit(None)
    more = total.select(key, none.cast("int").alias("place"), none.cast("double").alias("start_s"), none.cast("double").alias("end_s"), F.format_string(f"showing {limit} of %d (open the JSON/TSV for all)", "_n").alias("text"))
    return shown.unionByName(more)


def spoken_words(n_words: Column, text: Column) -> Column:
    """Words of a segment: the timed ones, or without any those between white space."""
    return F.when(n_words > 0, n_words).otherwise(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))).cast("long")


def _first_seen(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """``by, name``: the distinct values that are not empty, in the order of their first rows; found on the map side, so that no list holds a key's rows."""
    firsts = df.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*by, value).agg(F.min(order).alias("_o"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_o", value))), lambda p: p[value])
    return firsts.groupBy(*by).agg(_scalar(listed).alias(name))


def _left_joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """A left join on keys of which null is one, too."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in by})
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(named, same, "left").drop(*[f"_{k}" for k in by])


def _scalar(values: Column) -> Column:
    """Null for none, the value for one, a JSON list for more."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0))).when(F.size(values) > 1, F.to_json(values))


def finish_reasons(df: DataFrame, by: list[str], order: str, reason: str) -> DataFrame:
    """``by, finish_reason``: null, the one reason, or all of them as JSON in the order they were first met."""
    return _left_joined(df.select(*by).distinct(), _first_seen(df, by, order, reason, "finish_reason"), by)


def transcript_summary(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Sums of ``duration_s, elapsed_s, segments, words``, the distinct ``model`` and ``language``, and counts of rows and of ``error`` ones, which do not count otherwise."""
    good = F.col("error").isNull()
    own = df.withColumns({c: F.when(good, F.col(c)) for c in ("model", "language", "duration_s", "elapsed_s", "segments", "words", "injected")})
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = own.groupBy(*by).agg(
        zero("duration_s").alias("duration_s"), zero("elapsed_s").alias("elapsed_s"), zero("segments").alias("segments"), zero("words").alias("words"),
        F.coalesce(F.bool_or("injected"), F.lit(False)).alias("injected"), F.count_if(good).alias("records"), F.count_if(~good).alias("errors"),
    )
    for c in ("model", "language"):
        sums = _left_joined(sums, _first_seen(own, by, order, c, c), by)
    return sums


def bench_summary(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of measured runs the largest ``peak_gib``, the means of rates, tokens and times, one finish reason or that they are mixed, and how many they are."""
    reasons = F.transform(F.sort_array(F.collect_list(F.struct(order, "finish_reason"))), lambda p: p["finish_reason"])
    same = F.size(F.array_distinct(reasons)) == 1
    mean = [F.avg(c).alias(f"{c}_mean") for c in ("prefill_tok_s", "decode_tok_s", "generated_tokens", "wall_clock_s")]
    reason = F.when(same, F.get(reasons, F.lit(0))).otherwise(F.concat(F.lit("mixed: "), F.array_join(reasons, ", ")))
    return df.groupBy(*by).agg(F.max("peak_gib").alias("peak_gib"), *mean, reason.alias("finish_reason"), F.count("*").alias("runs"))


def result_summary(df: DataFrame, key: str) -> DataFrame:
    """``segment_count, word_count, duration_s`` of transcripts' segments (``end_s, text, n_words``)."""
    return df.groupBy(key).agg(F.count("*").alias("segment_count"), F.sum(spoken_words(F.col("n_words"), F.col("text"))).alias("word_count"), F.max("end_s").alias("duration_s"))


def token_speed(df: DataFrame, key: list[str], ts: str, tokens: str) -> DataFrame:
    """Adds ``tok_per_s``: the tokens so far (``tokens`` is cumulative) over the time since the first row."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    span = F.greatest((t - F.min(t).over(Window.partitionBy(*key))) / 1e6, F.lit(1e-9))
    return df.withColumn("tok_per_s", F.greatest(F.lit(0), F.col(tokens)) / span)


def covered_length(islands: DataFrame, points: DataFrame, key: str, large: int | None = None) -> DataFrame:
    """Rows of ``points`` (``key, at``, and where they ``stop`` at the latest) with ``covered``: how far the island (``start_s, end_s``) that holds ``at`` goes on from there; 0 in none."""
    spans = islands.select(key, F.col("start_s").alias("_start"), F.col("end_s").alias("_end"))
    met = scans.asof_join(points, spans, [key], "at", "_start", large)
    inside = F.when(F.col("at") < F.col("_end"), F.least("_end", "stop") - F.col("at"))
    return met.withColumn("covered", F.greatest(F.lit(0.0), F.coalesce(inside, F.lit(0.0)))).drop("_start", "_end")
