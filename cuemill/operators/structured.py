"""Texts inside structured answers, and where frames of a clip are taken."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ColumnOrName, col, let

#: The fields, in any case, whose texts are captions.
CAPTION_KEYS = ["text", "caption", "description", "answer", "summary", "segment_detail_caption", "camera_state", "video_background", "storyline", "shooting_style", "speech_content", "acoustics_content"]


def _leaves(value: Any, field: str | None, change: Callable[[str], str]) -> Any:
    """The value with ``change`` made to its caption texts, in the document's order; lists have their field's name, what has none is a caption."""
    if isinstance(value, str):
        return change(value) if field is None or field.lower() in CAPTION_KEYS else value
    if isinstance(value, dict):
        return {k: _leaves(v, k, change) for k, v in value.items()}
    if isinstance(value, list):
        return [_leaves(v, field, change) for v in value]
    return value


def _parsed(text: str | None) -> Any:
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return text


def caption_leaves(document: ColumnOrName) -> Column:
    """The caption texts of a JSON document, in order; a text that is no JSON is its own."""

    @F.pandas_udf("array<string>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for t in batch:
                found: list[str] = []
                _leaves(_parsed(t), None, lambda s, f=found: f.append(s) or s)
                out.append(found)
            yield pd.Series(out, dtype=object)

    return apply(col(document))


def with_caption_leaves(document: ColumnOrName, leaves: ColumnOrName) -> Column:
    """A document with other caption texts in the places of its own."""

    @F.pandas_udf("string")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for documents, texts in batches:
            out = []
            for t, new in zip(documents, texts, strict=True):
                given, value = iter(new), _parsed(t)
                done = _leaves(value, None, lambda s, g=given: next(g))
                out.append(None if t is None else done if value is t else json.dumps(done, ensure_ascii=False, separators=(",", ":")))
            yield pd.Series(out, dtype=object)

    return apply(col(document), col(leaves))


def finalized_documents(df: DataFrame, key: list[str], document: str, finalize: Callable[[str], Column]) -> DataFrame:
    """``key`` and the documents whose caption texts went through ``finalize``, a function of a text column's name.

    Texts stand in rows of their own while they are worked on, so that any
    column function can be used. A key names one document.
    """
    own = df.select(*key, F.col(document).alias("_doc"), F.posexplode_outer(caption_leaves(document)).alias("_i", "_text"))
    clean = own.withColumn("_new", F.when(F.col("_text").isNotNull(), F.struct("_i", F.coalesce(finalize("_text"), F.lit("")).alias("t"))))
    back = clean.groupBy(*key, "_doc").agg(F.transform(F.sort_array(F.collect_list("_new")), lambda x: x["t"]).alias("_texts"))
    return back.select(*key, with_caption_leaves("_doc", "_texts").alias(document))


def rounded_frames(count: Column, least: int, most: int | None = None, factor: int | None = None) -> Column:
    """A number of frames: the nearest multiple of ``factor``, at least ``least``, at most the multiple below ``most``."""
    n = F.greatest(F.lit(least), count.cast("long"))
    if factor and factor > 1:
        n = F.greatest(F.lit(factor), F.bround(n / factor).cast("long") * factor)
    if most is not None:
        cap = max(1, most)
        n = F.least(n, F.lit(cap // factor * factor if factor and 1 < factor <= cap else cap))
    return F.greatest(F.lit(1), n).cast("long")


def wanted_times(start: ColumnOrName, end: ColumnOrName, duration: ColumnOrName, fps: ColumnOrName, frames: ColumnOrName, *, strategy: str = "uniform", target_fps: float | None = None, count: int | None = None, most: int | None = None, least: int = 1, factor: int | None = None) -> Column:
    """Times at which frames of a clip are looked for, evenly from its start to half a frame before its end.

    ``uniform`` takes ``count`` (else ``most``) of them, ``fps`` and
    ``adaptive`` as many as the rate gives, of which adaptive keeps those that
    differ. Null where frames are taken as they come: ``keyframe``, uniform
    without a number, a clip whose end isn't known; and for a clip without a length.
    """
    if strategy not in {"uniform", "fps", "keyframe", "adaptive"}:
        raise ValueError("strategy must be 'uniform', 'fps', 'keyframe' or 'adaptive'")
    least = max(2 if strategy == "adaptive" else 1, least)
    if most is not None and most < least:
        raise ValueError("most must not be below least")
    number = lambda c: col(c).cast("double")
    rate = F.coalesce(number(fps), F.lit(0.0))
    begin = F.greatest(F.lit(0.0), F.coalesce(number(start), F.lit(0.0)))
    known = F.least(F.coalesce(number(end), number(duration)), F.coalesce(number(duration), number(end)))
    counted = F.when((number(frames) > 0) & (rate > 0), begin + number(frames) / rate)
    both = F.struct(begin.alias("a"), F.coalesce(known, counted).alias("z"))
    given = count if count is not None else most if strategy == "uniform" else None

    def times(x: Column) -> Column:
        last = F.greatest(x["a"], x["z"] - F.when(rate > 0, 0.5 / rate).otherwise(1e-6))
        if strategy == "uniform":
            n = rounded_frames(F.lit(given), least, most, factor)
        else:
            wanted = F.lit(target_fps) if target_fps else F.when(rate > 0, rate).otherwise(1.0)
            n = F.greatest(F.lit(least), F.ceil((x["z"] - x["a"]) * wanted).cast("long"))
            n = F.least(n, F.lit(max(1, count))) if count is not None else n
            n = rounded_frames(n, least, most, factor)
        even = let(n, lambda k: F.when(k == 1, F.array(x["a"])).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.when(i == k - 1, last).otherwise(x["a"] + i * ((last - x["a"]) / (k - 1))))))
        return F.when(x["z"] > x["a"], even)

    if strategy == "keyframe" or (strategy == "uniform" and given is None):
        return F.lit(None).cast("array<double>")
    return let(both, times)
