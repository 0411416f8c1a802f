"""Whole transcripts as files: cues of timed words, each word marked in turn, lyrics aligned to words, captions cut anew.

A transcript is an array of segments ``start_s, end_s, text, words``, words an
array of ``start_s, end_s, word``, null or empty where they are not timed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from ..functions import text as X, timecode as T
from ..functions.text import let
from .clips import word_cues
from .render import cue_spans, plain_cues, spoken, transcript_file

_CUES = "array<struct<start_s:double,end_s:double,text:string>>"


def _worded(segment: Column) -> Column:
    return F.size(F.coalesce(segment["words"], F.array())) > 0


def _cue(start: Column, end: Column, text: Column) -> Column:
    return F.struct(start.cast("double").alias("start_s"), end.cast("double").alias("end_s"), F.replace(X.strip(text), F.lit("-->"), F.lit("->")).alias("text"))


def marked_cues(segments: Column) -> Column:
    """A cue for each timed word, its segment's words with it underlined, and one for each pause between; segments without timed words as they are."""

    def of(s: Column) -> Column:
        words = s["words"]
        whole = F.array_join(F.transform(words, lambda w: w["word"]), "")

        def around(w: Column, i: Column) -> Column:
            line = F.array_join(F.transform(words, lambda x, j: F.when(j == i, F.regexp_replace(x["word"], r"(?s)^(\s*)(.*)$", "$1<u>$2</u>")).otherwise(x["word"])), "")
            last = F.get(words, i - 1)["end_s"]
            cue = F.array(_cue(w["start_s"], w["end_s"], line))
            return F.when((i > 0) & (last < w["start_s"]), F.concat(F.array(_cue(last, w["start_s"], whole)), cue)).otherwise(cue)

        plain = F.when(X.strip(F.coalesce(s["text"], F.lit(""))) != "", F.array(_cue(s["start_s"], s["end_s"], s["text"]))).otherwise(F.array().cast(_CUES))
        return F.when(_worded(s), F.flatten(F.transform(words, around))).otherwise(plain)

    return F.flatten(F.transform(segments, of))


def recut(segments: Column, longest_chars: int = 92, longest_words: int = 24, longest_s: float = 8.0, least_words: int = 4) -> Column:
    """Segments cut anew at ends of sentences, or at soft breaks where they grow too long, from all timed words on end.

    A segment without timed words closes the one before and stands as it is,
    with its white space drawn together, however long; a transcript without any timed word stays as it is.
    """

    @F.pandas_udf("array<struct<start_s:double,end_s:double,text:string>>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda s: None if s is None else _recut(list(s), longest_chars, longest_words, longest_s, least_words)).astype(object)

    none = F.lit(None).cast("array<struct<start_s:double,end_s:double,word:string>>")
    done = F.transform(apply(segments), lambda c: F.struct(c["start_s"].alias("start_s"), c["end_s"].alias("end_s"), c["text"].alias("text"), none.alias("words")))
    same = F.transform(segments, lambda s: F.struct(s["start_s"].cast("double").alias("start_s"), s["end_s"].cast("double").alias("end_s"), s["text"].alias("text"), none.alias("words")))
    return F.when(F.exists(segments, _worded), done).otherwise(same)


def _recut(segments: list[dict], longest_chars: int, longest_words: int, longest_s: float, least_words: int) -> list[dict]:
    out: list[dict] = []
    run: list[dict] = []

    def close() -> None:
        texts, starts, ends = ([w[k] for w in run] for k in ("word", "start_s", "end_s"))
        for a, b in cue_spans(texts, starts, ends, longest_chars, longest_words, longest_s, least_words):
            out.append({"start_s": starts[a], "end_s": max(starts[a], ends[b]), "text": spoken(texts[a : b + 1])})
        run.clear()

    for s in segments:
        words = [] if s["words"] is None else list(s["words"])
        if words:
            run += [w for w in words if w["word"].strip()]
            continue
        close()
        text = " ".join((s["text"] or "").replace("-->", "->").split())
        if text:
            out.append({"start_s": s["start_s"], "end_s": max(s["start_s"], s["end_s"]), "text": text})
    close()
    return out


def aligned_lyrics(segments: Column) -> Column:
    """Lyric lines with a stamp before each timed word and one behind the last; segments without timed words between their own two."""
    stamp = lambda s: F.concat(F.lit("["), T.short_stamp(s), F.lit("]"))

    def line(s: Column) -> Column:
        words = s["words"]
        pieces = F.transform(words, lambda w, i: F.concat(stamp(w["start_s"]), F.when(i == 0, X.strip(w["word"])).otherwise(w["word"])))
        timed = F.concat(F.array_join(pieces, " "), stamp(F.get(words, F.size(words) - 1)["end_s"]))
        return F.when(_worded(s), timed).otherwise(F.concat(stamp(s["start_s"]), X.strip(F.coalesce(s["text"], F.lit(""))), stamp(s["end_s"])))

    lines = F.transform(segments, line)
    return F.concat(F.array_join(lines, "\n\n"), F.when(F.size(segments) > 0, "\n\n").otherwise(""))


#: Other names of forms.
FORMS = {"webvtt": "vtt"}


def transcript_document(segments: Column, form: str, *, normalize: bool = False, highlight: bool = False, language: Column | None = None) -> Column:
    """A transcript as srt, vtt, txt, lrc, tsv or json; ``normalize`` cuts it anew first, ``highlight`` marks words in turn (not both)."""
    form = form.strip().lower().lstrip(".")
    form = FORMS.get(form, form)
    if form not in {"srt", "vtt", "txt", "lrc", "tsv", "json"}:
        raise ValueError(f"unknown form: {form}")
    rows = recut(segments) if normalize else segments
    marked = highlight and not normalize
    timed = F.exists(rows, _worded)
    if form == "json":
        return F.to_json(F.struct(*([language.alias("language")] if language is not None else []), rows.alias("segments")))
    plain = F.transform(rows, lambda s: F.struct(s["start_s"].cast("double").alias("start_s"), s["end_s"].cast("double").alias("end_s"), F.coalesce(s["text"], F.lit("")).alias("text")))
    if form in ("txt", "tsv"):
        return transcript_file(plain, form)
    if form == "lrc":
        return F.when(timed, aligned_lyrics(rows)).otherwise(transcript_file(plain, "lrc")) if marked else transcript_file(plain, "lrc")
    cues = F.when(timed, (marked_cues(rows) if marked else word_cues(rows)).cast(_CUES)).otherwise(plain_cues(plain).cast(_CUES))
    return let(cues, lambda c: transcript_file(c, form))
