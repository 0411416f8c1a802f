"""The files that captions and transcripts make, as rows of path and content for the file sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..operators import render, transcripts as T
from .files import json_text

#: The suffixes of a caption's forms.
CAPTION_FORMS = {"txt": ".txt", "json": ".json", "srt": ".srt", "vtt": ".vtt", "jsonl": ".jsonl", "reasoning": ""}


def _ended(c: Column) -> Column:
    return F.when((c == "") | c.endswith("\n"), c).otherwise(F.concat(c, F.lit("\n")))


def _exploded(df: DataFrame, key: list[str], files: list[tuple[str, Column, Column]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(form).alias("form"), path.alias("path"), content.alias("content")) for form, path, content in files])
    return df.select(*key, F.explode(F.filter(rows, lambda f: f["content"].isNotNull())).alias("_f")).select(*key, "_f.form", "_f.path", "_f.content")


def answer_json(structured: Column, text: Column) -> Column:
    """The JSON that stands for a caption: its structured answer; an answer that is no JSON, or none, as an object with the text."""
    value = F.try_parse_json(structured)
    said = lambda c: F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("text")))
    return F.when(structured.isNull(), said(text)).when(value.isNull(), said(structured)).otherwise(F.to_json(value))


def wrapped_cues(cues: Column, width: int) -> Column:
    """Cues whose texts are broken to lines of a width, if one is given."""
    if width <= 0:
        return cues
    return F.transform(cues, lambda c: F.struct(c["start_s"].alias("start_s"), c["end_s"].alias("end_s"), render.wrap(c["text"], width).alias("text")))


def caption_files(df: DataFrame, key: list[str], folder: str, stem: str, formats: Sequence[str], *, text: str, structured: str | None = None, cues: str | None = None, reasoning: str | None = None, width: int = 0, always_txt: bool = True) -> DataFrame:
    """``key, form, path, content`` of the files of each row's caption.

    txt comes first and always, or, without ``always_txt``, never. srt and vtt
    need cues, reasoning a text that isn't blank; json and jsonl hold the
    structured answer (``answer_json``), jsonl a line for each of a list's. A stem's last suffix
    is no part of a name; reasoning beside a stem named caption has no stem.
    """
    asked = [f.lower().lstrip(".") for f in formats]
    unknown = set(asked) - set(CAPTION_FORMS)
    if unknown:
        raise ValueError(f"unknown forms: {sorted(unknown)}")
    asked = list(dict.fromkeys((["txt"] if always_txt and "txt" not in asked else []) + [f for f in asked if always_txt or f != "txt"]))
    bare = F.regexp_replace(F.regexp_extract(stem, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")
    name = X.safe_name(F.when(bare == "", "caption").otherwise(bare))
    with_name = df.withColumn("_at", F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"))).withColumn("_name", name)
    said = F.coalesce(F.col(text), F.lit(""))
    value = answer_json(F.col(structured) if structured else F.lit(None).cast("string"), said)
    if {"json", "jsonl"} & set(asked):
        with_name = with_name.withColumn("_json", value)
    shown = F.coalesce(F.col(cues), F.array().cast("array<struct<start_s:double,end_s:double,text:string>>")) if cues else F.array().cast("array<struct<start_s:double,end_s:double,text:string>>")
    timed = F.size(shown) > 0
    listed = F.schema_of_variant(F.try_parse_json("_json")).startswith("ARRAY")
    many = F.when(listed, F.try_parse_json("_json")).cast("array<variant>")
    made = {
        "txt": lambda: _ended(said),
        "json": lambda: json_text("_json"),
        "srt": lambda: F.when(timed, render.srt(wrapped_cues(shown, width))),
        "vtt": lambda: F.when(timed, render.vtt(wrapped_cues(shown, width))),
        "jsonl": lambda: F.when(listed, F.array_join(F.transform(many, lambda x: F.concat(F.to_json(x), F.lit("\n"))), "")).otherwise(F.concat("_json", F.lit("\n"))),
        "reasoning": lambda: F.when(X.strip(F.coalesce(F.col(reasoning), F.lit(""))) != "", _ended(F.col(reasoning))) if reasoning else F.lit(None).cast("string"),
    }
    own = lambda f: F.when(X.fold("_name") == "caption", "reasoning.txt").otherwise(F.concat("_name", F.lit("_reasoning.txt"))) if f == "reasoning" else F.concat("_name", F.lit(CAPTION_FORMS[f]))
    return _exploded(with_name, key, [(f, F.concat("_at", own(f)), made[f]()) for f in asked])


def transcript_files(df: DataFrame, key: list[str], folder: str, stem: str, formats: Sequence[str], segments: str, *, suffix: str = "_transcript", stamp: str | None = None, normalize: bool = False, highlight: bool = False) -> DataFrame:
    """``key, form, path, content`` of the files of each row's transcript.

    The name is the stem and a suffix, and the row's ``stamp`` if one is named. Where words are
    marked in turn (and the transcript has timed words, and isn't cut anew), subtitles without marks come as a companion.
    """
    forms = list(dict.fromkeys(T.FORMS.get(f.lower().lstrip("."), f.lower().lstrip(".")) for f in formats))
    base = X.safe_name(F.concat(F.col(stem), F.lit(suffix)))
    with_name = df.withColumn("_at", F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"))).withColumn("_base", base)
    tail = F.concat(F.lit("-"), F.col(stamp)) if stamp else F.lit("")
    s = F.col(segments)
    files = [(f, F.concat("_at", "_base", tail, F.lit(f".{f}")), T.transcript_document(s, f, normalize=normalize, highlight=highlight)) for f in forms]
    if highlight and not normalize:
        timed = F.exists(s, lambda x: F.size(F.coalesce(x["words"], F.array())) > 0)
        files.append(("companion", F.concat("_at", "_base", F.lit("_noword_timestamps"), tail, F.lit(".srt")), F.when(timed, T.transcript_document(s, "srt"))))
    return _exploded(with_name, key, files)
