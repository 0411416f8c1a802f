"""Captions of clips and items put together from their parts: what stands in which file, and what a run says of it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X, timecode as T
from ..operators import metadata as M

#: The templates that are used where none is given.
AUDIO_TEMPLATE, MERGE_TEMPLATE = "{{TRANSCRIPT}}\n\n{{SOUND_CAPTION}}", "{{VIDEO_CAPTION}}\n\n{{AUDIO_CAPTION}}"


@dataclass(frozen=True)
class CaptionRules:
    """How the parts of a caption are put together and which files they make.

    ``audio`` renders TRANSCRIPT, SOUND_CAPTION and FILENAME, ``merge`` these,
    VIDEO_CAPTION and AUDIO_CAPTION. ``placeholder`` stands for the audio
    caption where nothing was heard. ``merged`` writes the merged caption;
    ``only_merged`` it alone; ``json`` a document of all parts beside them;
    ``clear`` names audio captions of earlier runs that are now empty.
    """

    audio: str = AUDIO_TEMPLATE
    merge: str = MERGE_TEMPLATE
    placeholder: str = ""
    merged: bool = True
    only_merged: bool = False
    json: bool = False
    clear: bool = False


def _blank(c: Column) -> Column:
    return X.strip(F.coalesce(c, F.lit(""))) == ""


def _ended(c: Column) -> Column:
    """A text as its file holds it: with a line end, unless it is empty."""
    return F.when((c == "") | c.endswith("\n"), c).otherwise(F.concat(c, F.lit("\n")))


def caption_units(units: DataFrame, rules: CaptionRules) -> DataFrame:
    """Adds ``audio_caption, merged_caption, no_speech, note`` and ``files`` to units.

    A unit has ``folder, stem, filename, video_caption, transcript,
    sound_caption, structured`` (JSON or null) and ``has_video`` (false where
    an earlier video caption was looked for and isn't there). ``files`` are
    ``part, path, content``; one without content is to go. Null texts count as empty.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    heard = ~_blank(F.col("transcript")) | ~_blank(F.col("sound_caption"))
    values = {"TRANSCRIPT": text("transcript"), "SOUND_CAPTION": text("sound_caption"), "FILENAME": text("filename")}
    made = units.withColumn("no_speech", ~heard)
    made = made.withColumn("audio_caption", F.when(heard, X.render_template(rules.audio, values)).otherwise(rules.placeholder.strip()))
    both = values | {"VIDEO_CAPTION": text("video_caption"), "AUDIO_CAPTION": F.col("audio_caption")}
    silent = F.col("audio_caption") == ""
    made = made.withColumn("merged_caption", F.when(silent, text("video_caption")).otherwise(X.render_template(rules.merge, both)))

    writes = F.lit(rules.merged or rules.only_merged) & F.col("has_video")
    kept = F.when(writes, "merged caption is the video caption only").otherwise("audio caption skipped")
    quiet = F.concat(F.lit("No speech detected in "), text("filename"), F.lit("; "), kept)
    bare = F.concat(F.lit("Audio caption template rendered empty for "), text("filename"), F.lit("; merged caption uses video only"))
    made = made.withColumn("note", F.when(silent, F.when(F.col("no_speech"), quiet).otherwise(bare)))

    at, split = M.unit_paths("folder", "stem"), F.lit(not rules.only_merged)
    file = lambda part, path, content, when: F.when(when, F.struct(F.lit(part).alias("part"), path.alias("path"), content.alias("content")))
    document = with_caption_parts(F.col("structured"), text("video_caption"), F.col("audio_caption"), F.when(F.col("has_video"), F.col("merged_caption")).otherwise(""))
    beside = F.regexp_replace(at["merged"], r"\.txt$", ".json")
    files = F.array(
        file("video_caption", at["video"], _ended(text("video_caption")), split & ((text("video_caption") != "") | F.col("has_video"))),
        file("audio_caption", at["audio"], _ended(F.col("audio_caption")), split & ~silent),
        file("audio_caption", at["audio"], F.lit(None).cast("string"), split & silent & F.lit(rules.clear)),
        file("merged_caption", at["merged"], _ended(F.col("merged_caption")), writes),
        file("json", beside, document, split & F.lit(rules.json)),
    )
    return made.withColumn("files", F.filter(files, lambda f: f.isNotNull()))


def with_caption_parts(structured: Column, video: Column, audio: Column, merged: Column) -> Column:
    """JSON of a structured answer with its caption parts: an object grows by them, a list becomes its segments, anything else its caption."""
    value = F.try_parse_json(structured)
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    own = F.when(kind.startswith("OBJECT"), value).cast("map<string,variant>")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    single = lambda name: F.map_from_entries(F.array(F.struct(F.lit(name), value)))
    said = F.map_from_entries(F.array(F.struct(F.lit("caption"), structured.cast("variant"))))  # a text that is no JSON
    base = F.when(own.isNotNull(), own).when(kind.startswith("ARRAY"), single("segments")).when(kind != "VOID", single("caption"))
    base = F.coalesce(base, F.when(structured.isNotNull() & value.isNull(), said), empty)
    names = ["video_caption", "audio_caption", "merged_caption"]
    parts = F.map_from_entries(F.array(*[F.struct(F.lit(n), c.cast("variant")) for n, c in zip(names, (video, audio, merged), strict=True)]))
    return F.to_json(F.map_concat(F.map_filter(base, lambda k, v: ~k.isin(names)), parts))


def clip_place(folder: Column, stem: Column, media_path: Column, index: Column, persistent: Column, clips: Column) -> Column:
    """``folder, stem`` of a clip's captions: beside a clip that is kept, in the item's folder of segments for others; null for an item's only clip."""
    name, parent = F.element_at(F.split(media_path, "/"), -1), F.regexp_replace(media_path, r"/?[^/]*$", "")
    beside = F.struct(parent.alias("folder"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"))
    inside = F.struct(F.concat(folder, F.lit("/"), stem, F.lit("_segments")).alias("folder"), F.format_string("clip_%04d", F.coalesce(index.cast("int"), F.lit(1))).alias("stem"))
    kept = F.coalesce(persistent, F.lit(False))
    return F.when(kept & (F.coalesce(name, F.lit("")) != ""), beside).when((clips > 1) | kept, inside)


def _under_heads(records: Column, caption: str, blank_too: bool) -> Column:
    """Captions of an item's clips in order, each under its times; that of an only clip alone."""
    text = lambda r: F.coalesce(r[caption], F.lit("")) if blank_too else X.strip(F.coalesce(r[caption], F.lit("")))
    shown = records if blank_too else F.filter(records, lambda r: ~_blank(r[caption]))
    stamp = lambda s: T.stamp(F.coalesce(s, F.lit(0.0)), ".")
    blocks = F.transform(shown, lambda r: F.concat(F.lit("["), stamp(r["start_s"]), F.lit(" - "), stamp(r["end_s"]), F.lit("]\n"), text(r)))
    return F.when(F.size(records) == 1, F.coalesce(F.get(F.transform(shown, text), F.lit(0)), F.lit(""))).otherwise(F.array_join(blocks, "\n\n"))


def merge_captions(items: DataFrame, clips: DataFrame, rules: CaptionRules, key: Sequence[str] = ("item",)) -> tuple[DataFrame, DataFrame]:
    """(items, clips) after their captions were put together.

    Items have ``key, folder, stem, filename, transcript`` (as text) and
    ``structured`` (JSON of an earlier document, or null); clips ``key, index,
    start_s, end_s, media_path, persistent, status, caption, sound_caption,
    transcript, structured, has_video``. Clips that are done count. An item's
    caption is that of its clips in order of their index, under their times;
    its answer, where it has none, that of its only clip or the list of all.
    Both come back with what ``caption_units`` adds; items also with
    ``message``, clips that have no place of their own with no files, and
    items without a clip that is done with their transcript alone. The clips
    of one item make one row: a recording's cuts, not a corpus.
    """
    key = list(key)
    done = clips.filter("status = 'done'")
    numbers = done.groupBy(*key).agg(F.count("*").alias("_clips"))
    heads = items.select(*key, F.col("folder").alias("_folder"), F.col("stem").alias("_stem"))
    own = done.join(numbers, key).join(heads, key)
    place = clip_place(F.col("_folder"), F.col("_stem"), F.col("media_path"), F.col("index"), F.col("persistent"), F.col("_clips"))
    own = own.withColumn("_place", place)
    name = F.coalesce(F.regexp_extract("media_path", r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit(""))
    units = own.withColumns({"folder": F.coalesce(F.col("_place.folder"), F.lit("")), "stem": F.coalesce(F.col("_place.stem"), F.lit("")), "filename": F.when(name == "", F.col("_place.stem")).otherwise(name), "video_caption": F.col("caption")})
    made = caption_units(units.withColumn("has_video", F.coalesce("has_video", F.lit(True))), rules)
    made = made.withColumn("files", F.when(F.col("_place").isNotNull(), F.col("files")).otherwise(F.array().cast(made.schema["files"].dataType))).drop("_place", "_clips", "_folder", "_stem")

    fields = [c for c in ("index", "start_s", "end_s", "caption", "sound_caption", "structured") if c in clips.columns]
    gathered = done.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_records"), F.bool_or(F.coalesce("has_video", F.lit(True))).alias("_video"))
    whole = items.join(gathered, key, "left").withColumn("_records", F.coalesce("_records", F.array().cast(gathered.schema["_records"].dataType)))
    n = F.size("_records")
    answers = F.transform("_records", lambda r: F.coalesce(r["structured"], F.lit("null")))
    structured = F.coalesce(F.col("structured"), F.when(n == 1, F.get("_records", F.lit(0))["structured"]).when(n > 1, F.concat(F.lit("["), F.array_join(answers, ","), F.lit("]"))))
    whole = whole.withColumns({"video_caption": _under_heads(F.col("_records"), "caption", True), "sound_caption": _under_heads(F.col("_records"), "sound_caption", False), "structured": structured, "has_video": F.coalesce("_video", F.lit(True))})
    whole = caption_units(whole, rules)
    heard = F.col("audio_caption") != ""
    missing = F.concat(F.lit("No existing video caption for "), F.col("filename"), F.when(heard, "; audio caption saved separately").otherwise("; no audio caption produced"))
    said = F.when(heard, "audio caption saved").otherwise("merged caption uses video only" if rules.merged else "video caption saved without an audio part")
    message = F.when(~F.col("has_video"), missing).otherwise(F.concat(F.lit("Captioned "), n.cast("string"), F.lit(" segment(s); "), said))
    return whole.withColumn("message", message).drop("_records", "_video"), made


def unit_files(units: DataFrame) -> DataFrame:
    """``part, path, content`` of all files of units, those that go without content."""
    return units.select(F.explode("files").alias("f")).select("f.part", "f.path", "f.content")


def rebuilt(captions: DataFrame, rules: CaptionRules) -> DataFrame:
    """Captions whose video part was made anew: ``merged_caption`` and the ``files`` that change.

    Rows have ``caption_path, video_path, audio_caption, video_caption`` and
    ``sidecar`` (the JSON beside the caption, or null). Without a video part
    the new caption is all there is, and no file changes; a sidecar that is no
    object stays as it is.
    """
    video, audio = X.strip(F.coalesce("video_caption", F.lit(""))), F.coalesce(F.col("audio_caption"), F.lit(""))
    stem = F.regexp_extract("caption_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    empty = F.lit("")
    merged = X.render_template(rules.merge, {"VIDEO_CAPTION": video, "AUDIO_CAPTION": audio, "TRANSCRIPT": empty, "SOUND_CAPTION": empty, "FILENAME": stem})
    parted = F.coalesce(F.col("video_path"), empty) != ""
    object_ = F.coalesce(F.schema_of_variant(F.try_parse_json("sidecar")).startswith("OBJECT"), F.lit(False))
    file = lambda part, path, content: F.struct(F.lit(part).alias("part"), path.alias("path"), content.alias("content"))
    document = with_caption_parts(F.col("sidecar"), video, audio, merged)
    beside = F.regexp_replace("caption_path", r"\.[^./]*$", ".json")
    files = F.array(file("video_caption", F.col("video_path"), video), file("merged_caption", F.col("caption_path"), merged), F.when(object_, file("json", beside, document)))
    kept = F.filter(files, lambda f: f.isNotNull())
    return captions.withColumns({"merged_caption": F.when(parted, merged).otherwise(F.coalesce("video_caption", empty)), "files": F.when(parted, kept).otherwise(F.array().cast("array<struct<part:string,path:string,content:string>>"))})
