"""Folder listings as DataFrames, and the joins that pair media with caption files."""

from __future__ import annotations

import re

from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..functions.text import ColumnOrName, col
from .files import found_files, open_folder

#: File suffixes by kind.
SUFFIXES = {
    "video": "mp4 mkv mov webm avi m4v ts mts m2ts wmv flv mpg mpeg 3gp ogv".split(),
    "audio": "wav mp3 flac m4a aac ogg opus wma aiff aif amr mka".split(),
    "image": "png jpg jpeg webp bmp tiff tif gif heic avif".split(),
    "text": "txt md".split(),
}
#: Suffixes of captions, the preferred first, and folders that hold parts of captions.
CAPTION_SUFFIXES = "txt json srt vtt jsonl".split()
PART_FOLDERS = ("video_caption", "audio_caption")


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``path, dir, name, stem, suffix, kind, modified, size`` of files that are not hidden or empty; their contents are never read. Tasks list the folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if recursive and _known(folder):
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        top = store.makeQualified(place).toString().rstrip("/")
        files = found_files(spark, folder, _passed_over).filter("size > 0")
        files = files.select(F.concat(F.lit(f"{top}/"), "file").alias("path"), F.timestamp_millis("modified").alias("modified"), "size")
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
        files = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return describe_paths(files, "path").filter(~F.col("name").startswith("."))


def _known(folder: str) -> bool:
    """Whether this is one folder of a store that pyarrow opens, as Spark names it; other stores and patterns are left to Spark's reader."""
    if re.search(r"[*?\[{]", folder) or not (folder.startswith(("file:", "hdfs:")) or "://" not in folder):
        return False
    store, root = open_folder(folder)
    return store.get_file_info(root).type == FileType.Directory


def _passed_over(name: str) -> bool:
    """Whether Spark's readers pass over files and folders of this name."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def describe_paths(df: DataFrame, path: str) -> DataFrame:
    """Adds ``dir, name, stem, suffix, kind``."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    return df.withColumns({"dir": F.regexp_replace(path, r"/[^/]*$", ""), "name": name, "stem": stem, "suffix": suffix, "kind": kind_of(path)})


def kind_of(path: ColumnOrName) -> Column:
    """video, audio, image, text or unknown, by the suffix."""
    suffix = F.lower(F.regexp_extract(col(path), r"[^./](\.[^./]+)$", 1))
    out = F.when(F.lit(False), "")
    for kind, known in SUFFIXES.items():
        out = out.when(suffix.isin(*[f".{s}" for s in known]), kind)
    return out.otherwise("unknown")


def in_part_folder(folder: ColumnOrName) -> Column:
    """Whether some folder above holds parts of captions."""
    return F.exists(F.split(col(folder), "/"), lambda p: F.lower(p).isin(*PART_FOLDERS))


def glob_filter(path: ColumnOrName, globs: str) -> Column:
    """Whether the name matches one of the patterns (``*``, ``?``, ``[...]``) between semicolons; true without any. Case counts."""
    name = F.element_at(F.split(col(path), "/"), -1)
    keep = None
    for g in (x.strip() for x in globs.split(";")):
        if g:
            body = "".join(".*" if x == "*" else "." if x == "?" else x if x.startswith("[") else re.escape(x) for x in re.findall(r"\[[^\]]+\]|.", g, re.S)).replace("[!", "[^")
            one = name.rlike(f"(?s)^(?:{body})$")
            keep = one if keep is None else keep | one
    return F.lit(True) if keep is None else keep


def select_media(files: DataFrame, kinds: list[str], globs: str = "") -> DataFrame:
    """Files of these kinds that match the patterns and lie in no part folder."""
    return files.filter(F.col("kind").isin(*kinds) & glob_filter("path", globs) & ~in_part_folder("dir")) if kinds else files.limit(0)


def without_sidecars(files: DataFrame) -> DataFrame:
    """Without text files that go with media of their folder: same stem, or same but for a last ``_suffix``, case aside."""
    media = files.filter("kind IN ('video', 'audio', 'image')").select(F.col("dir").alias("_d"), X.fold("stem").alias("_s")).distinct()
    texts = files.filter("kind = 'text'").withColumn("_full", X.fold("stem"))
    texts = texts.withColumn("_cut", F.regexp_replace("_full", "_[^_]*$", "")).filter(~in_part_folder("dir"))
    for c in ("_full", "_cut"):
        texts = texts.join(media, (F.col("dir") == F.col("_d")) & (F.col(c) == F.col("_s")), "left_anti")
    return files.filter("kind <> 'text'").unionByName(texts.drop("_full", "_cut"))


def pair_captions(media: DataFrame, captions: DataFrame) -> DataFrame:
    """Each medium with its caption file by folder and stem; of several, the preferred suffix."""
    rank = F.array_position(F.array(*[F.lit(f".{s}") for s in CAPTION_SUFFIXES]), F.col("suffix"))
    best = captions.filter(rank > 0).groupBy(F.col("dir").alias("_d"), X.fold("stem").alias("_s")).agg(F.min_by("path", rank).alias("caption_path"))
    return media.join(best, (F.col("dir") == F.col("_d")) & (X.fold("stem") == F.col("_s")), "left").drop("_d", "_s")


def dataset_folders(files: DataFrame) -> DataFrame:
    """``dir, name, repeats, kind, n``: folders with video or images; a name such as 10_cats repeats ten times."""
    name = F.element_at(F.split("dir", "/"), -1)
    by = files.groupBy("dir").agg(F.count_if(F.col("kind") == "video").alias("videos"), F.count_if(F.col("kind") == "image").alias("images"))
    by = by.filter("videos + images > 0")
    repeats = F.greatest(F.lit(1), F.coalesce(F.regexp_extract(name, r"^(\d+)_(.+)$", 1).try_cast("int"), F.lit(1)))
    shown = F.when(name.rlike(r"^\d+_.+$"), F.regexp_extract(name, r"^(\d+)_(.+)$", 2)).otherwise(name)
    kind = F.when((F.col("videos") > 0) & (F.col("images") > 0), "mixed").when(F.col("videos") > 0, "video").otherwise("image")
    return by.select("dir", shown.alias("name"), repeats.alias("repeats"), kind.alias("kind"), (F.col("videos") + F.col("images")).alias("n"))


def read_flags(json: ColumnOrName) -> Column:
    """``path, flag`` entries of a flags document; none if it is damaged, and none for paths that are absolute or go up."""
    entries = F.map_entries(F.from_json(col(json), "map<string,string>"))
    safe = F.filter(entries, lambda e: ~e["key"].rlike(r"^([/\\]|[A-Za-z]:)") & ~F.array_contains(F.split(e["key"], r"[/\\]"), ".."))
    flag = lambda v: F.coalesce(F.get_json_object(v, "$.flag"), F.get_json_object(v, "$.status"), F.lower(v))
    return F.transform(F.coalesce(safe, F.array()), lambda e: F.struct(e["key"].alias("path"), flag(e["value"]).alias("flag")))


def caption_text(path: ColumnOrName, content: ColumnOrName) -> Column:
    """A caption file's text: of JSON the first text among ``text, caption, description``, else the document."""
    found = F.coalesce(*[F.get_json_object(col(content), f"$.{k}") for k in ("text", "caption", "description")], col(content))
    return F.when(F.lower(col(path)).endswith(".json"), found).otherwise(col(content))


def metadata_outputs(json: ColumnOrName) -> Column:
    """``source_path, output_key, output_path, start_s, end_s`` of the items of a run's metadata and their segments; transcripts and reasoning left out."""
    item = "struct<path:string,status:string,outputs:map<string,string>,segments:array<struct<start_s:double,end_s:double,outputs:map<string,string>>>>"
    doc = F.from_json(col(json), f"struct<items_results:array<{item}>>")
    none = F.lit(None).cast("double")

    def rows(outputs: Column, source: Column, s: Column, e: Column) -> Column:
        kept = F.filter(F.coalesce(F.map_entries(outputs), F.array()), lambda o: ~o["key"].startswith("transcript_") & (o["key"] != "reasoning"))
        return F.transform(kept, lambda o: F.struct(source.alias("source_path"), o["key"].alias("output_key"), o["value"].alias("output_path"), s.alias("start_s"), e.alias("end_s")))

    def of(i: Column) -> Column:
        parts = F.flatten(F.transform(F.coalesce(i["segments"], F.array()), lambda g: rows(g["outputs"], i["path"], g["start_s"], g["end_s"])))
        return F.concat(rows(i["outputs"], i["path"], none, none), parts)

    return F.flatten(F.transform(F.coalesce(doc["items_results"], F.array()), of))


def failed_paths(json: ColumnOrName) -> Column:
    """Paths of a run's items that failed."""
    doc = F.from_json(col(json), "struct<items_results:array<struct<path:string,status:string>>>")
    return F.transform(F.filter(F.coalesce(doc["items_results"], F.array()), lambda i: i["status"].isin("failed", "error")), lambda i: i["path"])


def media_facts(probe_json: ColumnOrName) -> Column:
    """``kind, duration, width, height, fps, is_vfr, rotation, has_video, has_audio`` from a probe's JSON; kind unknown if it is damaged."""
    from ..functions.numeric import fraction

    stream = "struct<codec_type:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,disposition:struct<attached_pic:int>,tags:struct<rotate:string>,side_data_list:array<struct<rotation:double>>>"
    doc = F.from_json(col(probe_json), f"struct<format:struct<duration:string>,streams:array<{stream}>>")
    streams = F.coalesce(doc["streams"], F.array())
    video = F.get(F.filter(streams, lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0)), F.lit(0))
    audio = F.get(F.filter(streams, lambda s: s["codec_type"] == "audio"), F.lit(0))
    avg, real = fraction(video["avg_frame_rate"]), fraction(video["r_frame_rate"])
    duration = doc["format"]["duration"].try_cast("double")
    turn = F.coalesce(video["tags"]["rotate"].try_cast("int"), F.get(F.filter(video["side_data_list"], lambda d: d["rotation"].isNotNull()), F.lit(0))["rotation"].cast("int"), F.lit(0))
    kind = F.when(video.isNotNull() & (F.coalesce(duration, F.lit(0.0)) > 0), "video").when(video.isNotNull(), "image").when(audio.isNotNull(), "audio").otherwise("unknown")
    return F.struct(kind.alias("kind"), duration.alias("duration"), video["width"].alias("width"), video["height"].alias("height"), F.coalesce(avg, real).alias("fps"), F.coalesce(F.abs(avg - real) > F.greatest(F.lit(0.01), 0.001 * F.abs(real)), F.lit(False)).alias("is_vfr"), turn.alias("rotation"), video.isNotNull().alias("has_video"), audio.isNotNull().alias("has_audio"))


def event_lines(value: ColumnOrName) -> Column:
    """``ev, level, scope, text`` of a protocol line; a line that is no event is plain output."""
    got = F.from_json(col(value), "struct<ev:string,level:string,scope:string,text:string>")
    none = F.lit(None).cast("string")
    return F.when(got["ev"].isNotNull(), got).otherwise(F.struct(F.lit("stdout").alias("ev"), none.alias("level"), none.alias("scope"), col(value).alias("text")))


def sse_data(value: ColumnOrName) -> Column:
    """The JSON of a server-sent ``data:`` line; null for comments, other fields and ``[DONE]``."""
    body = F.trim(F.substring(col(value), 6, 2147483647))
    return F.when(col(value).startswith("data:") & (body != "[DONE]") & (body != ""), body)
