"""Joins of captions with the metadata documents that runs leave in folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..functions.text import ColumnOrName, col
from ..sources.listing import CAPTION_SUFFIXES, kind_of


def identity(path: ColumnOrName) -> Column:
    """What two spellings of a path share: case and doubled slashes aside."""
    return X.fold(F.regexp_replace(col(path), "/+", "/"))


def stem(path: ColumnOrName) -> Column:
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"(?<=[^.])\.[^.]+$", "")


def _first(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def captions_index(outputs: DataFrame) -> DataFrame:
    """``caption_path, source_path, output_key, start_s, end_s``: for each caption file the last write among ``item, part, place`` (an item's own outputs before its segments').

    Transcripts, reasoning and files of other suffixes are left out.
    """
    suffix = F.lower(F.regexp_extract("output_path", r"[^./](\.[^./]+)$", 1))
    key = F.lower("output_key")
    kept = outputs.filter(~key.startswith("transcript_") & (key != "reasoning") & suffix.isin(*[f".{s}" for s in CAPTION_SUFFIXES]))
    last = _first(kept, ["output_path"], F.desc("item"), F.desc("part"), F.desc("place"))
    return last.select(F.col("output_path").alias("caption_path"), "source_path", "output_key", "start_s", "end_s")


def records_of(runs: DataFrame) -> DataFrame:
    """Of each run's ``index`` and ``metadata`` records, those of the index if the run has one."""
    best = runs.groupBy("run").agg(F.min(F.when(F.col("origin") == "index", 0).otherwise(1)).alias("_o"))
    return runs.join(best, "run").filter(F.when(F.col("origin") == "index", 0).otherwise(1) == F.col("_o")).drop("_o")


def caption_lookup(runs: DataFrame, records: DataFrame, newest: int = 50) -> DataFrame:
    """Of the ``newest`` runs (``run, modified``), for each caption (case aside) the record of the newest run that has it."""
    top = runs.orderBy(F.desc("modified"), "run").limit(newest)
    met = records.join(F.broadcast(top), "run").withColumn("_id", identity("caption_path"))
    return _first(met, ["_id"], F.desc("modified"), "run").drop("_id")


def ancestors(path: ColumnOrName) -> Column:
    """``folder, depth`` of every folder above a path."""
    parts = F.split(col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder"), n.alias("depth")))


def nearest_metadata(captions: DataFrame, documents: DataFrame, root: str = "") -> DataFrame:
    """Captions (``caption_path``) with the ``folder`` of the nearest document above them, none above ``root``; others are left out."""
    each = captions.select("caption_path", F.explode(ancestors("caption_path")).alias("a")).select("caption_path", "a.folder", "a.depth")
    held = each.join(documents.select("folder").distinct(), "folder", "left_semi").filter(F.col("folder").startswith(root))
    return _first(held, ["caption_path"], F.desc("depth")).select("caption_path", "folder")


def media_candidates(captions: DataFrame, entries: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """``caption_path, source_path, rank``: the sources of a document's entries (``folder, entry, output_path, source_path``) that a caption (``caption_path, folder``) goes with.

    Rank 1 are entries that wrote the caption; failing these 2, entries whose
    source has its stem; failing these 3, the only entry of the document.
    Besides come the inputs that the document's settings name (``folder,
    source_path`` of ``configured``): 4 those of the caption's stem, 5 all of them if
    there is one alone, or the caption is named caption. Sources are media, each once, at its best rank.
    Ranks are joins of their own, on folder and path or stem, so that no folder's captions meet all its entries.
    """
    e = entries.select("folder", "source_path", identity("output_path").alias("_out"), X.fold(stem("source_path")).alias("_stem"))
    c = captions.select("caption_path", "folder", identity("caption_path").alias("_id"), X.fold(stem("caption_path")).alias("_own"))
    few = entries.groupBy("folder").agg(F.min("entry").alias("_least"), F.max("entry").alias("_most")).filter("_least = _most").select("folder")
    met = lambda other, on, rank: c.join(other, on).select("caption_path", "source_path", F.lit(rank).alias("rank"))
    wrote = met(e.withColumnRenamed("_out", "_id").drop("_stem"), ["folder", "_id"], 1)
    named = met(e.withColumnRenamed("_stem", "_own").drop("_out"), ["folder", "_own"], 2)
    only = met(e.drop("_out", "_stem").join(few, "folder"), ["folder"], 3)
    ranked = wrote.unionByName(named).unionByName(only)
    best = F.min("rank").over(Window.partitionBy("caption_path"))
    kept = ranked.withColumn("_best", best).filter("rank = _best").drop("_best")
    if configured is not None:
        inputs = configured.filter("source_path IS NOT NULL").select("folder", "source_path").distinct().withColumn("_own", X.fold(stem("source_path")))
        single = inputs.groupBy("folder").agg(F.count("*").alias("_n")).filter("_n = 1").select("folder")
        plain = inputs.drop("_own")
        kept = kept.unionByName(met(inputs, ["folder", "_own"], 4)).unionByName(met(plain.join(single, "folder"), ["folder"], 5))
        kept = kept.unionByName(c.filter("_own = 'caption'").join(plain, "folder").select("caption_path", "source_path", F.lit(5).alias("rank")))
    kept = kept.filter(kind_of("source_path").isin("video", "audio", "image"))
    return kept.groupBy("caption_path", "source_path").agg(F.min("rank").alias("rank"))


def existing_caption(part: ColumnOrName, merged: ColumnOrName, sidecar: ColumnOrName) -> Column:
    """The first caption text there is: the part's own, the merged one, the source's sidecar; without line ends after it."""
    return F.coalesce(*[F.regexp_replace(col(c), r"[\r\n]+\z", "") for c in (part, merged, sidecar)], F.lit(""))


def unit_paths(folder: ColumnOrName, name: ColumnOrName) -> Column:
    """``video, audio, merged``: where a clip's captions lie."""
    safe = F.coalesce(F.when(X.safe_name(name) != "", X.safe_name(name)), F.lit("caption"))
    at = lambda sub: F.concat(col(folder), F.lit(sub), safe, F.lit(".txt"))
    return F.struct(at("/video_caption/").alias("video"), at("/audio_caption/").alias("audio"), at("/").alias("merged"))


def in_plan_folder(path: ColumnOrName, root: str) -> Column:
    """Whether a path below ``root`` lies in a folder of clip-fitness plans."""
    top = root.rstrip("/") + "/"
    inner = F.split(F.substring(col(path), len(top) + 1, 2147483647), "/")
    folders = F.slice(inner, F.lit(1), F.greatest(F.lit(0), F.size(inner) - 1))
    return col(path).startswith(top) & F.exists(folders, lambda p: F.lower(p) == "clip_fitness")


def scan_folders(files: DataFrame, root: str, recursive: bool) -> DataFrame:
    """Folders that a scan reads: all of them, or the root and those right below it that hold captions or a numbered run's metadata."""
    if recursive:
        return files.select("dir").distinct()
    depth = F.size(F.split(root, "/")) if isinstance(root, Column) else F.lit(len(root.split("/")))
    name = F.element_at(F.split("dir", "/"), -1)
    below = F.col("dir").startswith(root + "/") & (F.size(F.split("dir", "/")) == depth + 1) & ~F.lower(name).isin("video_caption", "audio_caption")
    caption = F.col("suffix").isin(*[f".{s}" for s in CAPTION_SUFFIXES]) & (F.col("name") != "metadata.json")
    run = name.rlike(r"^(?:batch_)?[0-9]{4,}_") & (F.col("name") == "metadata.json")
    return files.filter(F.col("dir").isin(root) | (below & (caption | run))).select("dir").distinct()


def valid_metadata(json: ColumnOrName, formats: list[str], version: int = 1) -> Column:
    """Whether a document is a run's metadata of a known format and version, with all its fields."""
    doc = F.from_json(col(json), "struct<_meta:struct<format:string,version:int>,app_version:string,model_info:map<string,string>,settings:map<string,string>,items_results:array<map<string,string>>,timings:map<string,string>>")
    fields = [doc[c].isNotNull() for c in ("app_version", "model_info", "settings", "items_results", "timings")]
    ok = doc["_meta"]["format"].isin(*formats) & (doc["_meta"]["version"] == version)
    for f in fields:
        ok = ok & f
    return F.coalesce(ok, F.lit(False))


def bounded_json(json: ColumnOrName, most_bytes: int) -> Column:
    """The document, or null if it is damaged, no object, or larger than allowed."""
    fit = (F.octet_length(col(json)) <= most_bytes) & F.ltrim(col(json)).startswith("{")
    return F.when(fit & F.call_function("try_parse_json", col(json)).isNotNull(), col(json))
