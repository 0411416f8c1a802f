"""Writers: captions in several formats, dataset exports, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..operators import render


def caption_files(df: DataFrame, stem: str, text: str, cues: str, formats: list[str], reasoning: str | None = None) -> DataFrame:
    """``path, content``: one row for each file that an item's caption makes. txt is always made; subtitles need cues, reasoning a text."""
    some = F.size(F.coalesce(F.col(cues), F.array())) > 0
    made: dict[str, Column] = {"txt": F.coalesce(F.col(text), F.lit(""))}
    for f in dict.fromkeys(formats):
        if f == "json":
            made[f] = F.to_json(F.struct(F.col(text).alias("text"), F.col(cues).alias("segments")))
        elif f == "jsonl":
            made[f] = F.array_join(F.transform(F.coalesce(F.col(cues), F.array()), F.to_json), "\n")
        elif f in {"srt", "vtt"}:
            made[f] = F.when(some, render.srt(F.col(cues)) if f == "srt" else render.vtt(F.col(cues)))
        elif f == "reasoning" and reasoning:
            made[f] = F.when(F.coalesce(F.col(reasoning), F.lit("")).rlike(r"(?U)\S"), F.col(reasoning))
    name = X.safe_name(stem)
    files = F.array(*[F.struct(F.concat(name, F.lit(".reasoning.txt" if f == "reasoning" else f".{f}")).alias("path"), c.alias("content")) for f, c in made.items()])
    return df.select(F.explode(F.filter(files, lambda x: x["content"].isNotNull())).alias("f")).select("f.path", "f.content")


def write_caption_table(files: DataFrame, folder: str) -> None:
    """Write the files' rows, parted by suffix, with Spark's committer."""
    files.withColumn("suffix", F.regexp_extract("path", r"\.([^.]+)$", 1)).write.mode("overwrite").partitionBy("suffix").json(folder)


def export_counts(df: DataFrame, outcome: str) -> DataFrame:
    """How many items met each outcome of an export."""
    return df.groupBy(F.col(outcome).alias("outcome")).agg(F.count("*").alias("n"))


def dataset_toml(folders: DataFrame, resolution: tuple[int, int] = (960, 544), suffix: str = ".txt", batch: int = 1) -> str:
    """Trainer settings for dataset folders (``dir, repeats``), a block each."""
    out = ["[general]", f"resolution = [{resolution[0]}, {resolution[1]}]", f'caption_extension = "{suffix}"', f"batch_size = {batch}", "enable_bucket = true", "bucket_no_upscale = false"]
    for r in folders.select("dir", "repeats").orderBy("dir").toLocalIterator():
        path = r["dir"].replace("\\", "\\\\").replace('"', '\\"')
        out += ["", "[[datasets]]", f'directory = "{path}"', f"num_repeats = {r['repeats']}"]
    return "\n".join(out) + "\n"


def run_summary(items: DataFrame, by: list[str]) -> DataFrame:
    """``json`` of each run: counts by status and its items in order; an item without a status counts as pending. A run's items make one row: a batch, not a corpus."""
    items = items.withColumn("status", F.coalesce("status", F.lit("pending")))
    ordered = F.array_sort(F.collect_list(F.struct("index", "path", "status")))
    counts = items.groupBy(*by, "status").agg(F.count("*").alias("n")).groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("counts"))
    return counts.join(items.groupBy(*by).agg(ordered.alias("items")), by).select(*by, F.to_json(F.struct("counts", "items")).alias("json"))


def metadata_document(items: DataFrame, by: list[str], form: str, version: int, app_version: str, settings: str, order: str) -> DataFrame:
    """``by, json``: a run's document with its head, settings (a map column) and its items (``path, status``) in order."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, "path", "status"))), lambda i: F.struct(i["path"].alias("path"), i["status"].alias("status")))
    grouped = items.groupBy(*by).agg(listed.alias("items_results"), F.first(settings, ignorenulls=True).alias("settings"))
    head = F.struct(F.lit(form).alias("format"), F.lit(version).alias("version"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return grouped.select(*by, F.to_json(F.struct(head.alias("_meta"), F.lit(app_version).alias("app_version"), empty.alias("model_info"), F.coalesce("settings", empty).alias("settings"), "items_results", empty.alias("timings"))).alias("json"))


def flags_document(items: DataFrame, by: list[str], path: str, flag: str) -> DataFrame:
    """``by, json``: each folder's flags by relative path; paths that are absolute or go up are left out."""
    p = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    safe = ~p.rlike(r"^(/|[A-Za-z]:)") & ~F.array_contains(F.split(p, "/"), "..") & (p != "")
    entries = F.sort_array(F.collect_set(F.when(safe & F.col(flag).isNotNull(), F.struct(p.alias("key"), F.col(flag).alias("value")))))
    return items.groupBy(*by).agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def with_parts(structured: Column, video: Column, audio: Column, merged: Column) -> Column:
    """JSON of an item's structured answer (an object's JSON of texts, or null) with its caption parts; the parts win."""
    own = F.from_json(structured, "map<string,string>")
    parts = F.create_map(F.lit("video_caption"), video, F.lit("audio_caption"), audio, F.lit("merged_caption"), merged)
    kept = F.map_filter(F.coalesce(own, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~k.isin("video_caption", "audio_caption", "merged_caption"))
    return F.to_json(F.map_concat(kept, parts))


def with_transcript(structured: Column, transcript: Column) -> Column:
    """JSON of a structured answer with the transcript's JSON beside it: an object grows by it, a text becomes its caption, nothing stays with it alone."""
    object_ = F.coalesce(F.ltrim(structured).startswith("{"), F.lit(False))
    inner = F.regexp_replace(F.regexp_replace(structured, r"^\s*\{\s*", ""), r"\s*\}\s*$", "")
    joined = F.concat(F.lit("{"), F.when(inner != "", F.concat(inner, F.lit(","))).otherwise(""), F.lit('"transcript":'), transcript, F.lit("}"))
    alone = F.concat(F.lit('{"transcript":'), transcript, F.lit("}"))
    caption = F.concat(F.lit('{"caption":'), F.to_json(F.array(structured)).substr(F.lit(2), F.length(F.to_json(F.array(structured))) - 2), F.lit(',"transcript":'), transcript, F.lit("}"))
    return F.when(transcript.isNull(), structured).when(structured.isNull(), alone).when(object_, joined).otherwise(caption)
