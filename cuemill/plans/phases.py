"""Phases of a run as joins around the answers that models gave: sound captions, captions that exist, summaries, transcription plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..operators import metadata as M
from ..sources.listing import describe_paths

#: What stands for each kind of media in a folder's line.
KIND_LABELS = {"video": "🎬 %d videos", "audio": "🎵 %d audios", "image": "🖼️ %d images", "text": "📄 %d texts"}
#: The family and its endings of the models that describe sound, from which rate on whole precision is chosen, and families that sum up.
SOUND_MODELS, SOUND_ENDINGS, WHOLE_FROM_GB, WHOLE_FAMILY = "qwen3_omni_captioner_", ["gguf_q8", "gguf_q4"], 80.0, "qwen3_omni_"
SUMMARY_FAMILIES = ["qwen3_omni_instruct", "qwen3_omni_thinking"]
#: Characters that a token is reckoned to have.
CHARS_A_TOKEN = 4


def sound_captions(clips: DataFrame, windows: DataFrame, key: list[str]) -> DataFrame:
    """Clips (``key, status, media_path``) with ``sound_caption, audio_windows, prompt_tokens, new_tokens, sound_error`` from their windows' answers.

    ``windows`` have ``key, place, silent, text, prompt_tokens, new_tokens,
    error``: those that are silent were not asked and count as windows alone;
    answers are put together in order, blank ones left out. A clip one of whose
    windows failed has no sound caption, no windows, and its first error. Clips
    that are not done, or have no medium, stay without one. A clip's windows are
    half a minute each: an array of them is bounded by the clip.
    """
    asked = ~F.coalesce(F.col("silent"), F.lit(False))
    texts = F.sort_array(F.collect_list(F.when(asked & (X.strip(F.coalesce("text", F.lit(""))) != ""), F.struct("place", X.strip(F.col("text")).alias("t")))))
    tokens = lambda c: F.coalesce(F.sum(F.when(asked, F.col(c))), F.lit(0)).cast("long").alias(c)
    failed = F.min(F.when(F.col("error").isNotNull(), F.struct("place", "error")))["error"]
    sums = windows.groupBy(*key).agg(F.array_join(F.transform(texts, lambda x: x["t"]), " ").alias("_text"), F.count("*").alias("_n"), tokens("prompt_tokens"), tokens("new_tokens"), failed.alias("sound_error"))
    met = clips.join(sums, key, "left")
    fit = (F.col("status") == "done") & (F.coalesce("media_path", F.lit("")) != "")
    well = fit & F.col("sound_error").isNull()
    out = met.withColumns({"sound_caption": F.when(well, F.coalesce("_text", F.lit(""))).when(fit, ""), "audio_windows": F.when(well, F.coalesce("_n", F.lit(0))).when(fit, 0)})
    none = {c: F.when(fit, F.coalesce(c, F.lit(0))) for c in ("prompt_tokens", "new_tokens")}
    return out.withColumns({**none, "sound_error": F.when(fit, F.col("sound_error"))}).drop("_text", "_n")


def sound_model(variant: Column, family: Column, memory_gb: Column) -> Column:
    """The variant that describes sound beside a model: itself if it is one, else that of its precision; whole precision only beside its own family or in enough memory."""
    key, name = F.lower(variant), F.lit(SOUND_MODELS)
    whole = F.coalesce(family.startswith(WHOLE_FAMILY), F.lit(False)) | F.coalesce(memory_gb.try_cast("double") >= WHOLE_FROM_GB, F.lit(False))
    ending = F.lit("int8")
    for rule, to in [(key.endswith("_bf16") & whole, "bf16"), (key.endswith("_int4"), "int4"), *[(key.contains(e), e) for e in reversed(SOUND_ENDINGS)]]:
        ending = F.when(rule, to).otherwise(ending)
    return F.when(key.startswith(SOUND_MODELS), variant).otherwise(F.concat(name, ending))


def existing_units(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Clips of items whose video captions exist already, one each: ``item, index, start_s, end_s, media_path, persistent, status, caption, has_video, video_path, message``.

    ``items`` have ``item, folder, stem, path, duration``; ``texts`` are the files
    there are (``path, content``). The first of the unit's video part, its
    merged caption and the text beside the medium counts, without line ends
    after it; without any the audio caption stands alone. Of files with one path the largest counts.
    """
    have = texts.filter("path IS NOT NULL").groupBy(F.col("path").alias("_path")).agg(F.max("content").alias("_content"))
    at = M.unit_paths("folder", "stem")
    beside = F.regexp_replace("path", r"(?<=[^/.])\.[^./]*$", ".txt")
    asked = items.select("item", F.posexplode(F.array(at["video"], at["merged"], beside)).alias("_rank", "_path"))
    found = asked.join(have, "_path").filter(F.col("_content").isNotNull())
    first = found.groupBy("item").agg(F.min(F.struct("_rank", "_path", "_content")).alias("_f"))
    met = items.join(first, "item", "left")
    name, there = F.element_at(F.split("path", "/"), -1), F.col("_f").isNotNull()
    caption = F.coalesce(F.regexp_replace(F.col("_f._content"), r"[\r\n]+\z", ""), F.lit(""))
    message = F.when(there, F.concat(F.lit("Existing video caption loaded for "), name, F.lit("."))).otherwise(F.concat(F.lit("No existing video caption for "), name, F.lit("; audio caption will be saved separately")))
    return met.select(
        "item", F.lit(1).alias("index"), F.lit(0.0).alias("start_s"), F.coalesce(F.col("duration").cast("double"), F.lit(0.0)).alias("end_s"), F.col("path").alias("media_path"), F.lit(False).alias("persistent"),
        F.lit("done").alias("status"), caption.alias("caption"), there.alias("has_video"), F.col("_f._path").alias("video_path"), message.alias("message"),
    )


def summary_inputs(items: DataFrame, clips: DataFrame, heading: Column, families: list[str] | None = None) -> DataFrame:
    """``item, input, left_out`` of the items whose clips are to be summed up: two or more that are done, by a model of a family that can.

    ``items`` have ``item, family, context_tokens, answer_tokens``, ``clips``
    ``item, index, start_s, end_s, caption, status``. Under the heading stands a
    line a clip, its times and its caption; hours are shown where a clip ends
    after one. The oldest lines go until the rest fits what the context leaves
    for it, reckoned at CHARS_A_TOKEN; a single line too long keeps its end.
    """
    done = clips.filter("status = 'done'")
    long = F.max("end_s") >= 3600.0
    lines = F.sort_array(F.collect_list(F.struct("index", "start_s", "end_s", X.strip(F.coalesce("caption", F.lit(""))).alias("caption"))))
    gathered = done.groupBy("item").agg(lines.alias("_clips"), long.alias("_long")).filter(F.size("_clips") > 1)
    met = items.filter(F.col("family").isin(families or SUMMARY_FAMILIES)).join(gathered, "item").withColumn("_head", X.strip(F.coalesce(heading, F.lit(""))))
    stamp = lambda s: F.when(F.col("_long"), _clock(s, True)).otherwise(_clock(s, False))
    met = met.withColumn("_lines", F.transform("_clips", lambda c: F.concat(stamp(c["start_s"]), F.lit("-"), stamp(c["end_s"]), F.lit(" "), c["caption"])))
    budget = F.greatest(F.lit(1), F.greatest(F.lit(1), F.col("context_tokens") - F.col("answer_tokens")) * CHARS_A_TOKEN)
    met = met.withColumn("_budget", budget.cast("int")).withColumn("_n", F.size("_lines"))
    # room of the lines from each one on, the newest always kept
    sizes = F.transform("_lines", lambda x: F.length(x) + 1)
    behind = F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.aggregate(F.slice(sizes, i, F.col("_n")), F.lit(0), lambda a, x: a + x))
    first = F.filter(F.transform(behind, lambda s, i: F.when((F.length("_head") + 2 + s <= F.col("_budget")) | (i == F.col("_n") - 1), i)), lambda i: i.isNotNull())
    met = met.withColumn("_first", F.get(first, F.lit(0)))
    kept = F.slice("_lines", F.col("_first") + 1, F.col("_n"))
    whole = F.concat(F.col("_head"), F.when(F.col("_head") != "", "\n\n").otherwise(""), F.array_join(kept, "\n"))
    met = met.withColumn("_whole", whole).withColumn("_over", F.length("_whole") > F.col("_budget"))
    head = F.when(F.length("_head") >= F.col("_budget"), F.regexp_replace(F.substring(F.col("_head"), F.lit(1), F.col("_budget")), r"(?U)\s+\z", "")).otherwise(F.col("_head"))
    met = met.withColumn("_cut", head)
    room = F.greatest(F.lit(0), F.col("_budget") - F.length("_cut") - F.when(F.col("_cut") != "", 2).otherwise(0))
    newest = F.element_at("_lines", -1)
    end = F.when(room > 0, F.substring(newest, F.greatest(F.lit(1), F.length(newest) - room + 1), room)).otherwise("")
    short = F.concat(F.col("_cut"), F.when((F.col("_cut") != "") & (end != ""), "\n\n").otherwise(""), end)
    return met.select("item", F.when(F.col("_over"), short).otherwise(F.col("_whole")).alias("input"), (F.col("_first") + F.col("_over").cast("int")).alias("left_out"))


def _clock(seconds: Column, hours: bool) -> Column:
    whole = F.floor(F.greatest(F.lit(0.0), seconds)).cast("long")
    if hours:
        return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def summary_files(items: DataFrame, answers: DataFrame) -> DataFrame:
    """``path, content`` of the summaries (``item, summary``) beside the items' captions (``item, folder, stem``)."""
    text = F.coalesce("summary", F.lit(""))
    content = F.when((text == "") | text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))
    return answers.join(items.select("item", "folder", "stem"), "item").select(F.concat("folder", F.lit("/"), "stem", F.lit("_summary.txt")).alias("path"), content.alias("content"))


def transcription_plan(inputs: DataFrame, existing: DataFrame, *, key: str = "run", extension: str = "srt", beside: bool = False, overwrite: bool = False, limit: int = 0, trim_start: float = 0.0, trim_end: float | None = None) -> DataFrame:
    """``run, index, path, out_dir, stem, status, message, trim_start_s, trim_end_s`` of each run's inputs, and the file that is ``expected``.

    ``inputs`` have ``run, place, path, run_dir, source_root, output_root,
    folder_mode``; a path that comes twice counts once, at its first place. A
    run with one input is written to its folder and trimmed; others beside
    their sources, or below the output root as below the source root. Inputs whose
    transcript exists (``path``) are skipped, then those after the first
    ``limit`` that are left. A run's inputs are numbered in one window: a batch, not a corpus.
    """
    firsts = inputs.groupBy(key, "path").agg(F.min(F.struct("place", "run_dir", "source_root", "output_root", "folder_mode")).alias("_i")).select(key, "path", "_i.*")
    w, all_of = Window.partitionBy(key).orderBy("place", "path"), Window.partitionBy(key)
    rows = describe_paths(firsts.withColumn("index", F.row_number().over(w) - 1), "path")
    batch = F.coalesce(F.col("folder_mode"), F.lit(False)) | (F.count("*").over(all_of) > 1)
    root = F.concat(F.regexp_replace("source_root", "/+$", ""), F.lit("/"))
    inside = F.concat(F.col("dir"), F.lit("/")).startswith(root)
    below = F.when(inside, F.regexp_replace(F.substring(F.concat(F.col("dir"), F.lit("/")), F.length(root) + 1, F.length("path")), "/$", "")).otherwise("")
    at = F.concat(F.regexp_replace("output_root", "/+$", ""), F.when(F.coalesce(below, F.lit("")) != "", F.concat(F.lit("/"), below)).otherwise(""))
    rows = rows.withColumn("_batch", batch).withColumn("out_dir", F.when(~F.col("_batch"), F.col("run_dir")).otherwise(F.col("dir") if beside else at))
    rows = rows.withColumn("expected", F.concat("out_dir", F.lit("/"), "stem", F.lit(f".{extension}")))
    there = existing.select(F.col("path").alias("expected"), F.lit(True).alias("_there")).distinct()
    rows = rows.join(there, "expected", "left").withColumn("_done", F.coalesce("_there", F.lit(False)) & F.lit(not overwrite))
    before = F.sum(F.when(F.col("_done"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = F.col("_batch") & (before > limit) if limit > 0 else F.lit(False)
    message = F.when(F.col("_done"), F.concat(F.lit("Transcript already exists: "), "expected")).when(out, f"Excluded by batch limit of {limit} item(s).")
    rows = rows.withColumn("message", message).withColumn("status", F.when(F.col("message").isNull(), "pending").otherwise("skipped"))
    start = F.when(F.col("_batch"), 0.0).otherwise(max(0.0, trim_start))
    end = F.when(~F.col("_batch"), F.lit(float(trim_end)) if trim_end else F.lit(None).cast("double"))
    return rows.select(key, "index", "path", "out_dir", "stem", "expected", "status", "message", start.alias("trim_start_s"), end.alias("trim_end_s"))


def folder_facts(media: DataFrame, existing: DataFrame, *, root: str = "root", output_root: Column | None = None, extension: str = ".txt", overwrite: bool = False, limit: int = 0, noun: str = "captioned", files: str = "captions", coverage: bool = False, kinds: tuple[str, ...] = tuple(KIND_LABELS)) -> DataFrame:
    """``root, video, audio, image, text, total, existing, audio_captioned, line``: what a folder holds and what of it is done.

    ``media`` are listed files (``root, path, dir, stem, kind``) without their
    sidecars, ``existing`` the ``path`` of what there is. Outputs lie beside the
    media, or below ``output_root`` as the media below the root.
    """
    top = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    inner = F.substring(F.concat(F.col("dir"), F.lit("/")), F.length(top) + 1, F.length("path"))
    home = F.concat(F.col("dir"), F.lit("/")) if output_root is None else F.concat(F.regexp_replace(output_root, "/+$", ""), F.lit("/"), inner)
    suffix = extension.strip().lower()
    suffix = suffix if suffix.startswith(".") else f".{suffix}"
    m = media.filter(F.col("kind").isin(*kinds)).withColumns({"_caption": F.concat(home, "stem", F.lit(suffix)), "_audio": F.concat(home, F.lit("audio_caption/"), "stem", F.lit(".txt"))})
    have = existing.select("path").distinct()
    for place, name in (("_caption", "_has"), ("_audio", "_heard")):
        m = m.join(have.select(F.col("path").alias(place), F.lit(1).alias(name)), place, "left")
    counts = {k: F.count_if(F.col("kind") == k).alias(k) for k in KIND_LABELS}
    out = m.groupBy(root).agg(*counts.values(), F.count("*").alias("total"), F.coalesce(F.sum("_has"), F.lit(0)).alias("existing"), F.coalesce(F.sum("_heard"), F.lit(0)).alias("audio_captioned"))
    if output_root is None:
        place = "next to source files"
    else:
        place = "in output folder"
    hint = f"Overwrite is on; existing {files} will be replaced." if overwrite else f"Overwrite is off; existing {files} will be skipped."
    parts = [F.format_string(KIND_LABELS[k], F.col(k)) for k in kinds]
    if coverage:
        parts += [F.format_string("%d media files", "total"), F.format_string("%d already captioned (&lt;stem&gt;.txt)", "existing"), F.format_string("%d with audio captions (audio_caption/)", "audio_captioned"), F.lit(f"outputs {place}. {hint}")]
    else:
        parts.append(F.concat(F.col("existing").cast("string"), F.lit(f" already {noun} {place}. {hint}")))
    if limit > 0:
        parts.append(F.lit(f"limiting to first {limit}"))
    return out.withColumn("line", F.concat_ws(" · ", *parts))


def free_names(wanted: DataFrame, existing: DataFrame, folder: str, stem: str, order: list[str], suffix: str = ".json") -> DataFrame:
    """Adds ``path``: each file's own name in its folder if that is free, else the next free one with _0001 and so on behind the stem.

    A stem that ends with such a number goes on counting from it. Names that
    are wanted twice are given out in ``order``.
    """
    number = F.regexp_extract(stem, r"^(.*)_(\d{4})$", 2)
    base = F.when(number != "", F.regexp_extract(stem, r"^(.*)_(\d{4})$", 1)).otherwise(F.col(stem))
    start = F.when(number != "", number.cast("int")).otherwise(0)
    w = wanted.withColumns({"_base": base, "_start": start, "_own": F.concat(folder, F.lit("/"), stem, F.lit(suffix))})
    at = w.select(F.col(folder).alias("_f"), F.col("_base").alias("_b")).distinct()
    name = F.regexp_replace("path", r"^.*/", "")
    have = existing.select(F.regexp_replace("path", r"/[^/]*$", "").alias("_f"), "path", name.alias("_n")).filter(F.col("_n").endswith(suffix))
    body = F.substring("_n", F.lit(1), F.length("_n") - len(suffix))
    counted = have.withColumns({"_b": F.regexp_extract(body, r"^(.*)_(\d{4})$", 1), "_k": F.regexp_extract(body, r"^(.*)_(\d{4})$", 2).try_cast("int")}).filter("_k IS NOT NULL")
    taken = counted.join(at, ["_f", "_b"]).groupBy(F.col("_f").alias(folder), F.col("_b").alias("_base")).agg(F.array_sort(F.collect_set("_k")).alias("_taken"))
    own = have.select(F.col("path").alias("_own"), F.lit(True).alias("_there")).distinct()
    w = w.join(own, "_own", "left").join(taken, [folder, "_base"], "left")
    place = F.row_number().over(Window.partitionBy(folder, stem).orderBy(*order))
    w = w.withColumn("_p", place - F.when(F.col("_there"), 0).otherwise(1))  # how many names it has to go on
    free = F.aggregate(F.filter(F.coalesce("_taken", F.array().cast("array<int>")), lambda k: k > F.col("_start")), F.col("_start") + F.col("_p"), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    path = F.when(F.col("_p") == 0, F.col("_own")).otherwise(F.concat(folder, F.lit("/"), "_base", F.format_string("_%04d", free), F.lit(suffix)))
    return w.withColumn("path", path).drop("_base", "_start", "_own", "_there", "_taken", "_p")


def fitness_plan_files(plans: DataFrame, existing: DataFrame) -> DataFrame:
    """``path, content`` of plans (``source_folder, output_dir, stamp, json``): the source's name and a stamp, never over a file there is. Plans without a folder to go to, or a source, make none."""
    fit = plans.filter("trim(coalesce(source_folder, '')) <> '' AND trim(coalesce(output_dir, '')) <> ''")
    name = F.regexp_extract(F.regexp_replace("source_folder", "/+$", ""), r"([^/]*)$", 1)
    stem = F.concat(X.safe_name(F.when(name == "", "clips").otherwise(name)), F.lit("_"), X.safe_name("stamp"))
    named = fit.withColumns({"_folder": F.regexp_replace("output_dir", "/+$", ""), "_stem": stem})
    return free_names(named, existing, "_folder", "_stem", ["source_folder", "json"]).select("path", F.col("json").alias("content"))


def looked_up(rows: DataFrame, catalogue: DataFrame, name: str, key: str = "id") -> DataFrame:
    """Rows with the columns of their entry of a catalogue, and ``error`` where there is none of that name; case counts."""
    met = rows.join(catalogue.withColumnRenamed(key, "_key"), F.col(name) == F.col("_key"), "left")
    return met.withColumn("error", F.when(F.col("_key").isNull(), F.concat(F.lit("Unknown: "), F.coalesce(name, F.lit(""))))).drop("_key")


def family_of(rows: DataFrame, variants: DataFrame, variant: str = "variant") -> DataFrame:
    """Rows with the ``family`` that owns their variant (``key, aliases, family``), by its key or an alias, case aside; null for unknown ones."""
    names = variants.select(F.explode(F.array_union(F.array("key"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_name"), F.col("family"))
    names = names.groupBy(X.fold(X.strip(F.col("_name"))).alias("_name")).agg(F.min("family").alias("family"))
    return rows.join(names, X.fold(X.strip(F.col(variant))) == F.col("_name"), "left").drop("_name")


def prompt_entries(files: DataFrame) -> DataFrame:
    """``name, path, system_prompt, user_prompt`` of stored prompts (``path, content``), in order of names case aside; files that are no such object are left out.

    A prompt without a name has its file's.
    """
    doc = F.from_json("content", "struct<name:string,system_prompt:string,user_prompt:string>")
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json("content")).startswith("OBJECT"), F.lit(False))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    read = files.filter(ok & F.lower("path").endswith(".json")).withColumn("_d", doc)
    name = F.when(X.strip(F.coalesce(F.col("_d.name"), F.lit(""))) != "", X.strip(F.col("_d.name"))).otherwise(stem)
    return read.select(name.alias("name"), "path", F.col("_d.system_prompt").alias("system_prompt"), F.col("_d.user_prompt").alias("user_prompt")).orderBy(X.fold("name"), "name", "path")
