"""Models, presets and settings as small dimensions, and what follows from them for an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..functions.text import ColumnOrName, col

#: Kinds that an input may be given explicitly.
KINDS = ("video_audio", "video", "audio", "image", "text")
#: Families that take the last segment's text along.
CONTEXT_FAMILIES = ("avocado", "qwen3_omni_instruct", "qwen3_omni_thinking")


def required_capability(*, text_only: Column, kind: ColumnOrName, explicit: ColumnOrName, has_video: Column, frames_off: Column, hears: Column, audio_wanted: Column, audio_required: Column) -> Column:
    """``capability, kind`` that an item asks of a model; an empty capability if nothing fits.

    In this order: a bare prompt; nothing known of the file; sound of a video
    whose frames are off, for a model that hears; a kind given explicitly; a
    video with or without sound; anything else as it is.
    """
    both = lambda a, b: F.struct(a.alias("capability") if isinstance(a, Column) else F.lit(a).alias("capability"), b.alias("kind") if isinstance(b, Column) else F.lit(b).alias("kind"))
    k, given = col(kind), F.lower(F.coalesce(col(explicit), F.lit("")))
    return (
        F.when(text_only, both("text", "text"))
        .when(k.isNull(), both("", "unknown"))
        .when(has_video & frames_off & hears, both("audio", "video"))
        .when(given.isin(*KINDS), both(given, given))
        .when(k == "video", both(F.when(audio_wanted | audio_required, "video_audio").otherwise("video"), "video"))
        .when(k == "video_no_audio", both(F.when(audio_required, "video_audio").otherwise("video"), "video"))
        .when(k.isin("audio", "image", "text"), both(k, k))
        .otherwise(both("", k))
    )


def supporting_models(models: DataFrame) -> DataFrame:
    """``capability, labels`` of ``label, place, capabilities`` (an array): the models that have it, in their order."""
    each = models.select("label", "place", F.explode("capabilities").alias("capability"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "label"))), lambda x: x["label"])
    return each.groupBy("capability").agg(F.array_join(listed, ", ").alias("labels"))


def classify(items: DataFrame, models: DataFrame) -> DataFrame:
    """Items (``model, capability, kind, has_audio`` and more) with ``status`` pending or unsupported, and a ``message`` for the latter.

    ``models`` has ``model, label, place, capabilities``.
    """
    mine = models.select("model", F.col("label").alias("_label"), F.col("capabilities").alias("_can"))
    others = supporting_models(models).select(F.col("capability").alias("_need"), F.col("labels").alias("_labels"))
    need = F.when(F.col("capability") != "", F.col("capability")).otherwise(F.col("kind"))
    met = items.join(mine, "model", "left").join(others, need == F.col("_need"), "left")
    mute = (F.col("capability") == "audio") & (F.col("kind") == "video") & ~F.col("has_audio")
    able = (F.col("capability") != "") & F.coalesce(F.array_contains("_can", F.col("capability")), F.lit(False))
    named = F.when(F.col("kind") == "audio", "audio-only").otherwise(F.replace("kind", F.lit("_"), F.lit("-")))
    refusal = F.concat(F.coalesce(F.col("_label"), F.col("model")), F.lit(" does not support "), named, F.lit(" input."), F.coalesce(F.concat(F.lit(" Models that do support it: "), F.col("_labels"), F.lit(".")), F.lit("")))
    message = F.when(F.col("kind") == "unknown", "The file could not be inspected.").when(mute, "Visual frames are disabled, but the video has no audio track.").when(~able, refusal)
    out = met.withColumns({"message": message, "status": F.when(message.isNull(), "pending").otherwise("unsupported")})
    return out.drop("_label", "_can", "_need", "_labels")


def allowed_variants(variants: DataFrame, tier: ColumnOrName, headroom_gb: float = 1.4) -> DataFrame:
    """Rows of ``scheme, threshold, size_gb`` whose threshold the tier reaches; a size that leaves headroom lowers it, but for gguf."""
    fits = (F.col("scheme") != "gguf") & (F.col("size_gb") + headroom_gb <= col(tier))
    return variants.filter((col(tier) >= F.col("threshold")) | fits)


def presets_for(presets: DataFrame, groups: list[str], family: str | None = None, modality: str | None = None) -> DataFrame:
    """Presets (``id, group, place, families, modalities``) for a family and a modality, in order of groups and places.

    ``*`` stands for every family; for timechat, presets for video serve video with sound too.
    """
    keep = F.lit(True)
    if family is not None:
        keep = keep & (F.array_contains("families", "*") | F.array_contains("families", family))
    if modality is not None:
        fit = F.array_contains("modalities", modality)
        keep = keep & (fit | F.array_contains("modalities", "video") if family == "timechat" and modality == "video_audio" else fit)
    order = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("group"))
    return presets.filter(keep).orderBy(order, "place")


def carries_context(family: ColumnOrName) -> Column:
    return col(family).isin(*CONTEXT_FAMILIES)


def preset_entries(defaults: DataFrame, users: DataFrame, preferred: str = "", name: str = "name") -> DataFrame:
    """``name, protected`` of stored presets in order: defaults, the preferred first, then users' whose names no default has, case aside."""
    own = users.join(defaults.select(X.fold(name).alias("_d")).distinct(), X.fold(name) == F.col("_d"), "left_anti")
    both = defaults.select(F.col(name).alias("name"), F.lit(True).alias("protected")).unionByName(own.select(F.col(name).alias("name"), F.lit(False).alias("protected")))
    first = F.when(F.col("protected") & (X.fold("name") == X.fold(F.lit(preferred))), 0).when(F.col("protected"), 1).otherwise(2)
    return both.orderBy(first, X.natural_key("name"), "name")


def merge_settings(saved: DataFrame, defaults: DataFrame) -> DataFrame:
    """Every default (``key, value``) with the saved value where there is one; keys that have no default go."""
    s = saved.select("key", F.col("value").alias("_value"), F.lit(True).alias("_saved"))
    return defaults.join(s, "key", "left").select("key", F.when(F.col("_saved"), F.col("_value")).otherwise(F.col("value")).alias("value"))


def unknown_settings(saved: DataFrame, defaults: DataFrame) -> DataFrame:
    """Saved keys that have no default."""
    return saved.join(defaults.select("key"), "key", "left_anti").select("key")


def settings_subset(settings: DataFrame, registry: DataFrame, mark: str) -> DataFrame:
    """``key, value`` of the registered keys (``key, default`` and marks) that ``mark`` holds for, defaults where nothing is set."""
    kept = registry.filter(F.col(mark)).select("key", F.col("default").alias("_default"))
    return kept.join(settings.select("key", F.col("value").alias("_value"), F.lit(True).alias("_set")), "key", "left").select("key", F.when(F.col("_set"), F.col("_value")).otherwise(F.col("_default")).alias("value"))


def map_keys(settings: DataFrame, aliases: DataFrame, registry: DataFrame) -> DataFrame:
    """Settings whose stored names (``stored, key`` in ``aliases``) are turned into registered ones; a name already set under its registered key gives way to that."""
    known = registry.select("key")
    usable = aliases.join(known, "key", "left_semi").join(known.select(F.col("key").alias("stored")), "stored", "left_anti").select(F.col("stored").alias("_stored"), F.col("key").alias("_key"))
    moved = settings.join(usable, F.col("key") == F.col("_stored"), "left")
    named = moved.select(F.coalesce("_key", "key").alias("key"), "value", F.col("_key").isNotNull().cast("int").alias("_alias"))
    return named.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("_alias"))).filter("_r = 1").drop("_r", "_alias")


def recoverable(settings: DataFrame, registry: DataFrame, restore_paths: bool = False) -> DataFrame:
    """``key, value, outcome`` of stored settings: restored, skipped (not kept in metadata, or a path) or unknown."""
    r = registry.select("key", "in_metadata", "is_path")
    skipped = ~F.col("in_metadata") | (F.col("is_path") & F.lit(not restore_paths))
    outcome = F.when(F.col("in_metadata").isNull(), "unknown").when(skipped, "skipped").otherwise("restored")
    return settings.join(r, "key", "left").select("key", "value", outcome.alias("outcome"))


def usable_devices(wanted: Column, available: list[int]) -> Column:
    """``kept, all_kept`` of a list of device numbers: the available ones, each once."""
    kept = F.array_intersect(wanted, F.array(*[F.lit(i) for i in available]))
    return F.struct(kept.alias("kept"), (F.size(kept) == F.size(wanted)).alias("all_kept"))
