"""Typed plans from flat settings: declared fields and rules, compiled into columns in the order of what they depend on."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X

Fields = Mapping[str, Column]
_TYPES = {"int": "long", "float": "double", "bool": "boolean", "text": "string", "choice": "string", "positive": "double"}
#: The words that stand for yes and no.
YES, NO = ["1", "true", "yes", "on", "enabled"], ["0", "false", "no", "off", "disabled", ""]


@dataclass(frozen=True)
class Field:
    """A field of a plan and where it comes from.

    The first of ``names`` (its own, if none is given) that is set counts.
    ``int`` and ``float`` are numbers within ``low`` and ``high``, ``positive``
    a number above 0 or null, ``choice`` one of ``choices`` in any case,
    ``bool`` a word for yes or no. What is not set, or no such value, takes the
    default: a value, or a function of the plan's fields named in ``after``,
    as bounds may be, too. ``derive`` makes the value from the field's own and these.
    """

    name: str
    kind: str
    default: Any = None
    low: Any = None
    high: Any = None
    names: Sequence[str] = ()
    choices: Sequence[str] = ()
    after: Sequence[str] = ()
    derive: Callable[[Column, Fields], Column] | None = None


@dataclass(frozen=True)
class Rule:
    """What may not be: ``broken`` of the fields ``of`` tells it, ``said`` is its message."""

    name: str
    of: Sequence[str]
    broken: Callable[[Fields], Column]
    said: str


def in_order(fields: Sequence[Field], given: Sequence[str] = ()) -> list[list[Field]]:
    """Fields in steps, each after all that it depends on; an error for unknown names, twice declared ones and circles."""
    names = [f.name for f in fields]
    if len(set(names)) < len(names):
        raise ValueError("a field is declared twice")
    unknown = {a for f in fields for a in f.after} - set(names) - set(given)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    done, steps, left = set(given), [], list(fields)
    while left:
        step = [f for f in left if set(f.after) <= done]
        if not step:
            raise ValueError(f"fields depend on each other: {sorted(f.name for f in left)}")
        steps.append(step)
        done |= {f.name for f in step}
        left = [f for f in left if f.name not in done]
    return steps


def _parsed(f: Field, raw: Column) -> Column:
    """The value that a text stands for; null for none of the kind."""
    number = F.trim(raw).try_cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    word = F.lower(X.strip(raw))
    if f.kind == "int":
        return F.when(F.abs(finite) < 2.0**62, finite.cast("long"))
    if f.kind in ("float", "positive"):
        return finite
    if f.kind == "bool":
        return F.when(word.isin(*YES), True).when(word.isin(*NO), False)
    if f.kind == "choice":
        return F.when(word.isin(*f.choices), word)
    if f.kind == "text":
        return raw
    raise ValueError(f"unknown kind: {f.kind}")


def _error(f: Field, said: str, given: Column) -> Column:
    return F.struct(F.lit(f.name).alias("field"), F.lit(said).alias("said"), given.cast("string").alias("given"))


def compile_field(f: Field, settings: Column, known: Fields) -> tuple[Column, Column]:
    """(value, error or null) of a field from a map of texts and the fields before it."""
    raw = F.coalesce(*[settings[n] for n in (f.names or [f.name])])
    of = lambda x: x(known) if callable(x) else F.lit(x)
    kind = _TYPES[f.kind]
    got = _parsed(f, raw)
    if f.kind == "positive":  # without a bound of its own
        blank = X.strip(raw) == ""
        error = F.when(raw.isNotNull() & ~blank & ~F.coalesce(got > 0, F.lit(False)), _error(f, "not above 0", raw))
        value = F.when(got > 0, got)
    else:
        default = of(f.default).cast(kind)
        bounded = got
        if f.low is not None:
            bounded = F.greatest(bounded, of(f.low).cast(kind))
        if f.high is not None:
            bounded = F.least(bounded, of(f.high).cast(kind))
        bounded = F.when(got.isNotNull(), bounded)
        error = F.when(raw.isNotNull() & got.isNull(), _error(f, "invalid", raw)).when(bounded != got, _error(f, "out of range", raw))
        value = F.coalesce(bounded, default)
    if f.derive is not None:
        value = f.derive(value, known).cast(kind)
    return value, error


def plan(df: DataFrame, settings: str, fields: Sequence[Field], rules: Sequence[Rule] = (), given: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds ``plan`` (a struct of all fields) and ``errors`` (``field, said, given`` of each that isn't as declared, in order, rules last).

    ``settings`` is a column of a map of texts; ``given`` are columns that
    fields may depend on, as a model's limits. Each step of fields is one
    projection over those before, so no expression holds another's twice. A
    null map is one without settings.
    """
    given = dict(given or {})
    lost = {n for r in rules for n in r.of} - {f.name for f in fields} - set(given)
    if lost:
        raise ValueError(f"unknown fields: {sorted(lost)}")
    at = lambda name: f"_plan_{name}"
    wrong = lambda name: f"_error_{name}"
    out = df.withColumns({at(n): c for n, c in given.items()}) if given else df
    for step in in_order(fields, list(given)):
        made: dict[str, Column] = {}
        for f in step:
            made[at(f.name)], made[wrong(f.name)] = compile_field(f, F.col(settings), {n: F.col(at(n)) for n in f.after})
        out = out.withColumns(made)
    broken = [F.when(r.broken({n: F.col(at(n)) for n in r.of}), F.struct(F.lit(r.name).alias("field"), F.lit(r.said).alias("said"), F.lit(None).cast("string").alias("given"))) for r in rules]
    out = out.withColumn("plan", F.struct(*[F.col(at(f.name)).alias(f.name) for f in fields]))
    out = out.withColumn("errors", F.array_compact(F.array(*[F.col(wrong(f.name)) for f in fields], *broken)))
    return out.drop(*[at(f.name) for f in fields], *[wrong(f.name) for f in fields], *[at(n) for n in given])


def _mode(own: Column, k: Fields) -> Column:
    modes = ["whole", "scenes", "fixed", "trainer"]
    return F.coalesce(own, F.when(k["split_mode"].isin(*modes), k["split_mode"]), F.when(k["scene_detect_enabled"], "scenes").otherwise("whole"))


def _cut(own: Column, k: Fields) -> Column:
    return F.when(k["split_mode"].isin("copy", "precise"), k["split_mode"]).otherwise(own)


#: Fields of a captioning job, the names they have in settings, their defaults and bounds.
JOB_FIELDS = [
    Field("temperature", "float", 0.0),
    Field("top_p", "float", 1.0),
    Field("top_k", "int", 0),
    Field("repetition_penalty", "float", 1.0),
    Field("max_new_tokens", "int", 2048, low=1),
    Field("do_sample", "bool", False),
    Field("seed", "int", -1, -1, 2_147_483_647),
    Field("no_repeat_ngram_size", "int", 0, 0, 20),
    Field("context_tokens", "positive"),
    Field("trim_start_s", "float", 0.0, low=0.0, names=("trim_start_s", "trim_start")),
    Field("trim_end_s", "positive", names=("trim_end_s", "trim_end")),
    Field("fps", "float", lambda k: F.greatest(k["default_fps"], F.lit(0.01)), low=0.01, after=("default_fps",)),
    Field("max_frames", "int", lambda k: k["frame_cap"], 0, lambda k: k["frame_cap"], after=("frame_cap", "sound_only"), derive=lambda own, k: F.when((own == 0) & ~k["sound_only"], F.least(F.lit(4), k["frame_cap"])).otherwise(own)),
    Field("max_pixels", "int", 297_920, low=1),
    Field("sampling_strategy", "text", "fps", names=("sampling_strategy", "frame_sampling")),
    Field("audio_sample_rate", "int", 16_000, low=1),
    Field("total_pixel_cap", "int", 0, 0, 400_000_000),
    Field("adaptive_threshold", "float", 2.0, 0.1, 50.0),
    Field("split_mode", "choice", "copy", choices=("whole", "scenes", "fixed", "trainer", "copy", "precise")),
    Field("scene_detect_enabled", "bool", False),
    Field("segment_mode", "choice", None, names=("segment_mode", "segmentation_mode"), choices=("whole", "scenes", "fixed", "trainer"), after=("split_mode", "scene_detect_enabled"), derive=_mode),
    Field("cut_mode", "choice", "copy", names=("cut_mode", "split_cut_mode"), choices=("copy", "precise"), after=("split_mode",), derive=_cut),
    Field("scene_threshold", "float", 27.0),
    Field("scene_min_len_s", "float", 2.0, low=0.0),
    Field("scene_max_len_s", "float", 60.0, low=0.0),
    Field("merge_short_scenes", "bool", True),
    Field("merge_below_s", "float", 2.0, low=0.0),
    Field("fade_threshold", "float", 12.0, 1.0, 100.0),
    Field("fixed_chunk_s", "float", 30.0, low=0.0, names=("fixed_chunk_s", "chunk_s")),
    Field("overlap_s", "float", 0.5, low=0.0, names=("sub_split_overlap_s", "overlap_s")),
    Field("encode_crf", "int", 18, 0, 51),
    Field("quality_frames", "int", 8, 4, 32),
    Field("auto_reject", "bool", False, names=("auto_reject", "auto_reject_enabled")),
    Field("reject_black_luma", "int", 16, 0, 255),
    Field("reject_silence_rms", "float", 0.001, 0.0, 0.1),
    Field("caption_prefix", "text", "", names=("caption_prefix", "prefix")),
    Field("collapse_whitespace", "bool", False),
    Field("max_caption_chars", "int", 0, 0, 100_000),
    Field("subtitle_min_cue_s", "float", 0.5, 0.0, 5.0),
    Field("subtitle_max_line_chars", "int", 0, 0, 200),
    Field("gpu_index", "int", 0, low=0),
    Field("oom_retries", "int", 2, 0, 4),
    Field("oom_degrade_factor", "float", 0.75, 0.5, 0.95),
    Field("context_carry_words", "int", 60, 10, 400),
    Field("summary_max_new_tokens", "int", 1024, 64, 8192),
]
#: What settings may hold but a plan shouldn't: ends before beginnings, cuts that cover nothing.
JOB_RULES = [
    Rule("trim_end_s", ("trim_start_s", "trim_end_s"), lambda k: k["trim_end_s"] <= k["trim_start_s"], "ends before it begins"),
    Rule("scene_max_len_s", ("scene_min_len_s", "scene_max_len_s"), lambda k: (k["scene_max_len_s"] > 0) & (k["scene_max_len_s"] < k["scene_min_len_s"]), "shorter than the least length"),
    Rule("overlap_s", ("segment_mode", "fixed_chunk_s", "overlap_s"), lambda k: (k["segment_mode"] == "fixed") & (k["overlap_s"] >= k["fixed_chunk_s"]), "overlap as long as the window"),
    Rule("top_p", ("do_sample", "top_p"), lambda k: k["do_sample"] & (k["top_p"] <= 0), "nothing to sample from"),
]


def job_plan(df: DataFrame, settings: str, default_fps: Column, frame_cap: Column, sound_only: Column) -> DataFrame:
    """``plan`` and ``errors`` of captioning jobs, with the model's rate, its most frames and whether it takes sound alone."""
    given = {"default_fps": default_fps.cast("double"), "frame_cap": F.greatest(frame_cap.cast("long"), F.lit(1)), "sound_only": sound_only}
    return plan(df, settings, JOB_FIELDS, JOB_RULES, given)
