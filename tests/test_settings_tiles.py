"""Settings plans against a plain reading, tiles against a scan of all heights."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cuemill.functions import numeric as N
from cuemill.plans import settings as S


def read(fields, rules, given, settings):
    """Field by field, with each one's dependencies first."""
    known, errors = dict(given), {}
    by_name = {f.name: f for f in fields}

    def value(name):
        if name in known:
            return known[name]
        f = by_name[name]
        for a in f.after:
            value(a)
        raw = next((settings[n] for n in (f.names or [f.name]) if settings.get(n) is not None), None)
        got = None
        if raw is not None:
            word = raw.strip().lower()
            try:
                number = float(raw) if "_" not in raw else None
                number = number if number is not None and math.isfinite(number) else None
            except ValueError:
                number = None
            got = {"int": int(number) if number is not None else None, "float": number, "positive": number, "text": raw, "choice": word if word in f.choices else None, "bool": True if word in S.YES else False if word in S.NO else None}[f.kind]
        if f.kind == "positive":
            if raw is not None and raw.strip() and not (got is not None and got > 0):
                errors[name] = ("not above 0", raw)
            known[name] = got if got is not None and got > 0 else None
            return known[name]
        bound = {"frame_cap": given["frame_cap"]}
        low, high = (bound["frame_cap"] if callable(x) else x for x in (f.low, f.high))
        default = {"fps": max(given["default_fps"], 0.01), "max_frames": given["frame_cap"]}[name] if callable(f.default) else f.default
        if raw is not None and got is None:
            errors[name] = ("invalid", raw)
        out = got
        if got is not None and f.kind in ("int", "float"):
            out = got if low is None else max(got, low)
            out = out if high is None else min(out, high)
            if out != got:
                errors[name] = ("out of range", raw)
        out = default if out is None else out
        if name == "max_frames" and out == 0 and not given["sound_only"]:
            out = min(4, given["frame_cap"])
        if name == "segment_mode" and out is None:
            mode = known["split_mode"]
            out = mode if mode in ("whole", "scenes", "fixed", "trainer") else "scenes" if known["scene_detect_enabled"] else "whole"
        if name == "cut_mode" and known["split_mode"] in ("copy", "precise"):
            out = known["split_mode"]
        known[name] = out
        return out

    plan = {f.name: value(f.name) for f in fields}
    found = [(f.name, *errors[f.name]) for f in fields if f.name in errors]
    p = plan
    broken = [p["trim_end_s"] is not None and p["trim_end_s"] <= p["trim_start_s"], 0 < p["scene_max_len_s"] < p["scene_min_len_s"], p["segment_mode"] == "fixed" and p["overlap_s"] >= p["fixed_chunk_s"], p["do_sample"] and p["top_p"] <= 0]
    return plan, found + [(r.name, r.said, None) for r, b in zip(rules, broken, strict=True) if b]


def test_plans_follow_the_plain_reading(spark):
    rng = random.Random(2)
    words = ["", " ", "5", "-3", "1e3", "0", "0.3", "nan", "inf", "abc", "YES", "off", "Fixed", "precise", " 7 ", "99999999999", "-0.5", "trainer", None]
    names = [n for f in S.JOB_FIELDS for n in (f.names or [f.name])]
    rows = [(i, {n: rng.choice(words) for n in rng.sample(names, rng.randint(0, 30))}, rng.choice([2.0, 0.0, 1.5]), rng.choice([0, 1, 3, 768]), rng.random() < 0.5) for i in range(150)] + [(999, None, 2.0, 8, False)]
    df = spark.createDataFrame(rows, "i int, s map<string,string>, rate double, cap int, sound boolean")
    got = {r["i"]: r for r in S.job_plan(df, "s", F.col("rate"), F.col("cap"), F.col("sound")).collect()}
    assert len(S.JOB_FIELDS) >= 40
    seen = set()
    for i, s, rate, cap, sound in rows:
        plan, errors = read(S.JOB_FIELDS, S.JOB_RULES, {"default_fps": rate, "frame_cap": max(cap, 1), "sound_only": sound}, s or {})
        assert got[i]["plan"].asDict() == plan, i
        assert [tuple(e) for e in got[i]["errors"]] == errors, i
        seen |= {(e[0], e[1]) for e in errors}
    assert {r.said for r in S.JOB_RULES} <= {said for _, said in seen}


def test_order_of_fields():
    f = lambda name, *after: S.Field(name, "int", 0, after=after)
    assert [[x.name for x in step] for step in S.in_order([f("c", "b", "x"), f("a"), f("b", "a")], ["x"])] == [["a"], ["b"], ["c"]]
    for bad in ([f("a", "b"), f("b", "a")], [f("a", "zz")], [f("a"), f("a")]):
        with pytest.raises(ValueError):
            S.in_order(bad)
    with pytest.raises(ValueError):
        S.plan(None, "s", [f("a")], [S.Rule("r", ("b",), lambda k: k["b"], "x")])


def scan(least, most, ratio, area):
    best = None
    for h in range(1, most + 1):
        low, high = max(1, math.ceil(least / h)), most // h
        if low <= high:
            w = min(high, max(low, round(ratio * h)))
            score = round(10 * abs(math.log(w / h / ratio)) + abs(math.log(h * w / area)), 10)
            if best is None or score < best[0]:
                best = (score, h, w)
    return best


def test_tiles_equal_the_scan_of_all_heights(spark):
    rng = random.Random(6)
    cases = []
    for i in range(700):
        most = rng.choice([1, 2, 7, 30, 128, 380, 1500, 4000])
        least = rng.choice([1, most, max(1, most - rng.randint(0, most)), max(1, most // 3)])
        ratio = rng.choice([rng.uniform(0.002, 0.2), rng.uniform(0.2, 5), rng.uniform(5, 400), 1.0, 0.5, 2.0, 16 / 9])
        cases.append((i, float(least), float(most), ratio, max(0.5, rng.uniform(0.5, 2) * most)))
    df = spark.createDataFrame(cases, "i int, least double, most double, ratio double, area double")
    got = {r["i"]: r["b"] for r in df.select("i", N.best_tiles(*[F.col(c) for c in ("least", "most", "ratio", "area")]).alias("b")).collect()}
    for i, least, most, ratio, area in cases:
        want = scan(int(least), int(most), ratio, area)
        assert (want is None) == (got[i] is None)
        if want:
            assert abs(got[i]["s"] - want[0]) < 1e-8, (least, most, ratio, area, want, got[i])


def full(height, width, factor, least, most):
    r = lambda v, f: max(factor, f(v / factor) * factor)
    h, w = r(height, round), r(width, round)
    if most is not None and h * w > most:
        s = math.sqrt(height * width / most)
        h, w = (r(max(1, int(v / s)), math.floor) for v in (height, width))
    if least is not None and h * w < least:
        s = math.sqrt(least / (height * width))
        h, w = (r(max(1, math.ceil(v * s)), math.ceil) for v in (height, width))
    if h * w >= (least or 0) and (most is None or h * w <= most):
        return h, w
    tile = factor * factor
    wanted = min(max(height * width, least or 1), most or height * width)
    found = scan(max(1, math.ceil((least or 1) / tile)), int((most or max(h * w, least or 0)) // tile), width / max(1, height), wanted / tile)
    return None if found is None else (found[1] * factor, found[2] * factor)


def test_sizes_within_bounds(spark):
    rng = random.Random(8)
    sizes = [(i, rng.choice([1, 3, 30, 500, 1080, 4000]) + rng.randrange(9), rng.choice([1, 2, 40, 300, 1920, 9000]) + rng.randrange(9)) for i in range(120)] + [(500, 0, 5), (501, None, 5)]
    df = spark.createDataFrame(sizes, "i int, h int, w int")
    for factor, least, most in ((28, 3136, 297_920), (28, 100_000, 100_400), (14, None, 5000), (32, 65_536, None), (16, None, None)):
        got = {r["i"]: r["s"] and (r["s"]["height"], r["s"]["width"]) for r in df.select("i", N.fitted_size("h", "w", factor, least, most).alias("s")).collect()}
        for i, h, w in sizes:
            assert got[i] == (full(h, w, factor, least, most) if h else None), (h, w, factor, least, most)
    with pytest.raises(ValueError):
        N.fitted_size("h", "w", 28, 500, 400)


def test_the_best_tiles_are_looked_for_once(spark):
    df = spark.createDataFrame([(i, 20 + i * 7 % 300, 200 + i * 13 % 1900) for i in range(400)], "i int, h int, w int").select("i", "h", "w", N.fitted_size("h", "w", 28, 28_000, 30_000).alias("s"))
    for r in df.collect():
        assert (r["s"]["height"], r["s"]["width"]) == full(r["h"], r["w"], 28, 28_000, 30_000)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"(?<![a-z])round\(", plan)) == 1
