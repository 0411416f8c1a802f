"""Scans of large keys in buckets against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from cuemill.operators import clips as K, scans, timeline as L
from cuemill.plans import batch as B


def ranges(n, seed, wide=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        k = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        s = rng.randrange(n * 2) / 4 if rng.random() < 0.9 else 50.0
        out.append((k, s, s + rng.choice([0.0, 0.25, 0.5, 1.0, wide, wide * 10 if rng.random() < 0.02 else 0.25])))
    return [*out, ("a", None, 5.0), ("a", 1.0, None)]


def merged(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2] + 1)
        else:
            out.append((s, e, 1))
    return out


@pytest.mark.parametrize("wide", [3, 400])
@pytest.mark.parametrize("large", [None, 20, 5])
def test_islands_of_a_large_key(spark, wide, large):
    rows = ranges(600, wide, wide)
    df = spark.createDataFrame(rows, "k string, start_s double, end_s double").repartition(4)
    got = L.islands(df, ["k"], large=large)
    assert got.columns == ["k", "start_s", "end_s", "n"]
    for k in {r[0] for r in rows}:
        want = merged([(s, e) for x, s, e in rows if x == k and s is not None and e is not None and e > s])
        assert sorted((r["start_s"], r["end_s"], r["n"]) for r in got.collect() if r["k"] == k) == want
    assert L.islands(df.limit(0), ["k"], large=large).count() == 0


def test_a_large_key_runs_in_many_tasks(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"), F.col("id").cast("double").alias("t"))
    few, cut = scans.split_keys(rows, ["k"], "t", 100)
    sizes = [r["count"] for r in cut.groupBy("k", "_bucket").count().collect()]
    assert sum(sizes) == 2000 and len(sizes) >= 20 and max(sizes) <= 300 and few.count() == 2000


@pytest.mark.parametrize("large", [None, 30])
def test_asof_takes_the_last_span(spark, large):
    rng = random.Random(5)
    spans = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(200) / 2, f"s{i}") for i in range(150)] + [("a", None, "x")]
    points = [(i, rng.choice(["hot", "hot", "a", "none", None]), rng.choice([None, rng.randrange(-20, 220) / 2]), 1) for i in range(300)]
    a = spark.createDataFrame(points, "i int, k string, at double, _n int").drop("_n")
    b = spark.createDataFrame(spans, "k string, began double, name string")
    got = {r["i"]: (r["began"], r["name"]) for r in scans.asof_join(a, b, ["k"], "at", "began", large).collect()}
    assert len(got) == 300
    for i, k, at, _ in points:
        before = [(s, n) for x, s, n in spans if x == k and s is not None and at is not None and s <= at]
        assert got[i] == (max(before) if before else (None, None)), i
    with pytest.raises(ValueError):
        scans.asof_join(a, a, ["k"], "at", "at")


@pytest.mark.parametrize("large", [None, 10])
def test_times_go_back_to_the_source(spark, large):
    chunks = [("r", 1.0, 3.0), ("r", 10.0, 10.0), ("r", 7.0, 8.5), ("r", 20.0, 30.0), ("q", 5.0, 6.0)] + [("m", float(2 * i), 2 * i + 0.5) for i in range(40)]
    points = [("r", t / 4) for t in range(-2, 80)] + [("q", 0.5), ("q", 9.0), ("none", 1.0), ("r", None), ("r", 0.5)] + [("m", t / 8) for t in range(0, 170)]
    got = L.source_times(spark.createDataFrame(points, "k string, at_s double"), spark.createDataFrame(chunks, "k string, c_start double, c_end double"), "k", large).collect()
    want = []
    for k, t in points:
        own, done, found = sorted((a, z) for x, a, z in chunks if x == k and z > a), 0.0, None
        for a, z in own:
            if t is not None and t >= done:
                found = a + t - done
            done += z - a
        if found is not None:
            want.append((k, t, found))
    assert sorted(map(tuple, got)) == sorted(want)


def test_covered_length_keeps_every_row(spark):
    islands = spark.createDataFrame([("k", 0.0, 10.0), ("k", 20.0, 4e9)], "k string, start_s double, end_s double")
    points = spark.createDataFrame([("k", 5.0, 100.0), ("k", 5.0, 100.0), ("k", 10.0, 100.0), ("k", 25.0, 30.0), ("x", 1.0, 2.0), ("k", None, 1.0), ("k", 9.0, 8.0)], "k string, at double, stop double")
    got = sorted((r["k"], r["at"] or -1, r["covered"]) for r in K.covered_length(islands, points, "k").collect())
    assert got == [("k", -1, 0.0), ("k", 5.0, 5.0), ("k", 5.0, 5.0), ("k", 9.0, 0.0), ("k", 10.0, 0.0), ("k", 25.0, 5.0), ("x", 1.0, 0.0)]


def test_asof_makes_no_pairs(spark):
    n = 3000
    a = spark.range(n).select((F.col("id") % 2).alias("k"), F.col("id").alias("i"), F.col("id").cast("double").alias("at"))
    b = spark.range(n).select((F.col("id") % 2).alias("k"), (F.col("id") - 0.5).alias("began"), F.col("id").alias("name"))
    done = scans.asof_join(a, b, ["k"], "at", "began", 100)
    assert done.filter("name = i").count() == n
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("large", [None, 50, 3])
def test_ranks_of_large_keys(spark, large):
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot", "hot", "a", None]), rng.randrange(90), "s" * rng.randrange(3)) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, k string, o int, s string").repartition(5)
    got = {r["i"]: r["n"] for r in scans.ranked(df, ["k"], [F.desc("o"), "s", F.col("i")], "n", large).collect()}
    for k in ("hot", "a", None):
        own = sorted((r for r in rows if r[1] == k), key=lambda r: (-r[2], r[3], r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))
    whole = {r["i"]: r["n"] for r in scans.ranked(df, [], ["o", "i"], "n", large).collect()}
    assert [whole[r[0]] for r in sorted(rows, key=lambda r: (r[2], r[0]))] == list(range(1, 501))
    assert scans.ranked(df.limit(0), ["k"], ["o"], "n", large).count() == 0


def test_batches_of_large_keys(spark):
    rows = [(i, "f" if i % 3 else "g", "Clip" if i % 2 else "clip", "done" if i % 5 == 0 else "pending" if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, d string, s string, status string")
    for large in (None, 10):
        got = {r["i"]: r["status"] for r in B.limit_pending(df, ["i"], 20, ["d"], large).collect()}
        for d in ("f", "g"):
            waits = [r[0] for r in rows if r[1] == d and r[3] == "pending"]
            assert [got[i] for i in waits] == ["pending"] * 20 + ["skipped"] * (len(waits) - 20)
        assert all(got[r[0]] == r[3] for r in rows if r[3] != "pending")
        names = {r["i"]: r["output"] for r in B.output_names(df, "d", "s", ["i"], large).collect()}
        assert len(set(n.lower() + rows[i][1] for i, n in names.items())) == 200 and names[0] == "clip" and names[3] == "Clip_0002"
        shares = {r["i"]: r["share"] for r in B.round_robin(df, ["i"], 7, large=large).collect()}
        assert [shares[i] for i in range(200)] == [i % 7 for i in range(200)]
