"""The throttle with held values: plain clock, batch and stream."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cuemill.streaming import events as E


def by_clock(times, values, step):
    """One tick after another."""
    out, last, held = [], None, None
    todo = sorted(zip(times, values, strict=True))
    for now in range(min(times), max(times) + 2 * step + 1):
        here = [v for t, v in todo if t == now]
        if here and (last is None or now - last >= step):
            out.append((now, here[0], False))
            last, held = now, None
            here = here[1:]
        elif held is not None and now - last == step and not here:
            out.append((now, held, True))
            last, held = now, None
        if here:
            held = here[-1]
    return out


def test_shown_events_follow_the_clock():
    rng = random.Random(0)
    for _ in range(300):
        n, step = rng.randint(1, 12), rng.randint(1, 6)
        times = sorted(rng.sample(range(40), n))
        values = [f"v{i:02}" for i in range(n)]
        assert E._shown(times, values, step)[0] == by_clock(times, values, step)


def events(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = "hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}"
        rows.append((k, datetime(2024, 1, 1) + timedelta(milliseconds=rng.randrange(600_000)), f"e{i:04}"))
    return rows


SCHEMA = "k string, ts timestamp, value string"


def test_parts_between_pauses_are_alike(spark):
    rows = events(1)
    got = E.throttled_last(spark.createDataFrame([*rows, ("none", None, "x")], SCHEMA), ["k"], "ts", "value", 7.0).collect()
    for k in {r[0] for r in rows}:
        own = sorted((round((t - datetime(2024, 1, 1)).total_seconds() * 1000), v) for x, t, v in rows if x == k)
        want, _, _ = E._shown([t for t, _ in own], [v for _, v in own], 7000)
        base = int(datetime(2024, 1, 1).timestamp()) * 1000
        assert sorted((r["us"] // 1000 - base, r["value"], r["held"]) for r in got if r["k"] == k) == sorted(want)
    assert any(r["held"] for r in got) and E.throttled_last(spark.createDataFrame([], SCHEMA), ["k"], "ts", "value", 1.0).count() == 0


def test_the_stream_equals_the_batch_on_shuffled_input(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = sorted(events(2), key=lambda r: r[1])
    random.Random(3).shuffle(tail := rows[:])
    tail.sort(key=lambda r: r[1] + timedelta(seconds=random.Random(r[2]).uniform(0, 50)))  # up to 50 seconds late
    src = tmp_path / "src"
    for i in range(6):
        part = tail[i * 50 : i * 50 + 50]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(src / f"n={i}"))
    end = [("end", datetime(2024, 1, 2), "end"), ("end", datetime(2024, 1, 3), "end")]
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run(n):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(src / "n=*"))
        q = E.throttle_stream(stream, ["k"], "ts", "value", 7.0, "60 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        assert q.awaitTermination(300) and q.exception() is None

    run(0)
    before = spark.read.parquet(out).count()
    spark.createDataFrame(end[:1], SCHEMA).coalesce(1).write.parquet(str(src / "n=7"))
    run(1)  # started again from its checkpoint; time goes on, and what is held is due
    spark.createDataFrame(end[1:], SCHEMA).coalesce(1).write.parquet(str(src / "n=8"))
    run(2)
    got = sorted(map(tuple, spark.read.parquet(out).filter("k <> 'end'").select("k", "us", "value", "held").collect()))
    batch = E.throttled_last(spark.createDataFrame(rows, SCHEMA), ["k"], "ts", "value", 7.0)
    assert got == sorted(map(tuple, batch.select("k", "us", "value", "held").collect()))
    assert 0 < before < len(got)


@pytest.mark.parametrize("large", [None, 40, 10])
def test_events_let_through_on_a_dense_key(spark, large):
    rng = random.Random(11)
    rows = []
    for k, n, pause in (("hot", 600, 1), ("cold", 60, 9), (None, 80, 3)):
        t = 0
        for _ in range(n):
            t += rng.choice([0, 0, 1, 2, pause, 25 if rng.random() < 0.03 else 1])
            rows.append((k, datetime(2024, 1, 1) + timedelta(seconds=t)))
    rows.append(("hot", None))
    for seconds in (5.0, 1.0, 100.0):
        got = E.throttled(spark.createDataFrame(rows, "k string, ts timestamp"), ["k"], "ts", seconds, large).collect()
        for k in ("hot", "cold", None):
            want = []
            for t in sorted(t for x, t in rows if x == k and t is not None):
                if not want or t - want[-1] >= timedelta(seconds=seconds):
                    want.append(t)
            zero = min(r["us"] for r in got)
            first = min(t for x, t in rows if t is not None)
            assert sorted((r["us"] - zero) for r in got if r["k"] == k) == [round((t - first).total_seconds() * 1e6) for t in want], (k, seconds)


def test_stretches_are_no_groups_of_their_own(spark, capsys):
    rows = [("a", 1, None), ("a", 1, "x"), ("a", 3, "y"), (None, 50, "z"), ("a", 100, "w")]
    df = spark.createDataFrame(rows, "k string, t int, value string").select("k", F.timestamp_seconds("t").alias("ts"), "value")
    got = E.throttled_last(df, ["k"], "ts", "value", 7.0)
    assert sorted((r["us"] // 1_000_000, r["k"], r["value"], r["held"]) for r in got.collect()) == [(1, "a", None, False), (8, "a", "y", True), (50, None, "z", False), (100, "a", "w", False)]
    got.explain()
    assert "FlatMapGroups" not in capsys.readouterr().out
