"""The set of ranges against a bitmap, and its stream against the batch islands."""

import random

from cuemill.operators import timeline as L
from cuemill.streaming import ranges as S


def bits(pairs):
    return {i for s, e in pairs for i in range(int(s), int(e))}


def test_ranges_against_a_bitmap():
    rng = random.Random(0)
    for _ in range(200):
        held, covered = S.Ranges(), set()
        for _ in range(rng.randint(0, 25)):
            s = rng.randrange(60)
            e = s + rng.choice([0, 1, 2, 5, 20, -3])
            new = held.add(s, e)
            assert bits(new) == set(range(s, e)) - covered and all(b > a for a, b in new)
            covered |= set(range(s, e))
            assert bits(held.pairs()) == covered and all(a[1] < b[0] for a, b in zip(held.pairs(), held.pairs()[1:], strict=False))
        low, high = rng.randrange(60), rng.randrange(70)
        assert bits(held.missing(low, high)) == set(range(low, high)) - covered
        far = low
        while far in covered:
            far += 1
        assert held.prefix(low) == far - low


def test_sets_merge_in_any_tree():
    rng = random.Random(1)
    pairs = [(s, s + rng.randint(0, 4)) for s in (rng.randrange(100) for _ in range(40))]
    parts = [S.Ranges(pairs[i::4]) for i in range(4)]
    one = S.Ranges(parts[0].pairs()).merge(parts[1]).merge(S.Ranges(parts[2].pairs()).merge(parts[3]))
    other = S.Ranges(parts[3].pairs()).merge(S.Ranges(parts[1].pairs()).merge(parts[0]).merge(parts[2]))
    assert one.pairs() == other.pairs() == S.Ranges(pairs).pairs()


def test_the_stream_covers_what_the_batch_does(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        s = rng.randrange(4000) / 4
        rows.append(("hot" if rng.random() < 0.5 else f"k{rng.randrange(3)}", s, s + rng.choice([0.0, 0.25, 1.0, 3.0, 70.0])))
    schema = "k string, start_s double, end_s double"
    for i in range(4):
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):  # started twice: the second run finds nothing new
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
        q = S.covered_stream(stream, ["k"], 50.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        assert q.awaitTermination(300) and q.exception() is None
    pieces = spark.read.parquet(out)
    plain = spark.createDataFrame(rows, schema)
    assert sorted((r["k"], r["start_s"], r["end_s"]) for r in L.islands(pieces, ["k"]).collect()) == sorted((r["k"], r["start_s"], r["end_s"]) for r in L.islands(plain, ["k"]).collect())
    total = lambda df: round(sum(r["end_s"] - r["start_s"] for r in df.collect()), 6)
    assert total(pieces) == total(L.islands(plain, ["k"]))
