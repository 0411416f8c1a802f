"""Clips, transcripts, plans and parsers on small examples and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from cuemill.functions import labels as B, parsers as P, text as X, timecode as T
from cuemill.operators import clips as K, metadata as M, render as R, timeline as L
from cuemill.plans import catalogue as G, segments as S

SEGMENTS = "array<struct<start_s:double,end_s:double,text:string,words:array<struct<start_s:double,end_s:double,word:string,probability:double>>>>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_merge_short_against_a_loop(spark):
    def slow(rows, least):
        rows = sorted(rows)
        while len(rows) > 1:
            i = next((i for i, (s, e) in enumerate(rows) if e - s + 1e-9 < least), None)
            if i is None:
                break
            left = rows[i][0] - rows[i - 1][1] if i else None
            right = rows[i + 1][0] - rows[i][1] if i + 1 < len(rows) else None
            j = i + 1 if left is None else i - 1 if right is None or abs(left) <= abs(right) else i + 1
            a, b = min(i, j), max(i, j)
            rows[a : b + 1] = [(min(rows[a][0], rows[b][0]), max(rows[a][1], rows[b][1]))]
        return rows

    rng, rows, want = random.Random(5), [], []
    for k in range(60):
        t, mine = 0.0, []
        for _ in range(rng.randrange(1, 12)):
            t += rng.choice([0, 0.5, 1, 3])
            mine.append((t, t + rng.choice([0.25, 0.5, 1, 2, 4])))
            t = mine[-1][1] if rng.random() < 0.8 else t
        rows += [(k, *r) for r in mine]
        want += [(k, *r) for r in slow(list(mine), 2.0)]
    got = L.merge_short(spark.createDataFrame(rows, "k int, start_s double, end_s double"), "k", 2.0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_kept_frames_are_two_at_least(spark):
    far = lambda a, b: F.abs(a - b)
    kept = lambda xs: one(spark, L.kept_frames(F.array(*[F.lit(float(x)) for x in xs]).cast("array<double>"), far, 2.0))
    assert kept([1, 1, 1, 1]) == [0, 3]
    assert kept([1, 4, 4, 7]) == [0, 1, 3]
    assert kept([1]) == [0] and kept([]) == []


def test_windows_of_rows(spark):
    df = spark.createDataFrame([(10.0, 4.0, 1.0), (10.0, 0.0, 0.0), (10.0, 2.0, 2.0), (0.0, 4.0, 1.0)], "d double, l double, o double")
    got = [[tuple(w) for w in r["w"]] for r in df.select(L.windows_of(F.col("d"), F.col("l"), F.col("o")).alias("w")).collect()]
    assert got == [[(0.0, 4.0), (3.0, 7.0), (6.0, 10.0)], [], [], []]
    cut = L.cap_ranges(spark.createDataFrame([(1, 5.0, 16.0), (2, 0.0, 3.0)], "i int, s double, e double"), "s", "e", 5.0, 1.0)
    assert sorted(tuple(r) for r in cut.collect()) == [(1, 5.0, 10.0), (1, 9.0, 14.0), (1, 13.0, 16.0), (2, 0.0, 3.0)]


def test_plans(spark):
    assert S.trainer_seconds("wan") == 81 / 16 and S.trainer_seconds(3) == 3.0 and S.trainer_seconds(0) is None and S.trainer_seconds("none") is None
    assert S.trainer_seconds({"frames": [48, 96], "fps": 24}) == 2.0 and S.trainer_seconds({"seconds": 4, "frames": 1, "fps": 1}) == 4.0
    plan = one(spark, S.plan_segments("whole", F.lit(20.0), limit=F.lit(8.0)))
    assert [tuple(x) for x in plan["segments"]] == [(0.0, 8.0), (8.0, 16.0), (16.0, 20.0)]
    assert plan["warnings"] == ["Scene 1 (20 s) exceeds model's 8 s limit -> split into 3 clips"]
    assert one(spark, S.plan_segments("fixed", F.lit(5.0)))["warnings"] == ["No valid fixed clip length was supplied; using one clip."]
    assert one(spark, S.plan_segments("whole", F.lit(None).cast("double")))["segments"] == []
    with pytest.raises(ValueError):
        S.plan_segments("other", F.lit(5.0))
    ranges = F.from_json(F.lit('[{"start_s":3,"end_s":2},{"start_s":2,"end_s":5},{"start_s":0,"end_s":1}]'), "array<struct<start_s:double,end_s:double>>")
    assert [tuple(x) for x in one(spark, S.clean_ranges(ranges))] == [(0.0, 1.0), (2.0, 5.0)]


def transcript(spark, rows):
    return spark.createDataFrame([(rows,)], f"s {SEGMENTS}")


def test_transcripts_of_clips(spark):
    word = lambda a, b, w: (float(a), float(b), w, 0.5)
    rows = [(8.0, 13.0, " one two three", [word(8, 9.5, " one"), word(9.5, 11, " two"), word(11, 13, " three")]), (11.5, 14.0, "plain", None), (20.0, 21.0, "far", None), (11.0, 12.0, " ", [])]
    df = transcript(spark, rows)
    got = df.select(K.clip_segments(F.col("s"), F.lit(10.0), F.lit(12.0)).alias("x")).first()["x"]
    assert [tuple(x) for x in got] == [(0.0, 2.0, "two three"), (1.5, 2.0, "plain")]
    whole = df.select(K.clip_segments(F.col("s"), F.lit(0.0)).alias("x")).first()["x"]
    assert [x["text"] for x in whole] == ["one two three", "plain", "far"]
    cues = df.select(K.word_cues(F.col("s")).alias("x")).first()["x"]
    assert [tuple(x) for x in cues] == [(8.0, 13.0, "one two three"), (11.5, 14.0, "plain"), (20.0, 21.0, "far")]


def test_resegmented_sentences(spark):
    words = "Mr. Smith met Dr. Jones in the U.S. today, they said. Then he left!) And went".split()
    rows = [(i * 0.25, i * 0.25 + 0.2, w) for i, w in enumerate(words)]
    df = spark.createDataFrame([(rows,)], "w array<struct<start_s:double,end_s:double,text:string>>")
    assert [c["text"] for c in df.select(R.resegment(F.col("w")).alias("c")).first()["c"]] == ["Mr. Smith met Dr. Jones in the U.S. today, they said.", "Then he left!)", "And went"]
    assert R.ends_sentence('done."') and not R.ends_sentence("Inc.") and not R.ends_sentence("U.S.") and R.ends_clause("so,)")
    long = [(float(i), i + 0.5, "w," if i == 3 else "w") for i in range(30)]
    df = spark.createDataFrame([(long,)], "w array<struct<start_s:double,end_s:double,text:string>>")
    got = df.select(R.resegment(F.col("w")).alias("c")).first()["c"]
    assert got[0]["text"] == "w w w w," and max(c["end_s"] - c["start_s"] for c in got) <= 9


def test_subtitle_files_and_lines(spark):
    df = spark.createDataFrame([([(1.0, 2.5, "a --> b"), (3700.0, 3701.0, " ")],)], "c array<struct<start_s:double,end_s:double,text:string>>")
    got = df.select(*[R.transcript_file(F.col("c"), f).alias(f) for f in ("srt", "vtt", "txt", "lrc", "tsv")]).first()
    assert got["srt"] == "1\n00:00:01,000 --> 00:00:02,500\na -> b\n\n" and got["vtt"] == "WEBVTT\n\n00:01.000 --> 00:02.500\na -> b\n\n"
    assert got["lrc"] == "[00:01.000]a -> b[00:02.500]\n\n" and got["txt"] == "a --> b\n\n" and got["tsv"].splitlines() == ["start\tend\ttext", "1000\t2500\ta --> b", "3700000\t3701000\t"]
    words = spark.createDataFrame([([(0.0, 1.0, "a"), (2.0, 3.0, "b")],)], "w array<struct<start_s:double,end_s:double,text:string>>")
    assert [tuple(x) for x in words.select(R.highlight(F.col("w")).alias("x")).first()["x"]] == [(0.0, 1.0, "<u>a</u> b"), (1.0, 2.0, "a b"), (2.0, 3.0, "a <u>b</u>")]
    assert one(spark, R.wrap(F.lit("aa bb cccc d"), 5)) == "aa bb\ncccc\nd"


def test_speech_ranges_and_source_times(spark):
    p = [0.1, 0.9, 0.9, 0.4, 0.9, 0.1, 0.1, 0.1, 0.9, 0.1]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(p)], "k string, frame int, p double")
    got = [tuple(r) for r in L.speech_ranges(df, "k", 0.1, least_silence_s=0.15, least_speech_s=0.15, pad_s=0.0).collect()]
    assert [x for r in got for x in r[1:]] == pytest.approx([0.1, 0.5, 0.8, 1.0])
    chunks = spark.createDataFrame([("k", 10.0, 12.0), ("k", 20.0, 25.0)], "k string, c_start double, c_end double")
    at = spark.createDataFrame([("k", 1.0), ("k", 2.0), ("k", 6.0)], "k string, at_s double")
    assert sorted(r["source_s"] for r in L.source_times(at, chunks, "k").collect()) == [11.0, 20.0, 24.0]


def test_fences(spark):
    cases = {"```json\n{}\n```": "{}", "```JavaScript x```": "x", "plain ```": "plain", "```js": "", "﻿```python\nx": "python\nx", "a": "a", "``": "``"}
    df = spark.createDataFrame(list(cases.items()), "a string, b string")
    assert all(r["x"] == r["b"] for r in df.select("a", "b", X.strip_fences("a").alias("x")).collect())
    outer = {"```md\nhello\n```": "hello", "```\nx": "```\nx", "say ```x```": "say ```x```", "``` a b ```": "a b"}
    df = spark.createDataFrame(list(outer.items()), "a string, b string")
    assert all(r["x"] == r["b"] for r in df.select("a", "b", X.strip_outer_fence("a").alias("x")).collect())


def test_times_in_brackets(spark):
    cases = {"[0:05-0:10]": (5.0, 10.0), "1.5 --> 01:02:03.25": (1.5, 3723.25), "3–4": (3.0, 4.0), "a-b": None, "5": None, "1-2-3": None, "1:2.5:3-4": None, "": None}
    for text, want in cases.items():
        got = one(spark, T.seconds_pair(F.lit(text)))
        assert (tuple(got) if got else None) == want, text


def test_trailing_questions(spark):
    head = "The camera moves over a wide valley while the light slowly fades and birds cross the sky. " * 3
    cut = lambda t, capped=True: one(spark, P.trim_trailing_qa(F.lit(t), F.lit(capped)))
    assert cut(head + "\n\n### Question 1: what?\nIt is.\nAnswer: yes") == head.strip()
    assert cut(head + "\nUser: what?\nassistant： yes") == head.strip()
    assert cut(head + "\n<|im_start|>user\nwhy<|im_end|>\n<|im_start|>assistant\nso") == head.strip()
    for kept in (head + "\nQuestion: what?", "Question: a\nAnswer: b", head + "\nAnswer: b\nQuestion: a", head[:100] + "\nQuestion: a\nAnswer: b" + head):
        assert cut(kept) == kept.strip()
    assert cut(head + "\nQ: what?\nA: x", False) == (head + "\nQ: what?\nA: x").strip()


def test_labels(spark):
    assert one(spark, B.context_usage(F.lit(None), F.lit(8))) == "—" and one(spark, B.context_usage(F.lit(1234), F.lit(8192))) == "1,234 / 8,192 (15%)"
    assert one(spark, B.capped_text(F.lit("é" * 10), 13, "more")) == "éééé"[:3] + "\n\nmore"
    assert one(spark, B.unscrambled(F.lit("cafÃ©"))) == "café" and one(spark, B.unscrambled(F.lit("naïve â"))) == "naïve â"
    assert one(spark, B.marked_difference(F.lit("a b"), F.lit("a <c>"))) == "a <del>b</del><ins>&lt;c&gt;</ins>"
    assert one(spark, B.first_cues(F.lit("1\na\n\n2\nb\n\n3\nc\n"), 2)) == "1\na\n\n2\nb"
    assert one(spark, B.finite_window(F.lit("x"), F.lit("2"))) is None and tuple(one(spark, B.finite_window(F.lit("-1"), F.lit("2")))) == (0.0, 2.0)
    assert one(spark, K.segment_probability(F.array(F.lit(0.25), F.lit(None).cast("double"), F.lit(0.5)), F.lit(0.0))) == 0.375


def test_documents_above_captions(spark):
    captions = spark.createDataFrame([("/a/b/c.txt",), ("/a/x.txt",), ("/z/y.txt",)], "caption_path string")
    documents = spark.createDataFrame([("/a",), ("/a/b",)], "folder string")
    assert sorted(tuple(r) for r in M.nearest_metadata(captions, documents, "/a").collect()) == [("/a/b/c.txt", "/a/b"), ("/a/x.txt", "/a")]
    assert one(spark, M.bounded_json(F.lit("[1]"), 10)) is None and one(spark, M.bounded_json(F.lit('{"a":1}'), 3)) is None
    settings = spark.createDataFrame([("old", "1"), ("new", "2"), ("odd", "3")], "key string, value string")
    mapped = G.map_keys(settings, spark.createDataFrame([("old", "new"), ("odd", "even")], "stored string, key string"), spark.createDataFrame([("new",), ("even",)], "key string"))
    assert sorted(tuple(r) for r in mapped.collect()) == [("even", "3"), ("new", "2")]


def test_short_ranges_and_speech_are_no_groups_of_their_own(spark, capsys):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 9.0), (1, 9.0, 18.0), (None, 3.0, 4.0)], "k int, start_s double, end_s double")
    got = L.merge_short(rows, "k", 2.0)
    assert sorted((r["k"] or 0, r["start_s"], r["end_s"]) for r in got.collect()) == [(0, 3.0, 4.0), (1, 0.0, 9.0), (1, 9.0, 18.0)]
    got.explain()
    L.speech_ranges(spark.createDataFrame([(1, 0, 0.9)], "k int, frame int, p double"), "k", 0.1).explain()
    assert "FlatMapGroups" not in capsys.readouterr().out
