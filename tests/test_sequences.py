"""Edit scripts, cues and trainers' settings against plain definitions."""

import html
import random
import re

from pyspark.sql import functions as F

from cuemill.functions import labels as B
from cuemill.operators import render as R
from cuemill.plans import segments as S


def least_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def test_edit_scripts_are_shortest_and_whole():
    rng = random.Random(0)
    for n in range(400):
        a, b = ([rng.choice("abcd"[: 2 + n % 3]) for _ in range(rng.randint(0, 14))] for _ in range(2))
        script = B.edits(a, b)
        assert "".join(k + m for k, m, _ in script) == "".join(a) and "".join(k + p for k, _, p in script) == "".join(b)
        assert sum(len(m) + len(p) for _, m, p in script) == least_edits(a, b)


def test_marked_difference_gives_back_both_texts(spark):
    rows = [("a b", "a <c>"), ("", "new"), ("x & y", ""), ("It was, a day.", "It is a fine day!"), (None, None)]
    df = spark.createDataFrame(rows, "o string, n string").select("o", "n", B.marked_difference("o", "n").alias("d"))
    for r in df.collect():
        bare = lambda gone, kept: html.unescape(re.sub(rf"</?{kept}>", "", re.sub(rf"<{gone}>.*?</{gone}>", "", r["d"])))  # noqa: B023, E731
        assert bare("ins", "del") == (r["o"] or "") and bare("del", "ins") == (r["n"] or "")


def plain_cues(words, chars, most, seconds, least):
    """One word after another into a list that is given out whole, or up to its last soft break."""
    out, held = [], []
    give = lambda n: out.append((held[0]["start_s"], max(held[0]["start_s"], held[n - 1]["end_s"]), R.spoken([w["text"] for w in held[:n]])))
    for w in words:
        if w["text"].strip():
            held.append(w)
            breaks = [i for i, x in enumerate(held, 1) if R.ends_clause(x["text"])]
            if R.ends_sentence(w["text"]):
                give(len(held))
                held = []
            elif len(R.spoken([x["text"] for x in held])) >= chars or len(held) >= most or w["end_s"] - held[0]["start_s"] >= seconds:
                n = breaks[-1] if breaks and breaks[-1] >= least else len(held)
                give(n)
                held = held[n:]
    if held:
        give(len(held))
    return out


def word_stream(rng, n):
    t, out = 0.0, []
    for _ in range(n):
        d = rng.choice([0.1, 0.4, 1.5])
        out.append({"start_s": t, "end_s": t + d, "text": rng.choice([" a", " word", " Dr.", " and,", " stop.", "!)", " ", " loooooooooooooooooong", " U.S.", "-->"])})
        t += d + rng.choice([0.0, 0.2])
    return out


def test_cues_follow_the_plain_loop(spark):
    rng = random.Random(1)
    streams = [word_stream(rng, n) for n in (0, 1, 5, 40, 200, 200)]
    for chars, most, seconds, least in ((92, 24, 8.0, 4), (20, 5, 3.0, 2), (10, 100, 100.0, 3)):
        for ws in streams:
            assert [(c["start_s"], c["end_s"], c["text"]) for c in R._cues(ws, chars, most, seconds, least)] == plain_cues(ws, chars, most, seconds, least)
    rows = [(k, i, w["start_s"], w["end_s"], w["text"]) for k, ws in enumerate(streams) for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "k int, i int, start_s double, end_s double, text string")
    got = R.resegment_words(df, ["k"], ["i"], 20, 5, 3.0, 2).orderBy("k", "start_s").collect()
    for k, ws in enumerate(streams):
        assert sorted((r["start_s"], r["end_s"], r["text"]) for r in got if r["k"] == k) == sorted(plain_cues(ws, 20, 5, 3.0, 2))


def test_sentence_ends_alike_in_columns(spark):
    said = ['done."', "Inc.", "U.S.", "so,)", "Dr.", "mr.", "A.", "a.b.", "why?", "x", "", "ok!')]", "no..."]
    df = spark.createDataFrame([(w,) for w in said], "w string").select("w", R.sentence_end(F.col("w")).alias("e"))
    assert {r["w"]: r["e"] for r in df.collect()} == {w: R.ends_sentence(w) for w in said}


def test_trainer_settings():
    assert S.trainer_seconds({"target_seconds": 0, "seconds": 3}) == 3.0 and S.trainer_seconds({"default_frames": (33, 49), "target_fps": 16}) == 33 / 16
    assert S.trainer_seconds({"frames": 81}) is None and S.trainer_seconds({}) is None and S.trainer_seconds(True) is None and S.trainer_seconds([1]) is None


def test_sentences_are_no_groups_of_their_own(spark, capsys):
    rows = [("a", i, float(i), i + 1.0, w) for i, w in enumerate("One two. Three --> four! Five".split())]
    got = R.resegment_words(spark.createDataFrame(rows, "k string, i int, start_s double, end_s double, text string"), ["k"], ["i"])
    assert [tuple(r) for r in got.orderBy("start_s").collect()] == [("a", 0.0, 2.0, "One two."), ("a", 2.0, 5.0, "Three -> four!"), ("a", 5.0, 6.0, "Five")]
    got.explain()
    assert "FlatMapGroups" not in capsys.readouterr().out


def test_a_long_sentence_is_measured_once(monkeypatch):
    calls = []
    whole = R.spoken
    monkeypatch.setattr(R, "spoken", lambda words: calls.append(len(words)) or whole(words))
    words = ["word"] * 2000
    assert list(R.cue_spans(words, [0.0] * 2000, [0.0] * 2000, 1 << 30, 1 << 30, 1e9, 4)) == [(0, 1999)] and not calls
    assert list(R.cue_spans(words, [0.0] * 2000, [0.0] * 2000, 49, 1 << 30, 1e9, 4))[:2] == [(0, 9), (10, 19)]
