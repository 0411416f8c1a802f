"""Column functions against plain Python and given cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cuemill.functions import numeric as N, parsers as P, text as X, timecode as T
from cuemill.operators import corpus as K


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, make, kind="string"):
    return [r["out"] for r in column(spark, values, kind).select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


TEXTS = ["", "  ", "Hello there. Hello there. Bye!", "One\nOne\nTwo", "A? a! A…", "No marks", "dots... dots... end", "x. y. X. z", "kadın kad kadI", None]


def test_stats(spark):
    got = apply(spark, TEXTS, lambda c: F.array(X.chars(c), X.words(c), X.sentences(c), X.approx_tokens(c), X.lines(c)))
    for text, row in zip(TEXTS, got, strict=True):
        t = text or ""
        marks = re.findall(r"[.!?]+(?=\s|$)", t)
        want = [len(t), len(re.findall(r"\b\w+(?:['’]\w+)*\b", t)), len(marks) or int(bool(t.strip())), -(-len(t) // 4), len(t.splitlines())]
        assert row == want, text


def dedupe(text):
    chunks = re.split(r"(?<=[.!?…])(?=\s)|(?<=\S)(?=[\r\n])", text)
    seen, out = set(), []
    for c in chunks:
        key = " ".join(re.sub(r"[.!?…]+\s*$", "", c).casefold().split())
        if key and key in seen:
            continue
        seen.add(key)
        out.append(c)
    return "".join(out)


def test_sentence_dedupe(spark):
    rng = random.Random(1)
    texts = [t for t in TEXTS if t is not None] + ["".join(rng.choice(["Ab c. ", "ab C! ", "x\n", "yy… ", "z"]) for _ in range(12)) for _ in range(40)] + ['{"a": "b. b."}']
    got = apply(spark, texts, X.dedupe_sentences)
    assert got[-1] == texts[-1]
    for t, g in zip(texts[:-1], got[:-1], strict=True):
        assert g == dedupe(t)


def trim(value, limit, protected=""):
    if limit <= 0 or len(value) <= limit:
        return value
    low = len(protected)
    if low and limit < low:
        return ""
    ends = [m.end() for m in re.finditer(r"[.!?…](?=\s|$)", value) if low <= m.end() <= limit]
    blanks = [m.start() for m in re.finditer(r"\s+", value) if low <= m.start() <= limit]
    return value[: (ends or blanks)[-1]].rstrip() if ends or blanks else protected.rstrip()


@pytest.mark.parametrize("protected", ["", "abc", "abc def ghi"])
def test_trim(spark, protected):
    rng = random.Random(2)
    texts = [protected + "".join(rng.choice("ab. !\n?") for _ in range(rng.randint(0, 40))) for _ in range(120)]
    for limit in (0, 1, 5, 12, 20):
        assert apply(spark, texts, lambda c, n=limit: X.trim_caption(c, n, protected)) == [trim(t, limit, protected) for t in texts]


def test_finalize(spark):
    done = X.finalize_caption("v", prefix=" Pre ", trigger="ohwx", suffix="end", replace=("cat", "dog"))
    got = column(spark, ["```\na cat. A cat.\n```", None]).select(done.alias("o")).collect()
    assert [r["o"] for r in got] == ["Pre ohwx a dog. end", "Pre ohwx end"]
    with pytest.raises(ValueError):
        X.finalize_caption("v", trigger_mode="middle")


def test_replace(spark):
    change = X.replacer(X.parse_replace_pairs("a;b|b;c\nbad rule\ncat;dog"))
    assert change("a b A cat Cat CAT concat") == "b c B dog Dog DOG concat"
    assert X.format_replace_pairs([("a", "b"), ("c", "d")]) == "a;b\nc;d"
    assert apply(spark, ["the theme the.", "kadın kad"], lambda c: X.replace_word(c, "the", "$1")) == ["$1 theme $1.", "kadın kad"]
    assert apply(spark, ["kadın kad"], lambda c: X.replace_word(c, "kad", "x")) == ["kadın x"]
    assert apply(spark, ["a b A", None], lambda c: X.replace_all(c, [("a", "b"), ("b", "a")])) == ["b a B", None]


def test_names_and_lists(spark):
    assert apply(spark, ["a/b:c?.txt", " . ", "con.txt", "x" * 300 + ".mp4"], lambda c: X.safe_name(c)) == ["a_b_c_.txt", "unnamed", "file_con.txt", "x" * 196 + ".mp4"]
    names = ["clip10", "Clip2", "clip1", "a", "2x"]
    assert [r["v"] for r in column(spark, names).orderBy(X.natural_key("v")).collect()] == ["2x", "a", "clip1", "Clip2", "clip10"]
    assert apply(spark, ["SRT, txt;srt", None], lambda c: X.output_formats(c)) == [["txt", "srt"], ["txt"]]
    assert apply(spark, ["1, 2,x 2;3"], lambda c: X.integers(c)) == [[1, 2, 3]]
    assert apply(spark, ["a b c d", None], lambda c: X.last_words(c, 2)) == ["c d", ""]
    assert apply(spark, ["a\n\nb\nc"], X.newest_first) == ["c\nb\na"]


def test_template(spark):
    df = spark.createDataFrame([("v  v", ""), ("", "s")], "a string, b string")
    made = X.render_template("T: {{A}} ({{B}})\n{{B}}\n{{KEEP}}", {"A": F.col("a"), "B": F.col("b")})
    assert [r[0] for r in df.select(made).collect()][0].startswith("T: v  v")
    assert "{{KEEP}}" in df.select(made).first()[0]


def test_times(spark):
    assert apply(spark, [0.0, 3661.0005, -1.0, 59.9999], lambda c: T.stamp(c), "double") == ["00:00:00,000", "01:01:01,000", "00:00:00,000", "00:01:00,000"]
    assert apply(spark, ["1:02", "01:02:03.5", "x", "7", "1:2:3:4"], lambda c: T.seconds_of(c)) == [62.0, 3723.5, None, 7.0, None]
    assert apply(spark, [5.0, 65.0, 3725.0], lambda c: T.duration_text(c), "double") == ["5s", "1m 5s", "1h 2m"]
    assert apply(spark, [512.0, 1536.0], lambda c: T.bytes_text(c), "double") == ["512 B", "1.5 KB"]
    assert apply(spark, [65.0], lambda c: T.chapter(c), "double") == ["01:05"]


def test_numbers(spark):
    assert apply(spark, [3, 41, 81, 200], lambda c: N.valid_floor(c, "wan"), "long") == [None, 41, 81, 129]
    assert apply(spark, ["30000/1001", "25", "0/0", "N/A"], lambda c: F.round(N.fraction(c), 3)) == [29.97, 25.0, None, None]
    assert [tuple(r) for r in apply(spark, [100], lambda c: N.bucket_size(c * 19, c * 10, (854, 480), "letterbox"), "int")] == [(854, 480)]
    assert apply(spark, [5.4, 7.5, 200.0], lambda c: N.memory_tier(c), "double") == [6, 8, 96]
    assert apply(spark, [10], lambda c: N.uniform_indexes(c, 4), "long") == [[0, 3, 6, 9]]
    assert apply(spark, [[], [0.0] * 10, [1.0] * 8 + [0.0] * 8], lambda c: N.silence_ratio(c, 8), "array<double>") == [1.0, 1.0, 0.5]


def test_answers(spark):
    raw = ["<think>r</think> a", "plain", "<think>open", None]
    assert [tuple(r) for r in apply(spark, raw[:3], P.strip_reasoning)] == [("r", "a"), ("", "plain"), ("", "<think>open")]
    assert tuple(apply(spark, raw[2:3], P.split_thinking)[0]) == ("open", "")
    assert apply(spark, ["- Cat, #dog\n dog, ,Big   Cat."], P.tags) == [["cat", "dog", "big cat"]]
    assert apply(spark, ["Lyrics:\n1. one\n- two\n\n* three"], P.lyrics) == [["one", "two", "three"]]
    cues = apply(spark, ["[0:01-0:02] a\nmore\n[3 --> 2] b"], P.bracketed_cues)[0]
    assert [tuple(c) for c in cues] == [(1.0, 2.0, "a\nmore"), (3.0, 3.0, "b")]
    assert apply(spark, ['say {"a": [1, 2,]} now', "none"], P.extract_json) == ['{"a": [1, 2]}', None]
    broken = '[{"timestamp": "0-6", "storyline": "s1"}, {"timestamp": "6-12", "storyline": "s2"}, {"timest'
    assert apply(spark, [broken], lambda c: P.scene_text(P.scenes(c), "chapters")) == ["00:00-00:06 s1\n00:06-00:12 s2"]
    fenced = '```json\n[{"timestamp": "0:00-0:06", "segment_detail_caption": "A cat", "camera_state": "still",}]\n```'
    assert apply(spark, [fenced], lambda c: P.process("timechat_flatten_wan", c)) == ["A cat. still."]
    with pytest.raises(KeyError):
        P.process("unknown", F.lit(""))


def test_decimals_are_those_of_the_binary_value(spark):
    rng = random.Random(5)
    values = [0.25, 0.35, 0.75, 1.25, 2.675, 0.0005, 0.0015, 1.0005, 1023.96, -0.25, -0.04, 0.0, 9007199254740991.0, 1e15 + 0.25]
    values += [rng.randrange(-40000, 40000) / 2 ** rng.randrange(12) for _ in range(500)] + [rng.randrange(100000) / 1000 for _ in range(500)]
    for digits in (1, 2, 3):
        assert apply(spark, values, lambda c: T.fixed(c, digits), "double") == [f"{v:.{digits}f}" for v in values]  # noqa: B023
    assert apply(spark, [1280.0, 1.35 * 1024, 1023.96 * 1024**2, 2.25 * 1024**4], lambda c: T.bytes_text(c), "double") == ["1.2 KB", "1.4 KB", "1024.0 MB", "2.2 TB"]
    assert apply(spark, [4.5e18, float("inf"), None], lambda c: T.fixed(c, 1), "double") == ["4500000000000000000.0", "Infinity", None]


def test_captions_are_cut_and_bound_once(spark):
    df = column(spark, ["One.  Two\n\ntwo.\nOne.   \n Three \t\n" + " " * 60 + "\nEnd… One!", None, ""])
    found = [r["t"] for r in df.select("i", X.sentence_chunks("v").alias("t")).orderBy("i").collect()]
    assert found[0] == re.split(r"(?<=[.!?…])(?=\s)|(?=[\r\n])" + "(?:" + "|".join(rf"(?<=[^\s.!?…][ \t]{{{n}}})" for n in range(51)) + ")", "One.  Two\n\ntwo.\nOne.   \n Three \t\n" + " " * 60 + "\nEnd… One!")
    done = df.select(X.finalize_caption("v", prefix="A", replace=("x", "y"), collapse_whitespace=True, max_length=40).alias("t"))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("sort_array") <= 2
    dup = df.select(F.lit("a A").alias("t"), "i").unionByName(df.select(F.lit(" A  a").alias("t"), (F.col("i") + 10).alias("i")))
    out = K.duplicate_groups(dup, "t", "i")
    assert [tuple(r) for r in out.collect()] == [("a A", 6, 0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "lower(" in line]
