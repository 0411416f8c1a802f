"""Transcripts in every form against what each should hold."""

import json

import pytest
from pyspark.sql import functions as F

from cuemill.operators import transcripts as T

KIND = "array<struct<start_s:double,end_s:double,text:string,words:array<struct<start_s:double,end_s:double,word:string>>>>"
TIMED = [(0.0, 2.0, " Hello there. ", [(0.0, 0.5, " Hello"), (1.0, 1.5, " there.")]), (2.0, 3.0, " bare --> text ", None), (3.0, 3700.0, "x", [(3.0, 3.5, "so")])]
BARE = [(0.0, 1.0, " a\tb ", None), (1.0, 2.0, " ", None), (2.0, 3.0, "c", [])]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(0, TIMED), (1, BARE), (2, [])], f"i int, s {KIND}")


def of(df, form, **options):
    return [r["d"] for r in df.select("i", T.transcript_document(F.col("s"), form, **options).alias("d")).orderBy("i").collect()]


def test_subtitles(df):
    srt = of(df, "srt")
    assert srt[0] == "1\n00:00:00,000 --> 00:00:01,500\nHello there.\n\n2\n00:00:02,000 --> 00:00:03,000\nbare -> text\n\n3\n00:00:03,000 --> 00:00:03,500\nso\n\n"
    assert srt[1].startswith("1\n00:00:00,000 --> 00:00:01,000\na\tb\n\n2\n") and srt[2] == ""
    assert of(df, " .WebVTT")[2] == "WEBVTT\n\n" and of(df, "vtt")[0].startswith("WEBVTT\n\n00:00.000 --> 00:01.500\nHello there.\n\n")
    marked = of(df, "srt", highlight=True)[0]
    assert "00:00:00,000 --> 00:00:00,500\n<u>Hello</u> there.\n" in marked and "00:00:00,500 --> 00:00:01,000\nHello there.\n" in marked and "Hello <u>there.</u>" in marked and marked.count("-->") == 5
    assert of(df, "srt", highlight=True)[1] == srt[1]


def test_other_forms(df):
    assert of(df, "txt") == ["Hello there.\nbare --> text\nx\n", "a\tb\n\nc\n", ""]
    assert of(df, "tsv")[1] == "start\tend\ttext\n0\t1000\ta b\n1000\t2000\t\n2000\t3000\tc\n"
    assert of(df, "lrc")[0] == "[00:00.000]Hello there.[00:02.000]\n\n[00:02.000]bare -> text[00:03.000]\n\n[00:03.000]x[01:01:40.000]\n\n"
    aligned = of(df, "lrc", highlight=True)
    assert aligned[0] == "[00:00.000]Hello [00:01.000] there.[00:01.500]\n\n[00:02.000]bare --> text[00:03.000]\n\n[00:03.000]so[00:03.500]\n\n" and aligned[2] == ""
    assert json.loads(of(df, "json", language=F.lit("en"))[1])["segments"][0]["text"] == " a\tb " and json.loads(of(df, "json")[2]) == {"segments": []}
    with pytest.raises(ValueError):
        T.transcript_document(F.col("s"), "doc")


def test_captions_cut_anew(spark, df):
    words = [(float(i), i + 0.5, f" w{i}" + ("," if i == 9 else "")) for i in range(30)]
    long = [(0.0, 15.0, "t", words[:15]), (15.0, 16.0, " no   words --> here " * 12, None), (16.0, 30.0, "t", words[16:]), (30.0, 31.0, "", None)]
    d = spark.createDataFrame([(0, long), (1, BARE), (2, None)], f"i int, s {KIND}")
    got = [r["c"] for r in d.select("i", T.recut(F.col("s"), longest_s=100.0).alias("c")).orderBy("i").collect()]
    texts = [c["text"] for c in got[0]]
    assert texts == [" ".join(f"w{i}" + ("," if i == 9 else "") for i in range(15)), " ".join(["no words -> here"] * 12), " ".join(f"w{i}" for i in range(16, 30))]
    assert [c["text"] for c in got[1]] == [" a\tb ", " ", "c"] and got[2] is None
    assert of(df, "srt", normalize=True)[0].startswith("1\n00:00:00,000 --> 00:00:01,500\nHello there.\n")
