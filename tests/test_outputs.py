"""Files of captions and transcripts, and plans of clips."""

import json

import pytest
from pyspark.sql import functions as F

from cuemill.plans import fitness as P
from cuemill.sources import outputs as O

CUES = "array<struct<start_s:double,end_s:double,text:string>>"


def test_files_of_captions(spark):
    rows = [
        (1, "/o/", "a/b.clip.mp4", "said", '{"x": [1, "é"]}', [(0.0, 1.0, "one two three")], "why\n"),
        (2, "/o", "", None, "not json", [], " "),
        (3, "/o", "c?", "t\n", '[{"a": 1}, "two", 3]', None, None),
        (4, "/o", "caption", "x", None, None, "because"),
    ]
    df = spark.createDataFrame(rows, f"i int, f string, s string, t string, j string, c {CUES}, r string")
    got = O.caption_files(df, ["i"], "f", "s", [".JSON", "srt", "vtt", "jsonl", "reasoning", "srt"], text="t", structured="j", cues="c", reasoning="r", width=7)
    files = {(r["i"], r["form"]): (r["path"], r["content"]) for r in got.collect()}
    assert files[1, "txt"] == ("/o/b.clip.txt", "said\n") and json.loads(files[1, "json"][1]) == {"x": [1, "é"]} and files[1, "json"][1].startswith('{\n  "x"')
    assert files[1, "srt"][1] == "1\n00:00:00,000 --> 00:00:01,000\none two\nthree\n" and files[1, "reasoning"] == ("/o/b.clip_reasoning.txt", "why\n")
    assert files[2, "txt"] == ("/o/caption.txt", "") and json.loads(files[2, "json"][1]) == {"text": "not json"} and (2, "srt") not in files and (2, "reasoning") not in files
    assert [json.loads(x) for x in files[3, "jsonl"][1].splitlines()] == [{"a": 1}, "two", 3] and files[3, "txt"] == ("/o/c_.txt", "t\n")
    assert json.loads(files[4, "jsonl"][1]) == {"text": "x"} and files[4, "reasoning"] == ("/o/reasoning.txt", "because\n")
    assert {r["form"] for r in O.caption_files(df, ["i"], "f", "s", ["txt", "vtt"], text="t", cues="c", always_txt=False).collect()} == {"vtt"}
    with pytest.raises(ValueError):
        O.caption_files(df, ["i"], "f", "s", ["doc"], text="t")


def test_files_of_transcripts(spark):
    kind = "array<struct<start_s:double,end_s:double,text:string,words:array<struct<start_s:double,end_s:double,word:string>>>>"
    df = spark.createDataFrame([(1, "/o", "a", [(0.0, 1.0, " so ", [(0.0, 0.5, " so")])], "0101"), (2, "/o", "b", [(0.0, 1.0, "bare", None)], "0102")], f"i int, f string, s string, t {kind}, at string")
    got = {(r["i"], r["form"]): (r["path"], r["content"]) for r in O.transcript_files(df, ["i"], "f", "s", ["srt", "WebVTT", "vtt"], "t", stamp="at", highlight=True).collect()}
    assert set(got) == {(1, "srt"), (1, "vtt"), (1, "companion"), (2, "srt"), (2, "vtt")}
    assert got[1, "srt"] == ("/o/a_transcript-0101.srt", "1\n00:00:00,000 --> 00:00:00,500\n<u>so</u>\n\n")
    assert got[1, "companion"] == ("/o/a_transcript_noword_timestamps-0101.srt", "1\n00:00:00,000 --> 00:00:00,500\nso\n\n")
    assert [r["path"] for r in O.transcript_files(df, ["i"], "f", "s", ["txt"], "t", suffix="", normalize=True, highlight=True).collect()] == ["/o/a.txt", "/o/b.txt"]


def test_fitness_of_clips(spark):
    rows = [("a.mp4", 41, 2.0, 16.0, 1920, 1080), ("b.mp4", None, 6.0, 16.0, 480, 852), ("c.mp4", 200, None, None, None, None), ("d.mp4", None, None, None, 0, 5), ("e.mp4", 81, 5.0, 16.0, 832, 480)]
    df = spark.createDataFrame(rows, "path string, frames int, duration_s double, fps double, width int, height int")
    checked = P.clip_fitness(df, "WAN", "480p", "letterbox")
    got = {r["path"][0]: r for r in checked.collect()}
    assert got["a"]["verdict"] == "will be dropped: 41f < 81f" and got["a"]["warnings"] == ["will be dropped by trainer: only 41 frames, needs 81"] and tuple(got["a"]["bucket"]) == (832, 480)
    assert got["b"]["verdict"] == "OK 93f" and got["b"]["warnings"] == ["trainer will use 93 valid frames from 96 available"] and tuple(got["b"]["bucket"]) == (480, 832)
    assert got["c"]["verdict"] == "sub-split ×2 suggested" and got["d"]["available"] == 0 and not got["d"]["ok"] and got["e"]["warnings"] == []
    assert P.fitness_summary(checked.withColumn("g", F.lit(1)), ["g"]).first()["line"] == "**5 clips** · 2 ready · 2 will be dropped · 1 sub-split suggestions"
    plan = json.loads(P.fitness_plan(checked, F.lit("/in"), "wan", "480p", "letterbox", "plan").first()["json"])
    assert [i["file"] for i in plan["items"]] == [r[0] for r in rows] and plan["items"][4]["bucket"] == [832, 480] and plan["version"] == 1
    assert P.clip_fitness(df, "custom", (640, 360), custom_fps=10.0, custom_frames=60).filter("path = 'b.mp4'").first()["ok"]
    for bad in (("none", "480p"), ("wan", "9p")):
        with pytest.raises(ValueError):
            P.clip_fitness(df, *bad)
