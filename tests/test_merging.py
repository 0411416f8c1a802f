"""Captions put together from their parts, and changes of JSON documents in any order."""

import json
import random

from pyspark.sql import functions as F

from cuemill.functions import text as X
from cuemill.operators import sidecars as C
from cuemill.plans import merging as G


def render(spark, template, **values):
    return spark.range(1).select(X.render_template(template, {k: F.lit(v) for k, v in values.items()})).first()[0]


def test_templates_close_the_gaps_of_blank_values(spark):
    r = lambda t, **v: render(spark, t, **v)
    assert r("{{TRANSCRIPT}}\n\n{{SOUND_CAPTION}}", TRANSCRIPT="speech", SOUND_CAPTION="") == "speech"
    assert r("{{VIDEO_CAPTION}}\n\n{{AUDIO_CAPTION}}\n{{FILENAME}}", VIDEO_CAPTION="A  video\nsecond line", AUDIO_CAPTION="sound", FILENAME="klip_İ") == "A  video\nsecond line\n\nsound\nklip_İ"
    assert r("before {{EMPTY}} after", EMPTY="") == "before after" and r("({{EMPTY}})", EMPTY=None) == "()"
    assert r("{{ video_caption }}\r\n\r\n{{AUDIO_CAPTION}}", VIDEO_CAPTION="video", AUDIO_CAPTION=" \n") == "video"
    assert r("a {{X}} {{Y}} b{{X}}{{Y}}c {{X}}", X="", Y="") == "a bc" and r("a{{X}} {{Y}}b", X="", Y="") == "a b"
    assert r("{{X}}\n \n\t\n{{LATER}} {{Y}}", X="x", Y=" v  v ") == "x\n\n{{LATER}}  v  v" and r("", X="") == ""


def units(spark, rows):
    return spark.createDataFrame(rows, "folder string, stem string, filename string, video_caption string, transcript string, sound_caption string, structured string, has_video boolean")


def test_units_and_their_files(spark):
    rows = [
        ("/o", "a", "clip a", "A dog.", "hello", "birds\n", '{"x": [1, null], "video_caption": "old"}', True),
        ("/o", "b/b", "clip b", "A cat.", " ", None, "[1, {}]", True),
        ("/o", "c", "clip c", "", "words", "", '"text"', False),
        ("/o", "d", "clip d", None, None, None, None, True),
        ("/o", "e", "clip e", "", "", "", "no json", False),
    ]
    got = {r["filename"][-1]: r for r in G.caption_units(units(spark, rows), G.CaptionRules(json=True, clear=True)).collect()}
    a = got["a"]
    assert (a["audio_caption"], a["merged_caption"], a["no_speech"], a["note"]) == ("hello\n\nbirds", "A dog.\n\nhello\n\nbirds", False, None)
    files = {k: {f["part"]: (f["path"], f["content"]) for f in r["files"]} for k, r in got.items()}
    assert files["a"]["audio_caption"] == ("/o/audio_caption/a.txt", "hello\n\nbirds\n") and files["a"]["merged_caption"][0] == "/o/a.txt" and files["a"]["json"][0] == "/o/a.json"
    assert json.loads(files["a"]["json"][1]) == {"x": [1, None], "video_caption": "A dog.", "audio_caption": "hello\n\nbirds", "merged_caption": "A dog.\n\nhello\n\nbirds"}
    assert got["b"]["no_speech"] and got["b"]["merged_caption"] == "A cat." and files["b"]["audio_caption"][1] is None
    assert got["b"]["note"] == "No speech detected in clip b; merged caption is the video caption only"
    assert json.loads(files["b"]["json"][1])["segments"] == [1, {}]
    assert set(files["c"]) == {"audio_caption", "json"} and json.loads(files["c"]["json"][1]) == {"caption": "text", "video_caption": "", "audio_caption": "words", "merged_caption": ""}
    assert files["d"]["video_caption"] == ("/o/video_caption/d.txt", "") and files["d"]["merged_caption"][1] == ""
    assert got["e"]["note"].endswith("audio caption skipped") and json.loads(files["e"]["json"][1])["caption"] == "no json"

    only = G.caption_units(units(spark, rows[:3]), G.CaptionRules(only_merged=True, merged=False, json=True, placeholder=" nothing heard ")).collect()
    assert [[f["part"] for f in r["files"]] for r in only] == [["merged_caption"], ["merged_caption"], []]
    assert only[1]["merged_caption"] == "A cat.\n\nnothing heard" and only[1]["no_speech"]
    bare = G.caption_units(units(spark, rows[:1]), G.CaptionRules(audio="{{NOTHING", merged=False)).first()
    assert bare["audio_caption"] == "{{NOTHING" and [f["part"] for f in bare["files"]] == ["video_caption", "audio_caption"]
    empty = G.caption_units(units(spark, rows[:1]), G.CaptionRules(audio=" ")).first()
    assert empty["note"].startswith("Audio caption template rendered empty") and empty["merged_caption"] == "A dog."


def test_items_of_their_clips(spark):
    items = spark.createDataFrame([(1, "/o", "m", "m", "all said", None), (2, "/o", "n", "n", None, None), (3, "/o", "p", "p", "x", '{"k": 1}'), (4, "/o", "q", "q", None, None)], "item int, folder string, stem string, filename string, transcript string, structured string")
    clips = [
        (1, 2, 5.0, 9.5, "/o/m/two.mp4", True, "done", "second", "", "", '{"b": 2}', True),
        (1, 1, 0.0, 5.0, "/tmp/one.mp4", False, "done", "first", " wind ", "said", None, True),
        (1, 3, 9.5, 12.0, "/tmp/x.mp4", False, "failed", "lost", "", "", None, True),
        (2, 1, 0.0, 3.0, "/in/n.mp4", False, "done", "only", "rain", None, '{"a": 1}', None),
        (4, 1, 0.0, 3.0, "/in/q.mp4", False, "done", "", "hum", None, None, False),
    ]
    cuts = spark.createDataFrame(clips, "item int, index int, start_s double, end_s double, media_path string, persistent boolean, status string, caption string, sound_caption string, transcript string, structured string, has_video boolean")
    whole, parts = G.merge_captions(items, cuts, G.CaptionRules(json=True))
    got = {r["item"]: r for r in whole.collect()}
    assert got[1]["video_caption"] == "[00:00:00.000 - 00:00:05.000]\nfirst\n\n[00:00:05.000 - 00:00:09.500]\nsecond"
    assert got[1]["sound_caption"] == "[00:00:00.000 - 00:00:05.000]\nwind" and got[1]["audio_caption"].startswith("all said\n\n[00")
    assert got[1]["message"] == "Captioned 2 segment(s); audio caption saved"
    assert json.loads({f["part"]: f["content"] for f in got[1]["files"]}["json"])["segments"] == [None, {"b": 2}]
    assert (got[2]["video_caption"], got[2]["sound_caption"]) == ("only", "rain") and json.loads(got[2]["files"][-1]["content"])["a"] == 1
    assert got[3]["message"] == "Captioned 0 segment(s); audio caption saved" and got[3]["merged_caption"] == "x" and json.loads(got[3]["files"][-1]["content"])["k"] == 1
    assert got[4]["message"] == "No existing video caption for q; audio caption saved separately" and [f["part"] for f in got[4]["files"]] == ["audio_caption", "json"]
    placed = {(r["item"], r["index"]): [f["path"] for f in r["files"]] for r in parts.collect()}
    assert placed[1, 2][-2:] == ["/o/m/two.txt", "/o/m/two.json"] and placed[1, 1][0] == "/o/m_segments/video_caption/clip_0001.txt"
    assert placed[2, 1] == [] and (1, 3) not in placed
    assert {r["path"] for r in G.unit_files(whole).collect()} > {"/o/m.txt", "/o/n.json"}


def test_captions_rebuilt_after_a_new_video_part(spark):
    rows = [("/o/a.txt", "/o/video_caption/a.txt", "heard", " new ", '{"x": 1, "merged_caption": "m"}'), ("/o/b.txt", "", "heard", " new ", "{}"), ("/o/c.txt", "/v", None, None, "[1]")]
    got = G.rebuilt(spark.createDataFrame(rows, "caption_path string, video_path string, audio_caption string, video_caption string, sidecar string"), G.CaptionRules()).collect()
    assert got[0]["merged_caption"] == "new\n\nheard" and [f["path"] for f in got[0]["files"]] == ["/o/video_caption/a.txt", "/o/a.txt", "/o/a.json"]
    assert json.loads(got[0]["files"][2]["content"]) == {"x": 1, "video_caption": "new", "audio_caption": "heard", "merged_caption": "new\n\nheard"}
    assert got[1]["merged_caption"] == " new " and got[1]["files"] == [] and got[2]["merged_caption"] == "" and len(got[2]["files"]) == 2


def replay(documents, changes):
    """One change after another in the order that counts."""
    state = {p: (json.loads(c), None) for p, c in documents}
    fields = {}
    ranked = sorted(changes, key=lambda c: (c[3], c[4], c[2] is not None, c[2] or ""))
    since = {}
    for p, f, v, at, _ in ranked:
        if f is None:
            since[p] = at
    last_whole = {}
    for p, f, v, at, w in ranked:
        if f is None:
            last_whole[p] = v
        else:
            fields[p, f] = (v, at)
    out = {p: d for p, (d, _) in state.items()}
    for p, v in last_whole.items():
        if v is None:
            out.pop(p, None)
        else:
            out[p] = json.loads(v)
    for (p, f), (v, at) in fields.items():
        if p in since and at <= since[p]:
            continue
        out.setdefault(p, {})
        if v is None:
            out[p].pop(f, None)
        else:
            out[p][f] = json.loads(v)
    return out


def test_changes_in_any_order_make_one_result(spark):
    rng = random.Random(4)
    documents = [(f"d{i}", json.dumps({"a": i, "b": [i], "c": {"x": None}})) for i in range(6)]
    values = [None, "1", '"ü"', "[1, 2]", '{"y": {"z": 1.5}}', "true"]
    changes = []
    for i in range(120):
        p = f"d{rng.randrange(9)}"
        if rng.random() < 0.08:
            changes.append((p, None, rng.choice([None, '{"a": "whole"}']), i // 2, f"w{i % 3}"))
        else:
            changes.append((p, rng.choice("abcd"), rng.choice(values), i // 2, f"w{i % 3}"))
    schema = "path string, field string, value string, at int, writer string"
    docs = spark.createDataFrame(documents, "path string, content string")
    want = {p: d for p, d in replay(documents, changes).items()}
    results = []
    for seed in range(3):
        rows = changes[:]
        random.Random(seed).shuffle(rows)
        a, b, c = (spark.createDataFrame(x, schema) for x in (rows[:50], rows[30:90], rows[80:] + rows[:10]))
        merged = C.merged_changes(C.merged_changes(a, b), c) if seed else C.merged_changes(c, C.merged_changes(b, a), a)
        results.append(sorted((r["path"], r["content"]) for r in C.applied_changes(docs, merged).collect()))
    assert results[0] == results[1] == results[2]
    assert {p: json.loads(c) for p, c in results[0]} == want
    odd = spark.createDataFrame([(None, "a", "1", 1, "w"), ("d0", "a", "{broken", 1, "w"), ("d0", "a", "2", None, "w")], schema)
    assert sorted(map(tuple, C.applied_changes(docs, odd).collect())) == sorted(documents)
    assert [tuple(r) for r in C.applied_changes(spark.createDataFrame([("x", "[1]")], "path string, content string"), spark.createDataFrame([("x", "k", "1", 1, "w")], schema)).collect()] == [("x", '{"k":1}')]
