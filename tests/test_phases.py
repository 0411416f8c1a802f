"""Phases around answers, plans and names, and folds that are cut where nothing reaches over."""

import random

from pyspark.sql import functions as F

from cuemill.operators import timeline as L
from cuemill.plans import phases as H


def test_merges_do_not_reach_over_long_neighbours(spark):
    rng = random.Random(3)
    rows = []
    for k in ["a", "b", None, *"cdefgh"]:
        t = 0.0
        for _ in range(rng.randint(1, 60)):
            t += rng.choice([0.0, 0.1, 0.7, 2.0])
            d = rng.choice([0.2, 0.5, 1.0, 1.4, 3.0])
            rows.append((k, t, t + d))
            t += d * rng.choice([1.0, 1.0, 0.5])
    df = spark.createDataFrame(rows, "k string, start_s double, end_s double").repartition(3)
    got = L.merge_short(df, "k", 1.0).collect()
    for k in {r[0] for r in rows}:
        assert sorted((r["start_s"], r["end_s"]) for r in got if r["k"] == k) == sorted(L._merged_short(sorted((s, e) for x, s, e in rows if x == k), 1.0))


def test_snapped_rows_equal_the_array(spark):
    rng = random.Random(9)
    rows = []
    for k in range(6):
        t = 0.0
        for _ in range(50):
            t += rng.choice([0.0, 0.0, 0.01, 0.03, 0.5])
            d = rng.choice([0.001, 0.02, 0.041, 0.05, 0.9])
            rows.append((k, t, t + d))
            t += d
    df = spark.createDataFrame(rows, "k int, start_s double, end_s double")
    for fps in (23.976, 0.0):
        whole = df.groupBy("k").agg(F.collect_list(F.struct("start_s", "end_s")).alias("r")).select("k", F.explode(L.snap_ranges(F.col("r"), fps)).alias("s")).select("k", "s.*")
        assert sorted(map(tuple, L.snap_rows(df, ["k"], fps).collect())) == sorted(map(tuple, whole.collect()))


def test_sound_captions(spark):
    clips = spark.createDataFrame([(1, 1, "done", "/a"), (1, 2, "done", "/b"), (2, 1, "failed", "/c"), (2, 2, "done", ""), (3, 1, "done", "/d")], "item int, index int, status string, media_path string")
    windows = [(1, 1, 2, False, " birds ", 5, 3, None), (1, 1, 1, False, "wind", 4, 2, None), (1, 1, 3, True, None, None, None, None), (1, 1, 4, False, "  ", 1, 0, None), (1, 2, 1, False, "x", 1, 1, None), (1, 2, 2, False, None, 2, 0, "OOM"), (2, 1, 1, False, "y", 1, 1, None)]
    w = spark.createDataFrame(windows, "item int, index int, place int, silent boolean, text string, prompt_tokens int, new_tokens int, error string")
    got = {(r["item"], r["index"]): (r["sound_caption"], r["audio_windows"], r["prompt_tokens"], r["new_tokens"], r["sound_error"]) for r in H.sound_captions(clips, w, ["item", "index"]).collect()}
    assert got == {(1, 1): ("wind birds", 4, 10, 5, None), (1, 2): ("", 0, 3, 1, "OOM"), (2, 1): (None, None, None, None, None), (2, 2): (None, None, None, None, None), (3, 1): ("", 0, 0, 0, None)}


def test_models_for_sound(spark):
    rows = [("qwen3_omni_captioner_int8", "x", None), ("a_gguf_q8", "x", None), ("A_GGUF_Q4_x", "x", None), ("t_int4", "x", None), ("t_bf16", "timechat", "80"), ("t_bf16", "timechat", "79"), ("q_bf16", "qwen3_omni_instruct", None), ("odd", None, "junk")]
    df = spark.createDataFrame(rows, "v string, f string, m string")
    got = [r[0] for r in df.select(H.sound_model(F.col("v"), F.col("f"), F.col("m"))).collect()]
    assert [g.replace("qwen3_omni_captioner_", "") for g in got] == ["int8", "gguf_q8", "gguf_q4", "int4", "bf16", "int8", "bf16", "int8"]


def test_captions_that_exist(spark):
    items = spark.createDataFrame([(1, "/o", "a", "/in/a.mp4", 5.0), (2, "/o", "b", "/in/b.mp4", None), (3, "/o", "c", "/in/c.tar.mp4", 1.0), (4, "/o", "d", "/in/d", 1.0)], "item int, folder string, stem string, path string, duration double")
    texts = spark.createDataFrame([("/o/video_caption/a.txt", "part\n\n"), ("/o/a.txt", "merged"), ("/o/b.txt", "merged b\r\n"), ("/in/b.txt", "beside"), ("/in/c.tar.txt", "beside c"), ("/o/d.txt", None), (None, "x")], "path string, content string")
    got = {r["item"]: r for r in H.existing_units(items, texts).collect()}
    assert [got[i]["caption"] for i in (1, 2, 3, 4)] == ["part", "merged b", "beside c", ""]
    assert got[1]["message"] == "Existing video caption loaded for a.mp4." and got[4]["message"].startswith("No existing video caption for d;") and not got[4]["has_video"] and got[2]["end_s"] == 0.0


def test_inputs_of_summaries(spark):
    clips = [(1, 1, 0.0, 4.0, " one "), (1, 2, 4.0, 9.9, "two"), (2, 1, 0.0, 4000.0, "a" * 30), (2, 2, 4000.0, 4010.0, "b" * 30), (3, 1, 0.0, 1.0, "only"), (4, 1, 0.0, 1.0, "x" * 50), (4, 2, 1.0, 2.0, "y" * 60), (5, 1, 0.0, 1.0, "p"), (5, 2, 1.0, 2.0, "q")]
    c = spark.createDataFrame([(*x, "done") for x in clips] + [(1, 3, 9.0, 10.0, "bad", "failed")], "item int, index int, start_s double, end_s double, caption string, status string")
    items = spark.createDataFrame([(1, "qwen3_omni_instruct", 1000, 100), (2, "qwen3_omni_thinking", 120, 100), (3, "qwen3_omni_instruct", 1000, 1), (4, "qwen3_omni_instruct", 10, 5), (5, "other", 99, 1)], "item int, family string, context_tokens int, answer_tokens int")
    got = {r["item"]: (r["input"], r["left_out"]) for r in H.summary_inputs(items, c, F.lit(" Sum up: ")).collect()}
    assert got[1] == ("Sum up:\n\n00:00-00:04 one\n00:04-00:09 two", 0)
    assert got[2] == ("Sum up:\n\n01:06:40-01:06:50 " + "b" * 30, 1)
    assert got[4] == ("Sum up:\n\n" + "y" * 11, 2) and set(got) == {1, 2, 4}
    files = H.summary_files(spark.createDataFrame([(1, "/o", "a")], "item int, folder string, stem string"), spark.createDataFrame([(1, "all"), (9, "x")], "item int, summary string"))
    assert [tuple(r) for r in files.collect()] == [("/o/a_summary.txt", "all\n")]


def test_transcription_plans(spark):
    rows = [(1, 0, "/in/a/x.mp4", "/runs/1", None, "/out", False), (2, 3, "/src/b/y.wav", "/runs/2", "/src/", "/out/", True), (2, 1, "/src/z.mp4", "/runs/2", "/src/", "/out/", True), (2, 2, "/src/b/y.wav", "/runs/2", "/src/", "/out/", True), (2, 4, "/else/q.mp4", "/runs/2", "/src/", "/out/", True), (2, 5, "/src/b/r.mp4", "/runs/2", "/src/", "/out/", True)]
    inputs = spark.createDataFrame(rows, "run int, place int, path string, run_dir string, source_root string, output_root string, folder_mode boolean")
    there = spark.createDataFrame([("/out/z.srt",), ("/out/z.srt",)], "path string")
    got = [tuple(r) for r in H.transcription_plan(inputs, there, limit=2, trim_start=1.5, trim_end=9).orderBy("run", "index").collect()]
    assert got[0] == (1, 0, "/in/a/x.mp4", "/runs/1", "x", "/runs/1/x.srt", "pending", None, 1.5, 9.0)
    assert [(r[1], r[3], r[4], r[6], r[7]) for r in got[1:]] == [(0, "/out", "z", "skipped", "Transcript already exists: /out/z.srt"), (1, "/out/b", "y", "pending", None), (2, "/out", "q", "pending", None), (3, "/out/b", "r", "skipped", "Excluded by batch limit of 2 item(s).")]
    beside = H.transcription_plan(inputs, there, beside=True, overwrite=True).filter("run = 2").orderBy("index").collect()
    assert [r["out_dir"] for r in beside] == ["/src", "/src/b", "/else", "/src/b"] and {r["status"] for r in beside} == {"pending"}


def test_facts_of_folders(spark):
    media = spark.createDataFrame([("/m", "/m/a.mp4", "/m", "a", "video"), ("/m", "/m/s/b.mp4", "/m/s", "b", "video"), ("/m", "/m/c.png", "/m", "c", "image"), ("/n", "/n/d.wav", "/n", "d", "audio")], "root string, path string, dir string, stem string, kind string")
    there = spark.createDataFrame([("/o/a.txt",), ("/o/s/b.txt",), ("/o/s/audio_caption/b.txt",), ("/n/d.txt",)], "path string")
    got = {r["root"]: r for r in H.folder_facts(media, there, output_root=F.lit("/o/"), coverage=True, limit=5).collect()}
    assert (got["/m"]["video"], got["/m"]["image"], got["/m"]["total"], got["/m"]["existing"], got["/m"]["audio_captioned"]) == (2, 1, 3, 2, 1)
    assert got["/m"]["line"].startswith("🎬 2 videos · 🎵 0 audios · 🖼️ 1 images · 📄 0 texts · 3 media files · 2 already captioned (&lt;stem&gt;.txt) · 1 with") and got["/m"]["line"].endswith("will be skipped. · limiting to first 5")
    own = {r["root"]: r["line"] for r in H.folder_facts(media, there, overwrite=True, noun="done", kinds=("audio",)).collect()}
    assert own == {"/n": "🎵 1 audios · 1 already done next to source files. Overwrite is on; existing captions will be replaced."}


def test_names_that_are_free(spark):
    wanted = spark.createDataFrame([(i, "/p", s) for i, s in enumerate(["a", "a", "a", "b_0004", "c", "d"])], "i int, f string, s string")
    there = spark.createDataFrame([("/p/a.json",), ("/p/a_0002.json",), ("/p/b_0004.json",), ("/p/b_0005.json",), ("/q/c.json",), ("/p/d_0001.json",)], "path string")
    got = [r["path"] for r in H.free_names(wanted, there, "f", "s", ["i"]).orderBy("i").collect()]
    assert got == ["/p/a_0001.json", "/p/a_0003.json", "/p/a_0004.json", "/p/b_0006.json", "/p/c.json", "/p/d.json"]
    plans = spark.createDataFrame([("/in/My:Clips/", "/p", "2024", "{}"), ("", "/p", "x", "{}"), ("/", "/p/", "s", "[1]"), ("/x", " ", "s", "{}")], "source_folder string, output_dir string, stamp string, json string")
    assert sorted(map(tuple, H.fitness_plan_files(plans, there).collect())) == [("/p/My_Clips_2024.json", "{}"), ("/p/clips_s.json", "[1]")]


def test_catalogues(spark):
    presets = spark.createDataFrame([("p1", "One"), ("p2", "Two")], "id string, title string")
    got = H.looked_up(spark.createDataFrame([("p2",), ("P1",), (None,)], "preset string"), presets, "preset").collect()
    assert sorted((r["preset"] or "", r["title"] or "", r["error"] or "") for r in got) == [("", "", "Unknown: "), ("P1", "", "Unknown: P1"), ("p2", "Two", "")]
    variants = spark.createDataFrame([("m_int8", ["Old M"], "m"), ("n", None, "n")], "key string, aliases array<string>, family string")
    rows = spark.createDataFrame([("M_INT8",), (" old m",), ("n",), ("zz",)], "variant string")
    assert {r["variant"]: r["family"] for r in H.family_of(rows, variants).collect()} == {"M_INT8": "m", " old m": "m", "n": "n", "zz": None}
    files = [("/p/b.json", '{"name": "beta", "user_prompt": "u"}'), ("/p/z.json", '{"name": "Alpha"}'), ("/p/own.json", "{}"), ("/p/bad.json", "[1]"), ("/p/x.json", "{no"), ("/p/n.txt", "{}")]
    assert [r["name"] for r in H.prompt_entries(spark.createDataFrame(files, "path string, content string")).collect()] == ["Alpha", "beta", "own"]
