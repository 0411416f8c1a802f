"""Sources that a caption goes with."""

import time

from pyspark.sql import functions as F

from cuemill.operators import metadata as M


def test_configured_inputs_come_after_the_entries(spark):
    captions = spark.createDataFrame([("/r/a.txt", "/r"), ("/r/caption.txt", "/r"), ("/q/z.txt", "/q"), ("/p/none.txt", "/p")], "caption_path string, folder string")
    entries = spark.createDataFrame([("/r", 1, "/r/a.txt", "/in/a.mp4"), ("/r", 2, "/r/b.txt", "/in/b.mp4")], "folder string, entry int, output_path string, source_path string")
    named = [("/r", "/in/a.mp4"), ("/r", "/other/A.wav"), ("/r", "/other/c.png"), ("/r", "/other/c.txt"), ("/q", "/in/only.mp4"), ("/q", "/in/only.mp4"), ("/q", None), ("/p", "/x.mp4"), ("/p", "/y.mp4")]
    configured = spark.createDataFrame(named, "folder string, source_path string")
    got = sorted((r["caption_path"], r["rank"], r["source_path"]) for r in M.media_candidates(captions, entries, configured).collect())
    assert got == [("/q/z.txt", 5, "/in/only.mp4"), ("/r/a.txt", 1, "/in/a.mp4"), ("/r/a.txt", 4, "/other/A.wav"), ("/r/caption.txt", 5, "/in/a.mp4"), ("/r/caption.txt", 5, "/other/A.wav"), ("/r/caption.txt", 5, "/other/c.png")]
    assert sorted((r["caption_path"], r["rank"]) for r in M.media_candidates(captions, entries).collect()) == [("/r/a.txt", 1)]


def test_a_folder_of_many_captions_is_no_product(spark):
    n = 3000
    captions = spark.range(n).select(F.concat(F.lit("/r/C "), F.col("id").cast("string"), F.lit(".TXT")).alias("caption_path"), F.lit("/r").alias("folder"))
    name = F.concat(F.lit("/r/c "), (F.col("id") + n // 2).cast("string"))
    entries = spark.range(n).select(F.lit("/r").alias("folder"), F.col("id").alias("entry"), F.concat(name, F.when(F.col("id") % 2 == 0, ".txt").otherwise(".old")).alias("output_path"), F.concat(name, F.lit(".mp4")).alias("source_path"))
    began = time.monotonic()
    got = {r["caption_path"]: (r["rank"], r["source_path"]) for r in M.media_candidates(captions, entries).collect()}
    assert got == {f"/r/C {i}.TXT": (1 if (i - n // 2) % 2 == 0 else 2, f"/r/c {i}.mp4") for i in range(n // 2, n)}
    assert time.monotonic() - began < 60
