"""The file sink's commit, and lines of growing files as a stream with offsets."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuemill.sources import files as S

SCHEMA = StructType().add("path", "string").add("content", "string")


def on_disk(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in Path(folder).rglob("*") if p.is_file()}


def test_files_come_back_as_they_were_written(spark, tmp_path):
    rows = [(f"d{i % 3}/ü {i}+%.txt", f"text {i}\r\n" * (i % 4)) for i in range(60)] + [("d0/x.txt", None), (None, "x"), ("d1/./ü 1+%.txt", "text 1\r\n")]
    df = spark.createDataFrame(rows, "path string, content string").repartition(7)
    folder = str(tmp_path / "out")
    S.write_files(df, folder)
    want = {p: c.encode() for p, c in rows if p and c is not None and "/./" not in p}
    assert on_disk(folder) == want
    assert {r["path"]: bytes(r["content"]) for r in S.read_files(spark, folder).collect()} == want
    S.write_files(spark.createDataFrame([("d0/ü 0+%.txt", b"\x00\xff"), ("new", b"n")], "path string, content binary"), folder, commit="task")
    assert on_disk(folder) == want | {"d0/ü 0+%.txt": b"\x00\xff", "new": b"n"}
    S.write_files(df.limit(0), folder)
    assert len(on_disk(folder)) == 61
    S.write_files(spark.createDataFrame([("one", "1")], SCHEMA), folder, mode="overwrite")
    assert on_disk(folder) == {"one": b"1"}


def test_the_last_of_a_path_stays(spark, tmp_path):
    df = spark.createDataFrame([("a", f"v{i}", i) for i in range(50)], "path string, content string, at int").repartition(5)
    S.write_files(df, str(tmp_path / "o"), order="at")
    assert on_disk(tmp_path / "o") == {"a": b"v49"}


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    (folder / "old").mkdir(parents=True)
    (folder / "old" / "kept").write_text("kept")
    rows = spark.range(200, numPartitions=8).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 150, F.raise_error(F.lit("broken"))).otherwise("x").alias("content"))
    spark.dataSource.register(S.FileSink)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            rows.write.format("row_files").mode(mode).save(str(folder))
        assert on_disk(folder) == {"old/kept": b"kept"}
    for bad in ("../up", "/abs", "C:\\x", "_pending/x", "dir/", ""):
        with pytest.raises(Exception, match="not a path"):
            spark.createDataFrame([(bad, "x")], SCHEMA).write.format("row_files").mode("append").save(str(folder))
    assert on_disk(folder) == {"old/kept": b"kept"}


def test_a_task_that_is_killed_leaves_no_half_file(tmp_path):
    folder = tmp_path / "out"
    writer = S.FileWriter({"path": str(folder)}, SCHEMA, overwrite=False)

    def rows(die):
        for i in range(5):
            if die and i == 3:
                raise KeyboardInterrupt
            yield {"path": f"f{i}", "content": "x" * 1000}

    with pytest.raises(KeyboardInterrupt):
        writer.write(rows(die=True))
    # a worker that is killed while it writes leaves part of a file, and no message
    killed = folder / S.PENDING / writer.job / "0-99"
    killed.mkdir()
    (killed / "0.tmp").write_bytes(b"x" * 10)
    assert not [p for p in on_disk(folder) if not p.startswith(S.PENDING)]
    done = writer.write(rows(die=False))
    assert (done.files, done.size) == (5, 5000) and not [p for p in on_disk(folder) if not p.startswith(S.PENDING)]
    writer.commit([done, None])
    assert on_disk(folder) == {f"f{i}": b"x" * 1000 for i in range(5)}


def test_an_overwrite_that_fails_half_way_is_taken_back(tmp_path):
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "a").write_text("old")
    writer = S.FileWriter({"path": str(folder)}, SCHEMA, overwrite=True)
    done = writer.write(iter([{"path": "a", "content": "new"}, {"path": "b", "content": "new"}]))
    os.remove(folder / S.PENDING / writer.job / done.attempt / "1.tmp")
    with pytest.raises(FileNotFoundError):
        writer.commit([done])
    writer.abort([done])
    assert (folder / "a").read_text() == "old" and S.PENDING not in os.listdir(folder)


def test_json_files_and_edited_sidecars(spark, tmp_path):
    texts = [('{"b":1,"a":["é",null]}',), ("[]",), ("no json",), (None,)]
    df = spark.createDataFrame(texts, "j string").select(S.json_text("j").alias("p"), S.json_text(F.col("j"), False).alias("c"))
    assert [r["p"] for r in df.collect()] == ['{\n  "b": 1,\n  "a": [\n    "é",\n    null\n  ]\n}\n', "[]\n", None, None]
    assert [r["c"] for r in df.collect()] == ['{"b":1,"a":["é",null]}', "[]", None, None]
    docs = {"a/1.json": {"x": 1, "caption": "old", "text": "t"}, "a/2.json": {"text": "same"}, "a/3.json": {"caption": 5}, "a/4.json": [1], "b/1.json": {"merged_caption": "m", "caption": "c"}, "a/5.json": {"caption": "unedited"}}
    sidecars = spark.createDataFrame([(p, json.dumps(d)) for p, d in docs.items()] + [("a/6.json", "{broken")], SCHEMA)
    edits = spark.createDataFrame([("a/1.txt", "new ü"), ("a/2.TXT", "same"), ("a/3.txt", "x"), ("a/4.txt", "x"), ("b/1.txt", "z"), ("a/5.md", "x"), ("a/6.txt", "x"), ("a/7.txt", "x"), ("a/1.txt", None)], "path string, text string")
    got = {r["path"]: json.loads(r["content"]) for r in S.synced_sidecars(edits, sidecars).collect()}
    assert got == {"a/1.json": {"x": 1, "caption": "new ü", "text": "t"}, "b/1.json": {"merged_caption": "z", "caption": "c"}}


def test_lines_of_splits_are_all_lines(spark, tmp_path):
    texts = {"a.log": "one\ntwo\r\n\nlong " + "x" * 300 + "\nlast", "b/c.log": "\n\n", "empty.log": "", "d.txt": "other\n", "_hidden.log": "no\n"}
    for f, t in texts.items():
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_bytes(t.encode())
    want, at = [], 0
    for line in texts["a.log"].split("\n"):
        want.append(("a.log", at, line.rstrip("\r")))
        at += len(line) + 1
    want += [("b/c.log", 0, ""), ("b/c.log", 1, "")]
    for size in (1, 7, 100, 1 << 20):
        assert sorted(map(tuple, S.file_lines(spark, str(tmp_path), ".log", size).collect())) == sorted(want)


def run(stream, name, checkpoint, out):
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).option("path", str(out)).trigger(availableNow=True).queryName(name).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_a_stream_that_is_started_again_equals_the_batch(spark, tmp_path):
    src, out, check = tmp_path / "src", tmp_path / "out", tmp_path / "check"
    src.mkdir()
    events = [json.dumps({"ev": "progress", "n": i}) for i in range(50)] + ["plain words", '{"no": "ev"}', "", '{"ev":"done"}']
    (src / "a.log").write_text("\n".join(events[:20]) + "\n" + events[20][:7])  # a line that is being written
    for step in range(4):
        run(S.events_of(S.stream_lines(spark, str(src), ".log", 64)), f"lines{step}", check, out)
        seen = spark.read.parquet(str(out)).count()
        if step == 0:
            assert seen == 20
            with (src / "a.log").open("a") as f:
                f.write(events[20][7:] + "\n" + "\n".join(events[21:30]) + "\n")
            (src / "b.log").write_text("\n".join(events[30:]) + "\n")
        elif step == 1:
            assert seen == 53
            (src / "c.log").write_text("late")
        elif step == 2:
            assert seen == 53  # the line has no end yet
            with (src / "c.log").open("a") as f:
                f.write("\r\n")
    got = sorted(map(tuple, spark.read.parquet(str(out)).select("file", "offset", "line", "ev", "event").collect()))
    assert got == sorted(map(tuple, S.events_of(S.file_lines(spark, str(src), ".log")).collect())) and len(got) == 54
    kinds = {r[2]: r[3] for r in got}
    assert kinds["plain words"] == kinds['{"no": "ev"}'] == kinds["late"] == "stdout" and kinds['{"ev":"done"}'] == "done"


def test_server_sent_lines(spark, tmp_path):
    (tmp_path / "s").write_text('data: {"a": 1}\n: note\n\nevent: x\n  data:[DONE]\ndata:{"b":2} \ndata: 5\ndata: {broken\ndata:\n')
    got = S.events_of(S.file_lines(spark, str(tmp_path)), "sse").orderBy("offset").collect()
    assert [(r["ev"], r["event"]) for r in got] == [("data", '{"a": 1}'), ("data", '{"b":2}'), ("error", "{broken")]


def test_files_that_became_shorter_are_an_error(tmp_path):
    (tmp_path / "a").write_text("one\ntwo\n")
    reader = S.LineStreamReader({"path": str(tmp_path)})
    end = reader.latestOffset()
    assert end == {"a": 8} and [(x.start, x.end) for p in reader.partitions({}, end) for x in p.spans] == [(0, 8)]
    (tmp_path / "a").write_text("one\n")
    with pytest.raises(ValueError, match="shorter"):
        reader.partitions({}, end)


def test_tasks_move_what_is_held(spark, tmp_path):
    folder = tmp_path / "out"
    (folder / "d").mkdir(parents=True)
    (folder / "d" / "f0").write_text("old")
    writer = S.FileWriter({"path": str(folder), "commit": "held", "job": "j"}, SCHEMA, overwrite=False)
    done = writer.write(iter([{"path": f"d/f{i}", "content": f"new {i}"} for i in range(S.LISTED + 5)]))
    writer.commit([done, None])
    assert on_disk(folder / "d") == {"f0": b"old"}  # nothing is in its place before the second job
    os.rename(folder / S.PENDING / "j" / done.attempt / "1.tmp", folder / "d" / "f1")  # by an attempt that was lost
    writer.place(spark)
    assert on_disk(folder) == {f"d/f{i}": f"new {i}".encode() for i in range(S.LISTED + 5)}


def test_folders_are_listed_at_any_depth(spark, tmp_path):
    texts = {"top": "1", "a/b": "22", "a/b.d/c": "", "a/b.d/e/f/g": "4444", "a/b.d/e/_h/i": "x", "_pending/j": "x", "a/.k": "x"}
    for f, t in texts.items():
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text(t)
    shown = {f: t for f, t in texts.items() if t != "x"}
    assert {r["file"]: r["size"] for r in S.found_files(spark, str(tmp_path)).collect()} == {f: len(t) for f, t in shown.items()}
    assert {r["path"]: bytes(r["content"]).decode() for r in S.read_files(spark, f"file://{tmp_path}").collect()} == shown
