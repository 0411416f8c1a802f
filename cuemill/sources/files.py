"""One file a row: a sink that commits whole files alone, and lines of growing files as a source with byte offsets.

Both are Python data sources. Paths are URIs that pyarrow knows (``file:``,
``hdfs:``, ``s3:``) or local paths; a folder must be one that driver and executors share.
"""

from __future__ import annotations

import json
import os
import posixpath
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import chain, islice

import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..registry import spread
from ..ship import ship_package

#: Where files stand until their job commits; Spark's readers pass over names that begin so.
PENDING = "_pending"
#: Files that the driver moves at once, and files of one list, which a task moves.
MOVERS, LISTED = 16, 2000
#: Rows and bytes or so of a batch that a task gives out.
ROWS, BYTES = 10_000, 8 << 20


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri("file://" + folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def safe_relative(path: str) -> str:
    """A path within the folder, in plain form; an error for one that leaves it, or that a sink's own files could clash with."""
    parts = path.replace("\\", "/").split("/")
    if not path or path.startswith(("/", "\\")) or ":" in parts[0] or ".." in parts or parts[0] == PENDING or path.endswith("/"):
        raise ValueError(f"not a path within the folder: {path!r}")
    return posixpath.normpath("/".join(parts))


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: the list of its files stands in its folder, so that only sums come to the driver."""

    attempt: str
    files: int
    size: int


class FileWriter(DataSourceWriter):
    """Writes rows of ``path`` and ``content`` (text or bytes) as files of a folder, by a two-phase commit.

    A task writes into a folder of its own attempt, and at its end a list of
    its files. Only when all tasks have ended does the driver move the files of
    the attempts that count to their places, each at once; so neither a
    task that is killed nor a job that fails leaves a half file, or any. With
    ``commit=task`` a task moves its own files when it ends; a job that fails
    may then leave whole files, never half ones. With ``commit=held`` and a
    ``job`` of the caller's the files stay pending until ``place`` has the
    tasks of a second Spark job move them, as ``write_files`` does.
    """

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        if "path" not in options:
            raise ValueError("give the folder as path")
        if not {"path", "content"} <= set(schema.names):
            raise ValueError("a row needs path and content")
        self.folder, self.overwrite, self.job = options["path"], overwrite, options.get("job") or uuid.uuid4().hex
        self.by_task, self.held = (options.get("commit", "job") == x for x in ("task", "held"))
        if self.by_task and overwrite:
            raise ValueError("commit=task can't overwrite a folder")
        store, _, job = self._places()
        store.create_dir(job, recursive=True)

    def _places(self) -> tuple[pafs.FileSystem, str, str]:
        store, root = open_folder(self.folder)
        return store, root, f"{root}/{PENDING}/{self.job}"

    def write(self, iterator: Iterator) -> Written:
        """A null path or content writes nothing. Rows of one path in a task: the last stays."""
        store, root, job = self._places()
        task = TaskContext.get()
        attempt = f"{task.partitionId()}-{task.taskAttemptId()}" if task else uuid.uuid4().hex
        store.create_dir(f"{job}/{attempt}", recursive=False)  # fails once the job was aborted
        files: dict[str, tuple[str, int]] = {}
        for row in iterator:
            if row["path"] is None or row["content"] is None:
                continue
            path, data = safe_relative(row["path"]), row["content"]
            data = bytes(data) if isinstance(data, bytes | bytearray | memoryview) else data.encode("utf-8")
            held = files[path][0] if path in files else f"{len(files)}.tmp"
            with store.open_output_stream(f"{job}/{attempt}/{held}") as out:
                out.write(data)
            files[path] = held, len(data)
        moves, made = ([held, path] for path, (held, _) in files.items()), set()
        if self.by_task:
            for held, path in moves:
                self._move(store, f"{job}/{attempt}/{held}", f"{root}/{path}", made)
        else:
            for k in range(0, len(files), LISTED):
                with store.open_output_stream(f"{job}/{attempt}/files-{k // LISTED}.jsonl") as out:
                    out.write("".join(json.dumps(x) + "\n" for x in islice(moves, LISTED)).encode())
        return Written(attempt, len(files), sum(n for _, n in files.values()))

    @staticmethod
    def _move(store: pafs.FileSystem, held: str, place: str, made: set[str]) -> None:
        folder = posixpath.dirname(place)
        if folder not in made:
            store.create_dir(folder, recursive=True)
            made.add(folder)
        if isinstance(store, pafs.LocalFileSystem):
            # Renames between folders wait for one another on a Linux disk; new names for a file don't.
            try:
                os.link(held, place)
                os.unlink(held)
                return
            except FileNotFoundError:
                raise
            except OSError:  # the place is taken, or the disk has no links
                pass
        store.move(held, place)

    @staticmethod
    def _listed(store: pafs.FileSystem, attempt: str, number: int) -> list[list[str]]:
        with store.open_input_stream(f"{attempt}/files-{number}.jsonl") as listed:
            return [json.loads(line) for line in listed.read().splitlines()]

    def commit(self, messages: list[Written | None]) -> None:
        store, root, job = self._places()
        if self.held:
            with store.open_output_stream(f"{job}/attempts.json") as out:
                out.write(json.dumps([[m.attempt, m.files] for m in messages if m is not None]).encode())
            return
        if self.overwrite:
            self._set_aside(store, root, f"{job}/old")
        made: set[str] = set()
        with ThreadPoolExecutor(MOVERS) as pool:
            for m in messages:
                if m is None or self.by_task:
                    continue
                for k in range(-(-m.files // LISTED)):
                    moves = self._listed(store, f"{job}/{m.attempt}", k)
                    list(pool.map(lambda x, m=m: self._move(store, f"{job}/{m.attempt}/{x[0]}", f"{root}/{x[1]}", made), moves))
        self._clean(store, root, job)

    def place(self, spark: SparkSession) -> None:
        """Move the files of a job written with ``commit=held`` to their places, a list of LISTED files at a time, by tasks."""
        store, root, job = self._places()
        if self.overwrite:
            self._set_aside(store, root, f"{job}/old")
        with store.open_input_stream(f"{job}/attempts.json") as listed:
            attempts = [x for x in json.loads(listed.read()) if x[1]]

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            store, root, job = self._places()
            made: set[str] = set()
            for batch in batches:
                for attempt, number in zip(batch["attempt"], batch["number"], strict=True):
                    for held, path in self._listed(store, f"{job}/{attempt}", number):
                        try:
                            self._move(store, f"{job}/{attempt}/{held}", f"{root}/{path}", made)
                        except FileNotFoundError:  # an attempt of this task that was lost has moved it
                            if store.get_file_info(f"{root}/{path}").type != pafs.FileType.File:
                                raise
                yield pd.DataFrame({"lists": [len(batch)]})

        if attempts:
            lists = spark.createDataFrame(attempts, "attempt string, files long").select("attempt", F.explode(F.sequence(F.lit(0), F.expr(f"(files - 1) div {LISTED}"))).alias("number"))
            spread(lists).mapInPandas(task, "lists long").agg(F.sum("lists")).collect()
        self._clean(store, root, job)

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing of the job stays, and what was set aside comes back."""
        store, root, job = self._places()
        if self.overwrite and store.get_file_info(f"{job}/old").type == pafs.FileType.Directory:
            for x in store.get_file_info(pafs.FileSelector(f"{job}/old")):
                if store.get_file_info(f"{root}/{x.base_name}").type == pafs.FileType.Directory:
                    store.delete_dir(f"{root}/{x.base_name}")
                store.move(x.path, f"{root}/{x.base_name}")
        self._clean(store, root, job)

    @staticmethod
    def _set_aside(store: pafs.FileSystem, root: str, old: str) -> None:
        store.create_dir(old, recursive=True)
        for x in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if x.base_name != PENDING:
                store.move(x.path, f"{old}/{x.base_name}")

    @staticmethod
    def _clean(store: pafs.FileSystem, root: str, job: str) -> None:
        for left in reversed(range(5)):  # a task that isn't stopped yet may write while its folder goes
            try:
                if store.get_file_info(job).type == pafs.FileType.Directory:
                    store.delete_dir(job)
                break
            except OSError:
                if not left:
                    raise
                time.sleep(0.2)
        pending = f"{root}/{PENDING}"
        if store.get_file_info(pending).type == pafs.FileType.Directory and not store.get_file_info(pafs.FileSelector(pending)):
            store.delete_dir(pending)


class FileSink(DataSource):
    """``df.write.format("row_files").mode("append").save(folder)``; append replaces files of the same paths, overwrite the whole folder."""

    @classmethod
    def name(cls) -> str:
        return "row_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(dict(self.options), schema, overwrite)

    def reader(self, schema: StructType) -> DataSourceReader:
        return FileReader(dict(self.options))


@dataclass
class Whole(InputPartition):
    """Files that a task reads."""

    files: list[str]


class FileReader(DataSourceReader):
    """A row a file; files are dealt to tasks by their sizes."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.suffix, self.size = options["path"], options.get("suffix", ""), int(options.get("splitBytes", SPLIT))

    def partitions(self) -> Sequence[Whole]:
        out, held = [], self.size + 1
        for file, size in sorted(_files(self.folder, self.suffix).items()):
            if held > self.size or len(out[-1].files) >= 10_000:
                out.append(Whole([]))
                held = 0
            out[-1].files.append(file)
            held += size
        return out

    def read(self, partition: Whole) -> Iterator[tuple[str, bytes]]:
        store, root = open_folder(self.folder)
        for file in partition.files:
            with store.open_input_stream(f"{root}/{file}") as f:
                yield file, f.read()


def last_of_path(files: DataFrame, order: str | None = None) -> DataFrame:
    """``path, content`` with one row a path: that of the largest ``order``, else of the largest content; so a rerun writes the same."""
    best = F.max_by("content", F.struct(order, "content")) if order else F.max("content")
    return files.filter("path IS NOT NULL AND content IS NOT NULL").groupBy("path").agg(best.alias("content"))


def write_files(files: DataFrame, folder: str, mode: str = "append", order: str | None = None, commit: str = "job") -> None:
    """Write rows of ``path, content`` as files of a folder, each whole or not at all; of rows with one path the last by ``order`` counts.

    With ``commit="job"`` no file is in its place before all are written; then
    the tasks of a second job move them.
    """
    spark = files.sparkSession
    ship_package(spark)
    spark.dataSource.register(FileSink)
    # The work is by files, however few bytes these have: they are dealt to a set number of tasks.
    rows = last_of_path(spread(files, "path"), order)
    if commit != "job":
        rows.write.format("row_files").mode(mode).option("commit", commit).save(folder)
        return
    job = uuid.uuid4().hex
    rows.write.format("row_files").mode(mode).option("commit", "held").option("job", job).save(folder)
    writer = FileWriter({"path": folder, "job": job}, rows.schema, mode == "overwrite")
    try:
        writer.place(spark)
    except BaseException:
        writer.abort([])
        raise


def hidden(name: str) -> bool:
    """Whether a file or folder is pending or hidden."""
    return name.startswith(("_", "."))


#: Levels of folders that are listed one by one, each dealt to all tasks; what lies deeper is listed with its folder.
LEVELS = 2


def found_files(spark: SparkSession, folder: str, hidden: Callable[[str], bool] = hidden) -> DataFrame:
    """``file, size, modified`` (milliseconds) of every file of a folder, at any depth, listed by tasks when the rows are asked for.

    A folder's own entries are listed in one task.
    """
    ship_package(spark)
    schema = "file string, size long, modified long, folder boolean"

    def task(batches: Iterator[pd.DataFrame], deep: bool) -> Iterator[pd.DataFrame]:
        store, root = open_folder(folder)
        root = root.rstrip("/")
        for batch in batches:
            yield batch[~batch["folder"]]
            for parent in batch["file"][batch["folder"]]:
                found = store.get_file_info(pafs.FileSelector(f"{root}/{parent}", recursive=deep, allow_not_found=not parent))
                for lo in range(0, len(found), ROWS):
                    rows = [(x.path[len(root) + 1 :], x.size or 0, (x.mtime_ns or 0) // 1_000_000, x.type == pafs.FileType.Directory) for x in found[lo : lo + ROWS]]
                    below = len(parent) + 1 if parent else 0
                    yield pd.DataFrame([r for r in rows if not any(map(hidden, r[0][below:].split("/")))], columns=["file", "size", "modified", "folder"])

    found = spark.createDataFrame([("", 0, 0, True)], schema)
    for _ in range(LEVELS):
        found = spread(found.mapInPandas(lambda batches: task(batches, deep=False), schema))
    return found.mapInPandas(lambda batches: task(batches, deep=True), schema).filter("NOT folder").drop("folder")


def _batches(rows: Iterable[tuple], columns: list[str], size: Callable[[tuple], int]) -> Iterator[pd.DataFrame]:
    """Rows in batches of ROWS and BYTES or so."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if len(held) >= ROWS or total >= BYTES:
            yield pd.DataFrame(held, columns=columns)
            held, total = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` within the folder and ``content`` (bytes) of every file in it, empty ones too; what is pending or hidden is left out."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_folder(folder)

        def read(file: str) -> tuple[str, bytes]:
            with store.open_input_stream(f"{root}/{file}") as f:
                return file, f.read()

        yield from _batches(map(read, chain.from_iterable(b["file"] for b in batches)), ["path", "content"], lambda x: len(x[1]))

    return spread(found_files(spark, folder).select("file")).mapInPandas(task, "path string, content binary")


def json_text(document: str | Column, pretty: bool = True) -> Column:
    """A JSON text as it is kept in files: two blanks a level, or nothing between, letters as they are; null for what is no JSON."""

    @F.pandas_udf("string")
    def apply(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: _json_text(t, pretty)).astype(object)

    return apply(F.col(document) if isinstance(document, str) else document)


def _json_text(text: str | None, pretty: bool) -> str | None:
    try:
        value = json.loads(text) if text is not None else None
    except ValueError:
        return None
    if text is None:
        return None
    return json.dumps(value, ensure_ascii=False, indent=2) + "\n" if pretty else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


#: The fields of a document that may hold its caption; the first that holds a text counts.
CAPTION_FIELDS = ["merged_caption", "caption", "text", "final_caption", "description"]


def synced_sidecars(edits: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``path, content`` of the JSON files that change when captions are edited: their caption field takes the text.

    ``edits`` (``path, text``) are .txt files in any case; ``sidecars`` (``path, content``) .json files,
    found by path without suffix. Documents that are no object, have no
    caption field or hold the text already stay as they are and are not given
    out. Of several edits of a path the largest text counts.
    """
    stem = lambda: F.regexp_replace("path", r"\.[^./]+$", "")
    edited = edits.filter("lower(path) LIKE '%.txt' AND text IS NOT NULL").groupBy(stem().alias("_stem")).agg(F.max("text").alias("_text"))
    found = sidecars.filter("path LIKE '%.json'").withColumn("_stem", stem()).join(edited, "_stem")

    @F.pandas_udf("string")
    def synced(contents: pd.Series, texts: pd.Series) -> pd.Series:
        return contents.combine(texts, _synced).astype(object)

    return found.select("path", synced(F.col("content").cast("string"), "_text").alias("content")).filter("content IS NOT NULL")


def _synced(content: str | None, text: str) -> str | None:
    try:
        document = json.loads(content or "")
    except ValueError:
        return None
    field = next((k for k in CAPTION_FIELDS if isinstance(document.get(k), str)), None) if isinstance(document, dict) else None
    if field is None or document[field] == text:
        return None
    return json.dumps(document | {field: text}, ensure_ascii=False, indent=2) + "\n"


@dataclass
class Bytes:
    """Lines of a file that begin within [start, end)."""

    file: str
    start: int
    end: int


@dataclass
class Lines(InputPartition):
    """What a task reads: a split of a large file, or many small files."""

    spans: list[Bytes]


#: Bytes of a file that a task reads, and those searched at a time for a file's last line end.
SPLIT, LOOK = 32 << 20, 64 << 10


def _files(folder: str, suffix: str) -> dict[str, int]:
    store, root = open_folder(folder)
    found = store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    return {x.path[len(root.rstrip("/")) + 1 :]: x.size for x in found if x.type == pafs.FileType.File and x.path.endswith(suffix) and not any(p.startswith(("_", ".")) for p in x.path[len(root) :].split("/"))}


def whole_lines(store: pafs.FileSystem, path: str, start: int, size: int) -> int:
    """Where the last line end at or after ``start`` is behind, ``start`` without any: what stands beyond is a line being written."""
    with store.open_input_file(path) as f:
        high = size
        while high > start:
            low = max(start, high - LOOK)
            f.seek(low)
            at = f.read(high - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return start


def _splits(start: dict[str, int], end: dict[str, int], size: int) -> list[Lines]:
    out, held = [], size
    for x in (Bytes(f, a, min(a + size, int(z))) for f, z in sorted(end.items()) for a in range(int(start.get(f, 0)), int(z), size)):
        if held + x.end - x.start > size:
            out.append(Lines([]))
            held = 0
        out[-1].spans.append(x)
        held += x.end - x.start
    return out


def _read_lines(folder: str, part: Bytes, until: int | None) -> Iterator[tuple[str, int, str]]:
    """(file, offset, line) of the lines that begin in a split. A split that begins within a line leaves it to the one before."""
    store, root = open_folder(folder)
    with store.open_input_file(f"{root}/{part.file}") as f:
        at = part.start
        if at > 0:
            f.seek(at - 1)
            if f.read(1) != b"\n":
                at += len(_line(f))
        f.seek(at)
        rest = b""
        while at < part.end:
            cut = rest.find(b"\n")
            if cut < 0:
                more = f.read(LOOK)
                rest += more
                if more:
                    continue
                if rest and until is None:
                    yield part.file, at, rest.decode("utf-8", "replace").rstrip("\r")
                return
            yield part.file, at, rest[:cut].decode("utf-8", "replace").rstrip("\r")
            at, rest = at + cut + 1, rest[cut + 1 :]


def _line(f) -> bytes:
    out = b""
    while chunk := f.read(LOOK):
        cut = chunk.find(b"\n")
        if cut >= 0:
            return out + chunk[: cut + 1]
        out += chunk
    return out


class LineReader(DataSourceReader):
    """All lines of the files as they stand; a last line without an end counts."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.suffix, self.size = options["path"], options.get("suffix", ""), int(options.get("splitBytes", SPLIT))

    def partitions(self) -> Sequence[Lines]:
        return _splits({}, _files(self.folder, self.suffix), self.size)

    def read(self, partition: Lines) -> Iterator[tuple[str, int, str]]:
        return chain.from_iterable(_read_lines(self.folder, x, None) for x in partition.spans)


class LineStreamReader(DataSourceStreamReader):
    """Lines as they are written to the end of files.

    The offset is, for each file, how many bytes of whole lines were read: a
    line without an end waits. Offsets stand in the checkpoint, and a batch
    that is repeated reads the same bytes; files must only grow. A file that
    became shorter is an error. The offset has an entry a file: a folder of
    millions of files wants several streams.
    """

    def __init__(self, options: dict[str, str]):
        self.folder, self.suffix, self.size = options["path"], options.get("suffix", ""), int(options.get("splitBytes", SPLIT))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = open_folder(self.folder)
        for file, size in _files(self.folder, self.suffix).items():
            known = self.seen.get(file, 0)
            if size > known:
                self.seen[file] = whole_lines(store, f"{root}/{file}", known, size)
        return {f: n for f, n in self.seen.items() if n}

    def partitions(self, start: dict, end: dict) -> Sequence[Lines]:
        self.seen = {f: max(int(n), self.seen.get(f, 0)) for f, n in end.items()} | {f: n for f, n in self.seen.items() if f not in end}
        sizes = _files(self.folder, self.suffix)
        gone = [f for f, n in end.items() if int(n) > int(start.get(f, 0)) and sizes.get(f, 0) < int(n)]
        if gone:
            raise ValueError(f"files became shorter or are gone: {gone[:5]}")
        return _splits(start, end, self.size)

    def read(self, partition: Lines) -> Iterator[tuple[str, int, str]]:
        return chain.from_iterable(_read_lines(self.folder, x, x.end) for x in partition.spans)

    def commit(self, end: dict) -> None:
        pass


class FileLines(DataSource):
    """``spark.read`` or ``spark.readStream`` with ``.format("file_lines").load(folder)``: lines of the folder's files with where they begin."""

    @classmethod
    def name(cls) -> str:
        return "file_lines"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LineReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LineStreamReader(dict(self.options))


def file_lines(spark: SparkSession, folder: str, suffix: str = "", split_bytes: int = SPLIT) -> DataFrame:
    """``file, offset, line`` of all files of a folder whose names end with ``suffix``; tasks list the folder and read its splits."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spans = chain.from_iterable(zip(b["file"], b["start"], b["size"], strict=True) for b in batches)
        lines = chain.from_iterable(_read_lines(folder, Bytes(file, start, min(start + split_bytes, size)), None) for file, start, size in spans)
        yield from _batches(lines, ["file", "offset", "line"], lambda x: len(x[2]))

    files = found_files(spark, folder).filter(F.endswith("file", F.lit(suffix)) & (F.col("size") > 0))
    spans = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"), "size")
    return spread(spans).mapInPandas(task, "file string, offset long, line string")


def stream_lines(spark: SparkSession, folder: str, suffix: str = "", split_bytes: int = SPLIT) -> DataFrame:
    """``file_lines`` as a stream of the lines that are added."""
    ship_package(spark)
    spark.dataSource.register(FileLines)
    return spark.readStream.format("file_lines").option("suffix", suffix).option("splitBytes", split_bytes).load(folder)


def events_of(lines: DataFrame, form: str = "json") -> DataFrame:
    """Adds ``ev, event`` to lines, of a stream or not: worker events a line (``json``), or server-sent ones (``sse``).

    json: an object with ``ev`` is an event; any other line that isn't empty is
    one of kind stdout, with its text. sse: the object after ``data:``; other
    lines, the closing mark and values that are no object are left out, and
    data that is no JSON has the kind error.
    """
    if form == "json":
        text = F.col("line")
        value = F.try_parse_json(text)
        own = F.try_variant_get(value, "$.ev", "string")
        known = F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False)) & own.isNotNull()
        wrapped = F.to_json(F.struct(F.lit("stdout").alias("ev"), text.alias("text")))
        return lines.filter(text != "").withColumns({"ev": F.when(known, own).otherwise("stdout"), "event": F.when(known, text).otherwise(wrapped)})
    if form != "sse":
        raise ValueError("form must be 'json' or 'sse'")
    line = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    data = F.regexp_replace(F.substring(line, F.lit(6), F.length(line)), r"(?U)^\s+", "")
    value = F.try_parse_json(data)
    object_ = F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False))
    kept = lines.filter(line.startswith("data:") & ~data.isin("", "[DONE]") & (value.isNull() | object_))
    return kept.withColumns({"ev": F.when(object_, "data").otherwise("error"), "event": data})
