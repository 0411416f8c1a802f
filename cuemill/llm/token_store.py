"""Token ids in a binary format: fixed-width bit packing with block offsets."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import common as C
from .subwords import DEFAULT, word_ids

#: Shard files begin and end with this; the last bytes before it give the footer's length.
MAGIC = b"CMTOK\x00\x00\x01"
#: Ids of a block. Every block begins at a byte.
BLOCK_IDS = 1 << 16
#: Bytes of text that are encoded at once.
CHUNK = 2 << 20


def bits_for(vocabulary: int) -> int:
    """The least width that holds every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, lowest bit first, filled up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(each[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int, skip: int = 0) -> np.ndarray:
    """``n`` ids from ``data``, the first of them ``skip`` bits in."""
    if bits in (8, 16, 32) and not skip:
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[skip : skip + n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide.ravel(), bitorder="little").view("<u4").astype(np.uint32)


class ShardWriter:
    """Writes one shard: header, packed blocks as they fill, then the index.

    Header: magic, bits (u32), ids of a block (u32). Footer: documents,
    blocks, ids (u64 each), offset of each block (u64), and for each document
    its id (i64), whether it is null (u8) and its number of ids (u64). Then
    the footer's length (u64) and the magic.
    """

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.offsets: list[int] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.held: list[np.ndarray] = []
        self.n_held, self.ids = 0, 0
        head = MAGIC + struct.pack("<II", bits, block_ids)
        out.write(head)
        self.at = len(head)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.ids += len(ids)
        if self.n_held >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for a in range(0, stop, self.block_ids):
            data = pack(ids[a : min(a + self.block_ids, stop)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        null = np.array([d is None for d in self.docs], np.uint8)
        foot = struct.pack("<3Q", len(self.docs), len(self.offsets), self.ids) + np.array(self.offsets, "<u8").tobytes()
        foot += np.array([d or 0 for d in self.docs], "<i8").tobytes() + null.tobytes() + np.array(self.counts, "<u8").tobytes()
        self.out.write(foot + struct.pack("<Q", len(foot)) + MAGIC)


@dataclass
class Shard:
    """The index of a shard; ids are read from the file when asked for."""

    file: object
    bits: int
    block_ids: int
    n_ids: int
    offsets: np.ndarray
    docs: list[int | None]
    counts: np.ndarray

    @staticmethod
    def open(file) -> Shard:
        """``file``: seekable and readable."""
        file.seek(0, 2)
        size = file.tell()
        file.seek(0)
        head = file.read(len(MAGIC) + 8)
        file.seek(size - 8 - len(MAGIC))
        tail = file.read(8 + len(MAGIC))
        if head[: len(MAGIC)] != MAGIC or tail[8:] != MAGIC:
            raise ValueError("this is no whole shard file")
        bits, block_ids = struct.unpack("<II", head[len(MAGIC) :])
        length = struct.unpack("<Q", tail[:8])[0]
        file.seek(size - 8 - len(MAGIC) - length)
        foot = file.read(length)
        n, blocks, ids = struct.unpack_from("<3Q", foot)
        at = 24 + 8 * blocks
        null = np.frombuffer(foot, np.uint8, n, at + 8 * n)
        docs = [None if z else int(d) for d, z in zip(np.frombuffer(foot, "<i8", n, at), null, strict=True)]
        return Shard(file, bits, block_ids, ids, np.frombuffer(foot, "<u8", blocks, 24), docs, np.frombuffer(foot, "<u8", n, at + 9 * n).astype(np.int64))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard; only the bytes that hold them are read."""
        parts = []
        while start < stop:
            block, skip = divmod(start, self.block_ids)
            n = min(stop - start, self.block_ids - skip)
            first, end = skip * self.bits, (skip + n) * self.bits
            self.file.seek(int(self.offsets[block]) + first // 8)
            parts.append(unpack(self.file.read(-(-end // 8) - first // 8), n, self.bits, first % 8))
            start += n
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder (``file:``, ``hdfs:``, ``s3:`` ... or a plain path) and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def encode_store(docs: DataFrame, folder: str, tokenizer: str = DEFAULT, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, and write shard files in ascending ``doc_id`` order.

    Rows are dealt by ranges of ``doc_id`` and sorted within; task k writes one
    file in ``folder``. Returns the manifest, one row a shard in order: ``shard,
    path, start`` (ids of the shards before), ``n_docs, n_ids``. A file that a
    failed attempt leaves has a name of its own and is not in the manifest.

    A null text counts as empty and has the end id alone; null ids come first;
    rows of one id are ordered by their texts and written each; an empty table
    gives no shard.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = word_ids(tokenizer)
        writer, out, path, end = None, None, "", np.array([end_id], table.dtype)
        for batch in batches:
            ids, texts, lo, size = list(batch["doc_id"]), [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]], 0, 0
            for i in range(len(texts) + 1):
                if i == len(texts) or size > CHUNK:
                    for doc, got in zip(ids[lo:i], table.encode(texts[lo:i]), strict=True):
                        if writer is None:
                            fs, base = filesystem(folder)
                            path = f"{base}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
                            fs.create_dir(base, recursive=True)
                            out = fs.open_output_stream(path)
                            writer = ShardWriter(out, bits_for(table.size))
                        writer.add(None if pd.isna(doc) else int(doc), np.concatenate([got, end]))
                    lo, size = i, 0
                if i < len(texts):
                    size += len(texts[i])
        if writer is not None:
            writer.close()
            out.close()
            yield pd.DataFrame([(TaskContext.get().partitionId(), path, len(writer.docs), writer.ids)], columns=["shard", "path", "n_docs", "n_ids"])

    n = partitions or C.shuffle_partitions(docs.sparkSession)
    dealt = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    shards = C.materialize(dealt.mapInPandas(task, "shard int, path string, n_docs long, n_ids long"), "tokens")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("shard", "path", "start", "n_docs", "n_ids")


def read_store(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files: ids are unpacked block by block."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"], strict=True):
                with fs.open_input_file(path) as file:
                    shard = Shard.open(file)
                    first = np.concatenate([[0], np.cumsum(shard.counts)]).astype(np.int64)
                    lo = 0
                    while lo < len(shard.docs):
                        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + 16 * BLOCK_IDS, side="right")) - 1)
                        ids = shard.ids(int(first[lo]), int(first[hi])).astype("<u4")
                        cut = first[lo : hi + 1] - first[lo]
                        crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                        yield pd.DataFrame({"doc_id": pd.array(shard.docs[lo:hi], "Int64"), "start": start + first[lo:hi], "n_tokens": shard.counts[lo:hi], "ids_crc32": crc})
                        lo = hi

    shards = max(1, manifest.count())
    return manifest.repartition(shards, "shard").mapInPandas(task, "doc_id long, start long, n_tokens long, ids_crc32 long")
