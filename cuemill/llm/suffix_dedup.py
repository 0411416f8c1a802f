"""Suffix-array dedup: a distributed merge sort of suffixes that knows their common prefixes.

A window is a string of LENGTH bytes inside a document. Its anchor is the
leftmost place in it whose GRAM-byte hash is least, so equal windows have their
anchors at equal places. Suffixes are sorted at anchors alone (a sparse suffix
array, about one byte in 185): an item is an anchor with the windows it serves,
cut to the bytes that these cover.

An item that shares no mark (a hash of about half a window beside its anchor)
with any other has no window that repeats; marks are counted first, and the
other items are not sorted.

Each task sorts its items into runs, front-codes them (the length of the prefix
shared with the item before, and the rest) and deals them out by ranges of the
suffix. A loser tree merges the runs of a range; every string in it carries its
common prefix with the last winner, and two strings are compared only from
there on, if at all. In the merged order, the windows at offset o before their
anchors are equal where neighbours share LENGTH - o bytes to the right and the
last o bytes to the left, which is told exactly by refining ranks byte by byte.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from . import common as C

#: Bytes of a window, and of the strings whose hashes choose anchors.
LENGTH, GRAM = 400, 32
#: Words of a passage, and bytes that stand for a word: of two passages that differ in a word, one in 2^40 would be taken for alike.
PASSAGE, CODE = 51, 5
#: Bytes that are hashed at once (24 bits hold a place; 8 bytes each, in arrays that stay in a core's cache), items of a run, and items whose flags are read at once.
PIECE, RUN_ITEMS, FLAGGED = 24 << 10, 40_000, 8192
#: Rows drawn to place the range borders, and bytes of a border. They set the balance of tasks, never a result.
SAMPLE_ROWS, BORDER = 2000, 12
#: Marks that a task holds before it deals them out.
MARKS = 200_000
#: Bytes of text whose items one range is meant to hold.
RANGE_BYTES = 10 << 20


@dataclass
class Items:
    """Anchors: document number, place, least and largest offset of the windows served, bytes from the first window to the anchor and from it on."""

    doc: list[int]
    place: list[int]
    least: list[int]
    left: list[bytes]
    right: list[bytes]

    def extend(self, other: Items) -> None:
        for name in ("doc", "place", "least", "left", "right"):
            getattr(self, name).extend(getattr(other, name))

    def __len__(self) -> int:
        return len(self.doc)


def no_items() -> Items:
    return Items([], [], [], [], [])


@dataclass
class Anchors:
    """Anchors in ``data``, pieces of documents end to end; places and lengths are in units.

    ``piece``: the piece of each, ``at``: its place, ``low, high``: the first and last window served. Windows whose anchor is at an
    offset of ``half`` at most share ``near`` (a hash of what they all hold from the anchor on), the others ``far`` (of what they
    all hold up to the end of the anchor's gram); 0 where there is no such window.
    """

    data: bytes
    piece: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    half: int
    near: np.ndarray
    far: np.ndarray


def _units(data: bytes, unit: int) -> np.ndarray:
    if unit == 1:
        return np.frombuffer(data, np.uint8).astype(np.uint64)
    wide = np.zeros((len(data) // unit, 8), np.uint8)
    wide[:, :unit] = np.frombuffer(data, np.uint8).reshape(-1, unit)
    return wide.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def find_anchors(texts: list[tuple[int, int, bytes]], length: int = LENGTH, gram: int = GRAM, unit: int = 1) -> Anchors:
    """Anchors of pieces of documents, given as (document, place of the piece in it, bytes) with a window at least; PIECE bytes or so in all.

    ``length`` and ``gram`` are in units of ``unit`` bytes, and a window begins at a unit.
    """
    data = b"".join([t[2] for t in texts])
    h, size, mult = _units(data, unit), 1, 0x9E3779B97F4A7C15
    while size < gram:  # the hash of 2 * size units from those of size
        h = (h[:-size] ^ (h[:-size] >> np.uint64(29))) * np.uint64(mult) + h[size:]
        size *= 2
    grams = h
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    span, reach = length - gram + 1, 1
    while 2 * reach <= span:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    if reach < span:
        h = np.minimum(h[: len(h) - (span - reach)], h[span - reach :])
    anchor = (h & np.uint64(0xFFFFFF)).astype(np.int64)  # of the window that begins at each unit
    begin = np.cumsum([0] + [len(t[2]) // unit for t in texts])
    sizes = np.diff(begin) - length + 1
    first = np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    anchor = anchor[first]
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    low, high, text, anchor = first[new], first[np.append(new[1:] - 1, len(first) - 1)], text[new], anchor[new]
    half = (length - gram) // 2

    def mark(some: np.ndarray, offsets: list[int], seed: int) -> np.ndarray:
        out, got = np.zeros(len(anchor), np.uint64), np.full(int(some.sum()), seed, np.uint64)
        for o in offsets:
            got = (got ^ (got >> np.uint64(29))) * np.uint64(mult) + grams[anchor[some] + o]
        out[some] = (got ^ (got >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
        return out

    near = mark(anchor - high <= half, [*range(0, length - half - gram, gram), length - half - gram], 3)
    far = mark(anchor - low > half, [*range(-half - 1, 0, gram), 0], 5)
    return Anchors(data, text, anchor, low, high, half, near, far)


def find_items(texts: list[tuple[int, int, bytes]], length: int = LENGTH, gram: int = GRAM, unit: int = 1, wanted: np.ndarray | None = None) -> Items:
    """Items of pieces of documents, for windows whose marks are in ``wanted`` (sorted, if given); places are in bytes."""
    texts = [t for t in texts if len(t[2]) >= length * unit]
    if not texts:
        return no_items()
    x = find_anchors(texts, length, gram, unit)
    if wanted is not None:
        near, far = (wanted[np.minimum(np.searchsorted(wanted, m), len(wanted) - 1)] == m for m in (x.near, x.far))
        low, high = np.where(near & ~far, np.maximum(x.low, x.at - x.half), x.low), np.where(far & ~near, np.minimum(x.high, x.at - x.half - 1), x.high)
        some = near | far
        x = Anchors(x.data, x.piece[some], x.at[some], low[some], high[some], x.half, x.near[some], x.far[some])
    data, begin = x.data, np.cumsum([0] + [len(t[2]) for t in texts])
    piece = x.piece.tolist()
    shift = [texts[t][1] - int(begin[t]) for t in piece]
    a, lo, hi = (x.at * unit).tolist(), (x.low * unit).tolist(), (x.high * unit).tolist()
    return Items(
        [texts[t][0] for t in piece],
        [y + s for y, s in zip(a, shift, strict=True)],
        ((x.at - x.high) * unit).tolist(),
        [data[y:z] for y, z in zip(lo, a, strict=True)],
        [data[y : z + length * unit] for y, z in zip(a, hi, strict=True)],
    )


def shared(strings: list[bytes], width: int) -> np.ndarray:
    """Length of the prefix that each string shares with the one before, and 0 for the first."""
    if len(strings) < 2:
        return np.zeros(len(strings), np.int64)
    grid = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), np.uint8).reshape(len(strings), width)
    sizes = np.array([len(s) for s in strings])
    differ = grid[1:] != grid[:-1]
    at = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return np.concatenate([[0], np.minimum(at, np.minimum(sizes[1:], sizes[:-1]))])


def front_code(doc: np.ndarray, items: Items, order: list[int], length: int = LENGTH) -> bytes:
    """A sorted run as bytes: shared prefix lengths and rests, to the right and (from the anchor back) to the left."""
    right, left = [items.right[i] for i in order], [items.left[i][::-1] for i in order]
    lcp, lcs = shared(right, length), shared(left, length)
    rest = b"".join([s[k:] for s, k in zip(right, lcp.tolist(), strict=True)]) + b"".join([s[k:] for s, k in zip(left, lcs.tolist(), strict=True)])
    small = np.array([lcp, [len(s) for s in right], lcs, [len(s) for s in left], [items.least[i] for i in order]], "<u2")
    head = struct.pack("<I", len(order)) + small.tobytes() + np.array([doc[items.doc[i]] for i in order], "<i8").reshape(-1, 2).tobytes() + np.array([items.place[i] for i in order], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + rest)


@dataclass
class Run:
    """A decoded run; its strings are rebuilt one after the other."""

    lcp: list[int]
    right: list[bytes]
    left: list[bytes]
    least: np.ndarray
    doc: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(blob: bytes) -> Run:
        data = zstandard.ZstdDecompressor().decompress(blob)
        n = struct.unpack_from("<I", data)[0]
        lcp, rlen, lcs, llen, least = np.frombuffer(data, "<u2", 5 * n, 4).reshape(5, n).astype(np.int64)
        at = 4 + 10 * n
        doc, place = np.frombuffer(data, "<i8", 2 * n, at).reshape(n, 2), np.frombuffer(data, "<i8", n, at + 16 * n)
        at += 24 * n
        strings = []
        for same, size in ((lcp.tolist(), rlen.tolist()), (lcs.tolist(), llen.tolist())):
            got, before = [], b""
            for k, m in zip(same, size, strict=True):
                before = before[:k] + data[at : at + m - k]
                at += m - k
                got.append(before)
            strings.append(got)
        return Run(lcp.tolist(), *strings, least, doc, place)


def _common(a: bytes, b: bytes, k: int) -> int:
    """Length of the common prefix of a and b, which share k bytes."""
    end = min(len(a), len(b))
    if k >= end or a[k] != b[k]:
        return k
    if a[k:end] == b[k:end]:
        return end
    low, high = k + 1, end - 1  # a and b share low bytes, and differ within the next high - low + 1
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def merge_runs(runs: list[Run]) -> tuple[list[int], list[int], list[int]]:
    """(run, number in the run, common prefix with the item before) of all items in order.

    A loser tree. The string at each node knows its common prefix with the
    string that won there, hence with the last overall winner along its path:
    of two strings the one with the longer known prefix comes first, and only
    equal lengths are compared, from that length on.
    """
    runs = [r for r in runs]
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    head: list[bytes | None] = [r.right[0] if r.right else None for r in runs] + [None] * (k - len(runs))
    known, at = [0] * k, [0] * k
    loser = [-1] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser) of leaves x and y; the loser's known prefix becomes the one with the winner."""
        a, b = head[x], head[y]
        if a is None:
            return y, x
        if b is None or known[x] > known[y]:
            return x, y
        if known[x] < known[y]:
            return y, x
        h = _common(a, b, known[x])
        if h == len(a) or (h < len(b) and a[h] < b[h]):
            known[y] = h
            return x, y
        known[x] = h
        return y, x

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    run_of, number, lcp = [], [], []
    while head[winner] is not None:
        run_of.append(winner)
        number.append(at[winner])
        lcp.append(known[winner])
        at[winner] += 1
        r = runs[winner]
        if at[winner] < len(r.right):
            head[winner], known[winner] = r.right[at[winner]], r.lcp[at[winner]]
        else:
            head[winner], known[winner] = None, 0
        node = (winner + k) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2
    return run_of, number, lcp


def repeated_offsets(lcp: np.ndarray, left: list[bytes], least: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of sorted items appear twice or more: numbers of items, and for each a row of flags by offset."""
    most = np.array([len(s) for s in left], np.int64)
    near = np.maximum(lcp, np.append(lcp[1:], 0))
    some = np.flatnonzero(near >= length - most)
    width = int(most[some].max()) + 1 if len(some) else 1
    flags = np.zeros((len(some), width), bool)
    if len(some) < 2:
        return some, flags
    between = np.concatenate([[0], np.minimum.reduceat(lcp[: some[-1] + 1], some[:-1] + 1)])
    grid = np.frombuffer(b"".join([left[i].ljust(width, b"\0") for i in some]), np.uint8).reshape(len(some), width)
    most, least = most[some], least[some]
    alive, rank = np.arange(len(some)), np.zeros(len(some), np.int64)
    for o in range(width):
        if o:
            ok = most[alive] >= o
            alive, rank = alive[ok], rank[ok]
            _, rank, count = np.unique(rank * 256 + grid[alive, o - 1], return_inverse=True, return_counts=True)
            ok = count[rank] > 1
            alive, rank = alive[ok], rank[ok]
        if not len(alive):
            break
        segment = np.cumsum(between < length - o)[alive]
        here = np.flatnonzero(least[alive] <= o)
        _, group, count = np.unique(segment[here] * np.int64(len(some) + 1) + rank[here], return_inverse=True, return_counts=True)
        flags[alive[here[count[group] > 1]], o] = True
    return some, flags


def _spans(doc: np.ndarray, place: np.ndarray, flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first byte, end) of each run of flagged offsets."""
    rows, firsts, stops = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(flags), FLAGGED):
        edge = np.diff(np.pad(flags[at : at + FLAGGED].view(np.int8), ((0, 0), (1, 1))), axis=1)
        row, first = np.nonzero(edge == 1)
        rows.append(row + at)
        firsts.append(first)
        stops.append(np.nonzero(edge == -1)[1])
    row, first, stop = (np.concatenate(x) for x in (rows, firsts, stops))
    return doc[row], place[row] - (stop - 1), place[row] - first + length


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _word_codes(text: str | None) -> bytes:
    words = _utf8(text).split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "<u8", len(words))
    return hashes.view(np.uint8).reshape(-1, 8)[:, :CODE].tobytes()


@dataclass(frozen=True)
class Kind:
    """What windows are made of: ``length`` and ``gram`` in units of ``unit`` bytes that ``code`` makes of a text; texts of fewer bytes than ``least`` have none."""

    length: int
    gram: int
    unit: int
    code: Callable[[str | None], bytes]
    least: int


BYTES = Kind(LENGTH, GRAM, 1, _utf8, LENGTH)
#: Words, CODE bytes each. A passage has a byte a word and one between two at least.
WORDS = Kind(PASSAGE, 8, CODE, _word_codes, 2 * PASSAGE - 1)


def _borders(docs: DataFrame, ranges: int, share: float, kind: Kind) -> list[bytes]:
    """Suffix prefixes that cut the items of a sample of the rows into even ranges."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for piece in _pieces(batch["text"], kind.length * kind.unit, kind.code, kind.unit):
                yield pd.DataFrame({"prefix": [s[:BORDER] for s in find_items(piece, kind.length, kind.gram, kind.unit).right]})

    drawn = docs.filter(F.pmod(C.doc_hash("suffixes", "doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    got = sorted(bytes(r[0]) for r in drawn.select("text").mapInPandas(task, "prefix binary").collect())
    return sorted({got[len(got) * i // ranges] for i in range(1, ranges)}) if got else []


def _pieces(texts: pd.Series, length: int = LENGTH, code: Callable[[str | None], bytes] = _utf8, unit: int = 1) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, place, bytes) of PIECE bytes or so; pieces of a longer text overlap so that no window (of ``length`` bytes) is lost."""
    held, size, most = [], 0, PIECE - PIECE % unit
    for i, text in enumerate(texts):
        data = code(text)
        for lo in range(0, max(1, len(data) - length + 1), most - length + unit):
            part = data[lo : lo + most]
            if held and size + len(part) > PIECE:
                yield held
                held, size = [], 0
            held.append((i, lo, part))
            size += len(part)
    if held:
        yield held


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, first, stop``: ranges of words covered by PASSAGE words that stand anywhere else too, white space aside.

    The windows of ``repeated_spans`` over the codes of words. A range there
    may begin or end within a code; the whole ones in it count.
    """
    spans = repeated_spans(docs, WORDS)
    words = spans.withColumns({"first": F.expr(f"(first + {CODE - 1}) div {CODE}"), "stop": F.expr(f"stop div {CODE}")})
    return words.filter(F.col("stop") - F.col("first") >= PASSAGE)


def repeated_marks(keyed: DataFrame, kind: Kind, buckets: int) -> DataFrame:
    """``owner, marks``: for rows of ``owner, text`` the marks of their anchors (see ``Anchors``) that occur anywhere else too.

    Equal windows have equal marks, so that what has none of these marks has no
    window that repeats: a few bytes an anchor tell which items need to be sorted.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, owners, size = [], [], 0

        def emit() -> pd.DataFrame:
            mark, owner = np.concatenate(marks), np.concatenate(owners)
            bucket = ((mark >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            mark, owner, cut = mark[order], owner[order], np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            return pd.DataFrame([(int(b), mark[cut[b] : cut[b + 1]].tobytes() + owner[cut[b] : cut[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(cut))], columns=["bucket", "blob"])

        for batch in batches:
            own = batch["owner"].to_numpy(np.int64)
            for piece in _pieces(batch["text"], kind.length * kind.unit, kind.code, kind.unit):
                piece = [t for t in piece if len(t[2]) >= kind.length * kind.unit]
                if not piece:
                    continue
                x = find_anchors(piece, kind.length, kind.gram, kind.unit)
                of = own[np.array([t[0] for t in piece])[x.piece]]
                for m in (x.near, x.far):
                    marks.append(m[m > 0])
                    owners.append(of[m > 0])
                    size += len(marks[-1])
                if size >= MARKS:
                    yield emit()
                    marks, owners, size = [], [], 0
        if size:
            yield emit()
        C.give_back()

    def repeated(group: pd.DataFrame) -> pd.DataFrame:
        mark = np.concatenate([np.frombuffer(b, np.uint64, len(b) // 16) for b in group["blob"]])
        owner = np.concatenate([np.frombuffer(b, np.int64, len(b) // 16, len(b) // 2) for b in group["blob"]])
        order = np.argsort(mark, kind="stable")
        mark, owner = mark[order], owner[order]
        same = mark[1:] == mark[:-1]
        keep = np.append(same, False) | np.append(False, same)
        mark, owner = mark[keep], owner[keep]
        order = np.lexsort((mark, owner))
        mark, owner = mark[order], owner[order]
        new = np.append(True, (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1]))[: len(mark)]
        mark, owner = mark[new], owner[new]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
        cut = np.append(first, len(owner))
        return pd.DataFrame({"owner": owner[first], "marks": [mark[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]})

    found = keyed.select("owner", "text").mapInPandas(deal, "bucket int, blob binary").groupBy("bucket").applyInPandas(repeated, "owner long, marks binary")
    return found.groupBy("owner").agg(F.collect_list("marks").alias("marks"))


def repeated_spans(docs: DataFrame, kind: Kind = BYTES) -> DataFrame:
    """``doc_id, text_hash, first, stop``: ranges of bytes covered by windows of ``kind`` that start anywhere else too; written.

    The bytes are those that the kind's code makes of a text. Ranges of a
    document may overlap. ``text_hash`` is xxhash64 of the text, by which rows
    of one ``doc_id`` with different texts are told apart. Items are sorted
    where a mark of theirs occurs twice; the others have no window that repeats.
    """
    length, code, unit = kind.length * kind.unit, kind.code, kind.unit
    rows = docs.count()
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    sampled = docs.filter(F.pmod(C.doc_hash("suffixes", "doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(C.shuffle_partitions(docs.sparkSession), int(sampled / share) // RANGE_BYTES, 1)
    borders = _borders(docs, ranges, share, kind)

    def sort_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, keys = no_items(), []

        def emit() -> Iterator[pd.DataFrame]:
            nonlocal held, keys
            doc = np.array(keys, np.int64).reshape(-1, 2)
            order = sorted(range(len(held)), key=lambda i: (held.right[i], held.left[i]))
            # An item that this run holds twice is settled: all its windows repeat. One of it is handed on for the other runs.
            twin = np.zeros(len(order) + 1, bool)
            twin[1:-1] = [held.right[a] == held.right[b] and held.left[a] == held.left[b] for a, b in zip(order[:-1], order[1:], strict=True)]
            settled = [i for i, a, b in zip(order, twin[:-1], twin[1:], strict=True) if a or b]
            out = []
            if settled:
                spans = np.array([(*doc[held.doc[i]], held.place[i] - len(held.left[i]), held.place[i] + len(held.right[i])) for i in settled], np.int64)
                out += [(int(p), 0, zstandard.ZstdCompressor(level=1).compress(spans[p::ranges].tobytes())) for p in range(min(ranges, len(spans)))]
            order = [i for i, same in zip(order, twin[:-1], strict=True) if not same]
            part = np.searchsorted(np.array(borders, object), np.array([held.right[i][:BORDER] for i in order], object), side="right") if borders else np.zeros(len(order), np.int64)
            cut = np.flatnonzero(np.diff(np.concatenate([[-1], part])))
            for lo, hi in zip(cut, np.append(cut[1:], len(order)), strict=True):
                out.append((int(part[lo]), 1, front_code(doc, held, order[lo:hi], length)))
            held, keys = no_items(), []
            if out:
                yield pd.DataFrame(out, columns=["part", "kind", "blob"])

        for batch in batches:
            pairs = list(zip(batch["doc_id"].tolist(), batch["text_hash"].tolist(), strict=True))
            wanted = np.unique(np.frombuffer(b"".join([m for each in batch["marks"] for m in each]), np.uint64))
            for piece in _pieces(batch["text"], length, code, unit):
                found = find_items(piece, kind.length, kind.gram, unit, wanted)
                found.doc = [d + len(keys) for d in found.doc]
                held.extend(found)
                if len(held) >= RUN_ITEMS:
                    keys += pairs
                    yield from emit()
            if len(held):
                keys += pairs
        if len(held):
            yield from emit()
        C.give_back()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        found = [np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.int64).reshape(-1, 4) for b in group["blob"][group["kind"] == 0]]
        runs = [Run.of(b) for b in group["blob"][group["kind"] == 1]]
        if runs:
            run_of, number, lcp = merge_runs(runs)
            for r in runs:
                r.right = []
            base = np.cumsum([0] + [len(r.left) for r in runs])[:-1]
            at = base[run_of] + np.array(number)
            left = [runs[r].left[i] for r, i in zip(run_of, number, strict=True)]
            doc, place, offsets = (np.concatenate([getattr(r, c) for r in runs])[at] for c in ("doc", "place", "least"))
            some, flags = repeated_offsets(np.array(lcp, np.int64), left, offsets, length)
            d, first, stop = _spans(doc[some], place[some], flags, length)
            found.append(np.column_stack([d, first, stop]).astype(np.int64))
        every = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
        return pd.DataFrame(every, columns=["doc_id", "text_hash", "first", "stop"])

    keyed = docs.filter(F.octet_length("text") >= kind.least).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    keyed = keyed.withColumn("owner", F.xxhash64("doc_id", "text_hash"))
    # One after the other, so that the files of one shuffle are gone before the next is made.
    marks = C.materialize(repeated_marks(keyed, kind, ranges), "marks", tidy=True)
    C.sweep(docs.sparkSession)
    dealt = keyed.join(marks, "owner").select("doc_id", "text_hash", "text", "marks").mapInPandas(sort_runs, "part int, kind int, blob binary")
    spans = dealt.groupBy("part").applyInPandas(merge, "doc_id long, text_hash long, first long, stop long").distinct()
    spans = C.materialize(spans, "spans", tidy=True)
    C.discard(marks)
    C.sweep(docs.sparkSession)
    return spans


#: Stands for a null id while spans are joined to their rows.
NO_ID = -(2**63)


def _whole(gone: np.ndarray, data: bytes) -> np.ndarray:
    """``gone`` extended to whole UTF-8 characters."""
    of = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    hit = np.zeros(int(of[-1]) + 1, bool)
    hit[of[gone]] = True
    return hit[of]


def _covered(ranges: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places any of the ranges covers."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, ranges[:, 0], 1)
    np.add.at(edges, ranges[:, 1], -1)
    return np.cumsum(edges)[:-1] > 0


def _bytes_of(words: np.ndarray, data: bytes) -> np.ndarray:
    """Byte ranges of ranges of words."""
    at = np.array([m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)], np.int64)
    return np.column_stack([at[words[:, 0], 0], at[words[:, 1] - 1, 1]])


def remove_repeats(docs: DataFrame, characters: bool = False, passages: bool = False, count: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``_kept`` (the bytes that stay) and ``_n_bytes, _n_removed, _n_spans, _n_repeated``.

    A byte goes if it is covered by a LENGTH-byte string that also starts
    anywhere else in the input, in the same text or another; every copy goes.
    With ``characters``, a character goes whole if a byte of it goes. With
    ``passages``, so do PASSAGE words that stand anywhere else too, whatever
    white space and however few bytes they have, with what is between them. With
    ``count`` these stay, and ``_n_repeated`` is the number of words in them
    (null without either). A null
    text counts as empty; texts shorter than LENGTH stay whole; repeated rows
    are copies of each other; other columns are kept as they are, and may have
    any name but the five that are added.
    """
    id_name, hash_name, spans_name = C.unused(docs, "_id", "_hash", "_spans")
    spans = repeated_spans(docs.select("doc_id", "text")).withColumn("words", F.lit(0).cast("long"))
    if passages or count:
        spans = spans.unionByName(repeated_passages(docs.select("doc_id", "text")).withColumn("words", F.lit(1).cast("long")))
    spans = spans.groupBy(F.col("doc_id").alias(id_name), F.col("text_hash").alias(hash_name)).agg(F.collect_list(F.array("first", "stop", "words")).alias(spans_name))
    id_of = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    joined = docs.join(spans, (id_of == F.col(id_name)) & (F.xxhash64("text") == F.col(hash_name)), "left")
    joined = joined.select(*[C.column(c) for c in docs.columns], spans_name)
    names = docs.columns

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept, n_removed, n_spans, n_bytes, n_repeated = [], [], [], [], []
            for text, spans in zip(batch["text"], batch[spans_name], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                n_bytes.append(len(data))
                if spans is None:
                    kept.append(data)
                    n_removed.append(0)
                    n_spans.append(0)
                    n_repeated.append(0)
                    continue
                both = np.array([list(s) for s in spans], np.int64)
                both, words = both[both[:, 2] == 0, :2], both[both[:, 2] == 1, :2]
                n_repeated.append(int(_covered(words, int(words.max(initial=0))).sum()))
                if passages and len(words):
                    both = np.concatenate([both, _bytes_of(words, data)])
                gone = _covered(both, len(data))
                if characters:
                    gone = _whole(gone, data)
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
                n_removed.append(int(gone.sum()))
                n_spans.append(int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()))
            yield batch[names].assign(_kept=kept, _n_bytes=n_bytes, _n_removed=n_removed, _n_spans=n_spans, _n_repeated=pd.array(n_repeated if passages or count else [None] * len(batch), "Int64"))

    added = "_kept binary, _n_bytes long, _n_removed long, _n_spans long, _n_repeated long"
    return joined.mapInPandas(task, StructType([*docs.schema.fields, *StructType.fromDDL(added).fields]))


def digest(docs: DataFrame, count: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row, with ``count`` also ``n_repeated``.

    ``n_repeated``: words in passages of over 50 words that stand anywhere else
    too. Those of less than LENGTH bytes are kept, as the bytes decide what goes.
    """
    done = remove_repeats(docs.select("doc_id", "text"), count=count)
    out = done.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"), F.col("_n_repeated").alias("n_repeated"))
    return out if count else out.drop("n_repeated")


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same figures by a table of all windows, for small inputs."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(d) else 0
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out
