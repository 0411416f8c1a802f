"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import common as C
from .subwords import DEFAULT, word_ids

#: The rolling hash sees so many bytes, and cuts after one place in CUT_EVERY.
WINDOW, CUT_EVERY = 16, 256
#: Chunks and words whose encoding a process keeps.
KEEP_CHUNKS, KEEP_WORDS = 20_000, 150_000
#: Bytes of text that are cut and encoded at once.
BATCH = 1 << 20
#: Whole words on either side of a join that its new ids are compared on, at most.
ANCHORS = 3
_WHITE = b" \t\n\v\f\r"

#: Number of tokens, " id id ..." and " token token ..." of a stretch of text.
Piece = tuple[int, bytes, bytes]


def cut_points(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where chunks begin, in bytes that hold texts one after another from ``start`` on.

    A chunk ends after a place at which the polynomial hash of the last WINDOW
    bytes, all of the same text, is 0 modulo CUT_EVERY, moved on to the next
    character; so equal passages are cut alike wherever they stand.
    """
    h, size, base = data.astype(np.uint32), 1, 0x01000193
    while size < WINDOW:
        h = h[:-size] * np.uint32(base) + h[size:] if len(h) > size else h[:0]
        base, size = base * base & 0xFFFFFFFF, size * 2
    cut = np.flatnonzero(((h * np.uint32(0x9E3779B1)) >> np.uint32(12)) % np.uint32(CUT_EVERY) == 0)
    text = np.searchsorted(start, cut, side="right")
    cut = cut[text == np.searchsorted(start, cut + WINDOW - 1, side="right")] + WINDOW
    for _ in range(3):  # a character has three more bytes at most
        inside = (cut < len(data)) & ((data[np.minimum(cut, len(data) - 1)] & 0xC0) == 0x80)
        cut = cut + inside
    return np.unique(np.concatenate([start, cut[cut < len(data)]]))


def split_chunk(chunk: bytes) -> tuple[bytes, bytes, bytes] | None:
    """(before the first white space, what lies between, after the last); None without white space."""
    words = chunk.split()
    if words and len(words[0]) == len(chunk):
        return None
    head = b"" if not words or chunk[0] in _WHITE else words[0]
    tail = b"" if not words or chunk[-1] in _WHITE else words[-1]
    return head, chunk[len(head) : len(chunk) - len(tail)], tail


@dataclass
class Chunk:
    """What is kept of a chunk with white space: fragments of words at its ends, the whole words next to them, and the packed ids between the fragments."""

    head: bytes
    first: list[bytes]
    piece: bytes
    last: list[bytes]
    tail: bytes


class ChunkCoder:
    """Encodes texts chunk by chunk, each distinct chunk once while it is kept.

    A chunk is encoded between its first and last white space. At a join, the
    fragments of words of both chunks (and of chunks without white space
    between them) are put together and encoded anew, in one stretch with the
    whole words on either side. The join is mended when the new ids begin and
    end with the very ids that both chunks have for these words; until they do,
    the stretch is widened word by word, at most to ANCHORS words a side.
    Ids are packed in bytes until a whole text has its own; then they are spelled, once.
    """

    def __init__(self, tokenizer: str = DEFAULT):
        self.ids = word_ids(tokenizer)
        self.chunks: dict[bytes, Chunk | None] = {}
        self.code_of = self.ids.dtype.char
        self.words: dict[bytes, bytes] = {}
        self.joints: dict[tuple[bytes, bytes, bytes], tuple[bytes, bytes]] = {}  # packed, and as a string
        self.encoded = self.reused = self.widened = 0
        # What each id adds to the strings of a stretch: the decoder joins tokens with a space.
        decode = self.ids.tokenizer.decode_batch([[i] for i in range(self.ids.size)], skip_special_tokens=False)
        self.numbers = [f" {i}".encode() for i in range(self.ids.size)]
        self.tokens = [f" {t}".encode() for t in decode]

    def _piece(self, ids: list[int]) -> bytes:
        return array(self.code_of, ids).tobytes()

    def _spell(self, packed: bytes) -> Piece:
        ids = memoryview(packed).cast(self.code_of).tolist()
        return len(ids), b"".join(map(self.numbers.__getitem__, ids)), b"".join(map(self.tokens.__getitem__, ids))

    def _learn(self, words: set[bytes]) -> None:
        new = words.difference(self.words)
        if len(self.words) + len(new) > KEEP_WORDS:
            self.words, new = {}, words
        if new:
            self.ids.learn(new)
            self.words.update(self.ids.known)
            self.ids.known = {}
            if len(self.ids.cores) > KEEP_WORDS:
                self.ids.cores = {}

    def forget(self) -> None:
        """Let go of what is kept, at the end of a task: its worker may be idle for long."""
        self.chunks, self.words, self.joints = {}, {}, {}
        self.ids.forget()
        C.give_back()

    def _mend(self, joints: dict[tuple[bytes, bytes, bytes], tuple[list[bytes], list[bytes]]]) -> None:
        """Makes the pieces of words at joins, given with the words before (nearest last) and after (nearest first)."""
        wide, left = 1, dict(joints)
        while left:
            keys = list(left)
            sides = [(left[k][0][-wide:], left[k][1][:wide]) for k in keys]
            texts = [b" ".join([*before, k[1], *after]).decode("utf-8", "replace") for k, (before, after) in zip(keys, sides, strict=True)]
            again = {}
            for k, (before, after), e in zip(keys, sides, self.ids.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                begin, end = (b"".join([self.words[w] for w in ws]) for ws in (before, after))
                got = self._piece(e.ids)
                agree = len(got) >= len(begin) + len(end) and got.startswith(begin) and got.endswith(end)
                if not agree and wide < max(len(left[k][0]), len(left[k][1])):
                    again[k] = left[k]
                    continue
                if not agree:
                    raise ValueError("ids at a join agree with neither chunk; this tokenizer's pieces go beyond words")
                own, width = got[len(begin) : len(got) - len(end)], self.ids.dtype.itemsize
                self.joints[k] = own, b"".join(map(self.numbers.__getitem__, e.ids[len(begin) // width : len(got) // width - len(end) // width]))
            self.widened += len(again)
            left, wide = again, wide + 1

    def code(self, texts: list[bytes]) -> list[Piece]:
        """The pieces of whole texts; their strings lead with a space unless empty."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        cuts = cut_points(data, np.unique(begin[:-1][np.diff(begin) > 0])) if len(data) else np.zeros(0, np.int64)
        whole, ends = data.tobytes(), np.append(cuts[1:], len(data))[: len(cuts)]
        chunks = [whole[a:b] for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
        if len(self.chunks) + len(chunks) > KEEP_CHUNKS:
            self.chunks, self.joints = {}, {}
        new = {c: split_chunk(c) for c in set(chunks) if c not in self.chunks}
        self.encoded, self.reused = self.encoded + len(new), self.reused + len(chunks) - len(new)
        inner = {c: s[1].split() for c, s in new.items() if s is not None}
        near = {w for c in set(chunks) if (k := self.chunks.get(c)) is not None for w in (*k.first, *k.last)}
        self._learn(set(chain(chain.from_iterable(inner.values()), near)))
        look = self.words.__getitem__
        for c, s in new.items():
            words = inner.get(c, [])
            self.chunks[c] = None if s is None else Chunk(s[0], words[:ANCHORS], b"".join(map(look, words)), words[-ANCHORS:], s[2])

        first = np.searchsorted(cuts, begin)
        plans: list[list] = []  # for each text: chunks, and between them the words that their joins make, with what stands around
        wanted: dict[tuple[bytes, bytes, bytes], tuple[list[bytes], list[bytes]]] = {}
        for a, b in zip(first[:-1], first[1:], strict=True):
            plan, carry, before = [], [], []
            for c in [*chunks[a:b], None]:
                kept = None if c is None else self.chunks[c]
                if c is not None and kept is None:
                    carry.append(c)
                    continue
                word = b"".join([*carry, kept.head if kept else b""])
                if word:
                    after = kept.first if kept else []
                    key = (before[-1] if before else b"", word, after[0] if after else b"")
                    if key not in self.joints:
                        wanted[key] = (before, after)
                    plan.append(key)
                if kept:
                    plan.append(kept.piece)
                    carry, before = [kept.tail], kept.last
            plans.append(plan)
        self._mend(wanted)
        return [self._spell(b"".join([x if isinstance(x, bytes) else self.joints[x][0] for x in plan])) for plan in plans]


_coders: dict[str, ChunkCoder] = {}


def coder(tokenizer: str = DEFAULT) -> ChunkCoder:
    if tokenizer not in _coders:
        _coders[tokenizer] = ChunkCoder(tokenizer)
    return _coders[tokenizer]


def encode_decode(docs: DataFrame, tokenizer: str = DEFAULT, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, and with ``with_ids`` also ``ids`` and ``decoded``.

    Ids and text are those that the tokenizer gives for the whole text at once.
    A null text counts as empty and has no token; repeated rows stay; other
    columns are ignored. Chunks are shared by the texts of a Python worker.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = coder(tokenizer)
        for batch in batches:
            texts, lo, size = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]], 0, 0
            rows: list[Piece] = []
            for i in range(len(texts) + 1):
                if i == len(texts) or size > BATCH:
                    rows += [_digest(p, with_ids) for p in code.code(texts[lo:i])]
                    lo, size = i, 0
                if i < len(texts):
                    size += len(texts[i])
            names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"])
            yield out
        code.forget()

    more = ", ids array<int>, decoded string" if with_ids else ""
    return docs.select("doc_id", "text").mapInPandas(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)


def _digest(p: Piece, with_ids: bool) -> tuple:
    n, ids, text = p[0], p[1][1:], p[2][1:]
    row = (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest())
    return (*row, np.array(ids.split(), np.int32), text.decode()) if with_ids else row
