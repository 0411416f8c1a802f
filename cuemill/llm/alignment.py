"""Alignment of two tokenizers' ids over a corpus, through a dictionary of distinct groups.

Both tokenizers cut a text into tokens; where a token of either ends at the
same byte, a group of A ids and B ids ends. Groups repeat far more than texts
do: each block of documents interns its groups, the blocks' dictionaries are
added up on Spark, each distinct group is expanded into links once, and what
its links are worth goes back to the documents by block and group.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from . import common as C

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text whose groups share a dictionary; a longer text is a block of its own.
BLOCK = 8 << 20
#: Stretches whose ids a process keeps.
KEEP = 200_000
#: Stretches that are encoded in one call.
LINE = 256
#: A blank between two characters that are none: neither tokenizer has a token across it, so both begin a token there.
CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    return out | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in out)}


def _path(name: str) -> str:
    return name if os.path.sep in name else public_tokenizers.path(name)


class Aligner:
    """Groups of stretches of text, each distinct stretch encoded once while it is kept.

    A text falls into stretches at CUT. A stretch stands for itself with a
    blank before it. Tokens never cross such a place, so a text's tokens and
    groups are its stretches' end to end.
    """

    def __init__(self, a: str = A_FILE, b: str = B_FILE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(_path(a))
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=_path(b))
        letters = byte_alphabet()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = [bytes([letters[c] for c in t]) if all(c in letters for c in t) else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.kept: dict[str, tuple[int, int, tuple[str, ...]] | None] = {}

    def _encode(self, lines: list[str]) -> list[tuple[list[int], list[int], bool]]:
        """A ids, B ids and whether both spell the line with a blank before it."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([f" {t}" for t in lines], add_special_tokens=False)]
        ids_b = self.b.encode(lines, num_threads=1)
        out = []
        for t, x, y in zip(lines, ids_a, ids_b, strict=True):
            data = f" {t}".encode()
            out.append((x, y, b"".join(map(self.a_bytes.__getitem__, x)) == data and b"".join(map(self.b_bytes.__getitem__, y)) == data))
        return out

    def _groups(self, x: list[int], y: list[int]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Groups as ``a1,a2|b1``, and where each ends: in bytes, in A tokens and in B tokens."""
        ends_a, ends_b = np.cumsum(self.a_len[x]), np.cumsum(self.b_len[y])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        to_a, to_b = np.searchsorted(ends_a, both) + 1, np.searchsorted(ends_b, both) + 1
        xs, ys, i, k, out = list(map(str, x)), list(map(str, y)), 0, 0, []
        for j, m in zip(to_a.tolist(), to_b.tolist(), strict=True):
            out.append((xs[i] if j == i + 1 else ",".join(xs[i:j])) + "|" + (ys[k] if m == k + 1 else ",".join(ys[k:m])))
            i, k = j, m
        return out, both, to_a, to_b

    def learn(self, stretches: list[str]) -> None:
        """Make what is kept of ``stretches``: numbers of A and B tokens and groups; None where the tokens don't spell it."""
        apart = [s for s in stretches if not s or s[-1].isspace()]
        side = [s for s in stretches if s and not s[-1].isspace()]
        parts = [side[i : i + LINE] for i in range(0, len(side), LINE)]
        for part, (x, y, ok) in zip(parts, self._encode([" ".join(p) for p in parts]), strict=True):
            if not ok:
                apart += part
                continue
            names, both, to_a, to_b = self._groups(x, y)
            at = np.searchsorted(both, np.cumsum([len(s.encode()) + 1 for s in part]))
            low, done_a, done_b = 0, 0, 0
            for s, last, ta, tb in zip(part, at.tolist(), to_a[at].tolist(), to_b[at].tolist(), strict=True):
                self.kept[s] = ta - done_a, tb - done_b, tuple(names[low : last + 1])
                low, done_a, done_b = last + 1, ta, tb
        for s, (x, y, ok) in zip(apart, self._encode(apart), strict=True):
            self.kept[s] = (len(x), len(y), tuple(self._groups(x, y)[0])) if ok else None

    def block(self, texts: list[str | None]) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Rows of the texts (``n_a, n_b, n_groups, groups_sha256, groups``), and the block's dictionary (``gid, key, a, b, freq``).

        ``groups`` holds the numbers of a text's groups in ascending order, as
        differences of two or four bytes each; frequent groups have low numbers.
        """
        number: dict[str, int] = {}
        cut = [CUT.split(t) if t else [] for t in texts]
        at = [[number.setdefault(s, len(number)) for s in parts] for parts in cut]
        new = [s for s in number if s not in self.kept]
        if len(self.kept) + len(new) > KEEP:
            self.kept, new = {}, list(number)
        self.learn(new)
        known = [self.kept[s] for s in number]
        names: dict[str, int] = {}
        of = [[names.setdefault(g, len(names)) for g in k[2]] if k else [] for k in known]
        said = [";".join(k[2]) if k else "" for k in known]
        n_a, n_b = (np.array([k[i] if k else 0 for k in known], np.int64) for i in (0, 1))
        bad = np.array([k is None for k in known], bool)
        each = np.array([len(g) for g in of], np.int64)
        first, flat = np.concatenate([[0], np.cumsum(each)]), np.fromiter(chain.from_iterable(of), np.int64)

        rows, docs, shas, seen = [], [], [], np.zeros(len(names), np.int64)
        for i, stretches in enumerate(at):
            s = np.array(stretches, np.int64)
            if not len(s) or bad[s].any():
                rows.append((0, 0, 0))
                shas.append("")
                docs.append(np.zeros(0, np.int64))
                continue
            n = each[s]
            groups = flat[np.arange(n.sum()) + np.repeat(first[s] - np.cumsum(n) + n, n)]
            seen += np.bincount(groups, minlength=len(names))
            docs.append(groups)
            rows.append((int(n_a[s].sum()), int(n_b[s].sum()), len(groups)))
            shas.append(hashlib.sha256(";".join([said[j] for j in stretches]).encode()).hexdigest())
        order = np.argsort(-seen, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        used = order[: int((seen > 0).sum())]
        kind = "<u2" if len(used) <= 1 << 16 else "<u4"
        out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups"])
        out["groups_sha256"] = shas
        out["groups"] = [np.diff(np.sort(rank[g]), prepend=0).astype(kind).tobytes() for g in docs]
        keys = list(names)
        table = pd.DataFrame({"gid": np.arange(len(used)), "key": [keys[j] for j in used], "freq": seen[used]})
        return out, table


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str = A_FILE, b: str = B_FILE) -> Aligner:
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


_DOC = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups binary"
_ENTRY = "gid int, key string, freq long"


def group_blocks(docs: DataFrame, a: str = A_FILE, b: str = B_FILE, block: int = BLOCK) -> DataFrame:
    """A written table of each document's groups and each block's dictionary (rows with a ``key``).

    Rows of one input partition make blocks of about ``block`` bytes. A null
    or empty text, and one that a tokenizer doesn't spell byte by byte, has no
    tokens; repeated rows stay.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, number = aligner(a, b), (TaskContext.get().partitionId() << 32) - 1
        ids, texts, size = [], [], 0

        def close() -> Iterator[pd.DataFrame]:
            nonlocal ids, texts, size, number
            if texts:
                number += 1
                rows, table = code.block(texts)
                rows.insert(0, "doc_id", pd.array(ids, dtype="Int64"))
                for made in (rows, table):
                    whole = made.assign(block=number, **{c: None for c in names if c not in made and c != "block"})
                    yield whole[names].astype({c: object for c in ("groups_sha256", "groups", "key")})
            ids, texts, size = [], [], 0

        for batch in batches:
            for i, t in zip(batch["doc_id"], batch["text"], strict=True):
                ids.append(None if pd.isna(i) else int(i))
                texts.append(t)
                size += len(t or "")
                if size >= block:
                    yield from close()
        yield from close()
        code.kept = {}
        C.give_back()

    names = [c.split()[0] for c in f"{_DOC}, {_ENTRY}".split(", ")]
    return C.materialize(docs.select("doc_id", "text").mapInPandas(task, f"{_DOC}, {_ENTRY}"), "groups")


def _distinct(blocks: DataFrame) -> DataFrame:
    """``key, a, b, n``: each distinct group with the link that it holds and how often it stands in the corpus.

    Tokens of a group end together at its end alone, so its one link is of its last ids.
    """
    last = lambda side: F.element_at(F.split(F.split("key", r"\|")[side], ","), -1).cast("int")
    found = blocks.filter("key IS NOT NULL").groupBy("key").agg(F.sum("freq").alias("n"))
    return found.withColumns({"a": last(0), "b": last(1)})


def link_counts(blocks: DataFrame) -> DataFrame:
    """``a, b, links, best``: how many links of the corpus hold an A and a B id linked, and whether that is the most of its B id.

    The most of each B id is broadcast: no more rows than B has ids.
    """
    pairs = _distinct(blocks).groupBy("a", "b").agg(F.sum("n").alias("links"))
    most = pairs.groupBy(F.col("b").alias("_b")).agg(F.max("links").alias("_most"))
    return pairs.join(F.broadcast(most), F.col("b") == F.col("_b")).select("a", "b", "links", (F.col("links") == F.col("_most")).alias("best"))


def align(docs: DataFrame, a: str = A_FILE, b: str = B_FILE, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``doc_id, text``.

    A group stands once in each block's dictionary, whatever the number of its
    documents, so no key has more rows than there are blocks. What groups are
    worth meets the documents of a block in one call; a block is bounded (or
    one text). Null, empty and misspelt texts get zeros and ''; repeated rows
    and ids stay; other columns are ignored; an empty table gives no rows.
    """
    blocks = group_blocks(docs, a, b, block)
    worth = _distinct(blocks).join(link_counts(blocks), ["a", "b"]).select("key", "links", F.col("best").cast("long").alias("best"))
    entries = blocks.filter("key IS NOT NULL").select(F.col("block").alias("_block"), "gid", "key").join(worth, "key").select("_block", "gid", "links", "best")
    rows = blocks.filter("key IS NULL").select([c.split()[0] for c in _DOC.split(", ")])

    def together(rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        entries = entries.sort_values("gid")
        links, best = entries["links"].to_numpy(np.int64), entries["best"].to_numpy(np.int64)
        kind = "<u2" if len(entries) <= 1 << 16 else "<u4"
        groups = [np.cumsum(np.frombuffer(g, kind), dtype=np.int64) for g in rows["groups"]]
        out = rows.drop(columns=["block", "groups"])
        return out.assign(n_links=out["n_groups"], n_best=[int(best[g].sum()) for g in groups], count_sum=[int(links[g].sum()) for g in groups])[names]

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names)
    return rows.groupBy("block").cogroup(entries.groupBy("_block")).applyInPandas(together, schema)
