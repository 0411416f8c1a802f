"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Components of a hypervector, and letters of an n-gram.
DIMS = 1024
ORDER = 3
UNKNOWN = "und"
#: Letters of texts that are handled at once.
CHUNK, CHUNK_TEXTS = 1 << 20, 1024
#: N-grams whose vectors are summed up at once.
BLOCK = 8192
_SPACE = 0


def letter_vectors(codes: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """A random vector of +1 and -1 for each code point, the same in every task.

    Bits come from a counter-based mix of code and place, so no table of an
    alphabet is needed.
    """
    x = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dims + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return ((x & np.uint64(1)).astype(np.int8) * 2 - 1).astype(np.float32)


def gram_vectors(grams: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Bound vectors of n-grams (rows of code points): letter i permuted ORDER-1-i places, then multiplied."""
    codes, at = np.unique(grams, return_inverse=True)
    letters, at = letter_vectors(codes, dims), at.reshape(grams.shape)
    out = np.ones((len(grams), dims), np.float32)
    for i in range(grams.shape[1]):
        out *= np.roll(letters, grams.shape[1] - 1 - i, axis=1)[at[:, i]]
    return out


def _is_letter() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low[0])
    return table


_LETTERS: list[np.ndarray] = []


def letters_of() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(_is_letter())
    return _LETTERS[0]


def grams_of(texts: list[str], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the distinct letter n-grams of ``texts``, and for each occurrence its n-gram's number and its group, in order of these numbers.

    Letters are lower-cased; each run of other characters, and either end of a
    text, is one space. N-grams of more than one space are left out.
    """
    joined = "".join([f"\0{t}\0" for t in texts])
    codes = letters_of()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(groups, [len(t) + 2 for t in texts])
    edge = np.zeros(len(codes), bool)
    edge[np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])[:-1]])] = True
    keep = (codes != _SPACE) | edge | np.append(True, codes[:-1] != _SPACE)
    codes, row, edge = codes[keep], row[keep], edge[keep]
    used = np.flatnonzero(np.bincount(codes, minlength=1))
    number = np.zeros(int(used[-1]) + 1, np.int64)
    number[used] = np.arange(len(used))
    letter, k = number[codes], len(used)
    whole = ~(edge[1:-1] | edge[2:]) & (letter[1:-1] > 0)
    packed, row = ((letter[:-2] * k + letter[1:-1]) * k + letter[2:])[whole], row[:-2][whole]
    if k**3 <= 1 << 22:
        grams = np.flatnonzero(np.bincount(packed, minlength=1))
        at = np.zeros(int(grams[-1]) + 1 if len(grams) else 1, np.int64)
        at[grams] = np.arange(len(grams))
        at = at[packed]
    else:
        grams, at = np.unique(packed, return_inverse=True)
    letters = used[np.stack([grams // (k * k), grams // k % k, grams % k], axis=1)]
    if len(grams) <= BLOCK:  # one block needs no order
        return letters, at, row
    order = np.argsort(at, kind="stable")
    return letters, at[order], row[order]


def bundles(texts: list[str], groups: np.ndarray, n: int, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the n-gram vectors of each of ``n`` groups of texts, and their numbers of n-grams.

    Counts are made for BLOCK n-grams at once: a table of all groups and all
    n-grams of a script with many letters would not fit.
    """
    grams, at, row = grams_of(texts, groups)
    out = np.zeros((n, dims), np.float32)
    for a in range(0, len(grams), BLOCK):
        z = min(a + BLOCK, len(grams))
        lo, hi = (0, len(at)) if len(grams) <= BLOCK else np.searchsorted(at, [a, z])
        counts = np.bincount(row[lo:hi] * (z - a) + at[lo:hi] - a, minlength=n * (z - a)).reshape(n, z - a)
        out += counts.astype(np.float32) @ _known.vectors(grams[a:z], dims)
    return out, np.bincount(row, minlength=n).astype(np.float32)


class _Known:
    """N-gram vectors that this process has made, up to KEEP of them."""

    KEEP = 1 << 15

    def __init__(self):
        self.grams, self.table = np.zeros(0, np.int64), np.zeros((0, 0), np.int8)

    def vectors(self, grams: np.ndarray, dims: int) -> np.ndarray:
        key = (grams[:, 0] << 42) | (grams[:, 1] << 21) | grams[:, 2]
        if self.table.shape[1] != dims or len(self.grams) > self.KEEP:
            self.grams, self.table = np.zeros(0, np.int64), np.zeros((0, dims), np.int8)
        new = ~np.isin(key, self.grams)
        if new.any():
            both = np.concatenate([self.grams, key[new]])
            order = np.argsort(both)
            self.grams, self.table = both[order], np.concatenate([self.table, gram_vectors(grams[new], dims).astype(np.int8)])[order]
        return self.table[np.searchsorted(self.grams, key)].astype(np.float32)


_known = _Known()


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and (size + len(t) > CHUNK or i - lo >= CHUNK_TEXTS):
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if texts:
        yield lo, len(texts)


def fit(labelled: DataFrame, dims: int = DIMS) -> tuple[list[str], np.ndarray]:
    """Language prototypes from every row of ``text, lang`` with a language.

    Each task bundles its texts by language; the sums (one vector a language
    and task) are added up in Spark. The mean of the unit prototypes, which all
    languages share, is taken off each.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = sorted(set(batch["lang"]))
            number = {x: i for i, x in enumerate(langs)}
            texts, groups = list(batch["text"]), np.array([number[x] for x in batch["lang"]], np.int64)
            for lo, hi in _chunks(texts):
                got, _ = bundles(texts[lo:hi], groups[lo:hi], len(langs), dims)
                for x, v in zip(langs, got.astype(np.float64), strict=True):
                    sums[x] = sums[x] + v if x in sums else v
        for x, v in sums.items():
            yield pd.DataFrame({"lang": x, "dim": np.arange(dims), "value": v})

    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInPandas(task, "lang string, dim int, value double")
    rows = rows.groupBy("lang", "dim").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v"))
    got = sorted((r["lang"], [x["value"] for x in r["v"]]) for r in rows.collect())
    langs, vectors = [x for x, _ in got], np.array([v for _, v in got], np.float64).reshape(len(got), dims)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    if len(langs) > 1:
        vectors -= vectors.mean(axis=0)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return langs, vectors.astype(np.float32)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``doc_id, text``.

    The language whose prototype has the largest cosine with the text's bundle
    (the first by name in a tie); score is that cosine moved to 0..1. A null
    text, one without a letter, or any text while nothing was learned, is
    ``und`` with score 0.
    """
    dims = prototypes.shape[1]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for lo, hi in _chunks(texts):
                part, grams = bundles(texts[lo:hi], np.arange(hi - lo), hi - lo, dims)
                has = (grams > 0) & bool(langs)
                if has.any():
                    cosine = part[has] @ prototypes.T / np.maximum(np.linalg.norm(part[has], axis=1, keepdims=True), 1e-12)
                    pred[lo:hi][has] = np.array(langs, object)[cosine.argmax(axis=1)]
                    score[lo:hi][has] = np.clip((cosine.max(axis=1) + 1) / 2, 0, 1)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": pred, "score": score})

    return docs.select("doc_id", "text").mapInPandas(task, "doc_id long, lang_pred string, score double")
