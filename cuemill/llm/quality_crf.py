"""Quality classifier: a linear-chain conditional random field over the lines of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import common as C

#: At most so many labelled rows are fitted on, the ones with the smallest hash of their id.
MAX_ROWS = 2000
#: Hashed byte n-grams (of 1 to 4 bytes) are counted in so many cells.
CELLS = 1 << 14
GRAM_SIZES = (1, 2, 3, 4)
#: Numbers that describe a line's shape, and the bins that each falls in.
SHAPES, BINS = 9, 12
#: Offsets of the neighbouring lines whose shapes are features too.
NEIGHBOURS = (-1, 0, 1)
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.05, 1e-4


@dataclass
class Model:
    """Weights of label 1 against 0: n-gram cells, shape bins by neighbour, transitions, and the first line's."""

    cells: np.ndarray
    shapes: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


@dataclass
class Lines:
    """Lines of a batch of texts: their bytes in one buffer, and where each line and each text begins."""

    data: np.ndarray
    at: np.ndarray  # first byte of each line, and the end
    doc: np.ndarray  # first line of each text, and the end


def split_lines(texts: list[str | None]) -> Lines:
    """Every text has a line at least; line feeds belong to the line that they end."""
    raw = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    at = np.concatenate([[0], ends])
    doc = np.searchsorted(at, np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    return Lines(data, at, doc)


def gram_cells(data: np.ndarray, size: int) -> np.ndarray:
    """Cell of the n-gram that begins at each byte; the last ones run into zeros."""
    x = np.zeros(len(data), np.uint32)
    padded = np.concatenate([data, np.zeros(size, np.uint8)])
    for i in range(size):
        x = (x << np.uint32(8)) | padded[i : i + len(data)]
    x = (x + np.uint32(size)) * np.uint32(2654435761)
    return x >> np.uint32(32 - (CELLS - 1).bit_length())


def line_shapes(x: Lines) -> np.ndarray:
    """Bin of each shape number of each line: lengths, shares of kinds of bytes, repeats."""
    n = np.diff(x.at).astype(np.float64)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.float64), x.at[:-1]) / n

    d = x.data
    space = (d == 32) | (d == 9)
    upper, lower = (d >= 65) & (d <= 90), (d >= 97) & (d <= 122)
    symbol = np.isin(d, np.frombuffer(b"#*$%&|<>!=_~^@{}[]", np.uint8))
    same = np.zeros(len(d), bool)  # the byte eight, or as far as the last word's length, back
    starts = np.flatnonzero(np.append(True, space[:-1] | (d[:-1] == 10)) & ~space)
    if len(starts) > 1:
        gap = np.diff(starts)
        first = np.stack([d[np.minimum(starts + i, len(d) - 1)] for i in range(4)], axis=1)
        alike = (first[1:] == first[:-1]).all(axis=1) & (gap == np.append(gap[1:], 0))
        same[starts[1:]] = alike
    words = np.maximum(np.add.reduceat((np.append(True, space[:-1] | (d[:-1] == 10)) & ~space).astype(np.float64), x.at[:-1]), 1)
    repeated = np.add.reduceat(same.astype(np.float64), x.at[:-1]) / words
    numbers = [
        np.log2(n) / 16, share(upper), share(lower), share(symbol), share((d >= 48) & (d <= 57)), share(d >= 128),
        np.minimum(n / words / 24, 1), repeated, np.minimum(words / 64, 1),
    ]
    return np.stack([np.clip((v * (BINS - 1)).astype(np.int64), 0, BINS - 1) for v in numbers], axis=1)


def neighbour_features(x: Lines, shapes: np.ndarray) -> np.ndarray:
    """Index of the shape feature of every line, neighbour and number; beyond a text's ends stands bin 0 of an own block."""
    first, last = np.repeat(x.doc[:-1], np.diff(x.doc)), np.repeat(x.doc[1:], np.diff(x.doc)) - 1
    here, out = np.arange(len(shapes)), []
    for k, step in enumerate(NEIGHBOURS):
        at = here + step
        inside = (at >= first) & (at <= last)
        base = np.arange(SHAPES) * (BINS + 1) + k * SHAPES * (BINS + 1)
        out.append(np.where(inside[:, None], shapes[np.clip(at, 0, len(shapes) - 1)] + 1, 0) + base)
    return np.concatenate(out, axis=1)


def emissions(x: Lines, m: Model) -> np.ndarray:
    """Score of label 1 over label 0 of each line: the mean of its n-grams' weights, and its shapes'."""
    n = np.diff(x.at)
    score = np.zeros(len(n), np.float32)
    for size in GRAM_SIZES:
        score += np.add.reduceat(m.cells[gram_cells(x.data, size)], x.at[:-1]) / n
    return score.astype(np.float64) + m.shapes[neighbour_features(x, line_shapes(x))].sum(axis=1)


def by_length(x: Lines) -> Iterator[np.ndarray]:
    """Numbers of texts in groups of alike line counts, so that chains run side by side."""
    lines = np.diff(x.doc)
    order = np.argsort(lines, kind="stable")
    lo = 0
    while lo < len(order):
        hi = int(np.searchsorted(lines[order], max(8, 2 * lines[order[lo]]), side="right"))
        yield order[lo:hi]
        lo = hi


def marginals(x: Lines, score: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """P(label 1) of every line by forward-backward, and the expected transitions of each text."""
    p, pairs = np.zeros(len(score)), np.zeros((len(x.doc) - 1, 2, 2))
    for group in by_length(x):
        first, n = x.doc[group], np.diff(x.doc)[group]
        longest = int(n.max())
        emit = np.zeros((len(group), longest, 2))
        for t in range(longest):
            live = n > t
            emit[live, t, 1] = score[first[live] + t]
        alpha = np.zeros_like(emit)
        alpha[:, 0] = m.start + emit[:, 0]
        for t in range(1, longest):
            step = np.logaddexp(alpha[:, t - 1, 0, None] + m.trans[0], alpha[:, t - 1, 1, None] + m.trans[1]) + emit[:, t]
            alpha[:, t] = np.where((n > t)[:, None], step, alpha[:, t - 1])
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        beta = np.zeros((len(group), 2))
        for t in range(longest - 1, -1, -1):
            live = n > t
            p[first[live] + t] = np.exp(alpha[live, t, 1] + beta[live, 1] - total[live])
            if t:
                ahead = emit[:, t] + beta
                joint = np.exp(alpha[:, t - 1, :, None] + m.trans + ahead[:, None, :] - total[:, None, None])
                pairs[group[live]] += joint[live]
                back = np.logaddexp(m.trans[:, 0] + ahead[:, 0, None], m.trans[:, 1] + ahead[:, 1, None])
                beta = np.where(live[:, None], back, beta)
    return p, pairs


def raw_scores(x: Lines, m: Model) -> np.ndarray:
    """Length-weighted mean of the lines' marginals of each text."""
    p, _ = marginals(x, emissions(x, m), m)
    n = np.diff(x.at).astype(np.float64)
    return np.add.reduceat(p * n, x.doc[:-1]) / np.add.reduceat(n, x.doc[:-1])


def fit_texts(texts: list[str | None], labels: np.ndarray) -> Model:
    """Fit on texts with a label each; every line of a text has its text's label.

    The two labels weigh alike in the likelihood. Last, a logistic curve is put
    on the text scores so that 0.5 divides the labels best by likelihood.
    """
    m = Model(np.zeros(CELLS, np.float32), np.zeros(len(NEIGHBOURS) * SHAPES * (BINS + 1)), np.zeros((2, 2)), np.zeros(2))
    labels = np.asarray(labels)
    if not len(labels) or labels.min() == labels.max():
        m.slope, m.shift = 0.0, (0.0 if not len(labels) else 4.0 if labels.max() else -4.0)
        return m
    share = np.bincount(labels, minlength=2) / len(labels)
    weight, rng = 0.5 / share[labels], np.random.default_rng(7)
    squares = [np.full(len(m.cells), 1e-6), np.full(len(m.shapes), 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            x = split_lines([texts[i] for i in some])
            lines = np.diff(x.doc)
            truth, w = np.repeat(labels[some], lines), np.repeat(weight[some] / lines, lines)
            p, pairs = marginals(x, emissions(x, m), m)
            slack, n = (truth - p) * w / len(some), np.diff(x.at)
            cells = np.zeros(len(m.cells))
            for size in GRAM_SIZES:
                cells += np.bincount(gram_cells(x.data, size), np.repeat(slack / n, n), minlength=len(cells))
            found = neighbour_features(x, line_shapes(x))
            shapes = np.bincount(found.ravel(), np.repeat(slack, found.shape[1]), minlength=len(m.shapes))
            seen = np.zeros_like(pairs)
            seen[np.arange(len(some)), labels[some], labels[some]] = lines - 1
            trans = ((seen - pairs) * (weight[some] / lines / len(some))[:, None, None]).sum(axis=0)
            begin = np.zeros(2)
            np.add.at(begin, labels[some], weight[some] / lines / len(some))
            first = p[x.doc[:-1]]
            begin -= np.array([((1 - first) * weight[some] / lines).sum(), (first * weight[some] / lines).sum()]) / len(some)
            for i, (value, grad) in enumerate(((m.cells, cells), (m.shapes, shapes), (m.trans, trans), (m.start, begin))):
                grad = grad - DECAY * value
                squares[i] += grad * grad
                value += (RATE * 4 * grad / np.sqrt(squares[i])).astype(value.dtype)
            np.clip(m.trans, -2, 2, out=m.trans)  # lines keep a say of their own
    raw = np.concatenate([raw_scores(split_lines([t]), m) for t in texts])
    slope, shift = 1.0, 0.0
    z = _logit(raw)
    for _ in range(50):  # Newton's method, in two variables
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        g = np.array([((labels - p) * z).sum() - 0.01 * (slope - 1), (labels - p).sum() - 0.01 * shift])
        v = p * (1 - p)
        h = np.array([[(v * z * z).sum() + 0.01, (v * z).sum()], [(v * z).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        slope, shift = slope + step[0], shift + step[1]
        if np.abs(step).max() < 1e-6:
            break
    m.slope, m.shift = float(max(slope, 0.05)), float(shift)
    return m


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on the texts of at most ``max_rows`` rows of ``doc_id, quality`` with a quality of 0 or 1.

    They are the ones with the smallest hash of their id; so few ids are
    broadcast to ``docs`` (``doc_id, text``), whose texts stay where they are.
    Rows that share a labelled id are ``max_rows`` at most, too.
    """
    some = labels.filter("quality IN (0, 1)").select("doc_id", "quality").orderBy(C.doc_hash("crf", "doc_id"), "doc_id", "quality").limit(max_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = found.orderBy(C.doc_hash("crf", "doc_id"), "doc_id", F.xxhash64("text"), "quality").limit(max_rows).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["text"] or ""))
    return fit_texts([r["text"] for r in rows], np.array([r["quality"] for r in rows], np.int64))


def score(docs: DataFrame, model: Model, chunk: int = 1 << 20) -> DataFrame:
    """``doc_id, score`` of every row: 0 to 1, higher where label 1 is likelier.

    A null text counts as empty, which is one empty line; repeated rows are
    scored each; other columns are ignored.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, out, lo, size = list(batch["text"]), [], 0, 0
            for i, t in enumerate([*texts, None]):
                if i == len(texts) or size > chunk:
                    if i > lo:
                        out.append(raw_scores(split_lines(texts[lo:i]), model))
                    lo, size = i, 0
                size += len(t or "")
            raw = np.concatenate(out) if out else np.zeros(0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": 1 / (1 + np.exp(-(model.slope * _logit(raw) + model.shift)))})

    return docs.select("doc_id", "text").mapInPandas(task, "doc_id long, score double")
