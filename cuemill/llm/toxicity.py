"""Toxicity by class-conditional Kneser-Ney models of letters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import common as C
from .language_id import letters_of

#: Letters of the longest n-gram, sixteen bits of a key each.
ORDER = 4
#: What each seen n-gram gives away to those not seen.
DISCOUNT = 0.75
#: Cells of the table of an order: of n-grams that share one the most frequent is kept, the others back off.
CELLS_LOG2 = 20
#: Labelled rows that the models are fitted on, at most; a fourth of them set the threshold.
MAX_ROWS = 20_000
#: Letters of texts that are handled at once.
CHUNK = 1 << 20
_SYMBOL = np.uint64(0xFFFF)


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the last ORDER symbols up to each place of the texts, and the text of each place.

    A symbol is a lower-case letter (its code point's low sixteen bits), or 0
    for each run of anything else and for a text's start and end. The symbol
    at a start is given; no key reaches into the text before.
    """
    joined = "".join([f"\0{t or ''}\0" for t in texts])
    codes = letters_of()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    size = np.array([len(t or "") + 2 for t in texts], np.int64)
    edge = np.cumsum(size) - size
    keep = codes != 0
    keep[1:] |= keep[:-1]
    keep[edge] = True
    row = np.repeat(np.arange(len(texts)), size)[keep]
    s = codes[keep].astype(np.uint64)
    low = s & _SYMBOL
    s = np.where((s > 0) & (low == 0), np.uint64(1), low)
    key = s.copy()
    for k in range(1, ORDER):
        key[k:] |= s[:-k] << np.uint64(16 * k)
    first = np.searchsorted(row, np.arange(len(texts)))
    for k in range(ORDER - 1):
        at = first + k
        at = at[(at < len(row)) & (row[np.minimum(at, len(row) - 1)] == np.arange(len(texts)))]
        key[at] &= np.uint64((1 << 16 * (k + 1)) - 1)
    scored = np.ones(len(row), bool)
    scored[first] = False
    return key[scored], row[scored]


def cells(key: np.ndarray) -> np.ndarray:
    x = key ^ (key >> np.uint64(31))
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)


class Table:
    """Values of keys, given in ascending order of how often they were seen; by cell, of which the last stays.

    Keys and values alone are sent; each process lays out its cells when it first looks.
    """

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.key, self.value = key, value.astype(np.float32)
        self.laid: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"laid": None}

    def at(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a key is kept, its value or 0)."""
        if self.laid is None:
            keys, values, c = np.full(1 << CELLS_LOG2, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(1 << CELLS_LOG2, np.float32), cells(self.key)
            keys[c], values[c] = self.key, self.value
            self.laid = keys, values
        keys, values = self.laid
        c = cells(key)
        hit = keys[c] == key
        return hit, np.where(hit, values[c], np.float32(0))


@dataclass
class Model:
    """Log ratios (toxic over ordinary) of seen n-grams and of what contexts give away, from order 2 on, and the logistic curve over length-normalised sums."""

    grams: list[Table] = field(default_factory=list)
    contexts: list[Table] = field(default_factory=list)
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def ratios(self, key: np.ndarray) -> np.ndarray:
        """log P(symbol | context, toxic) - log P(symbol | context, ordinary) of each key.

        The longest n-gram that was seen gives the ratio, with what each longer
        context gives away; without any the shared counts say the same of both.
        """
        out, left = np.zeros(len(key), np.float32), np.arange(len(key))
        for k in range(ORDER, 1, -1):
            if not len(left) or not self.grams:
                break
            some = key[left] & np.uint64((1 << 16 * k) - 1)
            hit, value = self.grams[k - 2].at(some)
            _, given = self.contexts[k - 2].at(some >> np.uint64(16))
            out[left] += np.where(hit, value, given)
            left = left[~hit]
        return out

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The log likelihood ratio of each text and its number of symbols."""
        key, row = symbols(texts)
        return np.bincount(row, self.ratios(key), minlength=len(texts)), np.bincount(row, minlength=len(texts)).astype(np.float64)

    def scores(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(total, n) @ np.array(self.weights), -30, 30)))


def features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A sum over the root of the length has the same spread at every length; the root itself makes up for a mean that isn't 0."""
    root = np.sqrt(n)
    return np.stack([np.divide(total, root, out=np.zeros(len(n)), where=n > 0), root, np.ones(len(n))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method with halved steps where one overshoots."""
    w = np.zeros(x.shape[1])
    loss = lambda w: np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + ridge / 2 * (w @ w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        while loss(w + step) > loss(w) + 1e-12 and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHUNK:
            yield lo, i
            lo, size = i, 0
        size += len(t or "") + 2
    if texts:
        yield lo, len(texts)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``key, n0, n1``: how often each n-gram of the longest order stands in ordinary and toxic texts (``text, toxic``)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, toxic = list(batch["text"]), batch["toxic"].to_numpy(np.int64)
            for lo, hi in _chunks(texts):
                key, row = symbols(texts[lo:hi])
                found, at = np.unique(key, return_inverse=True)
                y = toxic[lo:hi][row]
                n1 = np.bincount(at, y, minlength=len(found)).astype(np.int64)
                yield pd.DataFrame({"key": found.view(np.int64), "n0": np.bincount(at, minlength=len(found)) - n1, "n1": n1})

    return labelled.select("text", "toxic").mapInPandas(task, "key long, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _kept(counts: DataFrame, *columns: str) -> dict[str, np.ndarray]:
    """The most frequent key of each cell with its ``columns``: no more rows than cells come to the driver."""
    x = F.col("key").bitwiseXOR(F.shiftrightunsigned("key", 31))
    cell = F.pmod(F.xxhash64("key"), F.lit(1 << CELLS_LOG2))
    best = counts.groupBy(cell.alias("cell")).agg(F.max(F.struct((F.col(columns[0]) + F.col(columns[1])).alias("n"), F.col("key"), *[F.col(c).alias(f"_{c}") for c in columns])).alias("x"))
    got = best.select("x.key", *[F.col(f"x._{c}").alias(c) for c in columns]).orderBy("x.n", "x.key").toPandas()
    return {"key": got["key"].to_numpy(np.int64).view(np.uint64), **{c: got[c].to_numpy(np.float64) for c in columns}}


def fit_counts(counts: DataFrame, discount: float = DISCOUNT) -> Model:
    """Kneser-Ney models of both classes from the counts of the longest n-grams.

    The longest order has each class's counts; each lower one counts how many
    different symbols stand before an n-gram in the class. What is discounted
    goes to the next lower order, and at last to the shared counts of both
    classes: how many different symbols stand before a symbol. So an
    expression that neither class knows is as likely under both.
    """
    levels: list[tuple[dict, dict]] = []
    here = counts
    for k in range(ORDER, 1, -1):
        by_context = here.groupBy(F.shiftrightunsigned("key", 16).alias("key")).agg(*[f(F.col(f"n{c}")).alias(f"{t}{c}") for c in (0, 1) for t, f in (("n", F.sum), ("t", lambda x: F.sum((x > 0).cast("long"))))])
        levels.insert(0, (_kept(here, "n0", "n1"), _kept(by_context, "n0", "n1", "t0", "t1")))
        shorter = F.col("key").bitwiseAND((1 << 16 * (k - 1)) - 1)
        here = here.groupBy(shorter.alias("key")).agg(*[F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"n{c}") for c in (0, 1)], F.count("*").alias("any"))
    shared = here.toPandas()
    seen, many = shared["key"].to_numpy(np.int64).view(np.uint64), shared["any"].to_numpy(np.float64)
    many_of = np.zeros(1 << 16)
    many_of[seen.astype(np.int64)] = many
    base = (many_of + 0.5) / (many.sum() + 0.5 * (len(seen) + 1))

    m, before = Model(), None
    for k, (grams, contexts) in enumerate(levels, 2):
        x = grams["key"] >> np.uint64(16)
        sort = np.argsort(contexts["key"])
        keys = contexts["key"][sort]
        place = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
        known = (keys[place] == x) if len(keys) else np.zeros(len(x), bool)
        lower = grams["key"] & np.uint64((1 << 16 * (k - 1)) - 1)
        p = []
        for c in (0, 1):
            below = base[lower.astype(np.int64)] if before is None else _look(before, lower, c, base)
            total, types = (np.where(known, contexts[f"{t}{c}"][sort][place], 0) for t in "nt")
            # a class that doesn't know the context passes all of it on
            p.append(np.where(total > 0, (np.maximum(grams[f"n{c}"] - discount, 0) + discount * types * below) / np.maximum(total, 1), below))
        share = [np.where(contexts[f"n{c}"] > 0, discount * contexts[f"t{c}"] / np.maximum(contexts[f"n{c}"], 1), 1.0) for c in (0, 1)]
        m.grams.append(Table(grams["key"], np.log(p[1] / p[0])))
        m.contexts.append(Table(contexts["key"], np.log(share[1] / share[0])))
        order = np.argsort(grams["key"])
        before = (grams["key"][order], [q[order] for q in p], keys, [s[sort] for s in share], before, k)
    return m


def _look(level: tuple | None, key: np.ndarray, c: int, base: np.ndarray) -> np.ndarray:
    """P(symbol | context) in class ``c`` of keys at a level, backing off where they are not kept."""
    if level is None:
        return base[(key & _SYMBOL).astype(np.int64)]
    keys, p, contexts, share, below, k = level
    if not len(keys):
        return _look(below, key & np.uint64((1 << 16 * (k - 1)) - 1), c, base)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    out, miss = p[c][at].copy(), keys[at] != key
    if miss.any():
        x = key[miss] >> np.uint64(16)
        here = np.minimum(np.searchsorted(contexts, x), len(contexts) - 1)
        given = np.where(contexts[here] == x, share[c][here], 1.0)
        out[miss] = given * _look(below, key[miss] & np.uint64((1 << 16 * (k - 1)) - 1), c, base)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` rows of ``doc_id, toxic`` with a label of 0 or 1, those with the smallest hash of their id.

    So few ids are broadcast to ``docs`` (``doc_id, text``). Three of four
    make the counts, the fourth the threshold; null texts count as empty.
    """
    spark = docs.sparkSession
    some = labels.filter("toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates()
    some = some.orderBy(C.doc_hash("toxicity", "doc_id"), "doc_id", "toxic").limit(max_rows)
    part = F.pmod(C.doc_hash("toxicity fold", "doc_id"), F.lit(4)) == 0
    labelled = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").withColumn("_hold", part)
    counts = C.materialize(gram_counts(labelled.filter("NOT _hold")), "grams")
    model = fit_counts(counts)
    sent = spark.sparkContext.broadcast(model)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            for lo, hi in _chunks(texts):
                total, n = sent.value.sums(texts[lo:hi])
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[lo:hi], "toxic": batch["toxic"].to_numpy()[lo:hi], "total": total, "n": n})

    held = labelled.filter("_hold").select("doc_id", "toxic", "text").mapInPandas(task, "doc_id long, toxic int, total double, n double")
    got = held.orderBy(C.doc_hash("toxicity", "doc_id"), "doc_id", "toxic", "total", "n").limit(max_rows).toPandas()
    y = got["toxic"].to_numpy(np.int64)
    if len(y) and 0 < y.sum() < len(y):
        model.weights = tuple(float(v) for v in logistic(features(got["total"].to_numpy(), got["n"].to_numpy()), y))
    else:
        model.weights = (0.0, 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1))))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row: 0 to 1, higher where a text is likelier toxic.

    A null text, or one without a letter, counts as empty; repeated rows are
    scored each; other columns are ignored; without labels of both kinds every
    text has the same score. The model, of a fixed number of cells, is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            out = [sent.value.scores(*sent.value.sums(texts[lo:hi])) for lo, hi in _chunks(texts)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": np.concatenate(out) if out else np.zeros(0)})

    return docs.select("doc_id", "text").mapInPandas(task, "doc_id long, score double")
