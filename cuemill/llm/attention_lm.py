"""LM scoring: word counts of the whole corpus, and a causal self-attention model over subword ids.

The counts give the base score. The model is a factored one: attention over
the ids before a token gives the probability of the token's class, in two
levels of a tree of classes, and counts over the whole corpus that of the token
within its class. Counts, the profiles that make the classes and the weights
are all learned from every training row: the weights start from a fit on a few
rows, then each task goes through its windows and the tasks' weights are averaged.

Texts are read once. A task cuts them into blocks that hold each distinct word
with its ids once, and the texts as numbers of words; all that follows works on
the blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common as C
from .subwords import DEFAULT, word_ids

#: Branches of either level of the tree of classes, width of the model, ids of a context window, and ids by which two windows overlap.
BRANCH, WIDTH, CONTEXT, OVERLAP = 16, 16, 32, 16
CLASSES = BRANCH * BRANCH
#: Training rows that the start of the weights is fitted on, about, and windows drawn from them for each step.
FIT_ROWS, STEPS, BATCH, RATE = 1000, 800, 64, 0.01
#: Windows of a step of the pass over all training rows, and its rate.
TRAINED, TRAIN_RATE = 256, 0.003
#: Windows that are scored at once, and bytes of text of a block.
SCORED, BLOCK_BYTES = 512, 8 << 20
#: Groups that ids are dealt to when an id's neighbours are counted, on either side.
NEAR = 32
#: Ids of a part of the tables that tasks' sums are added up in, and slots in which they are added up first.
PART, SLOTS = 1024, 32
#: Bytes of text whose distinct words (with repeats by block) one task counts.
COUNTED_BYTES = 24 << 20
LOG10 = np.float64(1 / np.log(10))
_NEVER = np.float32(-1e9)


# --- the attention model --------------------------------------------------------------------------


@dataclass
class Model:
    """``group``: class of each id; ``within``: log probability of each id in its class; weights of the attention layer.

    Id 0 to size - 1 are subwords, size is the end of a text, size + 1 its begin.
    """

    group: np.ndarray
    within: np.ndarray
    weights: dict[str, np.ndarray]


def classes(counts: np.ndarray, near: np.ndarray, branch: int = BRANCH) -> tuple[np.ndarray, np.ndarray]:
    """Class of each id and its log probability in it (with one count more for every id).

    ``near`` has for each id how often it stands next to each group of ids. All
    ids are halved by the first principal component of these profiles, by equal
    mass, and the halves again, until there are ``branch`` times ``branch``
    classes; class // branch is the half-way class. A frequent id may be alone in its class.
    """
    mass = counts + 1.0
    near = np.sqrt((near + 0.01) / (near + 0.01).sum(axis=1, keepdims=True))
    group, parts = np.zeros(len(counts), np.int64), [np.arange(len(counts))]
    while len(parts) < branch * branch:
        halves = []
        for part in parts:
            if len(part) < 2:
                halves += [part, part[:0]]
                continue
            x, m = near[part], mass[part]
            x = x - np.average(x, axis=0, weights=m)
            _, axes = np.linalg.eigh((x * m[:, None]).T @ x)
            along = np.argsort(x @ axes[:, -1], kind="stable")
            cut = int(np.clip(np.searchsorted(np.cumsum(m[along]), m.sum() / 2), 1, len(part) - 1))
            halves += [part[along[:cut]], part[along[cut:]]]
        parts = halves
    for j, part in enumerate(parts):
        group[part] = j
    total = np.bincount(group, mass, minlength=len(parts))
    return group, np.log(mass) - np.log(total[group])


def new_weights(size: int, branch: int = BRANCH, d: int = WIDTH, context: int = CONTEXT) -> dict[str, np.ndarray]:
    """``qkv`` side by side; ``far``: what distance adds to attention; ``o1, b1`` and ``o2, b2``: the two levels of classes."""
    rng = np.random.default_rng(11)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(d)).astype(np.float32)
    return {"embed": draw(size + 2, d), "far": np.zeros(context, np.float32), "qkv": draw(d, 3 * d), "o1": draw(2 * d, branch), "b1": np.zeros(branch, np.float32), "o2": draw(branch, 2 * d, branch), "b2": np.zeros((branch, branch), np.float32)}


def _bias(far: np.ndarray, queries: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """What a query at one place adds for a key at another; never for one that is ahead."""
    back = queries[:, None] - keys[None, :]
    return np.where(back >= 0, far[np.clip(back, 0, len(far) - 1)], _NEVER).astype(far.dtype)


def _softmax(s: np.ndarray, most: float = 30) -> np.ndarray:
    """In place, along the last axis; numbers beyond ``most`` count as that."""
    np.minimum(s, most, out=s)
    np.exp(s, out=s)
    s /= np.maximum(s @ np.ones(s.shape[-1], s.dtype), np.finfo(s.dtype).tiny)[..., None]
    return s


def attend(w: dict[str, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """One causal self-attention layer over windows of ids (n, length).

    Returns what stands at every place for the id that follows (n, length, 2
    * width), and what the gradient needs. A place sees itself and the places before it.
    """
    (n, size), d = ids.shape, w["embed"].shape[1]
    x = w["embed"].take(ids.ravel(), axis=0)
    qkv = (x @ w["qkv"]).reshape(n, size, 3 * d)
    q, k, v = qkv[..., :d], qkv[..., d : 2 * d], qkv[..., 2 * d :]
    s = q @ k.transpose(0, 2, 1)
    s *= x.dtype.type(1 / np.sqrt(d))
    s += _bias(w["far"], np.arange(size), np.arange(size))
    y = _softmax(s) @ v
    return np.concatenate([x.reshape(n, size, d), np.tanh(y, out=y)], axis=2), x, q, k, v, s


def _ordered(upper: np.ndarray, branch: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by upper class, and where each of them begins and the last ends."""
    return np.argsort(upper.astype(np.int16), kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(upper, minlength=branch))])


def step(w: dict[str, np.ndarray], ids: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Mean negative log likelihood of the target classes (-1: none), its gradient, and the ids that ``embed``'s rows are of."""
    z, x, q, k, v, s = attend(w, ids)
    (n, size), d, branch = ids.shape, x.shape[1], len(w["b1"])
    aim, flat = target.ravel(), z.reshape(n * size, 2 * d)
    void = aim < 0
    share = x.dtype.type(1 / max(1, len(aim) - int(void.sum())))
    aim = np.where(void, 0, aim)
    upper, lower = aim // branch, aim % branch
    order, cut = _ordered(upper, branch)
    here, z_by = np.arange(len(aim)), flat.take(order, axis=0)

    def slack(p: np.ndarray, which: np.ndarray, none: np.ndarray) -> float:
        """From probabilities to the gradient of logits, in place; gives the loss."""
        lost = -np.log(p[here, which])
        lost[none] = 0
        p[here, which] -= 1
        p *= share
        p[none] = 0
        return float(lost.sum(dtype=np.float64))

    p = flat @ w["o1"]
    p += w["b1"]
    loss = slack(_softmax(p, 60), upper, void)
    ones = np.ones(len(aim), x.dtype)
    out = {"o1": flat.T @ p, "b1": ones @ p, "o2": np.zeros_like(w["o2"]), "b2": np.zeros_like(w["b2"])}
    gz, gz_by = p @ w["o1"].T, np.empty_like(z_by)
    p = w["b2"].take(upper[order], axis=0)
    some = [(g, slice(a, b)) for g, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if a < b]
    for g, own in some:
        p[own] += z_by[own] @ w["o2"][g]
    loss += slack(_softmax(p, 60), lower[order], void[order])
    for g, own in some:
        np.matmul(z_by[own].T, p[own], out=out["o2"][g])
        np.matmul(p[own], w["o2"][g].T, out=gz_by[own])
        np.matmul(ones[own], p[own], out=out["b2"][g])
    back_to = np.empty_like(order)
    back_to[order] = here
    gz += gz_by.take(back_to, axis=0)
    t = flat[:, d:]
    gy = gz[:, d:] * (1 - t * t)
    gy = gy.reshape(n, size, d)
    gs = gy @ v.transpose(0, 2, 1)
    gqkv = np.empty((n, size, 3 * d), x.dtype)
    np.matmul(s.transpose(0, 2, 1), gy, out=gqkv[..., 2 * d :])
    gs *= s
    s *= (gs @ np.ones(size, x.dtype))[..., None]
    gs -= s
    back = np.arange(size)[:, None] - np.arange(size)[None, :]
    seen = back >= 0
    out["far"] = np.bincount(back[seen], gs.sum(axis=0)[seen], minlength=len(w["far"])).astype(w["far"].dtype)
    gs *= x.dtype.type(1 / np.sqrt(d))
    np.matmul(gs, k, out=gqkv[..., :d])
    np.matmul(gs.transpose(0, 2, 1), q, out=gqkv[..., d : 2 * d])
    gqkv = gqkv.reshape(-1, 3 * d)
    out["qkv"] = x.T @ gqkv
    gx = gqkv @ w["qkv"].T
    gx += gz[:, :d]
    every = ids.ravel()
    order = np.argsort(every.astype(np.int32), kind="stable")
    sorted_ids = every[order]
    first = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1]))
    out["embed"] = np.add.reduceat(gx.take(order, axis=0), first, axis=0)
    return loss * float(share), out, sorted_ids[first]


class Adam:
    """The optimiser's state; of ``embed``, rows that a step has not met stay as they are."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w, self.t = w, 0
        self.mean, self.square = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def move(self, grads: dict[str, np.ndarray], met: np.ndarray, rate: float) -> None:
        self.t += 1
        for k, g in grads.items():
            at = met if k == "embed" else slice(None)
            mean, square = 0.9 * self.mean[k][at] + 0.1 * g, 0.99 * self.square[k][at] + 0.01 * g * g
            self.mean[k][at], self.square[k][at] = mean, square
            self.w[k][at] -= (rate * (mean / (1 - 0.9**self.t)) / (np.sqrt(square / (1 - 0.99**self.t)) + 1e-8)).astype(self.w[k].dtype)


@dataclass
class Sequences:
    """Texts as ids end to end, each led by the begin of a text and followed by its end."""

    flat: np.ndarray
    begin: np.ndarray
    lengths: np.ndarray  # of what is to be predicted: the ids and the end

    @staticmethod
    def of(ids: np.ndarray, many: np.ndarray, size: int) -> Sequences:
        """``ids`` of all texts, ``many`` of each."""
        begin = np.concatenate([[0], np.cumsum(many + 2)])
        flat = np.empty(int(begin[-1]), np.int64)
        flat[np.arange(len(ids)) + 2 * np.repeat(np.arange(len(many)), many) + 1] = ids
        flat[begin[:-1]], flat[begin[1:] - 1] = size + 1, size
        return Sequences(flat, begin[:-1], many + 1)

    def windows(self, new: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, first place) of stretches of ``new`` places that cover every text once."""
        many = -(-self.lengths // new)
        seq = np.repeat(np.arange(len(many)), many)
        return seq, (np.arange(len(seq)) - np.repeat(np.cumsum(many) - many, many)) * new

    def grid(self, seq: np.ndarray, first: np.ndarray, size: int, ahead: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """``size`` ids from ``first`` on of each text (``ahead`` places on), and which places the text has."""
        place = first[:, None] + np.arange(size)
        live = (place >= 0) & (place < self.lengths[seq][:, None])
        return self.flat[self.begin[seq][:, None] + np.where(live, place, 0) + ahead], live


def batch_of(x: Sequences, seq: np.ndarray, first: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows' ids, and the class of what follows each (-1: nothing)."""
    ids, live = x.grid(seq, first, CONTEXT)
    return ids, np.where(live, group[x.grid(seq, first, CONTEXT, 1)[0]], -1)


def fit_weights(rows: list[np.ndarray], group: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Adam on windows drawn from sequences of ids (without begin and end)."""
    w = new_weights(size)
    share = np.bincount(np.concatenate([group[r] for r in rows] + [group[:0]]), minlength=CLASSES).reshape(BRANCH, BRANCH) + 1.0
    w["b1"] = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
    w["b2"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    if not rows:
        return w
    x = Sequences.of(np.concatenate(rows).astype(np.int64), np.array([len(r) for r in rows]), size)
    seq, first = x.windows(CONTEXT)
    rng, adam = np.random.default_rng(3), Adam(w)
    for t in range(1, STEPS + 1):
        some = rng.integers(0, len(seq), BATCH)
        _, grads, met = step(w, *batch_of(x, seq[some], first[some], group))
        adam.move(grads, met, RATE * min(1, 3 * (1 - t / (STEPS + 1))))
    return w


def train_rows(w: dict[str, np.ndarray], blocks: Iterator[Sequences], group: np.ndarray, size: int, seed: int) -> tuple[int, np.ndarray]:
    """Adam on every window of sequences of ids, once each; changes ``w``. Returns how many windows there were and how often each id was an input.

    Windows stand end to end, so that each id is aimed at once.
    """
    rng, seen, many, adam = np.random.default_rng(seed), np.zeros(size + 2, np.int64), 0, Adam(w)
    for x in blocks:
        seq, first = x.windows(CONTEXT)
        order = rng.permutation(len(seq))
        many += len(seq)
        seen += np.bincount(x.flat, minlength=size + 2)
        for a in range(0, len(order), TRAINED):
            some = order[a : a + TRAINED]
            _, grads, met = step(w, *batch_of(x, seq[some], first[some], group))
            adam.move(grads, met, TRAIN_RATE)
    return many, seen


class Scorer:
    """Scores texts by a model; what the layer makes of each single id (query, key, value and the id's own part) is made once."""

    def __init__(self, model: Model):
        w, d = model.weights, model.weights["embed"].shape[1]
        self.model, self.d = model, d
        self.table = np.concatenate([w["embed"] @ w["qkv"], w["embed"]], axis=1)
        self.table[:, :d] *= np.float32(1 / np.sqrt(d))
        self.bias = _bias(w["far"], np.arange(OVERLAP, CONTEXT), np.arange(CONTEXT))

    def score(self, x: Sequences) -> np.ndarray:
        """log10 probability of each text, its end included.

        Windows overlap by OVERLAP ids; a window scores what the one before has
        not, so that every id is scored once and, but for a text's first, with
        at least OVERLAP ids before it. What two windows share, the new ids of
        the one before, is looked up once.
        """
        w, d, new = self.model.weights, self.d, CONTEXT - OVERLAP
        branch, out = len(w["b1"]), np.zeros(len(x.lengths))
        seq, first = x.windows(new)
        before = np.zeros((1, new, 2 * d), np.float32)
        for a in range(0, len(seq), SCORED):
            of, at = seq[a : a + SCORED], first[a : a + SCORED]
            ids, live = x.grid(of, at, new)
            n = len(ids)
            own = self.table.take(ids.ravel(), axis=0).reshape(n, new, 4 * d)
            last = np.concatenate([before, own[:-1, :, d : 3 * d]])
            before = own[-1:, :, d : 3 * d].copy()
            s = np.empty((n, new, CONTEXT), np.float32)
            np.matmul(own[..., :d], last[..., :d].transpose(0, 2, 1), out=s[..., :OVERLAP])
            np.matmul(own[..., :d], own[..., d : 2 * d].transpose(0, 2, 1), out=s[..., OVERLAP:])
            s += self.bias
            s[at == 0, :, :OVERLAP] = _NEVER
            _softmax(s)
            y = s[..., :OVERLAP] @ last[..., d:]
            y += s[..., OVERLAP:] @ own[..., 2 * d : 3 * d]
            z = np.concatenate([own[..., 3 * d :], np.tanh(y, out=y)], axis=2).reshape(n * new, 2 * d)
            follow = x.grid(of, at, new, 1)[0].ravel()
            group = self.model.group.take(follow)
            upper, lower = group // branch, group % branch
            order, cut = _ordered(upper, branch)
            here = np.arange(len(upper))
            got = _log_share(z @ w["o1"] + w["b1"], upper, here)
            z_by, p = z.take(order, axis=0), w["b2"].take(upper[order], axis=0)
            for g in range(branch):
                i, j = cut[g], cut[g + 1]
                if i < j:
                    p[i:j] += z_by[i:j] @ w["o2"][g]
            got[order] += _log_share(p, lower[order], here)
            got += self.model.within.take(follow)
            got[~live.ravel()] = 0
            out += np.bincount(np.repeat(of, new), got, minlength=len(out))
        return out * LOG10


def _log_share(logits: np.ndarray, which: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Log softmax of one logit of each row."""
    np.minimum(logits, 60, out=logits)
    one = logits[here, which].astype(np.float64)
    return one - np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype))


# --- blocks of texts ------------------------------------------------------------------------------


@dataclass
class Block:
    """Rows of a block. Word i has the ids ``ids[start[i] : start[i + 1]]``; text r has the words ``words[at[r] : at[r + 1]]``."""

    docs: list[int | None]
    train: np.ndarray
    at: np.ndarray
    words: np.ndarray
    start: np.ndarray
    ids: np.ndarray

    def pack(self) -> bytes:
        null = np.array([d is None for d in self.docs], np.uint8)
        head = struct.pack("<4Q", len(self.docs), len(self.words), len(self.start) - 1, len(self.ids))
        parts = (np.array([d or 0 for d in self.docs], "<i8"), self.at.astype("<u8"), self.words.astype("<u4"), self.start.astype("<u4"), self.ids.astype("<u4"), null, self.train.astype(np.uint8))
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join([p.tobytes() for p in parts]))

    @staticmethod
    def unpack(blob: bytes) -> Block:
        blob = zstandard.ZstdDecompressor().decompress(blob)
        n, m, v, k = struct.unpack_from("<4Q", blob)
        at, got = 32, []
        for kind, many in (("<i8", n), ("<u8", n + 1), ("<u4", m), ("<u4", v + 1), ("<u4", k), ("u1", n), ("u1", n)):
            got.append(np.frombuffer(blob, kind, many, at))
            at += got[-1].nbytes
        docs, first, words, start, ids, null, train = got
        return Block([None if z else int(d) for d, z in zip(docs, null, strict=True)], train > 0, first.astype(np.int64), words.astype(np.int64), start.astype(np.int64), ids.astype(np.int64))

    def sequences(self, rows: np.ndarray, size: int) -> Sequences:
        """The ids of the texts that ``rows`` marks."""
        each = np.diff(self.at)
        words = self.words[np.repeat(rows, each)]
        many = np.diff(self.start)[words]
        before = np.concatenate([[0], np.cumsum(many)])
        ids = self.ids[np.repeat(self.start[words] - before[:-1], many) + np.arange(int(before[-1]))]
        edge = np.concatenate([[0], np.cumsum(each[rows])])
        return Sequences.of(ids, np.diff(before[edge]), size)


def neighbours(x: Sequences, size: int) -> np.ndarray:
    """For each id how often one of each group of ids (the begin and the end of a text among them) stands before it, and after it."""
    wide, a, b = 2 * NEAR, x.flat[:-1], x.flat[1:]
    out = np.bincount(b * wide + a % NEAR, minlength=(size + 2) * wide)
    out += np.bincount(a * wide + (NEAR + b % NEAR), minlength=len(out))
    return out[: (size + 1) * wide]


def _packed(part: int, at: np.ndarray, values: np.ndarray) -> tuple[int, int, bytes]:
    """Rows of ``values`` (m, width) that stand at ``at`` in a part."""
    blob = struct.pack("<QQ", len(at), values.shape[1]) + at.astype("<u4").tobytes() + values.astype("<f8").tobytes()
    return part, TaskContext.get().partitionId() % SLOTS, zstandard.ZstdCompressor(level=1).compress(blob)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    blob = zstandard.ZstdDecompressor().decompress(blob)
    n, width = struct.unpack_from("<QQ", blob)
    return np.frombuffer(blob, "<u4", n, 16).astype(np.int64), np.frombuffer(blob, "<f8", n * width, 16 + 4 * n).reshape(n, width)


def _summed(packed: DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sums of what tasks sent for each ``part`` (in a ``slot``, as ``blob``), added up by slots and then over these."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((0, 0))
        for blob in group["blob"]:
            at, values = _unpacked(blob)
            if len(at) and at.max() >= len(total):
                total = np.concatenate([total.reshape(len(total), values.shape[1]), np.zeros((int(at.max()) + 1 - len(total), values.shape[1]))])
            total[at] += values
        some = np.flatnonzero(total.any(axis=1))
        return pd.DataFrame([_packed(int(group["part"].iat[0]), some, total[some])], columns=["part", "slot", "blob"])

    schema = "part int, slot int, blob binary"
    by_slot = packed.groupBy("part", "slot").applyInPandas(add, schema)
    for r in by_slot.groupBy("part").applyInPandas(add, schema).toLocalIterator():
        yield r["part"], *_unpacked(r["blob"])


def text_blocks(docs: DataFrame, tokenizer: str = DEFAULT, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` (``doc_id, text, train``) as blocks, in one pass; written. Four kinds of rows, told by what is not null:

    ``rows``: a block, with its numbers of training rows and of their words;
    ``words``: digests of a block's words in one of ``bucket``'s shares, with their counts in training rows;
    ``sums``: a task's sums over its training rows for the ids of a ``part`` (see ``neighbours``);
    ``start``: ids of a training row that the weights' start is fitted on.
    Words are cut at the six ASCII white-space characters, with A-Z in lower case.
    """
    held = docs.count()
    share = min(1.0, fit_rows / max(1, held))
    drawn = docs.filter(F.pmod(C.doc_hash("lm", "doc_id"), F.lit(1 << 20)) < F.lit(max(1, int(min(1.0, 2000 / max(1, held)) * (1 << 20)))))
    sampled = drawn.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(min(4096, max(C.shuffle_partitions(docs.sparkSession), int(sampled / min(1.0, 2000 / max(1, held))) // COUNTED_BYTES, 1)))
    columns = ["block", "rows", "n_words", "n_train", "bucket", "words", "part", "slot", "sums", "start"]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, block = word_ids(tokenizer), TaskContext.get().partitionId() << 32
        wide, size = 2 * NEAR, table.size
        near = np.zeros((size + 1) * wide, np.int32)
        ids, train, start, texts, held = [], [], [], [], 0

        def flush() -> list[dict]:
            nonlocal block
            number: dict[bytes, int] = {}
            lines = [np.array([number.setdefault(w, len(number)) for w in t.split()], np.int64) for t in texts]
            words, flat = list(number), np.concatenate([*lines, np.zeros(0, np.int64)])
            table.learn(set(words))
            digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in words]), "<u8").reshape(-1, 2)
            bucket = ((digests[:, 0] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            own = [table.known[words[i]] for i in order.tolist()]
            first = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64) // table.dtype.itemsize
            each = np.array([len(x) for x in lines], np.int64)
            got = Block(ids, np.array(train, bool), np.concatenate([[0], np.cumsum(each)]), rank[flat], first, np.frombuffer(b"".join(own), table.dtype))
            known = np.repeat(got.train, each)
            counts = np.bincount(got.words[known], minlength=len(words))
            out = [{"block": block, "rows": got.pack(), "n_words": int(counts.sum()), "n_train": int(got.train.sum())}]
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                mine = order[cut[b] : cut[b + 1]]
                out.append({"block": block, "bucket": b, "words": digests[mine].tobytes() + counts[cut[b] : cut[b + 1]].astype("<i8").tobytes()})
            if got.train.any():
                x = got.sequences(got.train, size)
                np.add(near, neighbours(x, size), out=near, casting="unsafe")
                for r in np.flatnonzero(np.array(start)[got.train]).tolist():
                    out.append({"start": x.flat[x.begin[r] + 1 : x.begin[r] + x.lengths[r]].astype("<u4").tobytes()})
            block += 1
            return out

        for batch in batches:
            for i, text, known, first in zip(batch["doc_id"], batch["text"], batch["train"], batch["start"], strict=True):
                ids.append(None if pd.isna(i) else int(i))
                train.append(bool(known))
                start.append(bool(first))
                texts.append((text or "").encode("utf-8", "surrogatepass").lower())
                held += len(texts[-1])
                if held >= BLOCK_BYTES:
                    yield pd.DataFrame(flush(), columns=columns)
                    ids, train, start, texts, held = [], [], [], [], 0
        if ids:
            yield pd.DataFrame(flush(), columns=columns)
        out = []
        for part in range(0, size + 1, PART):
            mine = near[part * wide : (part + PART) * wide]
            at = np.flatnonzero(mine)
            if len(at):
                out.append(dict(zip(("part", "slot", "sums"), _packed(part, at, mine[at, None]), strict=True)))
        if out:
            yield pd.DataFrame(out, columns=columns)
        table.forget()
        C.give_back()

    first = F.pmod(C.doc_hash("lm-start", "doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    schema = "block long, rows binary, n_words long, n_train long, bucket int, words binary, part int, slot int, sums binary, start binary"
    rows = docs.select("doc_id", "text", "train", F.coalesce(first, F.lit(False)).alias("start"))
    return C.materialize(rows.mapInPandas(task, schema), "lm-blocks")


def word_counts(blocks: DataFrame) -> DataFrame:
    """``block, bucket, distinct, counts``, written: the corpus's counts of a block's words in a bucket, in the block's order.

    ``distinct`` is the number of the bucket's words with a count, given in one row of each bucket and 0 in the others.
    """

    def count(group: pd.DataFrame) -> pd.DataFrame:
        many = [len(b) // 24 for b in group["words"]]
        digests = np.concatenate([np.frombuffer(b, "<u8", 2 * n).reshape(-1, 2) for b, n in zip(group["words"], many, strict=True)])
        counts = np.concatenate([np.frombuffer(b, "<i8", n, 16 * n) for b, n in zip(group["words"], many, strict=True)])
        order = np.argsort(digests[:, 0], kind="stable")
        high, low = digests[order, 0], digests[order, 1]
        new = np.append(True, high[1:] != high[:-1])
        if (~new[1:] & (low[1:] != low[:-1])).any():  # words alike in half of their digests
            order = np.lexsort((digests[:, 1], digests[:, 0]))
            new = np.append(True, (digests[order][1:] != digests[order][:-1]).any(axis=1))
        first = np.flatnonzero(new)
        total = np.add.reduceat(counts[order], first)
        back = np.empty(len(order), np.int64)
        back[order] = np.repeat(total, np.diff(np.append(first, len(order))))
        cut = np.concatenate([[0], np.cumsum(many)])
        packed = [zstandard.ZstdCompressor(level=1).compress(back[a:b].astype("<i8").tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        distinct = np.zeros(len(packed), np.int64)
        distinct[0] = (total > 0).sum()
        return pd.DataFrame({"block": group["block"].to_numpy(), "bucket": group["bucket"].to_numpy(), "distinct": distinct, "counts": packed})

    found = blocks.filter("words IS NOT NULL").select("block", "bucket", "words")
    return C.materialize(found.groupBy("bucket").applyInPandas(count, "block long, bucket int, distinct long, counts binary"), "lm-counts")


def profiles(blocks: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each id occurs in all training rows (the end of a text is one), and how often next to each group of ids."""
    wide = 2 * NEAR
    near = np.zeros((size + 1) * wide)
    for part, at, values in _summed(blocks.filter("sums IS NOT NULL").select("part", "slot", F.col("sums").alias("blob"))):
        near[part * wide + at] = values[:, 0]
    near = near.reshape(size + 1, wide)
    return near[:, :NEAR].sum(axis=1), near  # something stands before every id


def train_on_all(blocks: DataFrame, start: dict[str, np.ndarray], group: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Weights after a pass over all training rows: each task starts from ``start`` and their weights are averaged.

    A task counts by its windows, and for an id's embedding by how often it met
    the id; what no task met stays as it was.
    """
    dense = [k for k in start if k != "embed"]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = {k: x.copy() for k, x in start.items()}
        found = (Block.unpack(blob) for batch in batches for blob in batch["rows"])
        many, seen = train_rows(w, (b.sequences(b.train, size) for b in found if b.train.any()), group, size, TaskContext.get().partitionId())
        out = []
        if many:
            flat = np.concatenate([[1.0], *[w[k].ravel() for k in dense]])
            out.append(_packed(-1, np.zeros(1, np.int64), many * flat[None].astype(np.float64)))
        for part in range(0, size + 2, PART):
            at = np.flatnonzero(seen[part : part + PART])
            if len(at):
                n = seen[part + at, None].astype(np.float64)
                out.append(_packed(part, at, np.concatenate([n, n * w["embed"][part + at]], axis=1)))
        yield pd.DataFrame(out, columns=["part", "slot", "blob"])
        C.give_back()

    out = {k: x.copy() for k, x in start.items()}
    rows = blocks.filter("rows IS NOT NULL AND n_train > 0").select("rows")
    for part, at, values in _summed(rows.mapInPandas(task, "part int, slot int, blob binary")):
        mean = (values[:, 1:] / values[:, :1]).astype(np.float32)
        if part >= 0:
            out["embed"][part + at] = mean
            continue
        cut = np.cumsum([0] + [start[k].size for k in dense])
        for k, a, b in zip(dense, cut[:-1], cut[1:], strict=True):
            out[k] = mean[0, a:b].reshape(start[k].shape)
    return out


def fit(blocks: DataFrame, size: int) -> Model:
    """Classes and weights from all training rows; weights start from the rows that the blocks set apart for it."""
    counts, near = profiles(blocks, size)
    group, within = classes(counts, near)
    some = sorted(bytes(r["start"]) for r in blocks.filter("start IS NOT NULL").select("start").limit(4 * FIT_ROWS).collect())
    rows = [np.frombuffer(b, "<u4").astype(np.int64) for b in some]
    return Model(group, within, train_on_all(blocks, fit_weights(rows, group, size), group, size))


def block_scores(blocks: DataFrame, counts: DataFrame, model: Model, size: int, n_train: int, total: int, distinct: int) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row: each block meets the corpus's counts of its words."""
    back = counts.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "counts"))).alias("found"))
    back = back.select("block", F.transform("found", lambda x: x["counts"]).alias("found"))
    joined = blocks.filter("rows IS NOT NULL").select("block", "rows").join(back, "block", "left")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bottom, scorer = np.log10(total + distinct + 1), Scorer(model)
        for batch in batches:
            for found, blob in zip(batch["found"], batch["rows"], strict=True):
                b = Block.unpack(blob)
                parts = [] if found is None else [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<i8") for x in found]
                c = np.concatenate([*parts, np.zeros(0, np.int64)])
                n = len(b.docs)
                row = np.repeat(np.arange(n), np.diff(b.at))
                tokens = np.diff(b.at) + 1
                known = np.bincount(row, (c > 0)[b.words], minlength=n) + (n_train > 0)
                base = np.bincount(row, np.log10(c + 1.0)[b.words], minlength=n) + np.log10(n_train + 1) - tokens * bottom
                score = scorer.score(b.sequences(np.ones(n, bool), size))
                yield pd.DataFrame({"doc_id": pd.array(b.docs, "Int64"), "n_tokens": tokens, "n_known": known.astype(np.int64), "train_tokens": total, "base_score": base, "score": score})
        C.give_back()

    return joined.mapInPandas(task, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_corpus(docs: DataFrame, tokenizer: str = DEFAULT, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``doc_id, text, train``.

    Counts, classes and attention weights are learned from all rows marked
    ``train``; the weights start from about ``fit_rows`` of them. The end of a
    text is a token too, one in each row. A null text counts as empty and has
    the end alone; repeated rows are scored and counted each; other columns are
    ignored; without training rows every count is 0.
    """
    blocks, size = text_blocks(docs.select("doc_id", "text", "train"), tokenizer, fit_rows), word_ids(tokenizer).size
    n_train, n_words = (int(x) for x in blocks.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first())
    counts = word_counts(blocks)
    distinct = int(counts.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]) + (1 if n_train else 0)
    return block_scores(blocks, counts, fit(blocks, size), size, n_train, n_train + n_words, distinct)
