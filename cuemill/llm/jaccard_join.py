"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Sets are the distinct five-word shingles of texts, as 64-bit hashes. Two sets
link if 100 * intersection >= 75 * union; then they differ in at most a seventh
of their sizes' sum, H elements. A band of sizes deals all tokens into m
segments by hash, and a differing token spoils one segment. Hence:

1. A set with more than H filled segments has one in common with every partner.
   In any order of segments that all sets share, a common one is among the
   first H + 1 of both; sets are indexed under those alone. The order is by
   cost: segments of frequent tokens alone come last, longer ones come first.
2. Pairs of sets with fewer filled segments than that are found by all their
   segments with their one-deletion neighbourhoods: a segment of two or more
   tokens then bears a difference of one token, and counts twice.
3. Where that is still too little, the H + 1 first tokens are indexed.

m is chosen for each band by the expected cost of these steps. The lower bands
are probed by the sets that reach into them. What is found is checked first by
parity sketches, which can only rule out, and then exactly on the texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C
from .components import connected_components

SHINGLE = 5
#: Groups of more sets than this under one key are linked to their first set, and the rest is looked at when these links are known.
ALL_PAIRS = 16
#: Rows drawn to learn frequent tokens, how often they must be seen, and how many are kept. They set the order of segments, never a result.
SAMPLE_ROWS, FREQUENT, FREQUENT_KEPT = 3000, 3, 100_000
#: Entries (of 16 bytes) that one bucket of the index is meant to hold, and bytes of text hashed at once.
BUCKET_ENTRIES, PIECE = 300_000, 2 << 20
#: Words whose hashes a task keeps.
KEEP_WORDS = 150_000
#: Rows of the candidates' key table up to which it is broadcast (16 bytes each); beyond, a shuffled join is used.
BROADCAST_ROWS = 500_000
#: Sets of a block when a large group is compared.
BLOCK = 2048
_M1, _M2, _M3 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_M2)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_M1)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Shingle sets of texts; the hashes of words are kept for the texts that follow."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes: of five-word shingles, of the whole sequence if it has fewer words, none without words."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > KEEP_WORDS:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n, k = max(1, len(words) - SHINGLE + 1), min(SHINGLE, len(words))
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = out * np.uint64(_M1) + h[i : i + n]
        return np.unique(mix(out))


def band(n: int) -> int:
    """Sizes from 2**b up to 2**(b+1) are band b."""
    return n.bit_length() - 1


def contexts(n: int) -> list[tuple[int, int]]:
    """(band, H) for which a set of ``n`` tokens is indexed: its own, and the one below if partners may lie there."""
    own = band(n)
    out = [(own, (n + n * 4 // 3) // 7)]
    if own and -(-3 * n // 4) < 1 << own:
        out.append((own - 1, (n + (1 << own) - 1) // 7))
    return out


@lru_cache(None)
def segments(b: int) -> int:
    """Number of segments of band ``b`` with the least expected cost over the sizes that are indexed under it.

    Of a set of n tokens, m * (1 - e^(-n/m)) segments are filled, give or take
    their deviation. Indexed are H + 1, and with the chance of too few also all
    segments and n neighbours; short segments cost extra, as they are met more.
    """
    low, high = 1 << b, (1 << (b + 1)) - 1
    best, best_cost = 1, float("inf")
    for m in sorted({max(1, round(high * f / 100)) for f in range(20, 160, 2)}):
        cost = 0.0
        for n in {low, (low + high) // 2, high, high * 4 // 3}:
            limit = next((h for c, h in contexts(n) if c == b), n // 3) + 1
            filled = m * (1 - exp(-n / m))
            deviation = sqrt(max(m * exp(-n / m) * (1 - (1 + n / m) * exp(-n / m)), 0.05))
            z = (filled - 0.5 - limit * 1.06) / deviation
            short = 1 / (1 + exp(min(50, max(-50, 1.7 * z))))
            single = n * exp(-n / m) / max(filled, 1)
            cost += (limit + short * (filled + n) + 0.5 * limit * single) / n
        if cost < best_cost:
            best, best_cost = m, cost
    return best


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Keys under which a set is indexed."""
    n, out = len(tokens), []
    if not n:
        return np.zeros(0, np.uint64)
    common = np.zeros(n, bool)
    if len(frequent):
        common = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
    value = mix(tokens * np.uint64(_M3))
    deepest = False
    for b, limit in contexts(n):
        m = segments(b)
        segment = ((mix(tokens + np.uint64(b * 0x51ED270B + 1)) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        order = np.argsort(segment, kind="stable")
        at = segment[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        size = np.diff(np.append(first, n))
        total = np.add.reduceat(value[order], first)
        tag = at[first] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(b * 0x165667B1 + 7)
        exact = mix(total + tag)
        if len(first) > limit + 1:
            cold = ~np.logical_and.reduceat(common[order], first)
            exact = exact[np.lexsort((exact, -size, ~cold))[: limit + 1]]
        out.append(exact)
        if len(first) <= limit:
            wide = np.repeat(size > 1, size)
            gone = np.repeat(total + tag, size)[wide] - value[order][wide]
            out += [mix((total + tag) ^ np.uint64(_M2)), mix(gone ^ np.uint64(_M2))]
            deepest |= int((1 + (size > 1)).sum()) <= limit
    if deepest:
        keep = n - -(-3 * n // 4) + 1
        out.append(mix(value[np.lexsort((value, common))[:keep]] ^ np.uint64(_M1)))
    return np.unique(np.concatenate(out))


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the number of tokens in each of about two cells a token; a differing token changes one bit."""
    bits = 64
    while bits < 2 * len(tokens):
        bits *= 2
    cell = (mix(tokens ^ np.uint64(_M3)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(a: bytes, size: int) -> bytes:
    """A sketch brought to ``size`` bytes, half onto half."""
    x = np.frombuffer(a, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded: never more than the tokens in which the sets differ."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(np.frombuffer(fold(a, size), np.uint8) ^ np.frombuffer(fold(b, size), np.uint8)).sum())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def fingerprint(tokens: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=5) - (1 << 63)


def _frequent(docs: DataFrame, rows: int) -> np.ndarray:
    share = min(1.0, SAMPLE_ROWS / max(1, rows))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"token": shingler.of(text).view(np.int64)})

    drawn = docs.filter(F.pmod(C.doc_hash("shingles", "doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("text")
    seen = drawn.mapInPandas(task, "token long").groupBy("token").count().filter(F.col("count") >= FREQUENT)
    got = seen.orderBy(F.desc("count"), "token").limit(FREQUENT_KEPT).collect()
    return np.sort(np.array([r["token"] for r in got], np.int64).view(np.uint64))


def _index(docs: DataFrame) -> DataFrame:
    """Rows of four kinds (0: a document, 1: a pair of sets under some key, 2: a member of a large group), written."""
    rows = docs.count()
    frequent = _frequent(docs, rows)
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    sampled = docs.filter(F.pmod(C.doc_hash("shingles", "doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(C.shuffle_partitions(docs.sparkSession), int(sampled / share * 0.08) // BUCKET_ENTRIES, 1)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal seen, keys, owners, found
            key, owner = np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*owners, np.zeros(0, np.int64)])
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            key, owner, part = key[order], owner[order], np.arange(buckets)
            out = [(int(p), 1, key[a:b].tobytes() + owner[a:b].tobytes()) for p, a, b in zip(part, cut[:-1], cut[1:], strict=True) if b > a]
            rng = xxhash.xxh3_64_intdigest(str(found[:1]).encode()) % buckets
            out += [((rng + i) % buckets, 0, pickle.dumps(found[i::16])) for i in range(min(16, len(found)))]
            seen, keys, owners, found = set(), [], [], []
            if out:
                yield pd.DataFrame(out, columns=["bucket", "kind", "blob"])

        seen, keys, owners, found, size = set(), [], [], [], 0
        for batch in batches:
            for doc, text, text_hash in zip(batch["doc_id"], batch["text"], batch["text_hash"], strict=True):
                tokens = shingler.of(text)
                node = fingerprint(tokens)
                found.append((None if pd.isna(doc) else int(doc), node, len(tokens), text_hash, b"" if node in seen or not len(tokens) else sketch(tokens)))
                if len(tokens) and node not in seen:
                    seen.add(node)
                    keys.append(signatures(tokens, frequent))
                    owners.append(np.full(len(keys[-1]), node, np.int64))
                size += len(text or "")
                if size > PIECE:
                    yield from flush()
                    size = 0
        yield from flush()
        C.give_back()

    def group(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in part["blob"][part["kind"] == 0]:
            out.append(_rows(0, *map(list, zip(*pickle.loads(b), strict=True))))
        blobs = list(part["blob"][part["kind"] == 1])
        if blobs:
            key = np.concatenate([np.frombuffer(b, np.uint64, len(b) // 16) for b in blobs])
            owner = np.concatenate([np.frombuffer(b, np.int64, len(b) // 16, len(b) // 2) for b in blobs])
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            same = key[1:] == key[:-1]
            keep = np.append(False, same) | np.append(same, False)
            key, owner = key[keep], owner[keep]
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])) if len(key) else np.zeros(0, bool)
            key, owner = key[new], owner[new]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(key)))
            pairs = []
            for step in range(1, ALL_PAIRS):
                at = np.repeat(first[(size > step) & (size <= ALL_PAIRS)], size[(size > step) & (size <= ALL_PAIRS)] - step)
                begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
                left = at + np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
                pairs.append(np.column_stack([owner[left], owner[left + step]]))
            large = size > ALL_PAIRS
            member = np.repeat(first[large], size[large]) + np.arange(size[large].sum()) - np.repeat(np.cumsum(size[large]) - size[large], size[large])
            lead = owner[np.repeat(first[large], size[large])]
            pairs.append(np.column_stack([lead, owner[member]])[lead != owner[member]])
            every = np.concatenate(pairs)
            if len(every):
                every, count = np.unique(every, axis=0, return_counts=True)
                out.append(_rows(1, every[:, 0], every[:, 1], count))
            if len(member):
                out.append(_rows(2, key[member].view(np.int64), owner[member], np.repeat(size[large], size[large])))
        return pd.concat(out or [_rows(1, [], [], [])], ignore_index=True)

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    dealt = keyed.mapInPandas(emit, "bucket int, kind int, blob binary").groupBy("bucket")
    return C.materialize(dealt.applyInPandas(group, "kind int, a long, b long, c long, d long, sketch binary"), "jaccard-index", tidy=True)


def _rows(kind: int, a: list, b: list, c: list, d: list | None = None, made: list | None = None) -> pd.DataFrame:
    whole = {k: pd.array(v if v is not None else [0] * len(a), "Int64") for k, v in (("a", a), ("b", b), ("c", c), ("d", d))}
    return pd.DataFrame({"kind": kind, **whole, "sketch": pd.Series(made if made is not None else [b""] * len(a), dtype=object)})


def _by_sketch(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``a, b, shared`` that sketches don't rule out."""
    n = nodes.select("node", "n", "sketch")
    both = pairs.join(n.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    both = both.join(n.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    both = both.filter("4 * least(na, nb) >= 3 * greatest(na, nb)")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            near = [7 * sketch_distance(s, t) <= m + n for s, t, m, n in zip(x["sa"], x["sb"], x["na"], x["nb"], strict=True)]
            yield x.loc[near, ["a", "b", "shared"]]

    return both.mapInPandas(task, "a long, b long, shared long")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose texts are similar indeed."""
    both = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for x in batches:
            linked = [similar(shingler.of(s), shingler.of(t)) for s, t in zip(x["ta"], x["tb"], strict=True)]
            yield x.loc[linked, ["a", "b"]]
        C.give_back()

    return both.mapInPandas(task, "a long, b long")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose sets are not in one component yet."""
    la, lb = (labels.select(F.col("node").alias(x), F.col("component").alias(f"_{x}")) for x in "ab")
    joined = pairs.join(la, "a", "left").join(lb, "b", "left")
    return joined.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).drop("_a", "_b")


def _size_band(n: Column) -> Column:
    """Sets that link lie in one band or in two that follow each other: a band ends at 4/3 of its begin."""
    return F.floor(F.log(n.cast("double")) / log(4 / 3) + 1e-9)


def _folds(sketches: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length in bytes: places of the sketches of that length and of those twice as long, all brought to that length."""
    size = np.array([len(s) for s in sketches])
    out = {}
    for length in np.unique(np.concatenate([size, size[size > 8] // 2])).tolist():
        at = np.flatnonzero((size == length) | (size == 2 * length))
        out[length] = at, np.array([np.frombuffer(fold(sketches[i], length), np.uint64) for i in at])
    return out


def _large_groups(members: DataFrame, labels: DataFrame, nodes: DataFrame, nearest: bool) -> DataFrame:
    """Pairs ``a, b, shared`` of one large group but different components that sketches don't rule out.

    With ``nearest``, each set is looked at in its two largest groups alone, and
    gives the one pair of least distance: enough to join most components before
    all that is left is compared. A group is parted by bands of sizes, each
    with the band below as guests, and compared block by block, each pair of
    blocks in a task of its own; a block may have no members left to look at.
    Sketches are brought to the shorter one's length pair by pair. Where all is
    compared, each member carries its keys, and a pair that meets under
    several is given out under the first of them alone.
    """
    m = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_keys = m.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).filter("x <> y")
    m = m.join(open_keys.select("key", "size"), "key")
    if nearest:
        m = m.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("size"), "key"))).filter("_r <= 2").drop("_r")
    m = m.drop("size").join(nodes.select("node", "n", "sketch"), "node").withColumn("_own", _size_band(F.col("n")))
    m = m.withColumn("band", F.explode(F.array(F.col("_own"), F.col("_own") + 1))).withColumn("guest", F.col("band") > F.col("_own"))
    sizes = m.groupBy("key", "band").agg(F.count("*").alias("size"), F.min("component").alias("x"), F.max("component").alias("y"), F.bool_and("guest").alias("idle"))
    m = m.join(sizes.filter("x <> y AND NOT idle").select("key", "band", "size"), ["key", "band"])
    if nearest:
        m = m.withColumn("keys", F.lit(None).cast("array<long>"))
    else:
        m = m.join(m.groupBy("node").agg(F.collect_set("key").alias("keys")), "node")
    m = m.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    m = m.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def task(x: pd.DataFrame) -> pd.DataFrame:
        node, component, n, guest = (x[c].to_numpy() for c in ("node", "component", "n", "guest"))
        rows, far = (np.flatnonzero(x["block"] == x[c].iat[0]) for c in ("i", "j"))
        if not len(rows) or not len(far):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        sketches, key, held = list(x["sketch"]), int(x["key"].iat[0]), {}

        def keys_of(i: int) -> frozenset[int]:
            if i not in held:
                held[i] = frozenset(x["keys"].iat[i].tolist())
            return held[i]

        folded, bytes_of = _folds([sketches[i] for i in far]), np.array([len(sketches[i]) for i in far])
        out, best = [np.zeros((0, 2), np.int64)], (np.full(len(far), np.inf), np.zeros(len(far), np.int64))
        for a in rows.tolist():
            own, found = sketches[a], []
            for length in (len(own) // 2, len(own)):
                if length not in folded:
                    continue
                at, grid = folded[length]
                if length < len(own):  # of the shorter ones alone; the others are compared in full
                    at, grid = at[bytes_of[at] == length], grid[bytes_of[at] == length]
                there = far[at]
                ok = (component[there] != component[a]) & ~(guest[there] & guest[a]) & (4 * np.minimum(n[there], n[a]) >= 3 * np.maximum(n[there], n[a]))
                at, grid = at[ok], grid[ok]
                if not len(at):
                    continue
                share = np.bitwise_count(grid ^ np.frombuffer(fold(own, length), np.uint64)).sum(axis=1, dtype=np.int64) / (n[far[at]] + n[a])
                near = 7 * share <= 1 + 1e-9
                found.append((at[near], share[near]))
            if not found:
                continue
            at, share = (np.concatenate(v) for v in zip(*found, strict=True))
            if nearest and len(at):
                better = share < best[0][at]
                best[0][at[better]], best[1][at[better]] = share[better], node[a]
                at = at[share.argmin()][None]
            elif len(at):
                mine = keys_of(a)
                at = at[np.array([min(mine & keys_of(far[i])) == key for i in at], bool)]
            out.append(np.column_stack([node[far[at]], np.full(len(at), node[a])]))
        if nearest:
            found = np.isfinite(best[0])
            out.append(np.column_stack([node[far[found]], best[1][found]]))
        every = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
        return pd.DataFrame({"a": every[:, 0], "b": every[:, 1]})

    found = m.groupBy("key", "band", "i", "j").applyInPandas(task, "a long, b long").distinct()
    return _by_sketch(found.withColumn("shared", F.lit(1).cast("long")), nodes)


def _labelled(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """What ``near_duplicates`` gives, and ``component``: the component's number, which ids play no part in; null without words.

    Beside it the written tables that it is read from.
    """
    C.lean_workers(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    index = _index(docs)
    rows = index.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("node"), F.col("c").alias("n"), F.col("d").alias("text_hash"), "sketch")
    nodes = rows.filter("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.min(F.struct("doc_id", "text_hash")).alias("sample"), F.min("doc_id").alias("least"))
    nodes = C.materialize(nodes, "jaccard-nodes", tidy=True)
    pairs = index.filter("kind = 1").groupBy("a", "b").agg(F.sum("c").alias("shared"))
    pairs = C.materialize(_by_sketch(pairs, nodes), "jaccard-pairs", tidy=True)
    members = index.filter("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("node"))

    def texts_of(found: DataFrame) -> DataFrame:
        ends = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct()
        wanted = C.materialize(nodes.join(ends, "node").select("node", F.col("sample.doc_id").alias("_doc"), F.col("sample.text_hash").alias("_hash")), "jaccard-wanted", tidy=True)
        listed = wanted
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
        texts = C.materialize(docs.join(wanted, same).select("node", "text").dropDuplicates(["node"]), "jaccard-texts", tidy=True)
        C.discard(listed)
        return texts

    # First each set's likeliest partner, then what these links leave apart.
    texts = texts_of(pairs)
    each = pairs.select("a", "b", "shared").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    likeliest = each.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("m")).select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct()
    links = C.materialize(_verify(likeliest, texts), "jaccard-links", tidy=True)
    labels = C.materialize(connected_components(links), "jaccard-labels", tidy=True)
    more = _verify(_across(pairs, labels).join(likeliest, ["a", "b"], "left_anti"), texts)
    first, links = links, C.materialize(links.union(more), "jaccard-links", tidy=True)
    C.discard(first, texts, labels, pairs)
    labels = C.materialize(connected_components(links), "jaccard-labels", tidy=True)
    if not members.isEmpty():
        for nearest in (True, True, False):
            far = C.materialize(_large_groups(members, labels, nodes, nearest), "jaccard-far", tidy=True)
            if not far.isEmpty():
                texts = texts_of(far)
                new = C.materialize(_verify(far, texts), "jaccard-links", tidy=True)
                C.discard(texts)
                if not new.isEmpty():
                    links, last = links.union(new), labels
                    labels = C.materialize(connected_components(links), "jaccard-labels", tidy=True)
                    C.discard(last)
            C.discard(far)

    named = nodes.select("node", "least").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("node", "component", "component_id")
    out = rows.join(named, "node", "left")
    out = out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "component")
    return out, [index, nodes, labels, links]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id`` for every row of ``doc_id, text``.

    ``component_id`` is the least ``doc_id`` that links lead to, the row's own
    included; rows with equal sets are linked. A text without words (or null)
    has an empty set and links with nothing; a null ``doc_id`` takes part but is
    never the least; repeated rows stay; other columns are ignored; an empty
    table gives an empty result.
    """
    return _labelled(docs)[0].drop("component")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component; all rows without words stay.

    It is the row with the least ``doc_id``, a null one if there is no other,
    then the least text hash; of rows alike in both, the least as JSON. Other
    columns may have any name.
    """
    doc, of, copies, whole = C.unused(docs, "_doc", "_hash", "_copies", "_row")
    found, made = _labelled(docs)
    found = C.materialize(found, "jaccard-found", tidy=True)
    C.discard(*made)
    rows = found.filter("n_shingles > 0").groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    lead = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "copies")).alias("m"))
    lead = lead.select(F.col("m.doc_id").alias(doc), F.col("m.text_hash").alias(of), F.col("m.copies").alias(copies))
    bare = found.filter("n_shingles = 0").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(of), F.lit(1).cast("long").alias(copies)).distinct()
    lead, last = C.materialize(lead.union(bare), "jaccard-lead", tidy=True), found
    C.discard(last)
    C.sweep(docs.sparkSession)
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.xxhash64("text").eqNullSafe(F.col(of))
    once = docs.join(lead.filter(F.col(copies) == 1), same, "left_semi")
    repeated = lead.filter(F.col(copies) > 1)
    if repeated.isEmpty():
        return once
    row = F.struct(*[C.column(c) for c in docs.columns])
    least = docs.join(repeated, same).groupBy(doc, of).agg(F.min_by(row, F.to_json(row)).alias(whole))
    return once.unionByName(least.select(f"{whole}.*"))


def brute_force(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """The same by comparing all pairs, for small inputs with distinct ids."""
    sets = {}
    for i, text in docs:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        sets[i] = {tuple(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))} if words else set()
    lead = {i: i for i, _ in docs}

    def find(x: int) -> int:
        while lead[x] != x:
            x = lead[x]
        return x

    order = sorted(sets)
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                lead[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in order}
