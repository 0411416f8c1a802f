"""Product codes of vectors: a codebook for each part, learned by Yinyang Lloyd in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as C

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Groups that the entries of a codebook are clustered into; each keeps one lower bound.
GROUPS = 6
#: Largest whole number of a component: squares of differences, and their sums, then fit 64 bits.
LARGEST = 1 << 26


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of whole numbers, each with each."""
    out = np.zeros((len(x), len(c)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] - c[None, :, k]
        out += d * d
    return out


def cluster(entries: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """The group of each entry of a codebook, from a few rounds of Lloyd among the entries themselves."""
    centres = entries[np.linspace(0, len(entries) - 1, min(groups, len(entries))).astype(int)].astype(np.float64)
    of = np.zeros(len(entries), np.int64)
    for _ in range(rounds):
        of = ((entries[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(len(centres)):
            if (of == g).any():
                centres[g] = entries[of == g].mean(axis=0)
    return of


@dataclass
class Codebooks:
    """Entries (part, entry, position), the group of each entry, and the entries before the last round."""

    entries: np.ndarray
    group: np.ndarray
    before: np.ndarray | None = None

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _two_least(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least of each row, its first place, and the least of the others."""
    at = d.argmin(axis=1)
    least = d[np.arange(len(d)), at]
    rest = d.copy()
    rest[np.arange(len(d)), at] = np.iinfo(np.int64).max
    return least, at, rest.min(axis=1)


def _floor_root(d: np.ndarray) -> np.ndarray:
    """A whole number not above the root of each, of sixteen bits: a lower bound however it is rounded."""
    return np.clip(np.floor(np.sqrt(np.minimum(d, 1 << 40).astype(np.float64)) - 1e-6), 0, 0xFFFF)


def assign(x: np.ndarray, books: Codebooks, part: int, code: np.ndarray | None = None, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest entry, its squared distance, lower bounds of the groups, distances computed) of rows of one part.

    ``code`` and ``bound`` are those of the round before: a bound less its
    group's drift still holds, and only groups whose bound doesn't exceed the
    distance to the row's own entry are scanned. Bounds leave out the row's own
    entry. All distances that decide are whole numbers; the lower index wins a tie.
    """
    c, group = books.entries[part], books.group[part]
    groups = int(group.max()) + 1 if len(group) else 0
    rows, members = np.arange(len(x)), [np.flatnonzero(group == g) for g in range(groups)]
    if code is None:
        code, best, old = np.full(len(x), len(c)), np.full(len(x), np.iinfo(np.int64).max), None
        low = np.zeros((len(x), groups))
        need = np.ones((len(x), groups), bool)
        done = 0
    else:
        drift = np.sqrt(((c - books.before[part]).astype(np.float64) ** 2).sum(axis=1))
        low = bound.astype(np.float64) - np.array([drift[m].max() + 1e-6 if len(m) else 0.0 for m in members])
        own = x - c[code]
        best = (own * own).sum(axis=1)
        code, old = code.copy(), (code, np.sqrt(best.astype(np.float64)))
        need = low <= old[1][:, None] + 1e-6
        done = len(x)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for g, m in enumerate(members):
        r = np.flatnonzero(need[:, g])
        if not len(m) or not len(r):
            found.append((r[:0],) * 4)
            continue
        least, at, rest = _two_least(squared(x[r], c[m]))
        done += len(r) * len(m)
        entry = m[at]
        nearer = (least < best[r]) | ((least == best[r]) & (entry < code[r]))
        best[r[nearer]], code[r[nearer]] = least[nearer], entry[nearer]
        found.append((r, least, entry, rest))
    if old is not None:  # the entry that was left counts among the others of its group
        g = group[old[0]]
        moved = code != old[0]
        low[rows[moved], g[moved]] = np.minimum(low[rows[moved], g[moved]], old[1][moved])
    for g, (r, least, entry, rest) in enumerate(found):
        low[r, g] = _floor_root(np.where(entry == code[r], rest, least))
    return code, best, np.clip(np.floor(low), 0, 0xFFFF), done


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, x``: rows whose vector and components are all there and finite, components as floor(scale * x)."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    x = F.transform("embedding", lambda v: F.when(F.abs(v.cast("double")) * scale < LARGEST, F.floor(v.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component is too large to be squared"))))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select("vec_id", "label", x.alias("x"))


def _first_books(rows: DataFrame, parts: int, entries: int, groups: int) -> Codebooks | None:
    least = [r["x"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()]
    if not least:
        return None
    if len({len(x) for x in least}) > 1 or len(least[0]) % parts:
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    books = np.array(least, np.int64).reshape(len(least), parts, -1).transpose(1, 0, 2)
    return Codebooks(books, np.stack([cluster(b, groups) for b in books]))


def _encode(state: DataFrame, books: Codebooks, final: bool) -> DataFrame:
    """One assignment of every row: the state of the next round, or codes and errors. Codebooks are of a fixed size."""
    parts, _, width = books.entries.shape
    groups = int(books.group.max()) + 1
    seen = "code" in state.columns
    sent = state.sparkSession.sparkContext.broadcast(books)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            if {len(v) for v in batch["x"]} != {parts * width}:
                raise ValueError("vectors must have one length")
            x = np.stack(batch["x"].to_numpy()).astype(np.int64).reshape(len(batch), parts, width)
            code, bound = np.zeros((len(batch), parts), np.uint8), np.zeros((len(batch), parts, groups), "<u2")
            error = np.zeros(len(batch), np.int64)
            if seen:
                old_code = np.frombuffer(b"".join(batch["code"]), np.uint8).reshape(len(batch), parts).astype(np.int64)
                old_bound = np.frombuffer(b"".join(batch["bound"]), "<u2").reshape(len(batch), parts, groups)
            for p in range(parts):
                code[:, p], best, bound[:, p], _ = assign(x[:, p], sent.value, p, *((old_code[:, p], old_bound[:, p]) if seen else ()))
                error += best
            if final:
                yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "code": [c.tobytes().hex() for c in code], "error": error})
            else:
                yield batch[["vec_id", "label", "x"]].assign(code=[c.tobytes() for c in code], bound=[b.tobytes() for b in bound])

    kinds = [state.schema["vec_id"], state.schema["label"]]
    if final:
        kinds += [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    else:
        kinds += [state.schema["x"], T.StructField("code", T.BinaryType()), T.StructField("bound", T.BinaryType())]
    kept = ["vec_id", "label", "x", *(["code", "bound"] if seen else [])]
    return state.select(*kept).mapInPandas(task, T.StructType(kinds))


def _means(state: DataFrame, books: Codebooks) -> np.ndarray:
    """New entries: sums of each task are added up in Spark, and as many rows as the codebooks have numbers come back."""
    parts, entries, width = books.entries.shape

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_numpy()).astype(np.int64).reshape(len(batch), parts, width)
            code = np.frombuffer(b"".join(batch["code"]), np.uint8).reshape(len(batch), parts).astype(np.int64)
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(total[p], code[:, p], x[:, p])
        used = np.argwhere(n > 0)
        yield pd.DataFrame({"part": used[:, 0], "entry": used[:, 1], "n": n[used[:, 0], used[:, 1]], "x": list(total[used[:, 0], used[:, 1]])})

    rows = state.select("x", "code").mapInPandas(task, "part int, entry int, n long, x array<long>")
    sums = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("x")[k]) for k in range(width)]).alias("x"))
    new = books.entries.copy()
    for r in sums.collect():
        new[r["part"], r["entry"]] = np.array(r["x"], np.int64) // r["n"]
    return new


def with_totals(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over equal ``by`` (nulls are equal).

    Values of ``by`` that hold more than a partition's share of the rows are
    broadcast (there are no more such than partitions); the others are joined
    by a shuffle, where none of them is large.
    """
    spark = rows.sparkSession
    totals = rows.groupBy(F.col(by).alias("_by")).agg(F.sum(value).alias(name), F.count("*").alias("_n"))
    share = max(1000, rows.count() // max(C.shuffle_partitions(spark), 1))
    same = F.col(by).eqNullSafe(F.col("_by"))
    large = rows.join(F.broadcast(totals.filter(F.col("_n") > share)), same)
    small = rows.join(F.broadcast(totals.filter(F.col("_n") > share).select("_by")), same, "left_anti")
    return large.unionByName(small.join(totals.filter(F.col("_n") <= share), same)).drop("_by", "_n")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """(``vec_id, label, code, error``, codebooks) of the rows of ``vec_id, embedding, label`` with a whole finite vector.

    Codebooks start as the parts of the ``entries`` rows with the smallest
    ids (null last, then by vector) and take ``rounds`` rounds of Lloyd. Codes
    and bounds are written after every round, so that the next one scans only
    what they leave open. Repeated rows count each; other columns are ignored;
    vectors of several lengths are an error; a table without a kept row gives
    no rows and no codebooks. At most 256 entries, as a code is two hex digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    state = whole_vectors(vectors, scale)
    books = _first_books(state, parts, entries, groups)
    if books is None:
        kinds = T.StructType([state.schema["vec_id"], state.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        return vectors.sparkSession.createDataFrame([], kinds), None
    for _ in range(rounds):
        state = C.materialize(_encode(state, books, final=False), "codes")
        books = Codebooks(_means(state, books), books.group, books.entries)
    return C.materialize(_encode(state, books, final=True), "codes"), books


def decode(coded: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``vec_id, vector``: the vectors that the codes stand for, the middle of each whole number's range."""
    width = books.entries.shape[2]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            code = np.frombuffer(bytes.fromhex("".join(batch["code"])), np.uint8).reshape(len(batch), -1)
            x = books.entries[np.arange(code.shape[1])[None, :], code].reshape(len(batch), code.shape[1] * width)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "vector": list((x + 0.5) / scale)})

    return coded.select("vec_id", "code").mapInPandas(task, "vec_id long, vector array<double>")


#: The same by all distances, for small tables.
SQL = r"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, q) AS r, vec_id, label, q, len(q) // 16 AS w FROM k),
p AS MATERIALIZED (SELECT r, i AS part, q[i * w + 1:i * w + w] AS x FROM r, range(16) t(i)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= 64),
a1 AS MATERIALIZED (SELECT r, p.part, any_value(x) AS x, min({d: list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry: entry}) AS m FROM p JOIN c0 ON p.part = c0.part GROUP BY r, p.part),
s1 AS (SELECT part, entry, list(v ORDER BY pos) AS c FROM (SELECT part, m.entry AS entry, pos, ((sum(x[pos]) - ((sum(x[pos]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v FROM a1, unnest(range(1, len(x) + 1)) t(pos) GROUP BY ALL) GROUP BY part, entry),
c1 AS MATERIALIZED (SELECT part, entry, coalesce(s1.c, c0.c) AS c FROM c0 LEFT JOIN s1 USING (part, entry)),
a2 AS MATERIALIZED (SELECT r, p.part, any_value(x) AS x, min({d: list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry: entry}) AS m FROM p JOIN c1 ON p.part = c1.part GROUP BY r, p.part),
s2 AS (SELECT part, entry, list(v ORDER BY pos) AS c FROM (SELECT part, m.entry AS entry, pos, ((sum(x[pos]) - ((sum(x[pos]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v FROM a2, unnest(range(1, len(x) + 1)) t(pos) GROUP BY ALL) GROUP BY part, entry),
c2 AS MATERIALIZED (SELECT part, entry, coalesce(s2.c, c1.c) AS c FROM c1 LEFT JOIN s2 USING (part, entry)),
a3 AS (SELECT r, p.part, min({d: list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry: entry}) AS m FROM p JOIN c2 ON p.part = c2.part GROUP BY r, p.part),
e AS (SELECT r, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a3 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN r USING (r), h"""
