"""Scans along the rows of a key in order, cut into buckets where a key has very many rows.

A window goes through a key in one task. Here the order of a large key is cut
at quantiles; each bucket is scanned on its own, what buckets hand on is
scanned over one row a bucket, and comes back to the rows by a broadcast.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import written

#: Rows from which a key may be cut, and buckets of a key, at most.
LARGE, PIECES = 200_000, 256


def repeated(value: object, n: int) -> pd.Series:
    """A key's column for the rows of its group, none included."""
    return pd.Series([value] * n, dtype=object)


def stretches_of(rows: DataFrame, by: list[str], order: list[str], *rest: str) -> DataFrame:
    """``by`` and an array of each other column: a row for each stretch of rows, in their order.

    Python goes through such rows a batch at a time. A group of its own for
    each stretch costs about a millisecond, which is far more than what a short one holds.
    """
    fields = list(dict.fromkeys([*order, *rest]))
    lists = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_rows"))
    return lists.select(*by, *[F.col("_rows")[c].alias(c) for c in fields])


def large_keys(rows: DataFrame, key: list[str], large: int | None = None) -> tuple[DataFrame | None, int, int]:
    """(keys with more rows than ``large``, or None without any; that bound; rows of the largest).

    Without a bound of the caller it is LARGE, and a fourth of a shuffle
    partition's share: so there are no more large keys than four times the
    partitions, and they may be broadcast. Their columns are named _key0 and so on.
    """
    counts = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"), F.coalesce(F.max("_n"), F.lit(0)).alias("most")).first()
    least = large or max(LARGE, total["total"] // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if total["most"] <= least:
        return None, least, total["most"]
    return counts.filter(F.col("_n") > least).select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)]), least, total["most"]


def _is_key(key: list[str]) -> Column:
    match = F.lit(True)
    for i, k in enumerate(key):
        match = match & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return match


def split_keys(rows: DataFrame, key: list[str], at: str, large: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of the other keys, rows of large keys with ``_bucket`` in the order of ``at``, or None without any).

    The borders of large keys, PIECES a key at most, are broadcast. Rows of one ``at`` share a bucket.
    """
    hot, least, most = large_keys(rows, key, large)
    if hot is None:
        return rows, None
    pieces, named = min(PIECES, -(-most // least) * 2), [f"_key{i}" for i in range(len(key))]
    of_hot = rows.join(F.broadcast(hot), _is_key(key))
    borders = of_hot.groupBy(*named).agg(F.percentile_approx(at, [i / pieces for i in range(1, pieces)], 20 * pieces).alias("_borders"))
    cut = rows.join(F.broadcast(borders), _is_key(key)).withColumn("_bucket", F.size(F.filter("_borders", lambda b: b <= F.col(at))))
    return rows.join(F.broadcast(hot), _is_key(key), "left_anti"), cut.drop("_borders", *named)


def ranked(rows: DataFrame, key: list[str], order: list[Column | str], name: str, large: int | None = None) -> DataFrame:
    """Adds ``name``: the place of each row within its key, from 1 on.

    A window does it in one task a key. Rows of large keys are instead sorted
    over all tasks by ranges of key and order, numbered in each, and the
    numbers of rows before a range (one a range) and before a key are taken off. That table is written, as ranges
    are drawn from a sample; equal rows may be in any order, as in a window.
    """
    hot, least, most = large_keys(rows, key, large)
    plain = F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")
    if most <= least:
        return rows.withColumn(name, plain)
    named = [f"_key{i}" for i in range(len(key))]
    few = rows.join(F.broadcast(hot), _is_key(key), "left_anti").withColumn(name, plain) if key else None
    many = rows.join(F.broadcast(hot), _is_key(key)).drop(*named) if key else rows
    by = [*[F.asc_nulls_first(k) for k in key], *order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = many.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    held = written(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_part"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = held.join(F.broadcast(before), part == F.col("_part")).withColumn("_at", place + F.col("_before")).drop("_id", "_part", "_before")
    if not key:
        return at.withColumn(name, F.col("_at") + 1).drop("_at")
    first = at.groupBy(*[F.col(k).alias(n) for k, n in zip(key, named, strict=True)]).agg(F.min("_at").alias("_first"))
    done = at.join(F.broadcast(first), _is_key(key)).withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_at", "_first", *named)
    return few.unionByName(done)


def handed_on(cut: DataFrame, key: list[str], what: dict[str, Column], before: dict[str, Column]) -> DataFrame:
    """Adds to rows with ``_bucket`` what the earlier buckets of their key hand on.

    ``what`` sums a bucket up, ``before`` is an aggregate over the sums of all
    earlier buckets; both by the new column's name.
    """
    sums = cut.groupBy(*key, "_bucket").agg(*[c.alias(n) for n, c in what.items()])
    w = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    by = [*key, "_bucket"]
    named = [f"_key{i}" for i in range(len(by))]
    found = sums.select(*[F.col(k).alias(n) for k, n in zip(by, named, strict=True)], *[c.over(w).alias(f"_before_{n}") for n, c in before.items()])
    return cut.join(F.broadcast(found), _is_key(by)).drop(*named)


def asof_join(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, large: int | None = None) -> DataFrame:
    """``points`` with the other columns of the span of their key that began last at or before ``at``; nulls without any.

    Points and spans are put in one order, in which each point takes over the
    last span before it: as many rows as there are of both, and no pairs. Of
    spans that begin together the largest by its columns counts. Points with a
    null ``at`` have no span; spans with a null ``start`` none begins. Names
    that both sides have, but for the key, must differ.
    """
    held = [c for c in spans.columns if c not in key]
    own = [c for c in points.columns if c not in key]
    clash = set(held) & set(own)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    span = F.struct(*[F.col(c) for c in [start, *[c for c in held if c != start]]])
    left = points.filter(F.col(at).isNotNull()).select(*key, F.col(at).cast("double").alias("_t"), F.struct(*own).alias("_point"), F.lit(None).cast(spans.select(span.alias("s")).schema["s"].dataType).alias("_span"))
    right = spans.filter(F.col(start).isNotNull()).select(*key, F.col(start).cast("double").alias("_t"), F.lit(None).cast(left.schema["_point"].dataType).alias("_point"), span.alias("_span"))
    both = left.unionByName(right)
    order = [F.col("_t"), F.col("_point").isNotNull(), F.col("_span")]
    last = lambda by: F.last("_span", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    few, cut = split_keys(both, key, "_t", large)
    done = few.withColumn("_found", last(key))
    if cut is not None:
        cut = handed_on(cut, key, {"span": F.max("_span")}, {"span": F.last("span", ignorenulls=True)})
        cut = cut.withColumn("_found", F.coalesce(last([*key, "_bucket"]), F.col("_before_span")))
        done = done.unionByName(cut.drop("_bucket", "_before_span"))
    done = done.filter("_point IS NOT NULL").select(*key, "_point.*", *[F.col("_found")[c].alias(c) for c in held])
    lost = points.filter(F.col(at).isNull()).select(*key, *own, *[F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in held])
    return done.unionByName(lost)


def islands(df: DataFrame, key: list[str], start: str, end: str, large: int | None = None) -> DataFrame:
    """Ranges that overlapping or touching ranges of a key make together, with how many went in; ranges without a length, or with a null end, are left out.

    Ranges of one start are first put together on the map side. In a bucket of
    a large key, ranges that begin within the reach of earlier buckets make
    one piece that goes on; the pieces that are open at a bucket's border, two
    a bucket at most, are then put together.
    """
    spans = df.filter(F.col(end) > F.col(start)).groupBy(*key, start).agg(F.max(end).alias(end), F.count("*").alias("n"))
    few, cut = split_keys(spans, key, start, large)

    def pieces(rows: DataFrame, by: list[str], reach_before: Column) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(start)
        reach = F.greatest(reach_before, F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        marked = rows.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
        marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("n"))

    done = pieces(few, key, F.lit(None).cast("double")).drop("_island")
    if cut is None:
        return done
    cut = handed_on(cut, key, {"reach": F.max(end)}, {"reach": F.max("reach")})
    found = pieces(cut, [*key, "_bucket"], F.col("_before_reach"))
    last = F.max("_island").over(Window.partitionBy(*key, "_bucket"))
    found = found.withColumn("_open", (F.col("_island") == 0) | (F.col("_island") == last))
    w = Window.partitionBy(*key).orderBy("_bucket", "_island").rowsBetween(Window.unboundedPreceding, 0)
    chained = found.filter("_open").withColumn("_chain", F.sum(F.when(F.col("_island") > 0, 1).otherwise(0)).over(w))
    chained = chained.groupBy(*key, "_chain").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("n")).drop("_chain")
    return done.unionByName(chained).unionByName(found.filter("NOT _open").select(done.columns))
