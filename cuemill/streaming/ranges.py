"""Disjoint ranges as a state: what a stream of ranges has covered, and what each one adds."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.scans import repeated


class Ranges:
    """Disjoint half-open ranges in order; ranges that touch are one."""

    def __init__(self, pairs: Iterable[tuple[float, float]] = ()):
        self.starts: list[float] = []
        self.ends: list[float] = []
        for s, e in pairs:
            self.add(s, e)

    def pairs(self) -> list[tuple[float, float]]:
        return list(zip(self.starts, self.ends, strict=True))

    def missing(self, low: float, high: float) -> list[tuple[float, float]]:
        """What of [low, high) is not covered."""
        i, out, at = bisect_right(self.ends, low), [], low
        while at < high and i < len(self.starts) and self.starts[i] < high:
            if self.starts[i] > at:
                out.append((at, self.starts[i]))
            at, i = max(at, self.ends[i]), i + 1
        return out + [(at, high)] * (at < high)

    def add(self, start: float, end: float) -> list[tuple[float, float]]:
        """Cover a range, found by binary search; returns what of it was open. One without a length changes nothing."""
        if not end > start:
            return []
        new = self.missing(start, end)
        i, j = bisect_left(self.ends, start), bisect_right(self.starts, end)  # those that overlap or touch
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]
        return new

    def merge(self, other: Ranges) -> Ranges:
        """Cover all that ``other`` covers; sets may be merged in any order and tree."""
        for s, e in other.pairs():
            self.add(s, e)
        return self

    def prefix(self, at: float = 0.0) -> float:
        """How far the cover goes on from a place without a gap."""
        i = bisect_right(self.starts, at) - 1
        return max(0.0, self.ends[i] - at) if i >= 0 else 0.0


class RangeGatherer(StatefulProcessor):
    """Keeps the ranges of a key and cell as a map from starts to ends, and gives out what each range newly covers.

    Only the ranges that rows touched are written back, so a step costs as much as it changes.
    """

    def __init__(self, key: list[str]):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("ranges", "start_s double", "end_s double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        before = {float(k[0]): float(v[0]) for k, v in self.held.iterator()}
        ranges = Ranges()
        ranges.starts, ranges.ends = map(list, zip(*sorted(before.items()), strict=True)) if before else ([], [])
        new: list[tuple[float, float]] = []
        for batch in rows:
            for s, e in batch[["start_s", "end_s"]].itertuples(index=False):
                new += ranges.add(float(s), float(e))
        after = dict(ranges.pairs())
        for s in before.keys() - after.keys():
            self.held.removeKey((s,))
        for s, e in after.items():
            if before.get(s) != e:
                self.held.updateValue((s,), (e,))
        out = {k: repeated(x, len(new)) for k, x in zip(self.key, key, strict=False)}
        yield pd.DataFrame({**out, "start_s": pd.Series([s for s, _ in new], dtype=float), "end_s": pd.Series([e for _, e in new], dtype=float)})

    def close(self) -> None:
        pass


def cells_of(df: DataFrame, width: float) -> DataFrame:
    """Ranges cut at multiples of ``width``, with the ``cell`` that each piece lies in: a key with very many ranges is kept in as many states as it has cells."""
    first = F.floor(F.col("start_s") / width)
    last = F.greatest(first, F.ceil(F.col("end_s") / width) - 1)
    cut = df.filter("end_s > start_s").withColumn("cell", F.explode(F.sequence(first, last)))
    return cut.withColumns({"start_s": F.greatest("start_s", F.col("cell") * F.lit(width)), "end_s": F.least("end_s", (F.col("cell") + 1) * F.lit(width))})


def covered_stream(stream: DataFrame, key: list[str], width: float) -> DataFrame:
    """``key, start_s, end_s``: what each range of a stream covers that none before did.

    The pieces are disjoint, so their lengths add up to what is covered, and
    ``islands`` of them are those of the ranges. States are by key and cell of ``width``.
    """
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in key)
    rows = cells_of(stream.select(*key, F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s")), width)
    return rows.groupBy(*key, "cell").transformWithStateInPandas(RangeGatherer(key), outputStructType=f"{kinds}, start_s double, end_s double", outputMode="append", timeMode="None")
