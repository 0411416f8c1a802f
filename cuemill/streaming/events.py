"""Event streams. The batch forms use windows; the streaming ones keep a state for each key."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.scans import repeated, split_keys, stretches_of


def without_repeats(df: DataFrame, key: list[str], ts: str, seconds: float = 0.5) -> DataFrame:
    """Events but those that follow an equal one of their key within ``seconds``; each repeat holds the next one off too."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = t - F.lag(t).over(Window.partitionBy(*key).orderBy(t))
    return df.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") >= int(seconds * 1_000_000))).drop("_gap")


def without_adjacent(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_last", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | ~F.col("_last").eqNullSafe(F.col(value))).drop("_last", "_n")


def since(df: DataFrame, revision: str, cursor: int, keep: int = 300) -> DataFrame:
    """Rows newer than a cursor; the newest ``keep`` if the cursor is ahead of all of them."""
    top = df.agg(F.coalesce(F.max(revision), F.lit(0)).alias("_top"))
    marked = df.join(F.broadcast(top))
    return marked.filter(F.when(F.lit(cursor) > F.col("_top"), F.col(revision) > F.col("_top") - keep).otherwise(F.col(revision) > cursor)).drop("_top")


def throttled(df: DataFrame, key: list[str], ts: str, seconds: float, large: int | None = None) -> DataFrame:
    """``key, us``: times (in microseconds) of the events let through when each holds back those of the next ``seconds``.

    What a gap of that length parts is told apart first (the event after it is
    let through whatever was before), so that only stretches without such a gap
    are gone through one by one. A large key (see ``scans``) is cut into buckets.
    Which event of a bucket is let through first is one of its first
    ``seconds``, or the one after these; for each of them the bucket says where it would leave
    off. One walk over these sums tells each bucket where it begins.
    """
    step = int(seconds * 1_000_000)
    rows = df.select(*key, F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).filter("us IS NOT NULL")
    few, cut = split_keys(rows, key, "us", large)
    order = Window.partitionBy(*key).orderBy("us")
    parts = few.withColumn("_new", F.when(F.col("us") - F.lag("us").over(order) < step, 0).otherwise(1))
    parts = parts.withColumn("_part", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    @F.pandas_udf("array<long>")
    def kept(times: pd.Series) -> pd.Series:
        return times.map(lambda ts: _let_through(np.asarray(ts, np.int64), step, 0))

    lists = parts.groupBy(*key, "_part").agg(F.sort_array(F.collect_list("us")).alias("_us"))
    done = lists.select(*key, F.explode(kept("_us")).alias("us"))
    if cut is None:
        return done
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)

    def ends(part: pd.DataFrame) -> pd.DataFrame:
        times = np.unique(part["us"].to_numpy(np.int64))
        onward, left = np.searchsorted(times, times + step), times.copy()
        for i in range(len(times) - 1, -1, -1):
            if onward[i] < len(times):
                left[i] = left[onward[i]]
        n = int(np.searchsorted(times, times[0] + step)) + 1
        return pd.DataFrame({**{k: repeated(part[k].iat[0], 1) for k in [*key, "_bucket"]}, "first": [times[:n].tolist()], "left": [left[:n].tolist()]})

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part, last, before = part.sort_values("_bucket"), None, []
        for first, left in zip(part["first"], part["left"], strict=True):
            before.append(last)
            i = 0 if last is None else bisect_left(list(first), last + step)
            last = int(left[i]) if i < len(first) else last
        return pd.DataFrame({**{k: repeated(part[k].iat[0], len(part)) for k in key}, "_bucket": part["_bucket"].to_numpy(), "_last": pd.array(before, dtype="Int64")})

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        times, last = np.sort(part["us"].to_numpy(np.int64)), part["_last"].iat[0]
        found = _let_through(times, step, 0 if pd.isna(last) else int(np.searchsorted(times, int(last) + step)))
        return pd.DataFrame({**{k: repeated(part[k].iat[0], len(found)) for k in key}, "us": pd.Series(found, dtype="int64")})

    sums = cut.groupBy(*key, "_bucket").applyInPandas(ends, f"{kinds}, _bucket int, first array<long>, left array<long>")
    begins = sums.groupBy(*key).applyInPandas(walk, f"{kinds}, _bucket int, _last long")
    named = {k: f"_key{i}" for i, k in enumerate([*key, "_bucket"])}
    same = F.lit(True)
    for k, n in named.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    begun = cut.join(F.broadcast(begins.withColumnsRenamed(named)), same).drop(*named.values())
    return done.unionByName(begun.groupBy(*key, "_bucket").applyInPandas(pick, f"{kinds}, us long"))


def _let_through(times: np.ndarray, step: int, i: int) -> list[int]:
    """Sorted times that are let through from place ``i`` on."""
    out: list[int] = []
    while i < len(times):
        out.append(int(times[i]))
        i = int(np.searchsorted(times, times[i] + step)) if step > 0 else i + 1
    return out


def _shown(times: list[int], values: list, step: int, last: int | None = None, held: object = None, until: int | None = None) -> tuple[list[tuple[int, object, bool]], int | None, object]:
    """What is shown of events in order, as (time, value, held), the time last shown and what is held then.

    Nothing is shown within ``step`` of what was shown before: the newest of
    these events is held, and shown when the step is over, unless an event of
    that very moment is newer. What is due up to ``until`` (always without
    one) is shown at the end. ``held`` is a one-item tuple, or None for nothing.
    """
    out: list[tuple[int, object, bool]] = []
    for t, v in zip(times, values, strict=True):
        while held is not None and last + step < t:
            out.append((last + step, held[0], True))
            last, held = last + step, None
        if last is None or t - last >= step:
            out.append((t, v, False))
            last, held = t, None
        else:
            held = (v,)
    if held is not None and (until is None or last + step <= until):
        out.append((last + step, held[0], True))
        last, held = last + step, None
    return out, last, held


def throttled_last(df: DataFrame, key: list[str], ts: str, value: str, seconds: float) -> DataFrame:
    """``key, us, value, held``: events at least ``seconds`` apart; of those between, the newest is held and shown when the time is over.

    After a pause of twice that time nothing of the events before counts any
    more, so only what lies between such pauses is gone through event by event.
    Events of one time are in the order of their values; rows without a time are left out.
    """
    step, order = int(seconds * 1_000_000), Window.partitionBy(*key).orderBy("us", value)
    rows = df.select(*key, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(value)).filter("us IS NOT NULL")
    rows = rows.withColumn("_new", F.when(F.col("us") - F.lag("us").over(order) < 2 * step, 0).otherwise(1))
    rows = rows.withColumn("_part", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    @F.pandas_udf("us array<long>, place array<int>, held array<boolean>")
    def shown(times: pd.Series) -> pd.DataFrame:
        found = [_shown(ts.tolist(), range(len(ts)), step)[0] for ts in times]
        return pd.DataFrame({c: [[x[i] for x in out] for out in found] for i, c in enumerate(("us", "place", "held"))})

    lists = stretches_of(rows, [*key, "_part"], ["us", value]).select(*key, F.col(value).alias("_values"), shown("us").alias("_s"))
    each = lists.select(*key, "_values", F.explode(F.arrays_zip("_s.us", "_s.place", "_s.held")).alias("_e"))
    return each.select(*key, "_e.us", F.get("_values", "_e.place").alias(value), "_e.held")


class HeldThrottle(StatefulProcessor):
    """``throttled_last`` on a stream whose events may come in any order within the watermark's delay.

    Events wait in a list until the watermark has passed them, as an older one
    may still come; they are then gone through in order. A timer stands at the
    oldest that waits, and one at the time at which what is held is due, so
    that it is shown even if its key is never heard of again.
    """

    def __init__(self, key: list[str], seconds: float, value: str = "value"):
        self.key, self.value, self.step = key, value, int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, value string")
        self.state = handle.getValueState("state", "last long, held boolean, value string")

    def _pass(self, key: tuple, watermark_ms: int) -> pd.DataFrame:
        last, has, value = self.state.get() if self.state.exists() else (None, False, None)
        waiting = sorted(((int(t), v) for t, v in self.waiting.get()), key=lambda x: (x[0], x[1] is not None, x[1] or ""))
        final = watermark_ms * 1000
        now, later = [x for x in waiting if x[0] <= final], [x for x in waiting if x[0] > final]
        out, last, held = _shown([t for t, _ in now], [v for _, v in now], self.step, last, (value,) if has else None, final)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if held is None and not later and last is not None and final - last >= self.step:
            self.state.clear()  # what comes now is shown in any case
        elif last is not None:
            self.state.update((last, held is not None, held[0] if held else None))
            self.handle.registerTimer((last + self.step) // 1000 + 1)
        rows = {k: repeated(x, len(out)) for k, x in zip(self.key, key, strict=True)}
        return pd.DataFrame({**rows, "us": [t for t, _, _ in out], self.value: pd.Series([v for _, v, _ in out], dtype=object), "held": pd.Series([h for _, _, h in out], dtype=bool)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        for batch in rows:
            us = batch["us"].astype("int64").tolist()
            self.waiting.appendList(list(zip(us, [None if pd.isna(v) else v for v in batch[self.value]], strict=True)))
        yield self._pass(key, max(0, timer_values.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._pass(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def throttle_stream(stream: DataFrame, key: list[str], ts: str, value: str, seconds: float, delay: str) -> DataFrame:
    """``throttled_last`` of a stream with a timestamp column and text values; events later than ``delay`` behind the newest are lost."""
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in key)
    rows = stream.withWatermark(ts, delay).select(*key, ts, F.unix_micros(F.col(ts)).alias("us"), value)
    return rows.groupBy(*key).transformWithStateInPandas(HeldThrottle(key, seconds, value), outputStructType=f"{kinds}, us long, `{value}` string, held boolean", outputMode="append", timeMode="EventTime")


class RepeatGate(StatefulProcessor):
    """Lets a log line through unless an equal one of its key came within ``seconds``; a key not heard of for ``forget_s`` is forgotten."""

    def __init__(self, seconds: float = 0.5, forget_s: float = 3600.0):
        self.seconds, self.forget_s = seconds, max(forget_s, seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts double", ttlDurationMs=int(self.forget_s * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("ts")
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for t in got["ts"].astype("datetime64[ns]").astype("int64") / 1e9:
            keep.append(last is None or t - last >= self.seconds)
            last = t
        self.last.update((float(last),))
        yield got[keep]

    def close(self) -> None:
        pass


def gate_stream(stream: DataFrame, key: list[str], seconds: float = 0.5) -> DataFrame:
    """``without_repeats`` on a stream with a ``ts`` column."""
    return stream.groupBy(*key).transformWithStateInPandas(RepeatGate(seconds), outputStructType=stream.schema, outputMode="append", timeMode="ProcessingTime")


def split_answer(text: str) -> tuple[str, str]:
    """(reasoning, answer) of what a model has said so far; a tag that is only begun is not shown."""
    opened, closed = text.find("<think>"), text.find("</think>")
    if opened < 0 and closed < 0:
        for n in range(len("<think>") - 1, 0, -1):
            if text.endswith("<think>"[:n]):
                return "", text[:-n]
        return "", text
    if closed >= 0:
        return text[:closed].replace("<think>", "", 1).strip(), text[closed + len("</think>") :].lstrip()
    inner = text[opened + len("<think>") :]
    for n in range(len("</think>") - 1, 0, -1):
        if inner.endswith("</think>"[:n]):
            return inner[:-n].lstrip(), text[:opened]
    return inner.lstrip(), text[:opened]


OPENS, CLOSES = "<think>", "</think>"


def _begun_tag(text: str, tag: str) -> int:
    """How many characters at a text's end begin a tag that isn't whole."""
    return next((n for n in range(min(len(tag) - 1, len(text)), 0, -1) if text.endswith(tag[:n])), 0)


@dataclass
class Heard:
    """What has to be known of an answer to go on with it: where it stands, and its last characters.

    ``mode`` is before any tag, within reasoning, or behind it; ``hidden`` what
    may begin a tag and isn't shown yet; ``tail`` the last characters, in which
    a closing tag without an opening one may have begun; ``begun`` whether
    anything but white space was shown of what is led by it.
    """

    mode: int = 0
    hidden: str = ""
    tail: str = ""
    begun: bool = False

    def add(self, delta: str, before: Callable[[], str]) -> tuple[str, str]:
        """(what ``delta`` adds to the answer, and to the reasoning), as ``split_answer`` has them before and after it.

        ``before`` gives the whole text so far; it is asked for once, where reasoning ends.
        """
        if self.mode == 2:
            return self._led(delta), ""
        seen = self.hidden + delta
        if CLOSES in (self.tail + delta if self.mode == 0 else seen):
            old = before()
            (was_thought, was_said), (thought, said) = split_answer(old), split_answer(old + delta)
            self.mode, self.hidden, self.tail, self.begun = 2, "", "", bool(said)
            more = lambda now, was: now[len(was) :] if now.startswith(was) else now
            return more(said, was_said), more(thought, was_thought)
        self.tail = (self.tail + delta)[-len(CLOSES) + 1 :]
        said = ""
        if self.mode == 0:
            at = seen.find(OPENS)
            if at < 0:
                n = _begun_tag(seen, OPENS)
                self.hidden = seen[len(seen) - n :]
                return seen[: len(seen) - n], ""
            said, seen = seen[:at], seen[at + len(OPENS) :]
            self.mode, self.begun = 1, False
        n = _begun_tag(seen, CLOSES)
        self.hidden = seen[len(seen) - n :]
        return said, self._led(seen[: len(seen) - n])

    def _led(self, text: str) -> str:
        """Text without the white space that leads it."""
        text = text if self.begun else text.lstrip()
        self.begun = self.begun or bool(text)
        return text


class DeltaGatherer(StatefulProcessor):
    """Gathers deltas of a conversation and gives out what each adds to the answer and the reasoning; an answer not added to for ``forget_s`` is forgotten.

    Deltas are appended to a list that is read once, where the reasoning ends,
    and then dropped: each costs as much as it is long.
    """

    def __init__(self, forget_s: float = 3600.0):
        self.forget_s = forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = int(self.forget_s * 1000)
        self.heard = handle.getValueState("heard", "mode int, hidden string, tail string, begun boolean", ttlDurationMs=ttl)
        self.parts = handle.getListState("parts", "delta string", ttlDurationMs=ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        heard = Heard(*self.heard.get()) if self.heard.exists() else Heard()
        out, new = [], []
        whole = lambda: "".join([p[0] for p in self.parts.get()] + new)
        for seq, delta in pd.concat(list(rows)).sort_values("seq")[["seq", "delta"]].itertuples(index=False):
            said, thought = heard.add(delta or "", whole)
            out.append((key[0], seq, said, thought))
            new.append(delta or "")
        if heard.mode == 2:
            self.parts.clear()
        else:
            self.parts.appendList([(d,) for d in new])
        self.heard.update((heard.mode, heard.hidden, heard.tail, heard.begun))
        yield pd.DataFrame(out, columns=["conv_id", "seq", "answer_delta", "reasoning_delta"])

    def close(self) -> None:
        pass


def gather_stream(stream: DataFrame) -> DataFrame:
    """Answer and reasoning deltas of a stream of ``conv_id, seq, delta``."""
    return stream.groupBy("conv_id").transformWithStateInPandas(DeltaGatherer(), outputStructType="conv_id long, seq long, answer_delta string, reasoning_delta string", outputMode="append", timeMode="ProcessingTime")


def by_type(stream: DataFrame, kinds: list[str]) -> dict[str, DataFrame]:
    """The events of each kind."""
    return {k: stream.filter(F.col("ev") == k) for k in kinds}


def tail(df: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    """The newest ``n`` rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).filter(F.col("_n") <= n).drop("_n")


#: Where worker events go.
ROUTES = {"log": "log", "stdout": "log", "download": "download", "progress": "progress", "segment": "segment", "item_done": "item", "item_error": "item", "runtime": "log", "model_loaded": "log", "done": "end", "error": "end"}


def routed(df: DataFrame, event: str, message: str) -> DataFrame:
    """Adds ``route`` and ``said`` of worker events: log lines without a text, and unknown events, go nowhere."""
    route = F.lit(None).cast("string")
    for kind, to in ROUTES.items():
        route = F.when(F.col(event) == kind, to).otherwise(route)
    text = F.trim(F.coalesce(F.col(message), F.lit("")))
    said = F.when(text != "", text).when(F.col(event) == "item_error", "Whisper item failed").when(F.col(event) == "error", "Whisper worker failed")
    quiet = (route == "log") & said.isNull()
    return df.withColumns({"route": F.when(~quiet, route), "said": F.when(route.isin("log", "item", "end"), said)})


def live_outputs(df: DataFrame, key: str, order: str) -> DataFrame:
    """``run_dir, caption_path, clip_path`` as they stand after all of a key's events: the last that were named; captions and clips of finished items alone.

    Of an item's ``merged, txt, video`` the first that is there is its caption.
    """
    done = F.lower("status") == "done"
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    caption = F.coalesce(filled(F.col("merged")), filled(F.col("txt")), filled(F.col("video")))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(order)))
    return df.groupBy(key).agg(last(filled(F.col("run_dir"))).alias("run_dir"), last(F.when(done, caption)).alias("caption_path"), last(F.when(done, filled(F.col("clip_path")))).alias("clip_path"))
