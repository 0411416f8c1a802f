"""Cues and transcripts as subtitle, lyric, table and Markdown text. ``cues`` are arrays of ``start_s, end_s, text`` in order."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X, timecode as T
from .scans import stretches_of


def valid(cues: Column) -> Column:
    """Cues that don't end before they begin."""
    return F.filter(cues, lambda c: c["end_s"] >= c["start_s"])


def _blocks(cues: Column, mark: str, numbered: bool = True) -> Column:
    def block(c: Column, i: Column) -> Column:
        head = F.concat((i + 1).cast("string"), F.lit("\n")) if numbered else F.lit("")
        return F.concat(head, T.stamp(c["start_s"], mark), F.lit(" --> "), T.stamp(c["end_s"], mark), F.lit("\n"), X.strip(c["text"]))

    return F.transform(cues, block)


def srt(cues: Column) -> Column:
    """SubRip; cues that end before they begin are dropped."""
    shown = valid(cues)
    return F.when(F.size(shown) > 0, F.concat(F.array_join(_blocks(shown, ","), "\n\n"), F.lit("\n"))).otherwise("")


def vtt(cues: Column) -> Column:
    """WebVTT; cues that end before they begin are dropped."""
    shown = valid(cues)
    body = F.concat(F.array_join(_blocks(shown, "."), "\n\n"), F.when(F.size(shown) > 0, "\n").otherwise(""))
    return F.concat(F.lit("WEBVTT\n\n"), body)


def straighten(cues: Column) -> Column:
    """Cues from 0 on that end where they begin at the earliest."""
    return F.transform(cues, lambda c: F.struct(F.greatest(F.lit(0.0), c["start_s"]).alias("start_s"), F.greatest(F.lit(0.0), c["start_s"], c["end_s"]).alias("end_s"), c["text"].alias("text")))


def srt_straightened(cues: Column) -> Column:
    """SubRip in which reversed cues stay, without length."""
    return srt(straighten(cues))


def vtt_straightened(cues: Column) -> Column:
    blocks = F.concat(F.array(F.lit("WEBVTT")), _blocks(straighten(cues), ".", numbered=False))
    return F.concat(F.array_join(blocks, "\n\n"), F.when(F.size(cues) > 0, "\n").otherwise("\n\n"))


def plain_cues(cues: Column) -> Column:
    """Without blank cues; arrows in texts shortened, as they would end a stamp."""
    clean = F.transform(cues, lambda c: F.struct(c["start_s"].alias("start_s"), c["end_s"].alias("end_s"), F.replace(X.strip(c["text"]), F.lit("-->"), F.lit("->")).alias("text")))
    return F.filter(clean, lambda c: c["text"] != "")


def lrc(cues: Column) -> Column:
    """Lyric lines with [mm:ss.xx] stamps."""

    def line(c: Column) -> Column:
        h = F.greatest(F.bround(c["start_s"] * 100).cast("long"), F.lit(0).cast("long"))
        return F.concat(F.format_string("[%02d:%02d.%02d]", F.floor(h / 6000), F.floor(h / 100) % 60, h % 100), c["text"])

    return F.array_join(F.transform(plain_cues(cues), line), "\n")


def tsv(cues: Column) -> Column:
    """start, end in milliseconds and text, tabs in texts as spaces."""
    rows = F.transform(plain_cues(cues), lambda c: F.concat_ws("\t", T.milliseconds(c["start_s"]).cast("string"), T.milliseconds(c["end_s"]).cast("string"), F.replace(c["text"], F.lit("\t"), F.lit(" "))))
    return F.array_join(F.concat(F.array(F.lit("start\tend\ttext")), rows), "\n")


def transcript(cues: Column, style: str = "plain") -> Column:
    """plain: one line; lines: a line a cue; timestamps: ``[mm:ss.t - mm:ss.t] text`` lines."""
    shown = plain_cues(cues)
    if style == "plain":
        return X.collapse(F.array_join(F.transform(shown, lambda c: c["text"]), " "))
    if style == "lines":
        return F.array_join(F.transform(shown, lambda c: X.collapse(c["text"])), "\n")
    if style != "timestamps":
        raise ValueError("style must be 'plain', 'lines' or 'timestamps'")
    return F.array_join(F.transform(shown, lambda c: F.concat(F.lit("["), T.tenths(c["start_s"]), F.lit(" - "), T.tenths(c["end_s"]), F.lit("] "), X.collapse(c["text"]))), "\n")


def combined(cues: Column) -> Column:
    """Segment captions under ``[start - end]`` heads, blank ones left out."""
    shown = F.filter(cues, lambda c: X.strip(c["text"]) != "")
    return F.array_join(F.transform(shown, lambda c: F.concat(F.lit("["), T.stamp(c["start_s"], "."), F.lit(" - "), T.stamp(c["end_s"], "."), F.lit("]\n"), X.strip(c["text"]))), "\n\n")


def shift(cues: Column, offset: Column | float) -> Column:
    """Cues moved by ``offset`` seconds."""
    by = F.lit(offset)
    return F.transform(cues, lambda c: F.struct((c["start_s"] + by).alias("start_s"), (c["end_s"] + by).alias("end_s"), c["text"].alias("text")))


def highlight(words: Column) -> Column:
    """A cue for each word of ``start_s, end_s, text`` with that word underlined, and cues for the pauses between."""
    line = lambda i: X.strip(F.array_join(F.transform(words, lambda w, j: F.when(j == i, F.concat(F.lit("<u>"), X.strip(w["text"]), F.lit("</u>"))).otherwise(X.strip(w["text"]))), " "))
    whole = F.array_join(F.transform(words, lambda w: X.strip(w["text"])), " ")

    def around(w: Column, i: Column) -> Column:
        cue = F.struct(w["start_s"].alias("start_s"), w["end_s"].alias("end_s"), line(i).alias("text"))
        before = F.get(words, i - 1)["end_s"]
        pause = F.struct(before.alias("start_s"), w["start_s"].alias("end_s"), whole.alias("text"))
        return F.when((i > 0) & (before < w["start_s"]), F.array(pause, cue)).otherwise(F.array(cue))

    return F.flatten(F.transform(words, around))


def wrap(c: Column, width: int) -> Column:
    """Lines broken at spaces to ``width`` characters; longer words stay whole. Greedy filling goes word by word, in a fold."""
    if width <= 0:
        return X.strip(c)

    def fill(line: Column) -> Column:
        ws = F.filter(F.split(line, " "), lambda w: w != "")
        start = F.struct(F.lit("").alias("done"), F.lit("").alias("now"))

        def add(s: Column, w: Column) -> Column:
            fits = (s["now"] != "") & (F.length(s["now"]) + 1 + F.length(w) <= width)
            done = F.when((s["now"] == "") | fits, s["done"]).otherwise(F.concat(s["done"], s["now"], F.lit("\n")))
            return F.struct(done.alias("done"), F.when(fits, F.concat(s["now"], F.lit(" "), w)).otherwise(w).alias("now"))

        return F.aggregate(ws, start, add, lambda s: F.concat(s["done"], s["now"]))

    return F.array_join(F.transform(F.split(X.strip(c), "\n"), fill), "\n")


def transcript_file(cues: Column, form: str) -> Column:
    """A transcript as srt, vtt, txt, lrc or tsv, in the plainer layout of transcription tools: vtt without numbers, hours only where there are any; lrc with both times, a blank line between."""
    shown = plain_cues(cues)
    ended = lambda blocks, mark: F.concat(F.array_join(blocks, mark), F.when(F.size(blocks) > 0, F.lit(mark)).otherwise(""))
    if form == "srt":
        blocks = F.transform(shown, lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), T.stamp(c["start_s"]), F.lit(" --> "), T.stamp(c["end_s"]), F.lit("\n"), c["text"]))
        return ended(blocks, "\n\n")
    if form == "vtt":
        blocks = F.transform(shown, lambda c: F.concat(T.short_stamp(c["start_s"]), F.lit(" --> "), T.short_stamp(c["end_s"]), F.lit("\n"), c["text"]))
        return F.concat(F.lit("WEBVTT\n\n"), ended(blocks, "\n\n"))
    if form == "txt":
        return ended(F.transform(cues, lambda c: X.strip(c["text"])), "\n")
    if form == "lrc":
        return ended(F.transform(shown, lambda c: F.concat(F.lit("["), T.short_stamp(c["start_s"]), F.lit("]"), c["text"], F.lit("["), T.short_stamp(c["end_s"]), F.lit("]"))), "\n\n")
    if form != "tsv":
        raise ValueError("form must be 'srt', 'vtt', 'txt', 'lrc' or 'tsv'")
    rows = F.transform(cues, lambda c: F.concat_ws("\t", T.milliseconds(c["start_s"]).cast("string"), T.milliseconds(c["end_s"]).cast("string"), F.replace(X.strip(c["text"]), F.lit("\t"), F.lit(" "))))
    return ended(F.concat(F.array(F.lit("start\tend\ttext")), rows), "\n")


#: Titles and the like, whose full stop ends no sentence; neither do letters with a full stop each, two or more.
ABBREVIATIONS = "mr mrs ms dr prof sen rep gov st no jr sr inc ltd".split()
#: Marks that may close a sentence after its end mark.
CLOSERS = "\"')]}"


def resegment(words: Column, longest_chars: int = 92, longest_words: int = 24, longest_s: float = 8.0, least_words: int = 4) -> Column:
    """Cues from a word stream: at ends of sentences, or where a cue grows too long at its last soft break. In Arrow batches: each cue depends on the last."""

    @F.pandas_udf("array<struct<start_s:double,end_s:double,text:string>>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda ws: None if ws is None else _cues(list(ws), longest_chars, longest_words, longest_s, least_words))

    return apply(words)


def _ending(word: str, marks: str) -> bool:
    return word.strip().rstrip(CLOSERS)[-1:] in tuple(marks)


def ends_sentence(word: str) -> bool:
    """Whether a word ends a sentence: end marks, then closing marks if any, but no abbreviation."""
    bare = word.strip()
    initials = len(bare) >= 4 and len(bare) % 2 == 0 and all(c == "." if i % 2 else c.isascii() and c.isalpha() for i, c in enumerate(bare))
    titled = bare.endswith(".") and bare[:-1].lower() in ABBREVIATIONS
    return bool(bare) and not initials and not titled and _ending(bare, ".!?")


def ends_clause(word: str) -> bool:
    return bool(word.strip()) and _ending(word, ",;:")


def spoken(words: list[str]) -> str:
    """What words say together. Where none brings a blank along, one stands between them; arrows are shortened."""
    glued = "".join(words)
    said = glued.split() if " " in glued.strip() or len(words) < 2 else [x for w in words for x in w.split()]
    return " ".join(said).replace("-->", "->")


def cue_spans(texts: list[str], starts: list[float], ends: list[float], longest_chars: int, longest_words: int, longest_s: float, least_words: int) -> Iterator[tuple[int, int]]:
    """First and last word of each cue.

    A cue's end follows from its first word and from how far words were read
    when the cue before was cut: it is the next word at which a sentence ends
    or the cue is full, and of a full cue the last soft break, if that leaves
    ``least_words``.
    """
    soft = [k for k, t in enumerate(texts) if ends_clause(t)]
    at_most = list(accumulate((len(t) + 1 for t in texts), initial=0))  # what is said is no longer than its words with a blank after each
    first = read = 0
    while first < len(texts):
        full = lambda k: k - first + 1 >= longest_words or ends[k] - starts[first] >= longest_s or (at_most[k + 1] - at_most[first] > longest_chars and len(spoken(texts[first : k + 1])) >= longest_chars)  # noqa: B023, E731
        last = through = next((k for k in range(read, len(texts)) if ends_sentence(texts[k]) or full(k)), len(texts) - 1)
        if read <= through and not ends_sentence(texts[through]) and full(through):
            at = bisect_right(soft, through) - 1
            last = soft[at] if at >= 0 and soft[at] - first + 1 >= max(1, least_words) else through
        yield first, last
        first, read = last + 1, through + 1


def _cues(words: list[dict], longest_chars: int, longest_words: int, longest_s: float, least_words: int) -> list[dict]:
    heard = [w for w in words if w["text"].strip()]
    return cues_of(*([w[k] for w in heard] for k in ("text", "start_s", "end_s")), longest_chars, longest_words, longest_s, least_words)


def cues_of(texts: list[str], starts: list[float], ends: list[float], longest_chars: int, longest_words: int, longest_s: float, least_words: int) -> list[dict]:
    """Cues of words, none of them blank."""
    spans = cue_spans(texts, starts, ends, longest_chars, longest_words, longest_s, least_words)
    return [{"start_s": starts[a], "end_s": max(starts[a], ends[b]), "text": spoken(texts[a : b + 1])} for a, b in spans]


def sentence_end(word: Column) -> Column:
    """``ends_sentence`` of a column."""
    bare = X.strip(word)
    titled = bare.rlike(rf"(?i)^({'|'.join(ABBREVIATIONS)})\.$")
    return bare.rlike(rf"[.!?][{re.escape(CLOSERS)}]*$") & ~titled & ~bare.rlike(r"^([A-Za-z]\.){2,}$")


def resegment_words(words: DataFrame, key: list[str], order: list[str], longest_chars: int = 92, longest_words: int = 24, longest_s: float = 8.0, least_words: int = 4) -> DataFrame:
    """``key, start_s, end_s, text``: ``resegment`` on rows of one word each (``start_s, end_s, text``).

    A sentence's end closes its cue whatever came before, so the words between
    two such ends are cut on their own: a group is a sentence, not a recording.
    """
    heard = words.filter(X.strip(F.col("text")) != "")
    w = Window.partitionBy(*key).orderBy(*order)
    before = F.coalesce(F.lag(sentence_end(F.col("text")).cast("int")).over(w), F.lit(0))
    parts = heard.withColumn("_before", before).withColumn("_part", F.sum("_before").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    @F.pandas_udf("start_s array<double>, end_s array<double>, text array<string>")
    def cut(starts: pd.Series, ends: pd.Series, texts: pd.Series) -> pd.DataFrame:
        found = [cues_of(t.tolist(), s.tolist(), e.tolist(), longest_chars, longest_words, longest_s, least_words) for s, e, t in zip(starts, ends, texts, strict=True)]
        return pd.DataFrame({c: [[x[c] for x in cues] for cues in found] for c in ("start_s", "end_s", "text")})

    parts = parts.withColumns({c: F.col(c).cast("double") for c in ("start_s", "end_s") if c not in order})
    lists = stretches_of(parts, [*key, "_part"], order, "start_s", "end_s", "text")
    lists = lists.select(*key, cut(F.col("start_s").cast("array<double>"), F.col("end_s").cast("array<double>"), "text").alias("_c"))
    return lists.select(*key, F.explode(F.arrays_zip("_c.start_s", "_c.end_s", "_c.text")).alias("_r")).select(*key, "_r.start_s", "_r.end_s", "_r.text")
