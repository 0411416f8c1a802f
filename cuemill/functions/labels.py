"""What tables and status lines show: previews, labels, counters, capped texts."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from . import text as X, timecode as T
from .text import ColumnOrName, col


def context_usage(used: ColumnOrName, limit: ColumnOrName) -> Column:
    """``1,234 / 8,192 (15%)``; without a limit the count alone, without a count a dash."""
    u, m = F.coalesce(col(used).cast("long"), F.lit(0)), F.coalesce(col(limit).cast("long"), F.lit(0))
    with_limit = F.concat(F.format_number(u, 0), F.lit(" / "), F.format_number(m, 0), F.lit(" ("), F.bround(100.0 * u / m).cast("long").cast("string"), F.lit("%)"))
    return F.when(u <= 0, "—").when(m > 0, with_limit).otherwise(F.format_number(u, 0))


def preview(c: ColumnOrName, longest: int = 120) -> Column:
    """Collapsed text of at most ``longest`` characters, cut ones ending in three dots."""
    t = X.collapse(c)
    return F.when(F.length(t) <= longest, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, longest - 3), r"(?U)\s+$", ""), F.lit("...")))


def flag_mark(flag: ColumnOrName, over: Column) -> Column:
    """A flag as shown, a dash for none, with a warning where a caption is over its limit."""
    f = F.coalesce(F.when(col(flag) != "", col(flag)), F.lit("-"))
    return F.when(over & (f != "-"), F.concat(F.lit("⚠ "), f)).when(over, "⚠").otherwise(f)


def item_counters(caption: ColumnOrName, flag: ColumnOrName, status: ColumnOrName) -> Column:
    """An aggregate: ``**n items** · a captioned · b approved · c failed``."""
    filled = F.coalesce(col(caption), F.lit("")).rlike(r"(?U)\S")
    part = lambda c: c.cast("string")
    return F.concat(F.lit("**"), part(F.count("*")), F.lit(" items** · "), part(F.count_if(filled)), F.lit(" captioned · "), part(F.count_if(col(flag) == "approved")), F.lit(" approved · "), part(F.count_if(col(status) == "failed")), F.lit(" failed"))


def item_label(caption_path: ColumnOrName, media_path: ColumnOrName, root: str, start: ColumnOrName, end: ColumnOrName) -> Column:
    """A segment's path below ``root`` with its times, or the medium's name. Segments lie in folders that end in _segments."""
    path = col(caption_path)
    parts = F.split(path, "/")
    folder = F.get(parts, F.size(parts) - 2)
    below = F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 2147483647)).otherwise(F.concat(folder, F.lit("/"), F.element_at(parts, -1)))
    clock = lambda c: _label_clock(col(c))
    timed = F.when(col(start).isNotNull() & col(end).isNotNull(), F.concat(below, F.lit(" · "), clock(start), F.lit("–"), clock(end))).otherwise(below)
    return F.when(F.lower(folder).endswith("_segments"), timed).otherwise(F.element_at(F.split(F.coalesce(col(media_path), path), "/"), -1))


def _label_clock(seconds: Column) -> Column:
    """MM:SS.t, with hours if there are any, half up."""
    t = F.floor(F.greatest(F.lit(0.0), seconds.cast("double")) * 10 + 0.5).cast("long")
    tail = F.format_string("%02d:%02d.%d", F.floor(t / 600) % 60, F.floor(t / 10) % 60, t % 10)
    return F.when(t >= 36000, F.concat(F.format_string("%02d:", F.floor(t / 36000)), tail)).otherwise(tail)


def log_newest_first(current: ColumnOrName, new_lines: Column, limit: int) -> Column:
    """New lines (in order) put in reverse above a log that shows the newest first; the oldest characters beyond ``limit`` go."""
    fresh = F.array_join(F.reverse(F.filter(new_lines, lambda x: x.rlike(r"(?U)\S"))), "\n")
    parts = F.filter(F.array(fresh, X.strip(F.coalesce(col(current), F.lit("")))), lambda x: x != "")
    return F.substring(F.array_join(parts, "\n"), 1, limit)


def _utf8_prefix(c: Column, limit: Column) -> Column:
    """The longest prefix of whole characters of at most so many bytes."""
    cut = F.substring(F.encode(c, "UTF-8"), F.lit(1), limit)
    return F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "�+$", "")


def capped_text(c: ColumnOrName, limit: int, note: str) -> Column:
    """Text of at most ``limit`` bytes; a longer one is cut to leave room for the note under it."""
    t, suffix = X.strip(c), f"\n\n{note}"
    room = limit - len(suffix.encode())
    if room <= 0:
        tail = suffix.encode()[-limit:].decode(errors="ignore") if limit > 0 else ""
        return F.when(F.octet_length(t) <= limit, t).otherwise(tail)
    return F.when(F.octet_length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(_utf8_prefix(t, F.lit(room)), r"(?U)\s+\z", ""), F.lit(suffix)))


def first_cues(srt: ColumnOrName, limit: int) -> Column:
    """The first cues of a SubRip text."""
    blocks = F.filter(F.split(F.regexp_replace(col(srt), "\r\n?", "\n"), r"\n\s*\n"), lambda b: b.rlike(r"\S"))
    return F.array_join(F.transform(F.slice(blocks, 1, limit), lambda b: F.regexp_replace(b, r"^\n+|\n+$", "")), "\n\n")


def unscrambled(c: ColumnOrName) -> Column:
    """Text whose UTF-8 bytes were read as Latin-1, set right, twice if it takes that; other text as it is. Replacement characters go."""
    t = F.coalesce(col(c), F.lit(""))
    for _ in range(2):
        latin = t.rlike(r"^[\x00-\xff]*$") & t.rlike("[âÃðÂ]")
        raw = F.encode(t, "ISO-8859-1")
        t = F.when(latin & F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(t)
    return F.replace(t, F.lit("�"), F.lit(""))


def history_row(name: ColumnOrName, kind: ColumnOrName, model: ColumnOrName, items: ColumnOrName, done: ColumnOrName, failed: ColumnOrName, created: ColumnOrName, text: ColumnOrName) -> Column:
    """A run as the history shows it: ``name, kind, model, items, done_failed, created, preview``."""
    shown = lambda c, other: F.coalesce(F.when(col(c) != "", col(c)), F.lit(other))
    return F.struct(
        shown(name, "").alias("name"), shown(kind, "other").alias("kind"), shown(model, "-").alias("model"), F.coalesce(col(items).cast("long"), F.lit(0)).alias("items"),
        F.concat(F.coalesce(col(done), F.lit(0)).cast("string"), F.lit(" / "), F.coalesce(col(failed), F.lit(0)).cast("string")).alias("done_failed"),
        F.coalesce(F.date_format(col(created), "yyyy-MM-dd HH:mm"), F.lit("-")).alias("created"), preview(text, 90).alias("preview"),
    )


def _meet(a: list[str], b: list[str]) -> tuple[int, int, int, int]:
    """Where a shortest edit script's middle run of equal words begins and ends, in both lists.

    Furthest-reaching paths are followed from both corners of the edit grid at
    once until two of them meet, so only the last ends of paths are kept.
    """
    n, m = len(a), len(b)
    skew, reach, back = n - m, {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = reach.get(k + 1, -1) if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else reach[k - 1] + 1
            x0, y0 = x, x - k
            while 0 <= x < n and 0 <= x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if skew % 2 and abs(skew - k) < d and x + back.get(skew - k, -1) >= n:
                return x0, y0, x, x - k
        for k in range(-d, d + 1, 2):
            x = back.get(k + 1, -1) if k == -d or (k != d and back.get(k - 1, -1) < back.get(k + 1, -1)) else back[k - 1] + 1
            x0, y0 = x, x - k
            while 0 <= x < n and 0 <= x - k < m and a[n - 1 - x] == b[m - 1 - x + k]:
                x += 1
            back[k] = x
            if skew % 2 == 0 and abs(skew - k) <= d and x + reach.get(skew - k, -1) >= n:
                return n - x, m - (x - k), n - x0, m - y0
    raise AssertionError("paths from both corners always meet")


def edits(a: list[str], b: list[str]) -> list[tuple[str, str, str]]:
    """Stretches of a shortest edit script as (kept, gone, come): in linear space, by halving at the middle."""
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a[head:]), reversed(b[head:]), strict=False)) if x != y), min(len(a), len(b)) - head)
    kept, last = a[:head], a[len(a) - tail :]
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        inner = [("", "".join(a), "".join(b))] if a or b else []
    else:
        x, y, u, v = _meet(a, b)
        inner = edits(a[:x], b[:y]) + [("".join(a[x:u]), "", "")] * (u > x) + edits(a[u:], b[v:])
    return [("".join(kept), "", "")] * bool(kept) + inner + [("".join(last), "", "")] * bool(last)


def _words_and_marks(text: str) -> list[str]:
    """Runs of blanks, runs of letters and digits, and single marks."""
    kind = lambda c: 0 if c.isspace() else 1 if c.isalnum() or c == "_" else 2
    out: list[str] = []
    for i, c in enumerate(text):
        if i and kind(c) < 2 and kind(c) == kind(text[i - 1]):
            out[-1] += c
        else:
            out.append(c)
    return out


def _difference(old: str, new: str) -> str:
    marked, gone, come = [], "", ""
    for same, minus, plus in [*edits(_words_and_marks(old), _words_and_marks(new)), ("", "", "")]:
        if (same or not (minus or plus)) and (gone or come):
            marked += [f"<{tag}>{html.escape(t)}</{tag}>" for tag, t in (("del", gone), ("ins", come)) if t]
            gone = come = ""
        gone, come = gone + minus, come + plus
        marked.append(html.escape(same))
    return "".join(marked)


def marked_difference(old: ColumnOrName, new: ColumnOrName) -> Column:
    """Word by word, what of ``old`` goes and what of ``new`` comes, as escaped text in del and ins marks, by a shortest edit script. In Arrow batches: its paths are followed step by step."""

    @F.pandas_udf("string")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for before, after in batches:
            yield pd.Series([_difference(a or "", b or "") for a, b in zip(before, after, strict=True)], dtype=object)

    return apply(col(old), col(new))


def segment_details(path: ColumnOrName, index: Column, start: Column, end: Column) -> Column:
    """``segment, start_s, end_s``: the given index, or the number in clip_0001 inside a _segments folder; times only of a window with a length."""
    parts = F.split(col(path), "/")
    named = F.lower(F.get(parts, F.size(parts) - 2)).endswith("_segments")
    number = F.when(named, F.regexp_extract(F.lower(F.element_at(parts, -1)), r"^clip_([0-9]+)(?:\.[^.]*)?$", 1).try_cast("int"))
    timed = end > start
    return F.struct(F.coalesce(index.cast("int"), number).alias("segment"), F.when(timed, start).alias("start_s"), F.when(timed, end).alias("end_s"))


def finite_window(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``start_s, end_s`` of a window with finite ends and a length, begun at 0 at the earliest; null for any other."""
    s, e = col(start).try_cast("double"), col(end).try_cast("double")
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite(s) & finite(e) & (e > s), F.struct(F.greatest(F.lit(0.0), s).alias("start_s"), e.alias("end_s")))


def sentence_to_avoid(c: ColumnOrName) -> Column:
    """``Do not mention: …`` with an end mark; empty for nothing."""
    t = X.strip(F.coalesce(col(c), F.lit("")))
    return F.when(t == "", "").otherwise(F.concat(F.lit("Do not mention: "), t, F.when(t.rlike("[.!?]$"), "").otherwise(".")))


def render_prompt(template: str | None, values: dict[str, Column], defaults: dict[str, str]) -> Column:
    """``{{NAME}}`` (any case, blanks allowed) by its value, else its default; unknown names by nothing; then blanks and empty lines are drawn together."""
    if template is None:
        return F.lit(None).cast("string")
    if "{{" not in template:
        return F.lit(template)
    given, parts = {k.upper(): v for k, v in values.items()}, []
    for i, piece in enumerate(re.split(r"\{\{\s*([A-Za-z]\w*)\s*\}\}", template)):
        name = piece.upper()
        if i % 2 == 0:
            parts.append(F.lit(piece))
        elif name in defaults:
            value = given.get(name, F.lit(defaults[name]))
            parts.append(sentence_to_avoid(value) if name == "AVOID" else X.strip(F.coalesce(value.cast("string"), F.lit(""))))
    t = F.regexp_replace(F.concat(*parts), r"[ \t]+", " ")
    return X.strip(F.regexp_replace(F.regexp_replace(t, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def prompt_with_transcript(prompt: ColumnOrName, transcript: ColumnOrName, wrapper: str, inject: bool = True) -> Column:
    """A prompt whose ``{{TRANSCRIPT}}`` is filled in; without that name the wrapper with the transcript goes under it, if wanted."""
    p, t = F.coalesce(col(prompt), F.lit("")), F.coalesce(col(transcript), F.lit(""))
    token = r"(?i)\{\{\s*transcript\s*\}\}"
    filled = F.regexp_replace(p, F.lit(token), F.regexp_replace(t, r"([\\$])", r"\\$1"))
    under = render_prompt(wrapper, {"TRANSCRIPT": t}, {"TRANSCRIPT": ""})
    both = F.array_join(F.filter(F.array(X.strip(p), X.strip(under)), lambda x: x != ""), "\n\n")
    return F.when(p.rlike(token), filled).when(F.lit(inject) & col(transcript).isNotNull(), both).otherwise(p)


def clip_clock(seconds: ColumnOrName) -> Column:
    return T.chapter(seconds)
