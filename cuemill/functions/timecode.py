"""Times as text: subtitle stamps, clocks, durations, sizes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import ColumnOrName, col, let


def _two(c: Column) -> Column:
    return F.format_string("%02d", c.cast("long"))


def milliseconds(seconds: ColumnOrName) -> Column:
    """Whole milliseconds, half to even, not below 0."""
    return F.greatest(F.bround(col(seconds).cast("double") * 1000).cast("long"), F.lit(0).cast("long"))


def stamp(seconds: ColumnOrName, mark: str = ",") -> Column:
    """HH:MM:SS,mmm."""
    ms = milliseconds(seconds)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def short_stamp(seconds: ColumnOrName, mark: str = ".") -> Column:
    """MM:SS.mmm, with hours only if there are any."""
    ms = milliseconds(seconds)
    rest = F.format_string(f"%02d:%02d{mark}%03d", F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    return F.when(ms >= 3600000, F.concat(_two(F.floor(ms / 3600000)), F.lit(":"), rest)).otherwise(rest)


def tenths(seconds: ColumnOrName) -> Column:
    """mm:ss.t, half to even."""
    t = F.greatest(F.bround(col(seconds).cast("double") * 10).cast("long"), F.lit(0).cast("long"))
    return F.format_string("%02d:%02d.%d", F.floor(t / 600), F.floor(t / 10) % 60, t % 10)


def chapter(seconds: ColumnOrName, hours: Column | bool = False) -> Column:
    """MM:SS, or HH:MM:SS where ``hours``."""
    t = F.greatest(F.bround(col(seconds).cast("double")).cast("long"), F.lit(0).cast("long"))
    long_form = F.format_string("%02d:%02d:%02d", F.floor(t / 3600), F.floor(t / 60) % 60, t % 60)
    short_form = F.format_string("%02d:%02d", F.floor(t / 60), t % 60)
    return F.when(hours if isinstance(hours, Column) else F.lit(hours), long_form).otherwise(short_form)


def clock(seconds: ColumnOrName, with_ms: bool = False) -> Column:
    """H:MM:SS or M:SS as a player shows it, half up; with milliseconds if asked."""
    k = 1000 if with_ms else 1
    t = F.greatest(F.floor(col(seconds).cast("double") * k + 0.5), F.lit(0)).cast("long")
    s = F.floor(t / k)
    tail = F.format_string(".%03d", t % 1000) if with_ms else F.lit("")
    return F.concat(F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60), tail)


def duration_text(seconds: ColumnOrName) -> Column:
    """1h 2m, 3m 4s or 5s."""
    s = F.greatest(F.floor(col(seconds).cast("double")), F.lit(0)).cast("long")
    return F.when(s >= 3600, F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s / 60) % 60)).when(s >= 60, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))


def fixed(value: ColumnOrName, digits: int) -> Column:
    """A number with 1 to 3 decimals as C and Python print it: its binary value to the nearest, halves to even.

    Spark's own formatting goes by the shortest decimal form and takes halves
    up. Each step here is exact: a fraction in two halves of 26 bits, and how
    far the lower one lies from the tie.
    """
    k = 10**digits

    def split(v: Column) -> Column:
        whole = F.floor(F.abs(v))
        rest = F.abs(v) - whole
        high = F.floor(rest * 2.0**26) / 2.0**26
        return F.struct(whole.alias("whole"), high.alias("high"), (rest - high).alias("low"))

    def rounded(x: Column) -> Column:
        n = F.floor(x["high"] * k)
        tie = (0.5 - (x["high"] * k - n)) / k
        return x["whole"] * k + n + F.when((x["low"] > tie) | ((x["low"] == tie) & (n % 2 == 1)), 1).otherwise(0)

    def text(v: Column) -> Column:
        shown = F.regexp_replace(F.format_string(f"%0{digits + 1}d", let(split(v), rounded)), rf"(.{{{digits}}})$", ".$1")
        return F.when(F.abs(v) < 2.0**53, F.concat(F.when(v.cast("string").startswith("-"), "-").otherwise(""), shown)).when(v.isNotNull(), F.format_string(f"%.{digits}f", v))

    return let(col(value).cast("double"), text)


def bytes_text(size: ColumnOrName) -> Column:
    """Sizes in B, KB, MB, GB, TB of 1024 each, one decimal from KB on."""
    b = F.greatest(col(size).cast("double"), F.lit(0.0))
    out = F.format_string("%d B", b.cast("long"))
    for unit, k in (("KB", 1), ("MB", 2), ("GB", 3), ("TB", 4)):
        out = F.when(b >= float(1024**k), F.concat(fixed(b / float(1024**k), 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def seconds_of(text: ColumnOrName) -> Column:
    """Seconds of [[h:]m:]s; null for anything else."""
    numbers = F.transform(F.split(F.trim(col(text)), ":"), lambda p: p.try_cast("double"))

    def value(n: Column) -> Column:
        whole = F.size(n).between(1, 3) & ~F.exists(n, lambda x: x.isNull())
        return F.when(whole, F.aggregate(n, F.lit(0.0), lambda a, x: a * 60 + x))

    return let(numbers, value)


def clock_seconds(text: ColumnOrName) -> Column:
    """Seconds of 75, 1:15 or 01:02:03.5: whole numbers between colons, the last one with a fraction if it has any; null for anything else."""
    t = F.trim(col(text))

    def strict(parts: Column) -> Column:
        whole = F.forall(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.rlike("^[0-9]+$"))
        return whole & F.element_at(parts, -1).rlike(r"^[0-9]+([.][0-9]+)?$")

    return F.when(let(F.split(t, ":"), strict), seconds_of(t))


def seconds_pair(text: ColumnOrName) -> Column:
    """``start_s, end_s`` of ``a-b`` (hyphen, dashes or -->), brackets around allowed; null for anything else."""
    bare = F.translate(F.translate(F.replace(F.replace(F.trim(col(text)), F.lit("-->"), F.lit("-")), F.lit("\u2014"), F.lit("-")), "\u2013", "-"), "[]", "  ")

    def pair(ends: Column) -> Column:
        two = F.when(F.size(ends) == 2, F.struct(clock_seconds(F.get(ends, F.lit(0))).alias("start_s"), clock_seconds(F.get(ends, F.lit(1))).alias("end_s")))
        return let(two, lambda p: F.when(p["start_s"].isNotNull() & p["end_s"].isNotNull(), p))

    return let(F.split(bare, "-"), pair)
