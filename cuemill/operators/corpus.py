"""Caption corpora: statistics, duplicates, words, filters, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from .scans import ranked


def with_stats(df: DataFrame, text: str) -> DataFrame:
    """Adds ``chars, words, sentences, approx_tokens, lines`` of a text column."""
    return df.withColumns({"chars": X.chars(text), "words": X.words(text), "sentences": X.sentences(text), "approx_tokens": X.approx_tokens(text), "lines": X.lines(text)})


def summary(df: DataFrame, text: str, trigger: str = "", failed: Column | None = None) -> DataFrame:
    """One row of counts, spans of characters and tokens (zeros if empty), and the trigger's hits and share of captions."""
    t = F.coalesce(F.col(text), F.lit(""))
    filled, folded = t.rlike(r"(?U)\S"), trigger.strip().lower().replace("ß", "ss")
    hit = filled & X.fold(t).contains(folded) if folded else F.lit(False)
    zero = lambda c: F.coalesce(c, F.lit(0))
    n, tokens = X.chars(text), X.approx_tokens(text)
    out = df.agg(
        F.count("*").alias("item_count"), F.count_if(filled).alias("captioned"), F.count_if(~filled).alias("empty"), F.count_if(F.lit(False) if failed is None else failed).alias("failed"),
        zero(F.min(n)).alias("chars_min"), F.coalesce(F.avg(n), F.lit(0.0)).alias("chars_avg"), zero(F.max(n)).alias("chars_max"),
        zero(F.min(tokens)).alias("tokens_min"), F.coalesce(F.avg(tokens), F.lit(0.0)).alias("tokens_avg"), zero(F.max(tokens)).alias("tokens_max"),
        F.count_if(hit).alias("trigger_hits"),
    )
    return out.withColumn("trigger_coverage_pct", F.when(F.col("captioned") > 0, 100.0 * F.col("trigger_hits") / F.col("captioned")).otherwise(0.0))


def _hashed(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_hash``, never null, of a text but for case and spacing."""
    return df.withColumn("_hash", F.coalesce(F.sha2(X.fold(X.collapse(text)), 256), F.lit("")))


def _keyed(df: DataFrame, text: str) -> DataFrame:
    return _hashed(df.filter(F.col(text).rlike(r"(?U)\S")), text)


def duplicate_groups(df: DataFrame, text: str, order: str, limit: int | None = None) -> DataFrame:
    """``caption, n, first``: captions held twice or more but for case and spacing; with ``limit`` the largest groups alone, in order.

    Groups by a hash of the key; a group shows its first text in ``order``, of
    several rows with that one the least. ``duplicate_members`` gives the rows.
    Texts are folded once to be grouped, and then those alone that a group may begin with.
    """
    keyed = _keyed(df, text)
    groups = keyed.groupBy("_hash").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    begun = df.select(F.col(order).alias("first"), F.col(text).alias("_text")).join(groups.select("first").distinct(), "first", "left_semi")
    texts = _hashed(begun, "_text").select("_hash", "first", F.trim("_text").alias("caption"))
    out = groups.join(texts, ["_hash", "first"]).groupBy("_hash", "n", "first").agg(F.min("caption").alias("caption")).select("caption", "n", "first")
    return out if limit is None else out.orderBy(F.desc("n"), X.fold("caption")).limit(limit)


def duplicate_members(df: DataFrame, text: str, order: str) -> DataFrame:
    """``first, member``: each row of a group of duplicates with the group's first one."""
    keyed = _keyed(df, text).select("_hash", order)
    groups = keyed.groupBy("_hash").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    return keyed.join(groups, "_hash").select("first", F.col(order).alias("member"))


def top_words(df: DataFrame, text: str, limit: int = 30, stop_words: tuple[str, ...] | list[str] = X.STOP_WORDS) -> DataFrame:
    """``word, n`` of the most frequent words of two letters or more; ties by the word."""
    words = df.select(F.explode(X.caption_words(text)).alias("word")).filter((F.length("word") > 1) & ~F.col("word").isin(*stop_words))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(limit)


def item_filter(*, text: str, path: Column, search: str = "", regex: bool = False, min_chars: int = 0, max_chars: int = 0, min_tokens: int = 0, max_tokens: int = 0, flag: str = "all", status: str = "all", token_limit: int = 512) -> Column:
    """The editor's filter as one predicate; bounds of 0 are none."""
    n, tokens, keep = X.chars(text), X.approx_tokens(text), F.lit(True)
    if search:
        hay = F.concat_ws("\n", F.coalesce(path, F.lit("")), F.coalesce(F.col(text), F.lit("")))
        keep = hay.rlike(f"(?iu){search}") if regex else X.fold(hay).contains(search.lower().replace("ß", "ss"))
    for bound, value, low in ((min_chars, n, True), (max_chars, n, False), (min_tokens, tokens, True), (max_tokens, tokens, False)):
        if bound > 0:
            keep = keep & (value >= bound if low else value <= bound)
    if flag == "unflagged":
        keep = keep & F.col("flag").isNull()
    elif flag in {"approved", "rejected"}:
        keep = keep & (F.col("flag") == flag)
    if status == "over token limit":
        keep = keep & (tokens > token_limit)
    elif status != "all":
        keep = keep & (F.col("status") == status)
    return keep


def page_bounds(total: int, page: int, size: int) -> tuple[int, int, int, int]:
    """(page, pages, start, end) with the page brought into range."""
    size, total = max(1, size), max(0, total)
    pages = max(1, -(-total // size))
    page = min(pages, max(1, page))
    return page, pages, (page - 1) * size, min(total, page * size)


def page(df: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """One page of the rows in ``order``."""
    number, _, start, end = page_bounds(df.count(), number, size)
    return df.orderBy(*order).offset(start).limit(end - start)


def join_captions(media: DataFrame, captions: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """Media with their caption and flag, and a status: no caption, empty or ok."""
    joined = media.join(captions, key, "left").join(flags, key, "left")
    status = F.when(F.col("caption").isNull(), "no caption").when(~F.col("caption").rlike(r"(?U)\S"), "empty").otherwise("ok")
    return joined.withColumn("status", status)


def orphans(captions: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """Captions without media."""
    return captions.join(media.select(key), key, "left_anti")


def status_counts(df: DataFrame, status: str, known: list[str], by: list[str] | None = None) -> DataFrame:
    """One column of counts for each known status, zeros included, and ``total``."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in known])


def find_replace_preview(df: DataFrame, text: str, key: str, find: str, to: str, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """(one row of ``files_changed, replacements``, the first ``limit`` changed rows with ``before`` and ``after``)."""
    seen = df.select(key, F.col(text).alias("before"), X.replace_word(text, find, to).alias("after"), X.count_matches(text, find, case_sensitive=True, whole_words=True).alias("_n"))
    totals = seen.agg(F.count_if(F.col("before") != F.col("after")).alias("files_changed"), F.coalesce(F.sum("_n"), F.lit(0)).alias("replacements"))
    return totals, seen.filter("before <> after").orderBy(key).limit(limit).drop("_n")


def recent(df: DataFrame, created: str, name: str, limit: int = 30) -> DataFrame:
    """The newest rows, ties in natural order of the name."""
    return df.orderBy(F.desc(created), X.natural_key(name), name).limit(limit)


def natural_rank(df: DataFrame, name: str, by: list[str], large: int | None = None) -> DataFrame:
    """Place of each row in the natural order of its name within ``by``."""
    return ranked(df, by, [X.natural_key(name), F.lower(name), F.col(name)], "rank", large).withColumn("rank", F.col("rank").cast("int"))


def settings_diff(saved: DataFrame, current: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Keys whose saved and current values differ, with both; missing ones are null."""
    s, c = saved.select(key, F.col(value).alias("saved")), current.select(key, F.col(value).alias("current"))
    return s.join(c, key, "full").filter(~F.col("saved").eqNullSafe(F.col("current")))


def coerce(c: Column, kind: str, default, low: float | None = None, high: float | None = None, choices: list[str] | None = None) -> tuple[Column, Column]:
    """(value, warning or null): text as int, float, bool or str; clamped to bounds; the default if unfit."""
    if kind == "bool":
        got = F.when(F.lower(c).isin("true", "1", "yes", "on"), True).when(F.lower(c).isin("false", "0", "no", "off"), False)
    elif kind == "int":
        got = c.try_cast("long")
    elif kind == "float":
        got = F.when(~F.isnan(c.try_cast("double")) & (F.abs(c.try_cast("double")) < float("inf")), c.try_cast("double"))
    else:
        got = F.when(c.isin(*choices), c) if choices else c
    bounded = got
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low).cast("double" if kind == "float" else "long"))
    if high is not None:
        bounded = F.least(bounded, F.lit(high).cast("double" if kind == "float" else "long"))
    bounded = F.when(got.isNotNull(), bounded)
    warning = F.when(c.isNotNull() & got.isNull(), "invalid, default used").when(got.isNotNull() & (bounded != got), "out of range, clamped")
    return F.coalesce(bounded, F.lit(default)), warning
