"""Registered queries over the test tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import numeric as N, parsers as P, text as X
from .operators import conversation as V, corpus as K, render as R, timeline as L
from .plans import batch as B
from .registry import QUERIES, SQL, query, table
from .sources import listing as S, sinks
from .streaming import events as E


def r6(c: Column) -> Column:
    return F.round(c, 6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of a user: ``start_s, end_s`` with value * 600 seconds of length."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value", t.alias("start_s"), (t + F.col("value") * 600).alias("end_s"))


EVENTS = "SELECT event_id, user_id, event_type, ts, value, epoch_us(ts) / 1e6 AS start_s, epoch_us(ts) / 1e6 + value * 600 AS end_s FROM events"
#: Word characters of a SQL engine whose classes are ASCII only.
_W = r"[\p{L}\p{N}_\p{M}]"


# --- captions ---


@query(rf"""
SELECT doc_id, length(text)::BIGINT AS chars, len(regexp_extract_all(text, '{_W}+(?:[''’]{_W}+)*'))::BIGINT AS words,
  (CASE WHEN len(regexp_extract_all(text || ' ', '[.!?]+\s')) > 0 THEN len(regexp_extract_all(text || ' ', '[.!?]+\s')) WHEN trim(text) <> '' THEN 1 ELSE 0 END)::BIGINT AS sentences,
  ((length(text) + 3) // 4)::BIGINT AS approx_tokens,
  (CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END)::BIGINT AS lines
FROM documents""")
def caption_stats_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.with_stats(table(spark, sf_dir, "documents"), "text").select("doc_id", "chars", "words", "sentences", "approx_tokens", "lines")


@query("""
WITH d AS (SELECT length(text) AS c, (length(text) + 3) // 4 AS t, trim(text) <> '' AS filled, contains(replace(lower(text), 'ß', 'ss'), 'tion') AS hit FROM documents)
SELECT count(*) AS item_count, count(*) FILTER (filled) AS captioned, count(*) FILTER (NOT filled) AS empty, 0::BIGINT AS failed,
  min(c)::BIGINT AS chars_min, round(avg(c), 6) AS chars_avg, max(c)::BIGINT AS chars_max, min(t)::BIGINT AS tokens_min, round(avg(t), 6) AS tokens_avg, max(t)::BIGINT AS tokens_max,
  count(*) FILTER (filled AND hit) AS trigger_hits, round(100.0 * count(*) FILTER (filled AND hit) / count(*) FILTER (filled), 6) AS trigger_coverage_pct
FROM d""")
def caption_stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.summary(table(spark, sf_dir, "documents"), "text", trigger="tion")
    return out.withColumns({c: r6(F.col(c)) for c in ("chars_avg", "tokens_avg", "trigger_coverage_pct")})


@query(r"""
WITH k AS (SELECT doc_id, text, replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') AS key FROM documents)
SELECT arg_min(trim(text), doc_id) AS caption, count(*) AS n, min(doc_id) AS first
FROM k WHERE key <> '' GROUP BY key HAVING count(*) > 1""")
def duplicate_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.duplicate_groups(table(spark, sf_dir, "documents"), "text", "doc_id")


@query(r"""
WITH k AS (SELECT doc_id, replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') AS key FROM documents)
SELECT min(doc_id) OVER (PARTITION BY key) AS first, doc_id AS member FROM k WHERE key <> '' QUALIFY count(*) OVER (PARTITION BY key) > 1""")
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.duplicate_members(table(spark, sf_dir, "documents"), "text", "doc_id")


@query(r"""
WITH r AS (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_''-]+')) AS run FROM documents),
w AS (SELECT replace(lower(regexp_extract(run, '^(?:(?:[\p{N}_][\p{L}\p{N}\p{M}_]*)?[''-]+)*(\p{L}(?:[\p{L}\p{N}\p{M}_''-]*[\p{L}\p{N}\p{M}_])?)', 1)), 'ß', 'ss') AS word FROM r)
SELECT word, count(*) AS n FROM w WHERE length(word) > 1 AND word NOT IN (""" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + """)
GROUP BY word ORDER BY n DESC, word LIMIT 50""")
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.top_words(table(spark, sf_dir, "documents"), "text", limit=50)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.withColumn("flag", F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected")).withColumn("status", F.when(F.length("text") < 300, "failed").otherwise("ok"))


ITEMS = "SELECT d.*, CASE l.quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' END AS flag, l.quality, CASE WHEN length(text) < 300 THEN 'failed' ELSE 'ok' END AS status FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)"


@query(f"""
SELECT doc_id, flag, status FROM ({ITEMS}) WHERE contains(replace(lower(source || chr(10) || text), 'ß', 'ss'), 'the') AND length(text) >= 200 AND length(text) <= 9000 AND flag = 'approved' AND status = 'ok'""")
def item_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = K.item_filter(text="text", path=F.col("source"), search="The", min_chars=200, max_chars=9000, flag="approved", status="ok")
    return items(spark, sf_dir).filter(keep).select("doc_id", "flag", "status")


@query("SELECT doc_id, length(text)::BIGINT AS chars FROM documents ORDER BY length(text) DESC, doc_id LIMIT 25 OFFSET 50")
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", X.chars("text").alias("chars"))
    return K.page(sized, [F.desc("chars"), "doc_id"], number=3, size=25)


@query(f"""
SELECT CASE WHEN coalesce(flag, '') <> 'approved' THEN 'rejected' WHEN source = 'src0' THEN 'no_media' WHEN trim(text) = '' THEN 'skipped' ELSE 'exported' END AS outcome, count(*) AS n FROM ({ITEMS}) GROUP BY 1""")
def approved_export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = items(spark, sf_dir).withColumn("outcome", B.export_outcome(F.col("flag") == "approved", F.col("source") != "src0", F.col("text")))
    return sinks.export_counts(out, "outcome")


@query("""
SELECT l.doc_id, CASE WHEN d.text IS NULL THEN 'no caption' WHEN trim(d.text) = '' THEN 'empty' ELSE 'ok' END AS status, l.quality::INT AS flag
FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l LEFT JOIN documents d USING (doc_id)""")
def corpus_join_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("int").alias("flag"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("caption"))
    return K.join_captions(labels.select("doc_id"), docs, labels, "doc_id").select("doc_id", "status", "flag")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def orphan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.orphans(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
SELECT o_orderstatus AS status, count(*) AS total, count(*) FILTER (o_orderpriority LIKE '1%') AS n_urgent, count(*) FILTER (o_orderpriority LIKE '2%') AS n_high, count(*) FILTER (o_orderpriority LIKE '5%') AS n_low FROM orders GROUP BY 1""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("p", F.when(F.col("o_orderpriority").startswith("1"), "urgent").when(F.col("o_orderpriority").startswith("2"), "high").when(F.col("o_orderpriority").startswith("5"), "low"))
    return K.status_counts(o, "p", ["urgent", "high", "low"], ["o_orderstatus"]).withColumnRenamed("o_orderstatus", "status")


#: A text cut into runs of word characters and of others, for an engine without lookaround.
_RUNS = r"regexp_extract_all(text, '[\p{L}\p{N}_\p{M}]+|[^\p{L}\p{N}_\p{M}]+')"


@query(f"""
SELECT doc_id, array_to_string(list_transform({_RUNS}, lambda x: CASE WHEN x = 'the' THEN 'THE$1' ELSE x END), '') AS text FROM documents""")
def replace_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.replace_word("text", "the", "THE$1").alias("text"))


_SHAPED = "CASE WHEN lower(x) NOT IN ('the', 'is', 'and', 'of') THEN x WHEN x = upper(x) THEN upper({0}) WHEN x[1] = upper(x[1]) AND x[2:] = lower(x[2:]) THEN upper({0}[1]) || {0}[2:] ELSE {0} END".format("map {'the': 'a', 'is': 'was', 'and': 'or', 'of': 'from the'}[lower(x)]")


@query(f"SELECT doc_id, array_to_string(list_transform({_RUNS}, lambda x: {_SHAPED}), '') AS text FROM documents")
def replace_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = X.parse_replace_pairs("the;a|is;was\nand;or|of;from the")
    return table(spark, sf_dir, "documents").select("doc_id", X.replace_all("text", pairs).alias("text"))


_KEY = r"replace(lower(trim(regexp_replace(regexp_replace(x, '[.!?…]+\s*$', ''), '\s+', ' ', 'g'))), 'ß', 'ss')"
_CHUNKS = r"string_split(regexp_replace(regexp_replace(text, '([.!?…])(\s)', '\1␞\2', 'g'), '([^\s.!?…␞][ \t]{0,50})([\r\n])', '\1␞\2', 'g'), '␞')"


def _deduped(source: str) -> str:
    """SQL for the sentences of ``source`` (``doc_id, text``), the first of each kind kept."""
    keyed = f"SELECT doc_id, chunks, list_transform(chunks, lambda x: {_KEY}) AS keys FROM (SELECT doc_id, {_CHUNKS} AS chunks FROM ({source}))"
    return f"SELECT doc_id, array_to_string(list_filter(chunks, lambda x, i: keys[i] = '' OR list_position(keys, keys[i]) = i), '') AS text, (len(list_filter(keys, lambda k: k <> '')) - len(list_distinct(list_filter(keys, lambda k: k <> ''))))::INT AS removed FROM ({keyed})"


@query(_deduped("SELECT doc_id, text FROM documents"))
def sentence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.deduped("text").alias("d")).select("doc_id", "d.text", "d.removed")


def _trimmed(source: str, limit: int, protected: str = "") -> str:
    """SQL for texts of ``source`` cut to ``limit`` characters at a sentence's or a word's end."""
    low = len(protected)
    ended = rf"regexp_extract(w, '^((?s:.){{{max(0, low - 1)},{limit - 1}}}[.!?…])(?:\s|$)', 1)"
    worded = rf"'^((?s:.){{{low},{limit}}}?)\s\S*$'"
    return f"SELECT doc_id, CASE WHEN length(text) <= {limit} THEN text WHEN {ended} <> '' THEN {ended} WHEN regexp_matches(w, {worded}) THEN regexp_replace(regexp_extract(w, {worded}, 1), '\\s+$', '') ELSE '{protected}' END AS text FROM (SELECT doc_id, text, left(text, {limit + 1}) AS w FROM ({source}))"


@query(_trimmed("SELECT doc_id, text FROM documents", 200))
def caption_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.trim_caption("text", 200).alias("text"))


_FLAT = r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents"
_REPLACED = f"SELECT doc_id, array_to_string(list_transform({_RUNS}, lambda x: CASE WHEN x = 'the' THEN 'a' ELSE x END), '') AS text FROM ({_FLAT})"
_PREFIXED = f"SELECT doc_id, 'A clip: ohwx' || CASE WHEN trim(text) <> '' THEN ' ' || trim(text) ELSE '' END AS text FROM ({_deduped(_REPLACED)})"


@query(_trimmed(_PREFIXED, 400, "A clip: ohwx"))
def finalized_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = X.finalize_caption("text", prefix="A clip:", trigger="ohwx", replace=("the", "a"), collapse_whitespace=True, max_length=400)
    return table(spark, sf_dir, "documents").select("doc_id", done.alias("text"))


@query(r"""
SELECT conv_id, turn, array_to_string(list_slice(w, greatest(1, len(w) - 7), len(w)), ' ') AS excerpt
FROM (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM conversations)""")
def context_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.last_words("text", 8).alias("excerpt"))


@query(r"""
WITH w AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT conv_id, turn, array_to_string(list_slice(w, greatest(1, len(w) - 4), len(w)), ' ') AS e FROM w)
SELECT conv_id, turn, coalesce(lag(e) OVER (PARTITION BY conv_id ORDER BY turn), '') AS context FROM p""")
def lag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.previous_text(table(spark, sf_dir, "conversations"), 5).select("conv_id", "turn", "context")


@query("""
WITH t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS k, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations),
m AS (SELECT *, max(k) OVER (PARTITION BY conv_id) AS last FROM t),
g AS (SELECT conv_id, k, sum(length(text)) AS n FROM m WHERE k >= 2 AND k < last GROUP BY ALL),
c AS (SELECT conv_id, k, sum(n) OVER (PARTITION BY conv_id ORDER BY k) - n AS gone FROM g)
SELECT m.conv_id, m.turn, m.role FROM m LEFT JOIN c USING (conv_id, k) WHERE NOT (c.gone IS NOT NULL AND m.total - c.gone > 720)""")
def chat_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.truncate(table(spark, sf_dir, "conversations"), F.length("text"), 800).select("conv_id", "turn", "role")


@query("""
SELECT conv_id, string_agg('## ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || trim(text, ' ' || chr(10) || chr(9) || chr(13)), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.markdown(table(spark, sf_dir, "conversations"))


@query("""
WITH c AS (SELECT *, sum(length(text) + 1) OVER w AS used, count(*) OVER w AS place FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn FROM c WHERE used - 1 <= 500 OR place = 1""")
def summary_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.newest_within(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 500).select("conv_id", "turn")


_TAG = r"regexp_replace(lower(trim(regexp_replace(trim(x), '^(?:[-*•#]\s*)+', ''), ' ,.;' || chr(9) || chr(10) || chr(13))), '\s+', ' ', 'g')"
_LYRIC = r"trim(regexp_replace(trim(x), '^(?:[-*•]\s+|\d+[.)]\s+)', ''))"


@query(rf"""
WITH c AS (SELECT conv_id, turn, role, list_filter(list_transform(string_split_regex(text, '[,\n]+'), lambda x: {_TAG}), lambda x: x <> '') AS t, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda x: {_LYRIC}), lambda x: x <> '' AND lower(x) NOT IN ('lyrics:', 'lyrics')) AS l FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), '|') AS tags, array_to_string(l, '|') AS lyrics, role AS reasoning FROM c""")
def tags_lyrics_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    thought = F.concat(F.lit("<think>"), F.col("role"), F.lit("</think>"), F.col("text"))
    return c.select("conv_id", "turn", F.array_join(P.tags("text"), "|").alias("tags"), F.array_join(P.lyrics("text"), "|").alias("lyrics"), P.strip_reasoning(thought)["reasoning"].alias("reasoning"))


@query("SELECT event_id, props->>'$.k' AS k, json_valid(props) AS valid FROM events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = P.repaired_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(fixed, "$.k").alias("k"), fixed.isNotNull().alias("valid"))


@query(r"""
SELECT page_id, CASE lower(regexp_extract(url, '[^./](\.[^./]+)$', 1)) WHEN '.txt' THEN 'text' WHEN '.md' THEN 'text' WHEN '.mp4' THEN 'video' WHEN '.png' THEN 'image' WHEN '.jpg' THEN 'image' WHEN '.mp3' THEN 'audio' ELSE 'unknown' END AS kind FROM pages""")
def media_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.kind_of("url").alias("kind"))


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(script|style|noscript|template)\b[^>]*>.*?</(script|style|noscript|template)\s*>', ' ', 'g') AS h FROM pages),
t AS (SELECT page_id, regexp_replace(h, '(?s)<[^>]*>', ' ', 'g') AS t FROM p)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM t""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.html_text("html").alias("text"))


# --- batches ---


@query("""
WITH d AS (SELECT doc_id, source, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'done' ELSE 'pending' END AS status FROM documents),
s AS (SELECT *, sum((status = 'pending')::INT) OVER (PARTITION BY source ORDER BY doc_id) AS seen FROM d)
SELECT doc_id, CASE WHEN status = 'pending' AND seen > 5 THEN 'skipped' ELSE status END AS status FROM s""")
def batch_limit_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("done", F.lit(True))
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(done, "doc_id", "left")
    d = d.withColumn("status", F.when(F.col("done"), "done").otherwise("pending"))
    return B.limit_pending(d, ["doc_id"], 5, ["source"]).select("doc_id", "status")


@query("""
SELECT doc_id, CASE WHEN k = 1 THEN source ELSE source || '_' || lpad(k::VARCHAR, greatest(4, length(k::VARCHAR))::INT, '0') END AS output
FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY lang, lower(source) ORDER BY doc_id) AS k FROM documents)""")
def collision_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.output_names(table(spark, sf_dir, "documents"), "lang", "source", ["doc_id"]).select("doc_id", "output")


@query("SELECT doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4)::INT AS share FROM documents")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.round_robin(table(spark, sf_dir, "documents"), ["doc_id"], 4, ["source"]).select("doc_id", "share")


@query("SELECT o_orderkey, o_orderdate, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, c_name, o_orderkey LIMIT 30")
def run_history_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    newest = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return newest.orderBy(F.desc("o_orderdate"), X.natural_key("c_name"), "o_orderkey").limit(30).select("o_orderkey", "o_orderdate", "c_name")


@query("""
SELECT o_orderstatus AS status, count(*) FILTER (o_orderpriority LIKE '1%') AS processed, count(*) FILTER (o_orderpriority LIKE '2%') AS skipped, count(*) FILTER (o_orderpriority LIKE '3%') AS failed,
  greatest(100000 - count(*) FILTER (o_orderpriority < '4'), 0) AS remaining, round(least(1.0, count(*) FILTER (o_orderpriority < '4') / 100000.0), 6) AS fraction,
  round(avg(o_totalprice) FILTER (o_orderpriority NOT LIKE '2%') * greatest(100000 - count(*) FILTER (o_orderpriority < '4'), 0), 2) AS eta_s
FROM orders GROUP BY 1""")
def eta_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("o_orderpriority", 1, 1)
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_totalprice").cast("double").alias("seconds"), F.when(k == "1", "done").when(k == "2", "skipped").when(k == "3", "failed").otherwise("pending").alias("status"))
    out = B.progress(o, F.lit(100000), ["o_orderstatus"])
    return out.select(F.col("o_orderstatus").alias("status"), "processed", "skipped", "failed", "remaining", F.round("fraction", 6).alias("fraction"), F.round("eta_s", 2).alias("eta_s"))


@query("""
SELECT coalesce(r.r_regionkey, n.n_nationkey)::INT AS key, r.r_name AS saved, n.n_name AS current FROM region r FULL JOIN nation n ON r.r_regionkey = n.n_nationkey WHERE r.r_name IS DISTINCT FROM n.n_name""")
def settings_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("key"), F.col("r_name").alias("value"))
    current = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("key"), F.col("n_name").alias("value"))
    return K.settings_diff(saved, current)


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'BUILDING' END AS choice,
  least(greatest(c_acctbal::DOUBLE, 0), 5000) AS level, CASE WHEN c_acctbal < 0 OR c_acctbal > 5000 THEN 'out of range, clamped' END AS warning FROM customer""")
def coerce_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    choice, _ = K.coerce(F.col("c_mktsegment"), "str", "BUILDING", choices=["BUILDING", "MACHINERY"])
    level, warning = K.coerce(F.col("c_acctbal").cast("string"), "float", 0.0, 0, 5000)
    return table(spark, sf_dir, "customer").select("c_custkey", choice.alias("choice"), level.alias("level"), warning.alias("warning"))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY regexp_extract(c_name, '[0-9]+')::BIGINT)::INT AS rank FROM customer")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.regexp_replace("c_name", "#0*", "#").alias("name"))
    return K.natural_rank(names, "name", ["c_nationkey"]).select("c_custkey", "rank")


# --- timelines ---


@query("""
WITH n AS (SELECT p_partkey, p_size::DOUBLE AS d, 1 + greatest(0, ceil((p_size - 5 - 1e-9) / 4.5)) AS n FROM part)
SELECT p_partkey, round(i * 4.5, 6) AS start_s, round(least(d, i * 4.5 + 5), 6) AS end_s FROM (SELECT *, unnest(range(0, n::BIGINT)) AS i FROM n)""")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "part").select("p_partkey", F.explode(L.windows("p_size", 5, 0.5)).alias("w"))
    return w.select("p_partkey", r6(F.col("w.start_s")).alias("start_s"), r6(F.col("w.end_s")).alias("end_s"))


@query("""
WITH e AS (SELECT event_id, value * 10 AS d FROM events),
n AS (SELECT *, CASE WHEN d <= 30 + 1e-9 THEN 1 ELSE 1 + greatest(0, ceil((d - 30 - 1e-9) / 28)) END AS n FROM e)
SELECT event_id, round(i * 28, 6) AS start_s, round(CASE WHEN n = 1 THEN d ELSE least(d, i * 28 + 30) END, 6) AS end_s, CASE WHEN n > 1 THEN 'exceeds the limit, split into ' || n::BIGINT || ' clips' END AS warning
FROM (SELECT *, unnest(range(0, n::BIGINT)) AS i FROM n)""")
def cap_and_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.lit(0.0).alias("s"), (F.col("value") * 10).alias("e"))
    w = L.cap_ranges(e.withColumn("warning", L.limit_warning("s", "e", 30, 2)), "s", "e", 30, 2)
    return w.select("event_id", r6(F.col("s")).alias("start_s"), r6(F.col("e")).alias("end_s"), "warning")


@query(f"""
WITH e AS ({EVENTS}) SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.end_s > b.start_s AND a.start_s < b.end_s""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    left = e.select("user_id", F.col("event_id").alias("a"), "start_s", "end_s")
    right = e.select("user_id", F.col("event_id").alias("b"), F.col("start_s").alias("o_start"), F.col("end_s").alias("o_end"))
    return L.overlap_join(left, right, "user_id", width=86400.0).filter("a < b").select("a", "b")


@query(f"""
WITH e AS ({EVENTS}), h AS (SELECT DISTINCT user_id, floor(start_s / 86400) * 86400 AS w FROM e)
SELECT h.user_id, h.w AS start_s, h.w + 86400 AS end_s, string_agg(event_type, ' ' ORDER BY e.start_s, e.end_s, event_type) AS text
FROM h JOIN e ON h.user_id = e.user_id AND h.w + 86400 > e.start_s AND h.w < e.end_s GROUP BY ALL""")
def overlap_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    days = e.select("user_id", (F.floor(F.col("start_s") / 86400) * 86400).cast("double").alias("start_s")).distinct().withColumn("end_s", F.col("start_s") + 86400)
    words = e.select("user_id", F.col("start_s").alias("o_start"), F.col("end_s").alias("o_end"), F.col("event_type").alias("word"))
    return L.text_between(days, words, "user_id", ["start_s", "end_s"], width=86400.0)


@query(f"""
WITH e AS ({EVENTS}), m AS (SELECT *, max(end_s) OVER (PARTITION BY user_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e WHERE end_s > start_s),
i AS (SELECT *, sum(CASE WHEN start_s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, round(min(start_s), 3) AS start_s, round(max(end_s), 3) AS end_s, count(*) AS n FROM i GROUP BY user_id, k""")
def interval_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.islands(events(spark, sf_dir), ["user_id"])
    return out.select("user_id", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "n")


@query(f"""
WITH e AS ({EVENTS}), m AS (SELECT user_id, start_s, end_s, max(end_s) OVER (PARTITION BY user_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e WHERE end_s > start_s),
g AS (SELECT user_id, coalesce(reach, 0) AS a, start_s AS b FROM m UNION ALL SELECT user_id, max(end_s), 4000000000 FROM m GROUP BY user_id)
SELECT user_id, round(a, 3) AS gap_start, round(b, 3) AS gap_end FROM g WHERE b > a""")
def interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.gaps(events(spark, sf_dir), ["user_id"], F.lit(0.0), F.lit(4e9))
    return out.select("user_id", F.round("gap_start", 3).alias("gap_start"), F.round("gap_end", 3).alias("gap_end"))


@query(f"""
WITH e AS (SELECT event_id, start_s % 86400 AS s, start_s % 86400 + value * 600 AS e FROM ({EVENTS})),
c AS (SELECT event_id, greatest(30000.0, s) AS cs, least(60000.0, e) AS ce FROM e WHERE NOT (e < s OR s >= 60000 OR e < 30000 OR (e = 30000 AND s < 30000))),
f AS (SELECT event_id, cs, CASE WHEN ce - cs < 900 THEN least(60000, cs + 900) ELSE ce END AS ce, ce - cs < 900 AS short FROM c),
b AS (SELECT event_id, CASE WHEN short AND ce - cs < 900 THEN greatest(30000, ce - 900) ELSE cs END AS cs, ce FROM f)
SELECT event_id, round(cs, 3) AS start_s, round(ce, 3) AS end_s FROM b WHERE ce > cs""")
def clamp_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", (F.col("start_s") % 86400).alias("s"), "value")
    cue = L.clamp_cue(F.col("s"), F.col("s") + F.col("value") * 600, F.lit(30000.0), F.lit(60000.0), 900.0)
    return e.select("event_id", cue.alias("c")).filter("c IS NOT NULL").select("event_id", F.round("c.start_s", 3).alias("start_s"), F.round("c.end_s", 3).alias("end_s"))


def user_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events of a day as cues, in seconds of that day."""
    day, at = F.floor(F.col("start_s") / 86400).cast("long"), F.col("start_s") % 86400
    e = events(spark, sf_dir).select("user_id", day.alias("day"), F.struct(at.alias("start_s"), (at + F.col("value")).alias("end_s"), F.col("event_type").alias("text")).alias("c"))
    return e.groupBy("user_id", "day").agg(F.sort_array(F.collect_list("c")).alias("cues"))


_MS = "round_even(({0}) * 1000, 0)::BIGINT"
_STAMP = "lpad(({0} // 3600000)::VARCHAR, 2, '0') || ':' || lpad((({0} // 60000) % 60)::VARCHAR, 2, '0') || ':' || lpad((({0} // 1000) % 60)::VARCHAR, 2, '0') || '{1}' || lpad(({0} % 1000)::VARCHAR, 3, '0')"
_CUES = f"SELECT user_id, floor(start_s / 86400)::BIGINT AS day, event_type AS text, start_s % 86400 AS s, start_s % 86400 + value AS e, {_MS.format('start_s % 86400')} AS a, {_MS.format('start_s % 86400 + value')} AS b FROM ({EVENTS})"
_FRAME = "round_even(round_even({0} * 23.976, 0) * (1000000.0::DOUBLE / 23.976), 0)::BIGINT"


@query(f"""
WITH RECURSIVE c AS (SELECT user_id, day, s, {_FRAME.format('s')} AS a, {_FRAME.format('e')} AS b, row_number() OVER (PARTITION BY user_id, day ORDER BY s, e) - 1 AS i FROM ({_CUES})),
r AS (SELECT user_id, day, i, a, CASE WHEN b <= a THEN a + 41708 ELSE b END AS b FROM c WHERE i = 0
UNION ALL SELECT user_id, day, i, a, CASE WHEN b <= a THEN a + 41708 ELSE b END FROM (SELECT c.user_id, c.day, c.i, CASE WHEN abs(c.s - r.b / 1000000.0::DOUBLE) <= 0.5 / 23.976 + 1e-6 THEN r.b ELSE c.a END AS a, c.b FROM r JOIN c ON c.user_id = r.user_id AND c.day = r.day AND c.i = r.i + 1))
SELECT user_id, day, i::INT AS i, a AS start_us, b AS end_us FROM r""")
def frame_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = F.transform("cues", lambda c: F.struct(c["start_s"].alias("start_s"), c["end_s"].alias("end_s")))
    out = user_cues(spark, sf_dir).select("user_id", "day", F.posexplode(L.snap_ranges(ranges, 23.976)).alias("i", "r"))
    return out.select("user_id", "day", "i", "r.start_us", "r.end_us")


@query()
def merge_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.merge_short(events(spark, sf_dir), "user_id", 20000.0)


@query(f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY s, e, text) AS i FROM ({_CUES}) WHERE e >= s)
SELECT user_id, day, string_agg(i || chr(10) || {_STAMP.format('a', ',')} || ' --> ' || {_STAMP.format('b', ',')} || chr(10) || text, chr(10) || chr(10) ORDER BY i) || chr(10) AS srt,
  'WEBVTT' || chr(10) || chr(10) || string_agg(i || chr(10) || {_STAMP.format('a', '.')} || ' --> ' || {_STAMP.format('b', '.')} || chr(10) || text, chr(10) || chr(10) ORDER BY i) || chr(10) AS vtt FROM c GROUP BY user_id, day""")
def srt_vtt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_cues(spark, sf_dir).select("user_id", "day", R.srt(F.col("cues")).alias("srt"), R.vtt(F.col("cues")).alias("vtt"))


@query(f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY s, e, text) AS i, round_even(s * 100, 0)::BIGINT AS h FROM ({_CUES}))
SELECT user_id, day, string_agg('[' || lpad((h // 6000)::VARCHAR, greatest(2, length((h // 6000)::VARCHAR))::INT, '0') || ':' || lpad(((h // 100) % 60)::VARCHAR, 2, '0') || '.' || lpad((h % 100)::VARCHAR, 2, '0') || ']' || text, chr(10) ORDER BY i) AS lrc,
  'start' || chr(9) || 'end' || chr(9) || 'text' || chr(10) || string_agg(a || chr(9) || b || chr(9) || text, chr(10) ORDER BY i) AS tsv FROM c GROUP BY user_id, day""")
def lrc_tsv_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_cues(spark, sf_dir).select("user_id", "day", R.lrc(F.col("cues")).alias("lrc"), R.tsv(F.col("cues")).alias("tsv"))


_TENTHS = "lpad(({0} // 600)::VARCHAR, greatest(2, length(({0} // 600)::VARCHAR))::INT, '0') || ':' || lpad((({0} // 10) % 60)::VARCHAR, 2, '0') || '.' || ({0} % 10)"


@query(f"""
WITH c AS (SELECT *, round_even(s * 10, 0)::BIGINT AS t, round_even(e * 10, 0)::BIGINT AS u, row_number() OVER (PARTITION BY user_id, day ORDER BY s, e, text) AS i FROM ({_CUES}))
SELECT user_id, day, string_agg(text, ' ' ORDER BY i) AS plain, string_agg('[' || {_TENTHS.format('t')} || ' - ' || {_TENTHS.format('u')} || '] ' || text, chr(10) ORDER BY i) AS stamped,
  string_agg('[' || {_STAMP.format('a', '.')} || ' - ' || {_STAMP.format('b', '.')} || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS combined FROM c GROUP BY user_id, day""")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = user_cues(spark, sf_dir)
    return c.select("user_id", "day", R.transcript(F.col("cues"), "plain").alias("plain"), R.transcript(F.col("cues"), "timestamps").alias("stamped"), R.combined(F.col("cues")).alias("combined"))


_SHORT = "CASE WHEN {0} >= 3600000 THEN lpad(({0} // 3600000)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad((({0} // 60000) % 60)::VARCHAR, 2, '0') || ':' || lpad((({0} // 1000) % 60)::VARCHAR, 2, '0') || '.' || lpad(({0} % 1000)::VARCHAR, 3, '0')"


@query(f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY s, e, text) AS i FROM ({_CUES}))
SELECT user_id, day, 'WEBVTT' || chr(10) || chr(10) || string_agg({_SHORT.format('a')} || ' --> ' || {_SHORT.format('b')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY i) AS vtt,
  string_agg('[' || {_SHORT.format('a')} || ']' || text || '[' || {_SHORT.format('b')} || ']' || chr(10) || chr(10), '' ORDER BY i) AS lrc, 'start' || chr(9) || 'end' || chr(9) || 'text' || chr(10) || string_agg(a || chr(9) || b || chr(9) || text || chr(10), '' ORDER BY i) AS tsv,
  string_agg(text || chr(10), '' ORDER BY i) AS txt FROM c GROUP BY user_id, day""")
def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = user_cues(spark, sf_dir)
    return c.select("user_id", "day", *[R.transcript_file(F.col("cues"), form).alias(form) for form in ("vtt", "lrc", "tsv", "txt")])


@query(f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY s, e, text) AS i FROM ({_CUES}))
SELECT 'user_' || user_id || '.' || unnest(['txt', 'srt']) AS path, unnest([t, r]) AS content FROM (SELECT user_id, day, 'text ' || day AS t, string_agg(i || chr(10) || {_STAMP.format('a', ',')} || ' --> ' || {_STAMP.format('b', ',')} || chr(10) || text, chr(10) || chr(10) ORDER BY i) || chr(10) AS r FROM c GROUP BY user_id, day)""")
def caption_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = user_cues(spark, sf_dir).withColumns({"stem": F.concat(F.lit("user?"), F.col("user_id").cast("string")), "text": F.concat(F.lit("text "), F.col("day").cast("string"))})
    return sinks.caption_files(c, "stem", "text", "cues", ["srt"])


@query(f"""
SELECT user_id, day, round(s + 2.5, 3) AS start_s, round(e + 2.5, 3) AS end_s, text FROM ({_CUES})""")
def shifted_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = user_cues(spark, sf_dir).select("user_id", "day", F.explode(R.shift(F.col("cues"), 2.5)).alias("c"))
    return c.select("user_id", "day", F.round("c.start_s", 3).alias("start_s"), F.round("c.end_s", 3).alias("end_s"), "c.text")


@query()
def resegmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = user_cues(spark, sf_dir).select("user_id", "day", F.explode(R.resegment(F.col("cues"))).alias("c"))
    return c.select("user_id", "day", "c.start_s", "c.end_s", "c.text")


@query("""
WITH e AS (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts)) AS gap FROM events)
SELECT event_id FROM e WHERE gap IS NULL OR gap >= 3600000000""")
def log_dedupe_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.without_repeats(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 3600.0).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) WHERE last IS NULL OR last <> event_type")
def adjacent_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.without_adjacent(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id")


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, value FROM events),
w AS (SELECT event_id, t, min(t) OVER k AS t0, sum(value) OVER k AS v FROM e WINDOW k AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN t > t0 THEN v / ((t - t0) / 1e6) ELSE 0 END, 9) AS rate FROM w""")
def sliding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sliding_rate(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", 86400).select("event_id", F.round("rate", 9).alias("rate"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
r AS (SELECT user_id, i, t AS last, true AS kept FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, CASE WHEN e.t - r.last >= 43200000000 THEN e.t ELSE r.last END, e.t - r.last >= 43200000000 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, last AS us FROM r WHERE kept""")
def throttled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.throttled(table(spark, sf_dir, "events"), ["user_id"], "ts", 43200.0)


# --- numbers ---


@query("""
WITH p AS (SELECT p_partkey, floor(p_size * 16.0 / 10 + 1e-9)::BIGINT AS a FROM part)
SELECT p_partkey, a AS available, a >= 81 AS ok, CASE WHEN least(a, 129) >= 5 THEN ((least(a, 129) - 1) // 4) * 4 + 1 END AS suggested FROM p""")
def fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = N.frames_available(F.lit(None).cast("long"), F.col("p_size") / 10, F.lit(16.0), "wan")
    p = table(spark, sf_dir, "part").select("p_partkey", a.alias("available"))
    return p.select("p_partkey", "available", (F.col("available") >= N.TRAINER_TARGETS["wan"]["frames"]).alias("ok"), N.valid_floor("available", "wan").alias("suggested"))


_SIZED = "SELECT o_orderkey, (200 + o_orderkey % 1900)::DOUBLE AS w, (150 + o_orderkey % 1100)::DOUBLE AS h FROM orders"


@query(f"""
WITH s AS ({_SIZED}), t AS (SELECT *, CASE WHEN w < h THEN 480 ELSE 832 END AS tw, CASE WHEN w < h THEN 832 ELSE 480 END AS th FROM s), k AS (SELECT *, least(tw / w, th / h) AS f FROM t)
SELECT o_orderkey, greatest(16, (least(greatest(16, round_even(w * f / 16, 0)::BIGINT * 16), tw) // 16) * 16)::BIGINT AS width, greatest(16, (least(greatest(16, round_even(h * f / 16, 0)::BIGINT * 16), th) // 16) * 16)::BIGINT AS height FROM k""")
def bucket_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sized(spark, sf_dir).select("o_orderkey", N.bucket_size("w", "h", (832, 480), "keep_ar", 16).alias("b"))
    return o.select("o_orderkey", "b.width", "b.height")


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", (200 + F.col("o_orderkey") % 1900).cast("double").alias("w"), (150 + F.col("o_orderkey") % 1100).cast("double").alias("h"))


@query(f"""
WITH s AS ({_SIZED}), r AS (SELECT *, greatest(28, round_even(h / 28, 0)::BIGINT * 28) AS rh, greatest(28, round_even(w / 28, 0)::BIGINT * 28) AS rw FROM s)
SELECT o_orderkey, (CASE WHEN rh * rw > 400000 THEN greatest(28, floor(h / sqrt(h * w / 400000) / 28) * 28) WHEN rh * rw < 100352 THEN greatest(28, ceil(h * sqrt(100352 / (h * w)) / 28) * 28) ELSE rh END)::BIGINT AS height,
  (CASE WHEN rh * rw > 400000 THEN greatest(28, floor(w / sqrt(h * w / 400000) / 28) * 28) WHEN rh * rw < 100352 THEN greatest(28, ceil(w * sqrt(100352 / (h * w)) / 28) * 28) ELSE rw END)::BIGINT AS width FROM r""")
def smart_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sized(spark, sf_dir).select("o_orderkey", N.smart_resize("h", "w", 28, 100352, 400000).alias("b"))
    return o.select("o_orderkey", "b.height", "b.width")


@query("""
WITH p AS (SELECT p_partkey, p_size::DOUBLE AS d, least(64, greatest(4, ceil(p_size * 2.0)))::BIGINT AS c FROM part), n AS (SELECT *, greatest(4, (c // 2) * 2) AS n FROM p)
SELECT p_partkey, i, round(least(d - 1e-9, i / (n / d)), 6) AS t FROM (SELECT *, unnest(range(0, n)) AS i FROM n)""")
def sampling_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(N.sample_times("p_size", F.lit(24.0), fps=2.0, least=4, most=64, factor=2)["times"]).alias("i", "t"))
    return s.select("p_partkey", F.col("i").cast("long").alias("i"), r6(F.col("t")).alias("t"))


@query("""
WITH d AS (SELECT doc_id, n_chars % 64 AS f, 224 + n_chars % 500 AS h, 336 + n_chars % 700 AS w, n_chars / 100.0 AS a FROM documents),
t AS (SELECT doc_id, ceil(ceil(f / 2.0) * (h::DOUBLE * w / 784.0))::BIGINT AS video, ceil(a * 25)::BIGINT AS audio FROM d)
SELECT doc_id, video, audio, video + audio AS total, video + audio + 1000 <= 12000 AS fits FROM t""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    d = table(spark, sf_dir, "documents").select("doc_id", N.token_budget("qwen2.5-omni", n % 64, 224 + n % 500, 336 + n % 700, n / 100.0).alias("b"))
    return d.select("doc_id", "b.video", "b.audio", "b.total", N.fits_context(F.col("b.total"), 12000, 1000).alias("fits"))


@query("SELECT l_orderkey, l_linenumber, (SELECT coalesce(max(t), 6) FROM (VALUES (6), (8), (10), (12), (16), (24), (32), (48), (80), (96)) v(t) WHERE t <= floor(l_quantity + 0.5))::INT AS tier FROM lineitem")
def tier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.memory_tier("l_quantity").cast("int").alias("tier"))


@query("""
SELECT event_id, array_to_string(list_filter([CASE WHEN value + 1e-9 < 5 THEN printf('too short (%.2fs < 5.00s)', value) END, CASE WHEN value % 1 > 0.8 THEN printf('mostly black (%.1f%% > 80.0%%)', value % 1 * 100) END, CASE WHEN value % 3 <= 0.5 THEN printf('too static (frame difference %.3f <= 0.500)', value % 3) END, CASE WHEN value % 7 < 1 THEN printf('low sharpness (%.2f < 1.00)', value % 7) END,
  CASE WHEN user_id % 2 = 0 THEN 'audio track required' END, CASE WHEN user_id % 2 = 1 AND value % 1 > 0.9 THEN printf('mostly silent (%.1f%% > 90.0%%)', value % 1 * 100) END], lambda x: x IS NOT NULL), '; ') AS reasons FROM events""")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    why = N.reject_reasons(v, v % 1, v % 3, v % 7, v % 1, F.lit(True), F.col("user_id") % 2 == 1, min_duration=5.0, max_black=0.8, max_static=0.5, min_sharpness=1.0, require_audio=True, max_silence=0.9)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(why, "; ").alias("reasons"))


@query("""
WITH x AS (SELECT vec_id, len(embedding) AS n, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) // 8 AS k FROM embeddings),
w AS (SELECT vec_id, k, sqrt(sum(v * v) / 8) AS e FROM x GROUP BY ALL)
SELECT vec_id, round(count(*) FILTER (e < 0.1) / count(*), 6) AS silence FROM w GROUP BY vec_id""")
def silence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(N.silence_ratio(F.col("embedding").cast("array<double>"), 8, 0.1)).alias("silence"))


@query("""
WITH RECURSIVE f AS (SELECT vec_id // 50 AS clip, embedding, row_number() OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY vec_id // 50) AS n FROM embeddings),
d AS (SELECT clip, i, embedding AS last, true AS kept FROM f WHERE i = 0 UNION ALL SELECT clip, i, CASE WHEN far THEN embedding ELSE last END, far FROM (SELECT f.clip, f.i, f.embedding, d.last, list_sum(list_transform(list_zip(f.embedding, d.last), lambda x: abs(x[1] - x[2])::DOUBLE)) / len(d.last) >= 0.19 AS far FROM d JOIN f ON f.clip = d.clip AND f.i = d.i + 1)),
k AS (SELECT clip, i FROM d WHERE kept), c AS (SELECT clip, count(*) AS m FROM k GROUP BY clip)
SELECT clip, i FROM k UNION SELECT f.clip, f.n - 1 FROM f JOIN c USING (clip) WHERE m < 2 AND n >= 2 AND i = 0""")
def adaptive_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames kept in clips of 50 vectors each."""
    clip = F.floor(F.col("vec_id") / 50).cast("long")
    frames = table(spark, sf_dir, "embeddings").groupBy(clip.alias("clip")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("f"))
    far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    kept = L.kept_frames(F.transform("f", lambda x: x["embedding"]), far, 0.19)
    return frames.select("clip", F.explode(kept).alias("i"))


# --- the curation flow ---


@query(f"""
WITH i AS ({ITEMS}), s AS (SELECT *, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss') AS key FROM i WHERE flag = 'approved' AND length(text) >= 200),
u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1)
SELECT source, count(*) AS n, sum((length(text) + 3) // 4)::BIGINT AS tokens, max(length(text))::BIGINT AS longest FROM u GROUP BY source""")
def curated_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved captions of 200 characters or more, one of each duplicate group, by source."""
    keep = K.item_filter(text="text", path=F.col("source"), min_chars=200, flag="approved")
    found = items(spark, sf_dir).filter(keep).select("doc_id", "source", X.chars("text").alias("chars"), X.approx_tokens("text").alias("tokens"), F.sha2(X.fold(X.collapse("text")), 256).alias("key"))
    one = found.groupBy("key").agg(F.min_by(F.struct("source", "chars", "tokens"), "doc_id").alias("x")).select("x.*")
    return one.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.max("chars").alias("longest"))


# The other sets of queries register themselves.
from . import queries_files, queries_merging, queries_phases, queries_plans, queries_scans, queries_text  # noqa: E402, F401
