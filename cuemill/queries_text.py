"""Registered queries of time codes, answer parsers, templates, labels and subtitle files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import labels as B, parsers as P, text as X, timecode as T
from .operators import corpus as K, render as R
from .registry import query, spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# --- times ---


@query("""
WITH v AS (SELECT event_id, value * 37.5::DOUBLE AS s FROM events), e AS (SELECT event_id, round_even(s * 1000, 0)::BIGINT AS ms, round_even(s * 10, 0)::BIGINT AS t, round_even(s, 0)::BIGINT AS r, floor(s + 0.5)::BIGINT AS h, floor(s)::BIGINT AS w FROM v)
SELECT event_id, CASE WHEN ms >= 3600000 THEN lpad((ms // 3600000)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad(((ms // 60000) % 60)::VARCHAR, 2, '0') || ':' || lpad(((ms // 1000) % 60)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS short,
  lpad((t // 600)::VARCHAR, greatest(2, length((t // 600)::VARCHAR))::INT, '0') || ':' || lpad(((t // 10) % 60)::VARCHAR, 2, '0') || '.' || (t % 10) AS tenths,
  lpad((r // 60)::VARCHAR, greatest(2, length((r // 60)::VARCHAR))::INT, '0') || ':' || lpad((r % 60)::VARCHAR, 2, '0') AS chapter,
  lpad((h // 3600)::VARCHAR, 2, '0') || ':' || lpad(((h // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad((h % 60)::VARCHAR, 2, '0') AS clock,
  CASE WHEN w >= 3600 THEN (w // 3600) || 'h ' || ((w // 60) % 60) || 'm' WHEN w >= 60 THEN (w // 60) || 'm ' || (w % 60) || 's' ELSE w || 's' END AS duration FROM e""")
def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("value") * 37.5
    return table(spark, sf_dir, "events").select("event_id", T.short_stamp(s).alias("short"), T.tenths(s).alias("tenths"), T.chapter(s).alias("chapter"), T.clock(s).alias("clock"), T.duration_text(s).alias("duration"))


@query("""
SELECT o_orderkey, CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576) WHEN b >= 1024 THEN printf('%.1f KB', b / 1024) ELSE floor(b)::BIGINT || ' B' END AS size FROM (SELECT o_orderkey, (o_orderkey * 7919 % 100003)::DOUBLE * (o_orderkey % 3 * 9973 + 1) / 7.3::DOUBLE AS b FROM orders)""")
def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.bytes_text((k * 7919 % 100003).cast("double") * (k % 3 * 9973 + 1) / 7.3).alias("size"))


@query("""
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN (event_id % 50 * 60 + event_id % 60 + CASE WHEN event_id % 4 = 2 THEN 3600 ELSE 0 END)::DOUBLE END AS seconds,
  CASE WHEN event_id % 4 < 3 THEN 5.5 END AS pair_start, CASE WHEN event_id % 4 < 3 THEN (event_id % 50 * 60 + event_id % 60 + CASE WHEN event_id % 4 = 2 THEN 3600 ELSE 0 END)::DOUBLE END AS pair_end FROM events""")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    text = F.when(i % 4 == 3, "soon").otherwise(F.concat(F.when(i % 4 == 2, "1:").otherwise(""), F.format_string("%02d:%02d", i % 50, i % 60)))
    mark = F.when(i % 3 == 0, " --> ").when(i % 3 == 1, "–").otherwise(" - ")
    both = T.seconds_pair(F.concat(F.lit("[5.5"), mark, text, F.lit("]")))
    return table(spark, sf_dir, "events").select("event_id", T.seconds_of(text).alias("seconds"), both["start_s"].alias("pair_start"), both["end_s"].alias("pair_end"))


# --- answers ---


@query("""
SELECT conv_id, turn, 5.0 AS start_s, 70.5 AS end_s, role || chr(10) || 'more' AS text FROM conversations UNION ALL SELECT conv_id, turn, (100 + turn)::DOUBLE, (100 + turn)::DOUBLE, 'late' FROM conversations""")
def bracketed_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    answer = F.concat(F.lit("Heading\n- [0:05 - 1:10.5] "), F.col("role"), F.lit("\n\n more \n["), (F.col("turn") + 100).cast("string"), F.lit("-->50] late\n[not a time] "))
    cues = F.filter(P.bracketed_cues(answer), lambda x: x["text"] != "")
    fixed = F.transform(cues, lambda x: F.struct(x["start_s"].alias("start_s"), x["end_s"].alias("end_s"), F.replace(x["text"], F.lit("\n[not a time]"), F.lit("")).alias("text")))
    return c.select("conv_id", "turn", F.explode(fixed).alias("c")).select("conv_id", "turn", "c.*")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with two timed scenes each: whole, fenced, with a comma too many, inside prose, or broken off after the first."""
    name, k = F.col("p_name"), F.col("p_partkey") % 5
    one = F.concat(F.lit('{"timestamp":"00:00-00:06","segment_detail_caption":"A '), name, F.lit('","camera_state":"pan","storyline":"'), F.col("p_brand"), F.lit('","speech_content":"","acoustics_content":"hum."}'))
    two = F.lit('{"timestamp":"6 - 1:12","segment_detail_caption":"It stops!","camera_state":"","storyline":"The  end","speech_content":"bye","acoustics_content":""}')
    whole = F.concat(F.lit("["), one, F.lit(","), two, F.lit("]"))
    answer = F.when(k == 0, whole).when(k == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(k == 2, F.concat(F.lit("["), one, F.lit(","), two, F.lit(",]"))).when(k == 3, F.concat(F.lit("Here: "), whole, F.lit(" done"))).otherwise(F.concat(F.lit("["), one, F.lit(',{"timestamp":"6-')))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", P.scenes(answer).alias("s"))


_TWO = "p_partkey % 5 <> 4"


@query(f"""
SELECT p_partkey, 'A ' || p_name || '. pan.' || CASE WHEN {_TWO} THEN ' It stops!' ELSE '' END AS wan, 'A ' || p_name || '. pan.' || CASE WHEN {_TWO} THEN chr(10) || 'It stops!' ELSE '' END AS motion,
  'A ' || p_name || '. pan. hum.' || CASE WHEN {_TWO} THEN chr(10) || 'It stops! bye.' ELSE '' END AS av, CASE WHEN {_TWO} THEN 'bye' ELSE '' END AS speech,
  '00:00-00:06 ' || p_brand || CASE WHEN {_TWO} THEN chr(10) || '00:06-01:12 The end' ELSE '' END AS chapters,
  'Visual: A ' || p_name || '. Camera: pan. Story: ' || p_brand || '. Audio: hum.' || CASE WHEN {_TWO} THEN chr(10) || chr(10) || 'Visual: It stops! Story: The end. Speech: bye.' ELSE '' END AS full_text FROM part""")
def scene_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scenes(spark, sf_dir)
    kinds = [P.scene_text(F.col("s"), k).alias(k) for k in ("wan", "motion", "av", "speech", "chapters")]
    return s.select("p_partkey", *kinds, P.scene_text(F.col("s"), "full").alias("full_text"))


@query(f"""
SELECT p_partkey, '1' || chr(10) || '00:00:00,000 --> 00:00:06,000' || chr(10) || 'A ' || p_name || CASE WHEN {_TWO} THEN chr(10) || chr(10) || '2' || chr(10) || '00:00:06,000 --> 00:01:12,000' || chr(10) || 'It stops!' ELSE '' END || chr(10) AS srt,
  'WEBVTT' || chr(10) || chr(10) || '00:00:00.000 --> 00:00:06.000' || chr(10) || 'A ' || p_name || CASE WHEN {_TWO} THEN chr(10) || chr(10) || '00:00:06.000 --> 00:01:12.000' || chr(10) || 'It stops!' ELSE '' END || chr(10) AS vtt FROM part""")
def scene_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = P.scene_cues(F.col("s"), "detail")
    return scenes(spark, sf_dir).select("p_partkey", R.srt_straightened(cues).alias("srt"), R.vtt_straightened(cues).alias("vtt"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN p_size END AS k FROM part")
def json_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m = F.col("p_size").cast("string"), F.col("p_size") % 3
    answer = F.when(m == 0, F.concat(F.lit('Sure: {"k": '), s, F.lit(', "l": [1, 2,],} and [3]'))).when(m == 1, F.concat(F.lit('```JSON\n{"k": '), s, F.lit("}\n```"))).otherwise(F.lit("none {here"))
    return table(spark, sf_dir, "part").select("p_partkey", F.get_json_object(P.extract_json(answer), "$.k").cast("int").alias("k"))


@query("""
SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE role END AS reasoning, CASE turn % 3 WHEN 0 THEN 'answer' WHEN 1 THEN '' ELSE 'plain' END AS answer FROM conversations""")
def split_thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 3
    said = F.when(k == 0, F.concat(F.lit(" <think>\n"), F.col("role"), F.lit("\n</think>\n\nanswer "))).when(k == 1, F.concat(F.lit("<think>"), F.col("role"))).otherwise(" plain")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.split_thinking(said).alias("t")).select("conv_id", "turn", "t.reasoning", "t.answer")


@query(r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t, CASE doc_id % 3 WHEN 0 THEN chr(10) || '## Question 2: why?' || chr(10) || 'Because' || chr(10) || 'Answer: so' WHEN 1 THEN ' <|im_start|> user why<|im_end|> <|im_start|>assistant so' ELSE chr(10) || 'Question: why?' END AS more FROM documents),
k AS (SELECT doc_id, length(t) AS n, regexp_replace(t || more, '^\s+', '') AS whole, regexp_replace(t, '[ #-]+$', '') AS kept FROM d)
SELECT doc_id, CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 <> 2 AND length(whole) >= 160 AND n + 1 >= greatest(120, floor(length(whole) * 0.35)) AND length(kept) >= 120 THEN kept ELSE whole END AS text FROM k""")
def without_trailing_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    more = F.when(k == 0, "\n## Question 2: why?\nBecause\nAnswer: so").when(k == 1, " <|im_start|> user why<|im_end|> <|im_start|>assistant so").otherwise("\nQuestion: why?")
    d = documents(spark, sf_dir).select("doc_id", F.concat(X.collapse("text"), more).alias("t"))
    return d.select("doc_id", P.trim_trailing_qa("t", F.col("doc_id") % 4 != 0).alias("text"))


# --- lists, names, templates ---


@query("""
SELECT event_id, event_type || '|txt|srt' AS items, 'txt|' || event_type || '|srt' AS formats, (event_id % 9) || '|' || CASE WHEN event_id % 9 = 7 THEN '' ELSE '7|' END || '-1' AS numbers FROM events""")
def parsed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.upper("event_type"), F.lit(", txt; srt  TXT"))
    numbers = F.concat((F.col("event_id") % 9).cast("string"), F.lit(",x 7;-1, 7"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(X.list_items(text), "|").alias("items"), F.array_join(X.output_formats(text), "|").alias("formats"), F.array_join(X.integers(numbers), "|").alias("numbers"))


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(repeat(url, page_id % 5 + 1) || '.mp4', '[<>:"|?*/\\]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS t FROM pages)
SELECT page_id, CASE WHEN length(t) > 200 THEN regexp_replace(left(t, 196), '[ .]+$', '') || '.mp4' ELSE t END AS name FROM p""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.repeat("url", (F.col("page_id") % 5 + 1).cast("int")), F.lit(".mp4"))
    return table(spark, sf_dir, "pages").select("page_id", X.safe_name(path).alias("name"))


@query(r"""
SELECT conv_id, turn, array_to_string(list_reverse(list_filter(string_split_regex(text, '\r\n|[\n\r]'), lambda x: trim(x) <> '')), chr(10)) AS text FROM conversations""")
def lines_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.newest_first("text").alias("text"))


@query("""
SELECT doc_id, 'Video by' || coalesce(' ' || lang, '') || chr(10) || CASE WHEN doc_id % 2 = 0 OR source IS NULL THEN '' ELSE 'Says: ' || source || chr(10) END || '{{LATER}} end (' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'odd' END || ')' AS text FROM documents""")
def caption_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("doc_id") % 2 == 1
    said, mark = F.when(odd, F.concat(F.lit("Says: "), F.col("source"))), F.when(odd, "odd").otherwise(" ")
    return documents(spark, sf_dir).select("doc_id", X.render_template("Video by {{LANG}}\n{{ said }}\n{{LATER}} end ({{ODD}})\n\n\n{{SAID_LATER}}", {"LANG": F.col("lang"), "SAID": said, "ODD": mark, "SAID_LATER": F.lit(None)}).alias("text"))


@query("""
SELECT conv_id, turn, 'Describe in ' || role || ' tone.' || CASE WHEN turn % 2 = 0 THEN ' Do not mention: cars.' ELSE '' END || chr(10) || chr(10) || 'Go' AS prompt,
  CASE turn % 3 WHEN 0 THEN 'Say: $1 ' || role WHEN 1 THEN 'Base' || chr(10) || chr(10) || 'Heard: $1 ' || role ELSE 'Base' END AS spoken FROM conversations""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 3
    prompt = B.render_prompt("Describe in {{ tone }} tone.   {{AVOID}} {{nothing}}\n\n\n\nGo", {"tone": F.col("role"), "avoid": F.when(F.col("turn") % 2 == 0, "cars").otherwise(" ")}, {"TONE": "plain", "AVOID": ""})
    heard = F.when(k < 2, F.concat(F.lit("$1 "), F.col("role")))
    spoken = B.prompt_with_transcript(F.when(k == 0, "Say: {{ Transcript }}").otherwise("Base"), heard, "Heard: {{TRANSCRIPT}}")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompt.alias("prompt"), spoken.alias("spoken"))


_RUNS = r"regexp_extract_all(text, '[\p{L}\p{N}_\p{M}]+|[^\p{L}\p{N}_\p{M}]+')"


@query(rf"""
SELECT doc_id, len(list_filter({_RUNS}, lambda x: x = 'the'))::INT AS n FROM documents""")
def word_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", X.count_matches("text", "the", case_sensitive=True, whole_words=True).alias("n"))


@query(rf"""
SELECT count(*) FILTER (n > 0) AS files_changed, sum(n)::BIGINT AS replacements FROM (SELECT len(list_filter({_RUNS}, lambda x: x = 'the')) AS n FROM documents)""")
def replacement_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.find_replace_preview(documents(spark, sf_dir), "text", "doc_id", "the", "a")[0]


# --- labels ---


@query("""
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '—' WHEN event_id % 3 = 0 THEN format('{:,}', event_id * 11) ELSE format('{:,}', event_id * 11) || ' / 8,192 (' || round_even(100.0 * event_id * 11 / 8192, 0)::BIGINT || '%)' END AS usage FROM events""")
def context_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    used, limit = F.when(i % 10 == 0, F.lit(None).cast("long")).otherwise(i * 11), F.when(i % 3 != 0, 8192)
    return table(spark, sf_dir, "events").select("event_id", B.context_usage(used, limit).alias("usage"))


@query(r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, (length(text) + 3) // 4 > 512 AS big FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(left(t, 117)) || '...' END AS preview, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN big THEN '⚠' ELSE '-' END ELSE CASE WHEN big THEN '⚠ approved' ELSE 'approved' END END AS flag FROM d""")
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("doc_id") % 3 != 0, "approved")
    return documents(spark, sf_dir).select("doc_id", B.preview("text").alias("preview"), B.flag_mark(flag, X.approx_tokens("text") > 512).alias("flag"))


@query("""
SELECT source, '**' || count(*) || ' items** · ' || count(*) FILTER (trim(text) <> '') || ' captioned · ' || count(*) FILTER (doc_id % 3 = 0) || ' approved · ' || count(*) FILTER (doc_id % 7 = 0) || ' failed' AS counters FROM documents GROUP BY source""")
def item_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumns({"flag": F.when(F.col("doc_id") % 3 == 0, "approved"), "status": F.when(F.col("doc_id") % 7 == 0, "failed")})
    return d.groupBy("source").agg(B.item_counters("text", "flag", "status").alias("counters"))


@query("""
WITH e AS (SELECT event_id, floor(value * 10 + 0.5)::BIGINT AS a, floor(value * 20 + 0.5)::BIGINT AS b FROM events)
SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'film.mp4' ELSE 'film_Segments/clip_' || lpad((event_id % 100)::VARCHAR, 4, '0') || '.txt · ' || lpad((a // 600)::VARCHAR, 2, '0') || ':' || lpad(((a // 10) % 60)::VARCHAR, 2, '0') || '.' || (a % 10) || '–' || lpad((b // 600)::VARCHAR, 2, '0') || ':' || lpad(((b // 10) % 60)::VARCHAR, 2, '0') || '.' || (b % 10) END AS label,
  CASE WHEN event_id % 2 = 0 THEN (event_id % 100)::INT END AS segment, CASE WHEN value > 0 THEN value END AS start_s FROM e JOIN events USING (event_id)""")
def item_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    path = F.concat(F.when(i % 2 == 0, "/d/film_Segments/clip_").otherwise("/d/film/clip_"), F.format_string("%04d", i % 100), F.lit(".txt"))
    details = B.segment_details(path, F.lit(None), F.col("value"), F.col("value") * 2)
    e = table(spark, sf_dir, "events")
    return e.select("event_id", B.item_label(path, F.lit("/in/film.mp4"), "/d", F.col("value"), F.col("value") * 2).alias("label"), details["segment"].alias("segment"), details["start_s"].alias("start_s"))


@query("""
SELECT event_id, left('new ' || event_id || chr(10) || 'older' || chr(10) || event_type, 16) AS log FROM events""")
def merged_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array(F.lit("older"), F.lit(" "), F.concat(F.lit("new "), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", B.log_newest_first("event_type", lines, 16).alias("log"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), c AS (SELECT doc_id, t, (SELECT coalesce(max(n), 0) FROM range(greatest(0, 294 // 4), least(294, length(t)) + 1) r(n) WHERE strlen(left(t, n)) <= 294) AS n FROM d)
SELECT doc_id, CASE WHEN strlen(t) <= 300 THEN t ELSE regexp_replace(left(t, n), '\s+$', '') || chr(10) || chr(10) || 'more' END AS text FROM c""")
def capped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", B.capped_text("text", 300, "more").alias("text"))


@query("SELECT conv_id, turn, replace(text, '�', '') AS text FROM conversations")
def unscrambled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    wrong = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return c.select("conv_id", "turn", B.unscrambled(F.when(F.col("turn") % 2 == 0, wrong).otherwise(F.col("text"))).alias("text"))


@query("""
SELECT o_orderkey, c_name AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'other' ELSE o_orderstatus END AS kind, '-' AS model, (o_orderkey % 9)::BIGINT AS items, (o_orderkey % 5) || ' / 0' AS done_failed, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS created FROM orders JOIN customer ON o_custkey = c_custkey""")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("o_orderkey")
    row = B.history_row("c_name", F.when(k % 4 != 0, F.col("o_orderstatus")), F.lit(""), k % 9, k % 5, F.lit(None), "o_orderdate", "c_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", row.alias("r")).select("o_orderkey", "r.name", "r.kind", "r.model", "r.items", "r.done_failed", "r.created")


@query("SELECT event_id, greatest(0, value - 20) AS start_s, value + event_id % 3 - 21 AS end_s FROM events WHERE event_id % 5 <> 0 AND value + event_id % 3 - 21 > value - 20")
def finite_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("event_id") % 5 == 0, "nan").otherwise((F.col("value") - 20).cast("string"))
    w = B.finite_window(start, F.col("value") + F.col("event_id") % 3 - 21)
    return table(spark, sf_dir, "events").select("event_id", w.alias("w")).filter("w IS NOT NULL").select("event_id", "w.start_s", "w.end_s")


@query("""
SELECT conv_id, string_agg('<del>' || turn || '</del><ins>x</ins> &amp; y', '|' ORDER BY turn) AS diff FROM conversations GROUP BY conv_id""")
def marked_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    d = c.select("conv_id", "turn", B.marked_difference(F.concat(F.col("turn").cast("string"), F.lit(" & y")), F.lit("x & y")).alias("d"))
    parts = F.sort_array(F.collect_list(F.struct("turn", "d")))
    return d.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["d"]), "|").alias("diff"))
