"""Registered queries of phases around answers, plans and names, word cues, and listings of written files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import labels as B, text as X
from .operators import clips as K, corpus as A, render as R, structured as D, timeline as L, transcripts as W
from .plans import fitness as Z, phases as H
from .queries import _CUES, _FRAME, _STAMP, user_cues
from .registry import query, table
from .scratch import shared_path
from .sources import files as S, listing, outputs as O
from .streaming import events as E



@query("""
WITH w AS (SELECT conv_id, turn, i, (turn + i) % 4 = 0 AS silent, CASE WHEN (conv_id + i) % 5 = 0 THEN '' ELSE role || i END AS said, (conv_id * 7 + turn) % 11 = 0 AND i = 1 AS bad FROM conversations, range(3) t(i)),
s AS (SELECT conv_id, turn, bool_or(bad) AS bad, coalesce(string_agg(said, ' ' ORDER BY i) FILTER (NOT silent AND said <> ''), '') AS said, sum(CASE WHEN silent THEN 0 ELSE i + 1 END)::BIGINT AS tokens FROM w GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN turn % 6 = 5 THEN NULL WHEN bad THEN '' ELSE said END AS sound_caption, CASE WHEN turn % 6 = 5 THEN NULL WHEN bad THEN 0 ELSE 3 END AS audio_windows, CASE WHEN turn % 6 <> 5 THEN tokens END AS new_tokens, CASE WHEN turn % 6 <> 5 AND bad THEN 'OOM' END AS sound_error FROM s""")
def sound_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as clips of three windows each, some silent, some without a word, some of which failed."""
    c, t, i = table(spark, sf_dir, "conversations"), F.col("turn"), F.col("place")
    clips = c.select("conv_id", "turn", F.when(t % 6 == 5, "failed").otherwise("done").alias("status"), F.lit("/x.mp4").alias("media_path"))
    said = F.when((F.col("conv_id") + i) % 5 == 0, " ").otherwise(F.concat("role", i.cast("string")))
    w = c.select("conv_id", "turn", "role", F.explode(F.array(*[F.lit(n) for n in range(3)])).alias("place"))
    w = w.select("conv_id", "turn", "place", ((t + i) % 4 == 0).alias("silent"), said.alias("text"), F.lit(1).alias("prompt_tokens"), (i + 1).alias("new_tokens"), F.when(((F.col("conv_id") * 7 + t) % 11 == 0) & (i == 1), "OOM").alias("error"))
    return H.sound_captions(clips, w, ["conv_id", "turn"]).select("conv_id", "turn", "sound_caption", F.col("audio_windows").cast("int").alias("audio_windows"), "new_tokens", "sound_error")


@query("""
SELECT p_partkey, 'qwen3_omni_captioner_' || CASE p_partkey % 6 WHEN 0 THEN 'int8' WHEN 1 THEN 'gguf_q8' WHEN 2 THEN 'gguf_q4' WHEN 3 THEN 'int4' WHEN 4 THEN CASE WHEN p_size >= 40 OR p_partkey % 4 = 0 THEN 'bf16' ELSE 'int8' END ELSE 'own' END AS model FROM part""")
def sound_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    names = ["m_int8", "M_GGUF_Q8_0", "m_gguf_q4", "m_int4", "m_bf16", "qwen3_omni_captioner_own"]
    variant = F.element_at(F.array(*[F.lit(n) for n in names]), (k % 6 + 1).cast("int"))
    model = H.sound_model(variant, F.when(k % 4 == 0, "qwen3_omni_thinking"), (F.col("p_size") * 2).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", model.alias("model"))


@query("""
SELECT doc_id AS item, CASE WHEN doc_id % 5 < 3 THEN regexp_replace(text, '[\\r\\n]+$', '') ELSE '' END AS caption, CASE doc_id % 5 WHEN 0 THEN '/o/video_caption/' || doc_id || '.txt' WHEN 1 THEN '/o/' || doc_id || '.txt' WHEN 2 THEN '/in/' || doc_id || '.txt' END AS video_path, CASE WHEN doc_id % 5 < 3 THEN 'Existing video caption loaded for ' || doc_id || '.mp4.' ELSE 'No existing video caption for ' || doc_id || '.mp4; audio caption will be saved separately' END AS message FROM documents WHERE text IS NOT NULL""".replace("\\\\", "\\"))
def existing_video_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose captions lie as a part, merged, beside the medium, or nowhere."""
    d, i, k = table(spark, sf_dir, "documents").filter("text IS NOT NULL"), F.col("doc_id").cast("string"), F.col("doc_id") % 5
    items = d.select(F.col("doc_id").alias("item"), F.lit("/o").alias("folder"), i.alias("stem"), F.concat(F.lit("/in/"), i, F.lit(".mp4")).alias("path"), F.lit(1.0).alias("duration"))
    at = F.when(k == 0, F.concat(F.lit("/o/video_caption/"), i, F.lit(".txt"))).when(k == 1, F.concat(F.lit("/o/"), i, F.lit(".txt"))).when(k == 2, F.concat(F.lit("/in/"), i, F.lit(".txt")))
    return H.existing_units(items, d.select(at.alias("path"), F.col("text").alias("content"))).select("item", "caption", "video_path", "message")


_LINE = "lpad((turn * 9 // 60)::VARCHAR, 2, '0') || ':' || lpad((turn * 9 % 60)::VARCHAR, 2, '0') || '-' || lpad(((turn * 9 + 8) // 60)::VARCHAR, 2, '0') || ':' || lpad(((turn * 9 + 8) % 60)::VARCHAR, 2, '0') || ' ' || regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"


@query(f"""
WITH c AS (SELECT conv_id, turn, {_LINE} AS line, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS behind, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM c WHERE n > 1),
k AS (SELECT conv_id, max(n) - count(*) AS gone, string_agg(line, chr(10) ORDER BY turn) AS lines, arg_max(line, turn) AS newest FROM s WHERE 9 + 2 + behind <= 2400 OR back = 1 GROUP BY conv_id)
SELECT conv_id AS item, CASE WHEN 11 + length(lines) <= 2400 THEN 'Summarize' || chr(10) || chr(10) || lines ELSE 'Summarize' || chr(10) || chr(10) || right(newest, 2389) END AS input, (gone + CASE WHEN 11 + length(lines) > 2400 THEN 1 ELSE 0 END)::INT AS left_out FROM k""")
def summary_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is asked to sum up of each conversation, in 2400 characters."""
    t = F.col("turn")
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item"), t.alias("index"), (t * 9.0).alias("start_s"), (t * 9 + 8.0).alias("end_s"), F.col("text").alias("caption"), F.lit("done").alias("status"))
    items = c.select("item").distinct().select("item", F.lit("qwen3_omni_instruct").alias("family"), F.lit(1000).alias("context_tokens"), F.lit(400).alias("answer_tokens"))
    return H.summary_inputs(items, c, F.lit("Summarize"))


@query("""
WITH i AS (SELECT user_id AS run, '/src/' || event_type || '/' || (event_id % 40) || '.mp4' AS path, min(event_id) AS place FROM events GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY place, path) - 1 AS "index", count(*) OVER (PARTITION BY run) > 1 AS batch FROM i),
o AS (SELECT *, CASE WHEN batch THEN '/out/' || split_part(path, '/', 3) ELSE '/runs/' || run END AS out_dir, regexp_extract(path, '([^/]+)\\.mp4$', 1) AS stem FROM n),
d AS (SELECT *, out_dir || '/' || stem || '.srt' AS expected, batch AND stem::INT % 7 = 0 AS done FROM o), l AS (SELECT *, batch AND sum(CASE WHEN done THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY place, path) > 20 AS over FROM d)
SELECT run, "index"::INT AS "index", out_dir, CASE WHEN done OR "over" THEN 'skipped' ELSE 'pending' END AS status, CASE WHEN done THEN 'Transcript already exists: ' || expected WHEN "over" THEN 'Excluded by batch limit of 20 item(s).' END AS message FROM l""".replace("\\\\", "\\").replace(" AS over", ' AS "over"'))
def transcription_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as runs over media, of which every seventh is transcribed already, 20 at most each."""
    n = (F.col("event_id") % 40).cast("string")
    path = F.concat(F.lit("/src/"), "event_type", F.lit("/"), n, F.lit(".mp4"))
    e = table(spark, sf_dir, "events")
    inputs = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("place"), path.alias("path"), F.concat(F.lit("/runs/"), F.col("user_id").cast("string")).alias("run_dir"), F.lit("/src").alias("source_root"), F.lit("/out").alias("output_root"), F.lit(False).alias("folder_mode"))
    there = e.filter(F.col("event_id") % 40 % 7 == 0).select(F.concat(F.lit("/out/"), "event_type", F.lit("/"), n, F.lit(".srt")).alias("path"))
    return H.transcription_plan(inputs, there, limit=20).select("run", F.col("index").cast("int").alias("index"), "out_dir", "status", "message")


@query("""
WITH m AS (SELECT source, CASE doc_id % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' WHEN 2 THEN 'image' ELSE 'text' END AS kind, doc_id % 3 = 0 AS has, doc_id % 9 = 0 AS heard FROM documents WHERE source IS NOT NULL),
c AS (SELECT source, count(*) FILTER (kind = 'video') AS v, count(*) FILTER (kind = 'audio') AS a, count(*) FILTER (kind = 'image') AS i, count(*) FILTER (kind = 'text') AS t, count(*) AS n, count(*) FILTER (has) AS e, count(*) FILTER (heard) AS h FROM m GROUP BY source)
SELECT '/m/' || source AS root, '🎬 ' || v || ' videos · 🎵 ' || a || ' audios · 🖼️ ' || i || ' images · 📄 ' || t || ' texts · ' || n || ' media files · ' || e || ' already captioned (&lt;stem&gt;.txt) · ' || h || ' with audio captions (audio_caption/) · outputs in output folder. Overwrite is off; existing captions will be skipped.' AS line FROM c""")
def folder_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each source, every third medium captioned, every ninth with its sound."""
    d, k, i = table(spark, sf_dir, "documents").filter("source IS NOT NULL"), F.col("doc_id"), F.col("doc_id").cast("string")
    root = F.concat(F.lit("/m/"), "source")
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".mp4", ".wav", ".png", ".txt")]), (k % 4 + 1).cast("int"))
    media = listing.describe_paths(d.select(root.alias("root"), F.concat(root, F.lit("/a/"), i, suffix).alias("path")), "path")
    caption = lambda part: F.concat(F.lit("/o/"), "source", F.lit(f"/a/{part}"), i, F.lit(".txt"))
    there = d.filter(k % 3 == 0).select(caption("").alias("path")).unionByName(d.filter(k % 9 == 0).select(caption("audio_caption/").alias("path")))
    out = F.concat(F.lit("/o/"), F.element_at(F.split("root", "/"), -1))
    return H.folder_facts(media, there, output_root=out, coverage=True).select("root", "line")


@query("""
WITH w AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT event_id, '/p/' || user_id || CASE WHEN user_id % 2 = 1 AND p = 1 THEN '' ELSE '_' || lpad((p - CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN user_id % 2 = 0 AND p >= 3 THEN 1 ELSE 0 END)::VARCHAR, 4, '0') END || '.json' AS path FROM w""")
def free_plan_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named after their users; those of even ones, and the third of these, are there already."""
    e, u = table(spark, sf_dir, "events"), F.col("user_id").cast("string")
    there = e.filter("user_id % 2 = 0").select(F.explode(F.array(F.concat(F.lit("/p/"), u, F.lit(".json")), F.concat(F.lit("/p/"), u, F.lit("_0003.json")))).alias("path"))
    return H.free_names(e.select("event_id", F.lit("/p").alias("f"), u.alias("s")), there, "f", "s", ["event_id"]).select("event_id", "path")


@query("""
SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE n_name END AS title, CASE WHEN c_nationkey % 3 = 0 THEN 'Unknown: x' || c_nationkey END AS error, CASE WHEN c_custkey % 2 = 0 THEN 'fam' || n_regionkey END AS family FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def presets_and_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations as presets looked up by id, and as variants by an alias in other letters."""
    n = table(spark, sf_dir, "nation")
    presets = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"))
    variants = n.select(F.lower("n_name").alias("key"), F.array(F.concat(F.lit("Alias "), F.col("n_nationkey").cast("string"))).alias("aliases"), F.concat(F.lit("fam"), F.col("n_regionkey").cast("string")).alias("family"))
    key = F.col("c_nationkey").cast("string")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.when(F.col("c_nationkey") % 3 == 0, "x").otherwise(""), key).alias("preset"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" ALIAS "), key)).otherwise("none").alias("variant"))
    return H.family_of(H.looked_up(c, presets, "preset"), variants).select("c_custkey", "title", "error", "family")


@query("""
SELECT CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'file ' || s_suppkey END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'say' END AS user_prompt FROM supplier WHERE s_suppkey % 5 <> 0""")
def prompt_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, i = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    doc = F.to_json(F.struct(F.when(k % 3 == 0, F.col("s_name")).alias("name"), F.when(k % 2 == 0, "say").alias("user_prompt")))
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("/p/file "), i, F.lit(".json")).alias("path"), F.when(k % 5 == 0, "[broken").otherwise(doc).alias("content"))
    return H.prompt_entries(files).select("name", "user_prompt")


@query(f"""
WITH RECURSIVE c AS (SELECT user_id, s, {_FRAME.format('s')} AS a, {_FRAME.format('e')} AS b, row_number() OVER (PARTITION BY user_id ORDER BY s, e) AS i FROM ({_CUES}) WHERE day < 19726),
r AS (SELECT user_id, i, a AS x, CASE WHEN b <= a THEN a + 41708 ELSE b END AS y FROM c WHERE i = 1 UNION ALL SELECT user_id, i, x, CASE WHEN b <= x THEN x + 41708 ELSE b END FROM (SELECT c.user_id, c.i, c.b, CASE WHEN abs(c.s - r.y / 1000000.0) <= 0.5 / 23.976 + 1e-6 THEN r.y ELSE c.a END AS x FROM r JOIN c ON c.user_id = r.user_id AND c.i = r.i + 1))
SELECT user_id, x AS start_us, y AS end_us FROM r""")
def snapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' cues of some days, on one clock of a day, in whole frames."""
    c = user_cues(spark, sf_dir).filter("day < 19726").select("user_id", F.explode("cues").alias("c")).select("user_id", "c.start_s", "c.end_s")
    return L.snap_rows(c, ["user_id"], 23.976)


# --- words ---


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a segment of three words, a second each from its value on."""
    v = F.col("value")
    word = lambda i, w: F.struct((v + float(i)).alias("start_s"), (v + float(i + 1)).alias("end_s"), w.alias("word"))
    words = F.array(word(0, F.lit(" one")), word(1, F.concat(F.lit(" "), F.col("event_type"))), word(2, F.lit(" -->x")))
    timed = F.when(F.col("event_id") % 3 > 0, words)
    segment = F.struct(v.alias("start_s"), (v + 3.0).alias("end_s"), F.concat(F.lit(" one "), F.col("event_type"), F.lit(" -->x ")).alias("text"), timed.alias("words"))
    return table(spark, sf_dir, "events").select("event_id", "value", F.array(segment).alias("segments"))


@query("""
WITH e AS (SELECT event_id, value AS v, event_type AS t, event_id % 3 > 0 AS worded, floor(value) + 1.5 AS a, floor(value) + 4.0 AS b FROM events),
w AS (SELECT event_id, i, v + i AS s, v + i + 1 AS z, CASE i WHEN 0 THEN ' one' WHEN 1 THEN ' ' || t ELSE ' -->x' END AS word FROM e, range(3) r(i) WHERE worded AND v + i + 1 > a AND v + i < b),
k AS (SELECT event_id, min(s) AS s, max(z) AS z, trim(string_agg(word, '' ORDER BY i)) AS text FROM w GROUP BY event_id)
SELECT e.event_id, round(greatest(coalesce(k.s, e.v), a) - a, 6) AS start_s, round(greatest(greatest(coalesce(k.s, e.v), a) - a, least(coalesce(k.z, e.v + 3), b) - a), 6) AS end_s, coalesce(k.text, 'one ' || t || ' -->x') AS text FROM e LEFT JOIN k USING (event_id) WHERE e.v + 3 > a AND e.v < b AND (NOT worded OR k.text IS NOT NULL)""")
def clip_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said in a window of two and a half seconds, word by word where words have times."""
    c = spoken(spark, sf_dir).select("event_id", F.explode(K.clip_segments(F.col("segments"), F.floor("value") + 1.5, F.floor("value") + 4.0)).alias("c"))
    return c.select("event_id", F.round("c.start_s", 6).alias("start_s"), F.round("c.end_s", 6).alias("end_s"), "c.text")


@query("SELECT event_id, value AS start_s, value + 3 AS end_s, 'one ' || event_type || ' ->x' AS text FROM events")
def words_as_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spoken(spark, sf_dir).select("event_id", F.explode(K.word_cues(F.col("segments"))).alias("c"))
    return c.select("event_id", "c.start_s", "c.end_s", "c.text")


@query("""
WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role FROM conversations), l AS (SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS whole FROM c GROUP BY conv_id)
SELECT c.conv_id, (c.turn * 2)::DOUBLE AS start_s, (c.turn * 2 + 1)::DOUBLE AS end_s, (SELECT string_agg(CASE WHEN o.turn = c.turn THEN '<u>' || o.role || '</u>' ELSE o.role END, ' ' ORDER BY o.turn) FROM c o WHERE o.conv_id = c.conv_id) AS text FROM c
UNION ALL SELECT c.conv_id, (p.turn * 2 + 1)::DOUBLE, (c.turn * 2)::DOUBLE, whole FROM c JOIN c p ON c.conv_id = p.conv_id AND p.i = c.i - 1 JOIN l ON l.conv_id = c.conv_id""")
def highlighted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns' roles as words of a second with a second between, each underlined in turn."""
    w = F.struct((F.col("turn") * 2.0).alias("start_s"), (F.col("turn") * 2 + 1.0).alias("end_s"), F.col("role").alias("text"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(w)).alias("w"))
    return c.select("conv_id", F.explode(R.highlight(F.col("w"))).alias("h")).select("conv_id", "h.*")


@query("""
WITH RECURSIVE w AS (SELECT page_id, list_filter(string_split(replace(url, '/', ' '), ' '), lambda x: x <> '') AS ws FROM pages),
r AS (SELECT page_id, ws, 1 AS i, ws[1] AS done, ws[1] AS line FROM w UNION ALL SELECT page_id, ws, i + 1, done || CASE WHEN length(line) + 1 + length(ws[i + 1]) <= 20 THEN ' ' ELSE chr(10) END || ws[i + 1], CASE WHEN length(line) + 1 + length(ws[i + 1]) <= 20 THEN line || ' ' || ws[i + 1] ELSE ws[i + 1] END FROM r WHERE i < len(ws))
SELECT page_id, done AS text FROM r WHERE i = len(ws)""")
def wrapped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses' parts as words, in lines of 20 characters."""
    return table(spark, sf_dir, "pages").select("page_id", R.wrap(F.replace("url", F.lit("/"), F.lit(" ")), 20).alias("text"))


@query(f"""
WITH c AS (SELECT user_id, day, text, {_STAMP.format('a', ',')} || ' --> ' || {_STAMP.format('b', ',')} AS times, row_number() OVER (PARTITION BY user_id, day ORDER BY s, e, text) AS i FROM ({_CUES}))
SELECT user_id, day, string_agg(i || chr(10) || times || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS preview FROM c WHERE i <= 2 GROUP BY user_id, day""")
def first_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two cues of each user's day as they stand in its file."""
    c = user_cues(spark, sf_dir).select("user_id", "day", R.srt(F.col("cues")).alias("srt"))
    return c.select("user_id", "day", B.first_cues("srt", 2).alias("preview"))


# --- files and events ---


@query("SELECT 'd' || (doc_id % 7) || '/' || CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id || CASE doc_id % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '.txt' ELSE '.bin' END END AS path, CASE doc_id % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'text' ELSE 'unknown' END AS kind, strlen(source)::BIGINT AS size FROM documents WHERE doc_id % 11 <> 0 AND source IS NOT NULL AND source <> ''")
def files_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written for the documents, listed without being read; hidden ones are left out."""
    k, folder = F.col("doc_id"), shared_path(spark, "listed")
    name = F.concat(F.when(k % 11 == 0, ".").otherwise(""), k.cast("string"), F.when(k % 3 == 0, ".mp4").when(k % 3 == 1, ".txt").otherwise(".bin"))
    S.write_files(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), (k % 7).cast("string"), F.lit("/"), name).alias("path"), F.col("source").alias("content")), folder)
    return listing.list_files(spark, folder).select(F.concat(F.element_at(F.split("dir", "/"), -1), F.lit("/"), F.col("name")).alias("path"), "kind", F.col("size").cast("long").alias("size"))


@query("SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) - 300 FROM events)")
def logs_since_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader whose place is ahead of the log gets its newest 300 rows."""
    return E.since(table(spark, sf_dir, "events"), "event_id", 1 << 60).select("event_id")


@query("SELECT event_id, event_type AS ev FROM events WHERE event_type IN ('click', 'error')")
def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.by_type(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("ev")), ["click", "error"])
    return found["click"].unionByName(found["error"])


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 newest orders, ties by the numbers in their names."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.concat(F.lit("run "), F.col("o_orderkey").cast("string")).alias("name"))
    return A.recent(o, "o_orderdate", "name").select("o_orderkey")


# --- documents and frames ---


@query(r"""
SELECT conv_id, turn, '{"caption":' || to_json(trim(regexp_replace(t, '\s+', ' ', 'g')))::VARCHAR || ',"id":' || to_json(t)::VARCHAR || ',"segments":[{"text":' || to_json(trim(regexp_replace(t, '\s+', ' ', 'g')))::VARCHAR || ',"n":1}]}' AS document FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)""")
def finalized_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured answers whose captions have their white space drawn together, ids as they are."""
    t = F.coalesce("text", F.lit(""))
    document = F.to_json(F.struct(t.alias("caption"), t.alias("id"), F.array(F.struct(t.alias("text"), F.lit(1).alias("n"))).alias("segments")))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", document.alias("document"))
    return D.finalized_documents(c, ["conv_id", "turn"], "document", lambda name: X.collapse(name))


@query("""
WITH p AS (SELECT p_partkey, (p_size % 5)::DOUBLE AS a, least(p_size * 0.7::DOUBLE, 30.0) AS z, (10 + p_partkey % 3 * 10)::DOUBLE AS fps FROM part),
n AS (SELECT *, greatest(z - 0.5 / fps, a) AS last, least(24, greatest(4, round_even(greatest(4, ceil((z - a) * 2)) / 4, 0) * 4))::BIGINT AS n FROM p WHERE z > a)
SELECT p_partkey, i, round(CASE WHEN i = n - 1 THEN last ELSE a + i * ((last - a) / (n - 1)) END, 9) AS at FROM (SELECT *, unnest(range(0, n)) AS i FROM n)""")
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames a second of parts as clips, in fours, 24 at most."""
    k, size = F.col("p_partkey"), F.col("p_size")
    times = D.wanted_times((size % 5).cast("double"), size * 0.7, F.lit(30.0), (10 + k % 3 * 10).cast("double"), F.lit(None).cast("int"), strategy="fps", target_fps=2.0, most=25, least=4, factor=4)
    t = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(times).alias("i", "at"))
    return t.select("p_partkey", F.col("i").cast("long").alias("i"), F.round("at", 9).alias("at"))


# --- transcripts ---


@query("""
WITH e AS (SELECT event_id, event_type AS t, event_id % 3 > 0 AS worded, round_even(value * 1000, 0)::BIGINT AS a, round_even((value + 1) * 1000, 0)::BIGINT AS b, round_even((value + 2) * 1000, 0)::BIGINT AS c, round_even((value + 3) * 1000, 0)::BIGINT AS d FROM events),
s AS (SELECT *, """ + ", ".join(f"lpad(({x} // 60000)::VARCHAR, 2, '0') || ':' || lpad((({x} // 1000) % 60)::VARCHAR, 2, '0') || '.' || lpad(({x} % 1000)::VARCHAR, 3, '0') AS s{x}" for x in "abcd") + """ FROM e)
SELECT event_id, CASE WHEN worded THEN '[' || sa || ']one [' || sb || '] ' || t || ' [' || sc || '] -->x[' || sd || ']' ELSE '[' || sa || ']one ' || t || ' ->x[' || sd || ']' END || chr(10) || chr(10) AS lrc,
  'WEBVTT' || chr(10) || chr(10) || CASE WHEN worded THEN sa || ' --> ' || sb || chr(10) || '<u>one</u> ' || t || ' ->x' || chr(10) || chr(10) || sb || ' --> ' || sc || chr(10) || 'one <u>' || t || '</u> ->x' || chr(10) || chr(10) || sc || ' --> ' || sd || chr(10) || 'one ' || t || ' <u>->x</u>' ELSE sa || ' --> ' || sd || chr(10) || 'one ' || t || ' ->x' END || chr(10) || chr(10) AS vtt FROM s""")
def marked_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of three words as lyrics aligned to them and as subtitles that mark each in turn."""
    s = F.col("segments")
    return spoken(spark, sf_dir).select("event_id", W.transcript_document(s, "lrc", highlight=True).alias("lrc"), W.transcript_document(s, "vtt", highlight=True).alias("vtt"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'one ' || event_type || ' ->x' ELSE ' one ' || event_type || ' -->x ' END AS text FROM events""")
def recut_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of one sentence each: those with timed words from these, others as they are."""
    c = spoken(spark, sf_dir).select("event_id", F.explode(W.recut(F.col("segments"))).alias("c"))
    return c.select("event_id", "c.text")


# --- outputs ---


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, '.txt' AS suffix, CASE WHEN t = '' OR t LIKE '%' || chr(10) THEN t ELSE t || chr(10) END AS content FROM d
UNION ALL SELECT doc_id, '_reasoning.txt', 'because' || chr(10) FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, '.jsonl', CASE WHEN doc_id % 3 = 0 THEN '{"a":1}' || chr(10) || '"b"' || chr(10) ELSE '{"text":' || to_json(t)::VARCHAR || '}' || chr(10) END FROM d)
SELECT '/o/clip ' || doc_id || suffix AS path, md5(content) AS digest FROM f""")
def caption_form_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a caption in text and JSON lines, every second with its reasoning."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("/o/").alias("folder"), F.concat(F.lit("x/clip "), k.cast("string"), F.lit(".mp4")).alias("stem"), F.when(k % 3 == 0, '[{"a": 1}, "b"]').alias("answer"), F.when(k % 2 == 0, "because").otherwise(" ").alias("why"))
    made = O.caption_files(d, ["doc_id"], "folder", "stem", ["jsonl", "reasoning", "srt"], text="text", structured="answer", reasoning="why")
    return made.select("path", F.md5("content").alias("digest"))


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size * 9 ELSE floor(p_size * 0.4::DOUBLE * (12 + p_partkey % 3 * 6) + 1e-9) END::BIGINT AS a, (200 + p_partkey % 1900)::DOUBLE AS w, (150 + p_partkey % 1100)::DOUBLE AS h FROM part),
s AS (SELECT *, CASE WHEN least(a, 129) >= 5 THEN (least(a, 129) - 1) // 4 * 4 + 1 END AS s FROM p)
SELECT p_partkey, a AS available, CASE WHEN a < 81 THEN 'will be dropped: ' || a || 'f < 81f' WHEN a // 81 >= 2 THEN 'sub-split ×' || (a // 81) || ' suggested' ELSE 'OK ' || s || 'f' END AS verdict, CASE WHEN a < 81 THEN 'will be dropped by trainer: only ' || a || ' frames, needs 81' WHEN s <> a THEN 'trainer will use ' || s || ' valid frames from ' || a || ' available' ELSE '' END AS warning, CASE WHEN w < h THEN 480 ELSE 832 END::BIGINT AS width FROM s""")
def fitness_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a trainer makes of parts as clips."""
    k, size = F.col("p_partkey"), F.col("p_size")
    clips = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 5 == 0, size * 9).alias("frames"), (size * 0.4).alias("duration_s"), (12 + k % 3 * 6).alias("fps"), (200 + k % 1900).alias("width"), (150 + k % 1100).alias("height"))
    made = Z.clip_fitness(clips, "wan", "480p", "letterbox")
    return made.select("p_partkey", "available", "verdict", F.array_join("warnings", "; ").alias("warning"), F.col("bucket.width").alias("width"))


@query("""
WITH p AS (SELECT p_brand, p_size * 9 AS a FROM part)
SELECT p_brand, '**' || count(*) || ' clips** · ' || count(*) FILTER (a >= 81 AND a // 81 < 2) || ' ready · ' || count(*) FILTER (a < 81) || ' will be dropped · ' || count(*) FILTER (a // 81 >= 2) || ' sub-split suggestions' AS line FROM p GROUP BY p_brand""")
def fitness_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("double")
    clips = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") * 9).alias("frames"), none.alias("duration_s"), none.alias("fps"), none.alias("width"), none.alias("height"))
    return Z.fitness_summary(Z.clip_fitness(clips, "wan", "480p"), ["p_brand"]).select("p_brand", "line")
