"""Registered queries of listings, sidecars, run documents, catalogues and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .operators import metadata as M
from .plans import batch as B, catalogue as G
from .registry import query, table
from .sources import listing as S, sinks


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of document numbers: three files to a stem, in folders with repeats and part folders."""
    g, k = F.floor(F.col("doc_id") / 3), F.col("doc_id") % 3
    folder = F.concat(F.lit("/data/"), F.when(g % 5 == 0, F.concat((g % 3 + 2).cast("string"), F.lit("_set"), (g % 7).cast("string"))).otherwise(F.concat(F.lit("set"), (g % 7).cast("string"))), F.when(g % 11 == 0, "/video_caption").otherwise(""))
    suffix = F.when(k == 0, ".mp4").when(k == 1, F.when(g % 4 == 0, ".json").otherwise(".txt")).otherwise(F.when(g % 2 == 0, ".PNG").otherwise(".wav"))
    name = F.concat(F.lit("/Clip "), g.cast("string"), F.when((k == 1) & (g % 6 == 1), "_raw").otherwise(""), suffix)
    return S.describe_paths(table(spark, sf_dir, "documents").select("doc_id", F.concat(folder, name).alias("path")), "path")


LISTED = r"""SELECT doc_id, dir, dir || '/' || name AS path, name, regexp_replace(name, '\.[^.]+$', '') AS stem, lower(suffix) AS suffix, CASE lower(suffix) WHEN '.mp4' THEN 'video' WHEN '.txt' THEN 'text' WHEN '.png' THEN 'image' WHEN '.wav' THEN 'audio' ELSE 'unknown' END AS kind, g % 11 = 0 AS part
FROM (SELECT *, 'Clip ' || g || CASE WHEN k = 1 AND g % 6 = 1 THEN '_raw' ELSE '' END || suffix AS name, '/data/' || CASE WHEN g % 5 = 0 THEN (g % 3 + 2) || '_set' || (g % 7) ELSE 'set' || (g % 7) END || CASE WHEN g % 11 = 0 THEN '/video_caption' ELSE '' END AS dir
FROM (SELECT *, CASE k WHEN 0 THEN '.mp4' WHEN 1 THEN CASE WHEN g % 4 = 0 THEN '.json' ELSE '.txt' END ELSE CASE WHEN g % 2 = 0 THEN '.PNG' ELSE '.wav' END END AS suffix FROM (SELECT doc_id, doc_id // 3 AS g, doc_id % 3 AS k FROM documents)))"""


@query(f"SELECT doc_id, dir, stem, suffix, kind, part FROM ({LISTED})")
def file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir).select("doc_id", "dir", "stem", "suffix", "kind", S.in_part_folder("dir").alias("part"))


@query(f"SELECT doc_id FROM ({LISTED}) WHERE kind IN ('video', 'image') AND (name LIKE 'Clip 1%' OR name LIKE '%.PNG') AND NOT part")
def selected_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select_media(listed(spark, sf_dir), ["video", "image"], "Clip 1*; *.PNG").select("doc_id")


@query(f"""
WITH f AS ({LISTED}), m AS (SELECT DISTINCT dir, lower(stem) AS s FROM f WHERE kind IN ('video', 'audio', 'image'))
SELECT doc_id FROM f WHERE kind <> 'text' OR (NOT part AND NOT EXISTS (SELECT 1 FROM m WHERE m.dir = f.dir AND m.s IN (lower(f.stem), regexp_replace(lower(f.stem), '_[^_]*$', ''))))""")
def without_sidecar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.without_sidecars(listed(spark, sf_dir)).select("doc_id")


@query(f"""
WITH f AS ({LISTED}), c AS (SELECT dir, lower(stem) AS s, arg_min(path, CASE suffix WHEN '.txt' THEN 1 ELSE 2 END) AS caption_path FROM f WHERE suffix IN ('.txt', '.json') GROUP BY ALL)
SELECT f.doc_id, c.caption_path FROM f LEFT JOIN c ON f.dir = c.dir AND lower(f.stem) = c.s WHERE f.kind = 'video'""")
def caption_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = listed(spark, sf_dir)
    return S.pair_captions(f.filter("kind = 'video'"), f.filter("suffix IN ('.txt', '.json')")).select("doc_id", "caption_path")


@query(rf"""
WITH f AS (SELECT dir, count(*) FILTER (kind = 'video') AS v, count(*) FILTER (kind = 'image') AS i FROM ({LISTED}) GROUP BY dir)
SELECT dir, regexp_replace(regexp_extract(dir, '[^/]+$'), '^\d+_', '') AS name, coalesce(try_cast(nullif(regexp_extract(dir, '/(\d+)_[^/]+$', 1), '') AS INT), 1) AS repeats, CASE WHEN v > 0 AND i > 0 THEN 'mixed' WHEN v > 0 THEN 'video' ELSE 'image' END AS kind, (v + i)::BIGINT AS n FROM f WHERE v + i > 0""")
def dataset_folder_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dataset_folders(listed(spark, sf_dir))


@query(f"SELECT DISTINCT dir FROM ({LISTED}) WHERE length(dir) - length(replace(dir, '/', '')) = 2 AND suffix IN ('.txt', '.json')")
def scanned_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.scan_folders(listed(spark, sf_dir), "/data", recursive=False)


@query(f"SELECT doc_id, replace(path, 'video_caption', 'Clip_Fitness') LIKE '/data/%/Clip_Fitness/%' AS planned FROM ({LISTED})")
def fitness_plan_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir).select("doc_id", M.in_plan_folder(F.replace("path", F.lit("video_caption"), F.lit("Clip_Fitness")), "/data").alias("planned"))


@query(f"SELECT doc_id, dir || '/video_caption/' || stem || '.txt' AS video, dir || '/audio_caption/' || stem || '.txt' AS audio, dir || '/' || stem || '.txt' AS merged FROM ({LISTED})")
def unit_path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir).select("doc_id", M.unit_paths("dir", "stem").alias("p")).select("doc_id", "p.*")


@query("""
SELECT doc_id, 'a/' || doc_id || '.mp4' AS path, 'approved' AS flag FROM documents UNION ALL SELECT doc_id, 'b', 'rejected' FROM documents""")
def flags_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit('{"a/'), F.col("doc_id").cast("string"), F.lit('.mp4": "Approved", "../up": "rejected", "/root": "approved", "b": {"flag": "rejected"}}'))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(S.read_flags(doc)).alias("f")).select("doc_id", "f.path", "f.flag")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'c' || doc_id WHEN doc_id % 3 = 1 THEN '{\"other\": 1}' ELSE text END AS caption FROM documents")
def caption_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    content = F.when(k == 0, F.concat(F.lit('{"caption": "c'), F.col("doc_id").cast("string"), F.lit('"}'))).when(k == 1, F.lit('{"other": 1}')).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", S.caption_text(F.when(k < 2, "/x.JSON").otherwise("/x.txt"), content).alias("caption"))


def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, json``: a run's metadata with one item and one segment for each document."""
    i = F.col("doc_id").cast("string")
    parts = ['{"_meta":{"format":"run","version":', (F.col("doc_id") % 2 + 1).cast("string"), '},"app_version":"1","model_info":{},"settings":{},"timings":{},"items_results":[{"path":"/in/', i, '.mp4","status":"', F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("done"), '","outputs":{"txt":"/out/', i, '.txt","transcript_srt":"/out/', i, '.srt"},"segments":[{"start_s":1.5,"end_s":3.0,"outputs":{"txt":"/out/', i, '_1.txt"}}]}]}']
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("json"))


@query("""
SELECT doc_id, '/in/' || doc_id || '.mp4' AS source_path, 'txt' AS output_key, '/out/' || doc_id || '.txt' AS output_path, NULL::DOUBLE AS start_s, NULL::DOUBLE AS end_s FROM documents
UNION ALL SELECT doc_id, '/in/' || doc_id || '.mp4', 'txt', '/out/' || doc_id || '_1.txt', 1.5, 3.0 FROM documents""")
def run_document_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_documents(spark, sf_dir).select("doc_id", F.explode(S.metadata_outputs("json")).alias("o")).select("doc_id", "o.*")


@query("SELECT doc_id, '/in/' || doc_id || '.mp4' AS path FROM documents WHERE doc_id % 4 = 0")
def failed_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_documents(spark, sf_dir).select("doc_id", F.explode(S.failed_paths("json")).alias("path"))


@query("SELECT doc_id, doc_id % 2 = 0 AS valid, doc_id % 5 <> 0 AS whole FROM documents")
def document_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("doc_id") % 5 == 0, F.substring("json", F.lit(1), F.length("json") - 1)).otherwise(F.col("json"))
    return run_documents(spark, sf_dir).select("doc_id", M.valid_metadata("json", ["run"]).alias("valid"), M.bounded_json(broken, 5000).isNotNull().alias("whole"))


_OUTPUTS = "SELECT user_id AS item, event_id % 3 AS part, event_id AS place, '/out/' || (event_id * 7 % 900) || CASE WHEN event_id % 5 = 0 THEN '.png' ELSE '.TXT' END AS output_path, CASE event_type WHEN 'view' THEN 'transcript_srt' WHEN 'signup' THEN 'Reasoning' ELSE 'txt' END AS output_key, '/in/' || user_id AS source_path, value AS start_s, value + 1 AS end_s FROM events"


@query(f"""
SELECT output_path AS caption_path, source_path, output_key, start_s, end_s FROM ({_OUTPUTS}) WHERE output_key = 'txt' AND output_path LIKE '%.TXT' QUALIFY row_number() OVER (PARTITION BY output_path ORDER BY item DESC, part DESC, place DESC) = 1""")
def index_of_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    path = F.concat(F.lit("/out/"), (i * 7 % 900).cast("string"), F.when(i % 5 == 0, ".png").otherwise(".TXT"))
    key = F.when(F.col("event_type") == "view", "transcript_srt").when(F.col("event_type") == "signup", "Reasoning").otherwise("txt")
    rows = e.select(F.col("user_id").alias("item"), (i % 3).alias("part"), i.alias("place"), path.alias("output_path"), key.alias("output_key"), F.concat(F.lit("/in/"), F.col("user_id").cast("string")).alias("source_path"), F.col("value").alias("start_s"), (F.col("value") + 1).alias("end_s"))
    return M.captions_index(rows)


@query("""
WITH r AS (SELECT s_suppkey AS run, s_acctbal AS modified FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10)
SELECT 'C' || (l_partkey % 300) AS caption_path, run FROM lineitem JOIN r ON l_suppkey = run QUALIFY row_number() OVER (PARTITION BY l_partkey % 300 ORDER BY modified DESC, run) = 1""")
def newest_caption_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run"), F.col("s_acctbal").alias("modified"))
    records = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), F.concat(F.lit("C"), (F.col("l_partkey") % 300).cast("string")).alias("caption_path"))
    return M.caption_lookup(runs, records, 10).select("caption_path", "run")


@query("SELECT c_custkey AS run, CASE WHEN c_nationkey % 2 = 0 THEN 'index' ELSE 'metadata' END AS origin FROM customer")
def preferred_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"), "c_nationkey")
    both = c.select("run", F.lit("metadata").alias("origin")).unionByName(c.filter("c_nationkey % 2 = 0").select("run", F.lit("index").alias("origin")))
    return M.records_of(both)


def document_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 1").select(F.concat(F.lit("/data/set"), F.col("n_nationkey").cast("string")).alias("folder"))
    return n.unionByName(spark.createDataFrame([("/data",), ("/",)], "folder string"))


@query(f"""
SELECT path AS caption_path, CASE WHEN regexp_extract(dir, '^/data/set([0-9])(/|$)', 1) IN ('1', '3', '5') THEN regexp_extract(dir, '^/data/set[0-9]') ELSE '/data' END AS folder FROM ({LISTED}) WHERE suffix = '.txt'""")
def nearest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    captions = listed(spark, sf_dir).filter("suffix = '.txt'").select(F.col("path").alias("caption_path"))
    return M.nearest_metadata(captions, document_folders(spark, sf_dir), "/data")


@query(f"""
WITH f AS ({LISTED}), e AS (SELECT dir, path AS source_path, replace(path, '.mp4', '.txt') AS o, lower(stem) AS s, count(*) OVER (PARTITION BY dir) AS n FROM f WHERE kind = 'video'),
m AS (SELECT f.path AS caption_path, e.source_path, CASE WHEN lower(f.path) = lower(e.o) THEN 1 WHEN lower(f.stem) = e.s THEN 2 WHEN e.n = 1 THEN 3 END AS rank FROM f JOIN e ON f.dir = e.dir WHERE f.suffix IN ('.txt', '.json'))
SELECT caption_path, source_path, rank FROM m WHERE rank IS NOT NULL QUALIFY rank = min(rank) OVER (PARTITION BY caption_path)""")
def candidate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = listed(spark, sf_dir)
    captions = f.filter("suffix IN ('.txt', '.json')").select(F.col("path").alias("caption_path"), F.col("dir").alias("folder"))
    entries = f.filter("kind = 'video'").select(F.col("dir").alias("folder"), F.col("doc_id").alias("entry"), F.replace("path", F.lit(".mp4"), F.lit(".txt")).alias("output_path"), F.col("path").alias("source_path"))
    return M.media_candidates(captions, entries)


@query(r"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'part' WHEN doc_id % 4 < 3 THEN 'merged' ELSE regexp_replace(text, '[\r\n]+$', '') END AS caption FROM documents""")
def existing_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    return table(spark, sf_dir, "documents").select("doc_id", M.existing_caption(F.when(k == 0, "part\n"), F.when(k.between(0, 2), "merged\r\n\n"), "text").alias("caption"))


# --- probes, protocols, sinks ---


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'audio' WHEN p_size % 4 = 1 THEN 'image' ELSE 'video' END AS kind, CASE WHEN p_size % 4 <> 1 THEN p_size::DOUBLE END AS duration,
  CASE WHEN p_size % 4 <> 0 THEN 640 END AS width, CASE WHEN p_size % 4 <> 0 THEN round(30000 / 1001.0, 6) END AS fps, coalesce(p_size % 4 <> 0 AND p_size % 3 = 0, false) AS is_vfr, CASE WHEN p_size % 4 = 2 THEN 90 ELSE 0 END AS rotation FROM part""")
def probe_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, k = F.col("p_size"), F.col("p_size") % 4
    video = F.concat(F.lit('{"codec_type":"video","width":640,"height":360,"avg_frame_rate":"30000/1001","r_frame_rate":"'), F.when(size % 3 == 0, "60/1").otherwise("30000/1001"), F.lit('"'), F.when(k == 2, ',"tags":{"rotate":"90"}').otherwise(""), F.lit("}"))
    streams = F.when(k == 0, '{"codec_type":"audio"}').when(k == 1, video).otherwise(F.concat(F.lit('{"codec_type":"audio"},'), video))
    doc = F.concat(F.lit('{"format":{'), F.when(k != 1, F.concat(F.lit('"duration":"'), size.cast("string"), F.lit('"'))).otherwise(""), F.lit('},"streams":['), streams, F.lit("]}"))
    return table(spark, sf_dir, "part").select("p_partkey", S.media_facts(doc).alias("m")).select("p_partkey", "m.kind", "m.duration", "m.width", F.round("m.fps", 6).alias("fps"), "m.is_vfr", "m.rotation")


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'stdout' ELSE 'log' END AS ev, CASE WHEN event_id % 3 <> 0 THEN event_type END AS level, CASE WHEN event_id % 3 = 0 THEN 'plain ' || event_id ELSE 'line' END AS text,
  CASE WHEN event_id % 3 = 1 THEN '{"n":' || event_id || '}' END AS sse FROM events""")
def protocol_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 3
    line = F.when(k == 0, F.concat(F.lit("plain "), i)).otherwise(F.concat(F.lit('{"ev":"log","level":"'), F.col("event_type"), F.lit('","text":"line"}')))
    sse = F.when(k == 0, ": comment").when(k == 1, F.concat(F.lit('data: {"n":'), i, F.lit("}"))).otherwise("data: [DONE]")
    return table(spark, sf_dir, "events").select("event_id", S.event_lines(line).alias("e"), S.sse_data(sse).alias("sse")).select("event_id", "e.ev", "e.level", "e.text", "sse")


@query("""
WITH documents AS (SELECT doc_id, source, coalesce(lang, 'pending') AS lang FROM documents), c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT d.source, '{"counts":{' || c.counts || '},"items":[' || string_agg('{"index":' || doc_id || ',"path":"p' || doc_id || '","status":"' || lang || '"}', ',' ORDER BY doc_id) || ']}' AS json
FROM documents d JOIN (SELECT source, string_agg('"' || lang || '":' || n, ',' ORDER BY lang) AS counts FROM c GROUP BY source) c ON d.source = c.source GROUP BY d.source, c.counts""")
def run_status_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return sinks.run_summary(d.select("source", F.col("doc_id").alias("index"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("status")), ["source"])


@query("SELECT max(c_custkey) + 1 AS next FROM customer WHERE c_custkey % 3 <> 2")
def next_run_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 3 == 0, "batch_").otherwise(""), F.lpad(k.cast("string"), 7, "0"), F.when(k % 3 == 2, "").otherwise("_model"))
    return B.next_run(table(spark, sf_dir, "customer").select(name.alias("name")))


@query("SELECT user_id, arg_max(event_type, event_id) AS status, round(sum(value), 4) AS seconds FROM events GROUP BY user_id")
def last_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("status"), F.col("value").alias("seconds"))
    return B.last_status(e, "user_id", "event_id").select("user_id", "status", F.round("seconds", 4).alias("seconds"))


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 14")
def newest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.keep_newest(table(spark, sf_dir, "events"), ["user_id"], "event_id", 14).select("event_id")


@query("SELECT user_id, min(event_id) AS first FROM events WHERE event_type = 'error' GROUP BY user_id")
def failed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.failed_first_seen(table(spark, sf_dir, "events").withColumn("status", F.col("event_type")), "user_id", "event_id")


@query("""
WITH o AS (SELECT DISTINCT doc_id, toxic FROM labels) SELECT doc_id FROM documents WHERE NOT (doc_id IN (SELECT doc_id FROM o) AND (doc_id % 2 = 1 OR doc_id IN (SELECT doc_id FROM o WHERE toxic = 1)))""")
def items_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, o = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    outputs = o.select("doc_id", F.lit("txt").alias("output")).unionByName(o.filter("toxic = 1").select("doc_id", F.lit("srt").alias("output")))
    required = d.select("doc_id", F.lit("txt").alias("output")).unionByName(d.filter("doc_id % 2 = 0").select("doc_id", F.lit("srt").alias("output")))
    return B.skip_done(d, outputs, required, "doc_id")


# --- catalogues and settings ---


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("default"), (n % 2 == 0).alias("in_metadata"), (n % 3 == 0).alias("is_path"), (n % 5 == 0).alias("in_preset"))


def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 4 == 3, "old_").otherwise("NATION_"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_name").alias("value"))


_REGISTRY = "SELECT n_name AS key, n_regionkey::VARCHAR AS dflt, n_nationkey % 2 = 0 AS in_metadata, n_nationkey % 3 = 0 AS is_path, n_nationkey % 5 = 0 AS in_preset FROM nation"
_SAVED = "SELECT CASE WHEN s_suppkey % 4 = 3 THEN 'old_' ELSE 'NATION_' END || s_suppkey AS key, s_name AS value FROM supplier"


@query(f"SELECT r.key, coalesce(s.value, r.dflt) AS value FROM ({_REGISTRY}) r LEFT JOIN ({_SAVED}) s USING (key)")
def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merge_settings(saved(spark, sf_dir), registry(spark, sf_dir).select("key", F.col("default").alias("value")))


@query(f"SELECT key FROM ({_SAVED}) WHERE key NOT IN (SELECT key FROM ({_REGISTRY}))")
def unknown_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.unknown_settings(saved(spark, sf_dir), registry(spark, sf_dir))


@query(f"SELECT r.key, coalesce(s.value, r.dflt) AS value FROM ({_REGISTRY}) r LEFT JOIN ({_SAVED}) s USING (key) WHERE r.in_preset")
def preset_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.settings_subset(saved(spark, sf_dir), registry(spark, sf_dir), "in_preset")


@query(f"SELECT r.key, coalesce(s.value, r.dflt) AS value FROM ({_REGISTRY}) r LEFT JOIN ({_SAVED}) s USING (key) WHERE r.in_metadata")
def metadata_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.settings_subset(saved(spark, sf_dir), registry(spark, sf_dir), "in_metadata")


@query(f"""
WITH m AS (SELECT CASE WHEN key LIKE 'old_%' AND replace(key, 'old_', 'NATION_') IN (SELECT key FROM ({_REGISTRY})) THEN replace(key, 'old_', 'NATION_') ELSE key END AS key, value FROM ({_SAVED})) SELECT key, value FROM m""")
def mapped_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.replace("n_name", F.lit("NATION_"), F.lit("old_")).alias("stored"), F.col("n_name").alias("key"))
    return G.map_keys(saved(spark, sf_dir), names, registry(spark, sf_dir))


@query(f"""
SELECT s.key, s.value, CASE WHEN r.key IS NULL THEN 'unknown' WHEN NOT in_metadata OR is_path THEN 'skipped' ELSE 'restored' END AS outcome FROM ({_SAVED}) s LEFT JOIN ({_REGISTRY}) r USING (key)""")
def recovered_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.recoverable(saved(spark, sf_dir), registry(spark, sf_dir))


@query("SELECT c_custkey, list_filter([c_custkey % 5, c_custkey % 3 + 2], lambda x, i: x < 4 AND (i = 1 OR c_custkey % 5 <> c_custkey % 3 + 2))::VARCHAR AS kept FROM customer")
def usable_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array((F.col("c_custkey") % 5).cast("int"), (F.col("c_custkey") % 3 + 2).cast("int"))
    kept = G.usable_devices(wanted, [0, 1, 2, 3])["kept"]
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("["), F.array_join(kept, ", "), F.lit("]")).alias("kept"))


@query("""
SELECT r_name AS name, true AS protected FROM region UNION ALL SELECT n_name, false FROM nation UNION ALL SELECT 'Mine', false""")
def preset_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    users = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).unionByName(spark.createDataFrame([("africa",), ("Mine",)], "name string"))
    return G.preset_entries(defaults, users, "ASIA")


@query("""
SELECT p_partkey FROM part WHERE (p_size % 4 IN (0, 1)) AND (p_size % 3 IN (0, 1))""")
def presets_for_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("p_size") % 4, F.col("p_size") % 3
    families = F.when(k == 0, F.array(F.lit("*"))).when(k == 1, F.array(F.lit("avocado"), F.lit("timechat"))).otherwise(F.array(F.lit("avocado")))
    modes = F.when(m == 0, F.array(F.lit("video"))).when(m == 1, F.array(F.lit("audio"), F.lit("video_audio"))).otherwise(F.array(F.lit("audio")))
    presets = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("group"), F.col("p_partkey").alias("place"), families.alias("families"), modes.alias("modalities"))
    return G.presets_for(presets, ["ECONOMY", "STANDARD"], "timechat", "video_audio").select("p_partkey")


MODELS = [("a", "Alpha", 1, ["video", "video_audio"]), ("b", "Beta", 2, ["audio", "video", "text"]), ("c", "Gamma", 3, ["image"])]


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    kind = F.when(i % 6 == 0, F.lit(None).cast("string")).when(i % 6 == 1, "video").when(i % 6 == 2, "video_no_audio").when(i % 6 == 3, "audio").when(i % 6 == 4, "image").otherwise("folder")
    need = G.required_capability(text_only=i % 13 == 0, kind=kind, explicit=F.when(i % 10 == 0, "Image"), has_video=kind.isin("video", "video_no_audio"), frames_off=i % 7 == 0, hears=i % 3 == 1, audio_wanted=i % 4 == 1, audio_required=F.lit(False))
    model = F.when(i % 3 == 0, "a").when(i % 3 == 1, "b").otherwise("c")
    return table(spark, sf_dir, "documents").select("doc_id", model.alias("model"), need.alias("n"), F.coalesce(kind == "video", F.lit(False)).alias("has_audio")).select("doc_id", "model", "n.*", "has_audio")


_ASKED = """SELECT doc_id, model, has_audio, CASE WHEN t THEN 'text' WHEN kind IS NULL THEN '' WHEN v AND off AND hears THEN 'audio' WHEN doc_id % 10 = 0 THEN 'image' WHEN kind = 'video' THEN CASE WHEN doc_id % 4 = 1 THEN 'video_audio' ELSE 'video' END WHEN kind = 'video_no_audio' THEN 'video' WHEN kind IN ('audio', 'image') THEN kind ELSE '' END AS capability,
  CASE WHEN t THEN 'text' WHEN kind IS NULL THEN 'unknown' WHEN v AND off AND hears THEN 'video' WHEN doc_id % 10 = 0 THEN 'image' WHEN v THEN 'video' ELSE kind END AS kind
FROM (SELECT doc_id, kind, doc_id % 13 = 0 AS t, coalesce(kind LIKE 'video%', false) AS v, doc_id % 7 = 0 AS off, doc_id % 3 = 1 AS hears, ['a', 'b', 'c'][doc_id % 3 + 1] AS model, coalesce(kind = 'video', false) AS has_audio FROM (SELECT doc_id, [NULL, 'video', 'video_no_audio', 'audio', 'image', 'folder'][doc_id % 6 + 1] AS kind FROM documents))"""


@query(f"SELECT doc_id, capability, kind FROM ({_ASKED})")
def asked_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("doc_id", "capability", "kind")


@query(f"""
WITH m(model, label, can) AS (VALUES ('a', 'Alpha', ['video', 'video_audio']), ('b', 'Beta', ['audio', 'video', 'text']), ('c', 'Gamma', ['image'])),
o(need, labels) AS (VALUES ('video', 'Alpha, Beta'), ('video_audio', 'Alpha'), ('audio', 'Beta'), ('text', 'Beta'), ('image', 'Gamma')),
q AS (SELECT a.*, m.label, o.labels, a.capability <> '' AND list_contains(m.can, a.capability) AS able FROM ({_ASKED}) a JOIN m USING (model) LEFT JOIN o ON o.need = CASE WHEN a.capability <> '' THEN a.capability ELSE a.kind END),
w AS (SELECT doc_id, CASE WHEN kind = 'unknown' THEN 'The file could not be inspected.' WHEN capability = 'audio' AND kind = 'video' AND NOT has_audio THEN 'Visual frames are disabled, but the video has no audio track.' WHEN NOT able THEN label || ' does not support ' || CASE WHEN kind = 'audio' THEN 'audio-only' ELSE replace(kind, '_', '-') END || ' input.' || coalesce(' Models that do support it: ' || labels || '.', '') END AS message FROM q)
SELECT doc_id, CASE WHEN message IS NULL THEN 'pending' ELSE 'unsupported' END AS status, message FROM w""")
def classified_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = spark.createDataFrame(MODELS, "model string, label string, place int, capabilities array<string>")
    return G.classify(asked(spark, sf_dir), models).select("doc_id", "status", "message")


@query("SELECT p_partkey FROM part WHERE 24 >= p_size OR (p_size % 4 <> 0 AND p_retailprice / 50 + 1.4 <= 24)")
def allowed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, "gguf").otherwise("int8").alias("scheme"), F.col("p_size").alias("threshold"), (F.col("p_retailprice") / 50).alias("size_gb"))
    return G.allowed_variants(v, F.lit(24)).select("p_partkey")


@query("SELECT p_partkey, p_size % 3 = 0 AS carries FROM part")
def context_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    family: Column = F.when(F.col("p_size") % 3 == 0, "avocado").otherwise("timechat")
    return table(spark, sf_dir, "part").select("p_partkey", G.carries_context(family).alias("carries"))
