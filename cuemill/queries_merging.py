"""Registered queries of captions put together from parts, changed sidecars and settings plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import numeric as N
from .operators import sidecars as C
from .plans import merging as G, settings as P
from .queries import _STAMP
from .registry import query, spread, table

_RULES = G.CaptionRules(json=False, clear=True)


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as items, their turns as clips of ten seconds: every fifth failed, every third with a sound, every second kept beside."""
    t, conv = F.col("turn"), F.col("conv_id")
    path = F.concat(F.lit("/c/"), conv.cast("string"), F.lit("/"), t.cast("string"), F.lit(".mp4"))
    c = table(spark, sf_dir, "conversations")
    clips = c.select(
        conv.alias("item"), t.alias("index"), (t * 10.0).alias("start_s"), (t * 10 + 9.5).alias("end_s"), path.alias("media_path"), (t % 2 == 0).alias("persistent"), F.when(t % 5 == 4, "failed").otherwise("done").alias("status"),
        F.col("text").alias("caption"), F.when(t % 3 == 0, " hum ").alias("sound_caption"), F.lit(None).cast("string").alias("transcript"), F.lit(None).cast("string").alias("structured"), F.lit(True).alias("has_video"),
    )
    spoken = F.when(conv % 2 == 1, "spoken words")
    items = c.select("conv_id").distinct().select(conv.alias("item"), F.lit("/o").alias("folder"), conv.cast("string").alias("stem"), F.concat(F.lit("talk "), conv.cast("string")).alias("filename"), spoken.alias("transcript"), F.lit(None).cast("string").alias("structured"))
    return items, clips


_CLIPS = f"SELECT conv_id AS item, turn, text, CASE WHEN turn % 3 = 0 THEN 'hum' ELSE '' END AS sound, '[' || {_STAMP.format('(turn * 10000)', '.')} || ' - ' || {_STAMP.format('(turn * 10000 + 9500)', '.')} || ']' || chr(10) AS head, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE turn % 5 <> 4"
_ITEMS = f"""SELECT i.item, coalesce(max(n), 0) AS n, coalesce(string_agg(CASE WHEN n = 1 THEN '' ELSE head END || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn), '') AS video, coalesce(string_agg(CASE WHEN n = 1 THEN '' ELSE head END || sound, chr(10) || chr(10) ORDER BY turn) FILTER (sound <> ''), '') AS sound
FROM (SELECT DISTINCT conv_id AS item FROM conversations) i LEFT JOIN ({_CLIPS}) c ON i.item = c.item GROUP BY i.item"""
_TIDY = r"regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\n[ \t]*\n([ \t]*\n)+', chr(10) || chr(10), 'g')"


@query(f"""
WITH i AS (SELECT item, n, video, array_to_string(list_filter([CASE WHEN item % 2 = 1 THEN 'spoken words' ELSE '' END, sound], lambda x: x <> ''), chr(10) || chr(10)) AS audio FROM ({_ITEMS}))
SELECT item, audio AS audio_caption, CASE WHEN audio = '' THEN video ELSE {_TIDY.format("video || chr(10) || chr(10) || audio")} END AS merged_caption, audio = '' AS no_speech, 'Captioned ' || n || ' segment(s); ' || CASE WHEN audio <> '' THEN 'audio caption saved' ELSE 'merged caption uses video only' END AS message FROM i""")
def merged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, _ = G.merge_captions(*turns(spark, sf_dir), _RULES)
    return whole.select("item", "audio_caption", "merged_caption", "no_speech", "message")


@query(f"""
WITH c AS (SELECT item, turn, coalesce(text, '') AS text, sound, CASE WHEN turn % 2 = 0 THEN '/c/' || item WHEN n > 1 THEN '/o/' || item || '_segments' END AS dir, CASE WHEN turn % 2 = 0 THEN turn::VARCHAR ELSE 'clip_' || lpad(turn::VARCHAR, 4, '0') END AS stem FROM ({_CLIPS})),
m AS (SELECT *, CASE WHEN sound = '' THEN text ELSE {_TIDY.format("text || chr(10) || chr(10) || sound")} END AS merged FROM c WHERE dir IS NOT NULL),
f AS (SELECT 'video_caption' AS part, dir || '/video_caption/' || stem || '.txt' AS path, text AS content FROM m UNION ALL SELECT 'audio_caption', dir || '/audio_caption/' || stem || '.txt', nullif(sound, '') FROM m UNION ALL SELECT 'merged_caption', dir || '/' || stem || '.txt', merged FROM m)
SELECT part, path, content || CASE WHEN content = '' OR content LIKE '%' || chr(10) THEN '' ELSE chr(10) END AS content FROM f""")
def clip_caption_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, clips = G.merge_captions(*turns(spark, sf_dir), _RULES)
    return G.unit_files(clips)


@query(f"""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN coalesce(text, '') ELSE {_TIDY.format("coalesce(text, '') || chr(10) || chr(10) || role")} END AS merged_caption, CASE WHEN turn % 2 = 0 THEN 0 WHEN turn % 3 = 0 THEN 3 ELSE 2 END AS files FROM conversations""")
def rebuilt_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("/o/x.txt").alias("caption_path"), F.when(t % 2 == 1, "/o/video_caption/x.txt").alias("video_path"), F.col("role").alias("audio_caption"), F.col("text").alias("video_caption"), F.when(t % 3 == 0, "{}").alias("sidecar"))
    return G.rebuilt(c, G.CaptionRules()).select("conv_id", "turn", "merged_caption", F.size("files").alias("files"))


@query("""
WITH c AS (SELECT 'd/' || user_id AS path, event_type AS field, CASE WHEN event_id % 7 <> 0 THEN '[' || event_id || ']' END AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 97 DESC, event_id % 3 DESC, CASE WHEN event_id % 7 <> 0 THEN '[' || event_id || ']' END DESC NULLS LAST) = 1),
g AS (SELECT path, string_agg(',"' || field || '":' || value, '' ORDER BY field) AS new FROM c GROUP BY path), d AS (SELECT 'd/' || doc_id AS path, '"click":0,' AS click, '"id":' || doc_id AS id FROM documents)
SELECT coalesce(d.path, g.path) AS path, CASE WHEN g.path IS NULL THEN '{"id": ' || substr(id, 6) || ', "click": 0}' WHEN d.path IS NULL THEN '{' || coalesce(substr(new, 2), '') || '}' ELSE '{' || CASE WHEN g.path IN (SELECT path FROM c WHERE field = 'click') THEN '' ELSE click END || id || coalesce(new, '') || '}' END AS content FROM d FULL JOIN g ON d.path = g.path""")
def changed_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after all events as changes of a field each, some of which take the field away."""
    i = F.col("event_id")
    value = F.when(i % 7 != 0, F.concat(F.lit("["), i.cast("string"), F.lit("]")))
    changes = table(spark, sf_dir, "events").select(F.concat(F.lit("d/"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("field"), value.alias("value"), (i % 97).alias("at"), (i % 3).alias("writer"))
    documents = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "click": 0}')).alias("content"))
    return C.applied_changes(documents, changes)


# --- settings ---

_WORDS = ["", "5", "-3", "1e3", "0", "0.3", "nan", "abc", "YES", "off", "Fixed", "precise", " 7 ", "99999999999", "-0.5", "trainer", "40"]


def _job_plans_sql() -> str:
    """Each field on its own, those that others depend on first; the plan and its errors as texts."""
    words = "[" + ", ".join(f"'{w}'" for w in _WORDS) + "]"
    raw, value, wrong = [], {}, {}
    number = "CASE WHEN isfinite(TRY_CAST(trim(r_{0}) AS DOUBLE)) THEN TRY_CAST(trim(r_{0}) AS DOUBLE) END"
    fields = {f.name: f for f in P.JOB_FIELDS}
    for i, f in enumerate(P.JOB_FIELDS):
        raw.append(f"{words}[p_partkey * {i + 7} % 23 + 1] AS r_{f.name}")
        got = number.format(f.name)
        word = f"lower(trim(r_{f.name}))"
        got = {"int": f"trunc({got})::BIGINT", "text": f"r_{f.name}", "bool": f"CASE WHEN {word} IN ('1', 'true', 'yes', 'on', 'enabled') THEN true WHEN {word} IN ('0', 'false', 'no', 'off', 'disabled', '') THEN false END", "choice": f"CASE WHEN {word} IN ({', '.join(repr(c) for c in f.choices) or 'NULL'}) THEN {word} END"}.get(f.kind, got)
        if f.kind == "positive":
            value[f.name] = f"CASE WHEN {got} > 0 THEN {got} END"
            wrong[f.name] = f"CASE WHEN trim(r_{f.name}) <> '' AND coalesce({got}, 0) <= 0 THEN '{f.name}:not above 0:' || r_{f.name} END"
            continue
        low, high = ("cap" if callable(x) else x for x in (f.low, f.high))
        default = {"fps": "greatest(rate, 0.01)", "max_frames": "cap"}.get(f.name, "NULL" if f.default is None else repr(f.default).lower() if f.kind == "bool" else repr(f.default))
        bounded = got if low is None else f"greatest({got}, {low})"
        bounded = f"CASE WHEN {got} IS NOT NULL THEN {bounded if high is None else f'least({bounded}, {high})'} END"
        value[f.name] = f"coalesce({bounded}, {default})"
        wrong[f.name] = f"CASE WHEN r_{f.name} IS NOT NULL AND {got} IS NULL THEN '{f.name}:invalid:' || r_{f.name} WHEN {bounded} <> {got} THEN '{f.name}:out of range:' || r_{f.name} END"
    after = {
        "max_frames": "CASE WHEN max_frames = 0 AND NOT sound THEN least(4, cap) ELSE max_frames END",
        "segment_mode": "coalesce(segment_mode, CASE WHEN split_mode IN ('whole', 'scenes', 'fixed', 'trainer') THEN split_mode WHEN scene_detect_enabled THEN 'scenes' ELSE 'whole' END)",
        "cut_mode": "CASE WHEN split_mode IN ('copy', 'precise') THEN split_mode ELSE cut_mode END",
    }
    said = lambda n: f"coalesce({n}::DECIMAL(20, 4)::VARCHAR, 'null')" if fields[n].kind in ("float", "positive") else f"coalesce({n}::VARCHAR, 'null')"
    rules = [
        "CASE WHEN trim_end_s <= trim_start_s THEN 'trim_end_s:ends before it begins' END", "CASE WHEN scene_max_len_s > 0 AND scene_max_len_s < scene_min_len_s THEN 'scene_max_len_s:shorter than the least length' END",
        "CASE WHEN segment_mode = 'fixed' AND overlap_s >= fixed_chunk_s THEN 'overlap_s:overlap as long as the window' END", "CASE WHEN do_sample AND top_p <= 0 THEN 'top_p:nothing to sample from' END",
    ]
    return f"""
WITH r AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS rate, greatest(p_size % 7, 1)::BIGINT AS cap, p_partkey % 2 = 0 AS sound, {', '.join(raw)} FROM part),
v AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in value.items())}, {', '.join(f'{e} AS e_{n}' for n, e in wrong.items())} FROM r), w AS (SELECT * REPLACE ({', '.join(f'{e} AS {n}' for n, e in after.items())}) FROM v)
SELECT p_partkey, array_to_string([{', '.join(said(f.name) for f in P.JOB_FIELDS)}], '|') AS plan, array_to_string(list_filter([{', '.join(f'e_{f.name}' for f in P.JOB_FIELDS)}, {', '.join(rules)}], lambda x: x IS NOT NULL), ';') AS errors FROM w"""


@query(_job_plans_sql())
def job_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each part, with settings of all sorts, as texts."""
    k = F.col("p_partkey")
    words = F.array(*[F.lit(w) for w in _WORDS])
    pairs = [F.struct(F.lit((f.names or [f.name])[-1]).alias("k"), F.get(words, (k * (i + 7) % 23).cast("int")).alias("v")) for i, f in enumerate(P.JOB_FIELDS)]
    settings = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))
    jobs = table(spark, sf_dir, "part").select("p_partkey", settings.alias("settings"), (F.col("p_size") / 10.0).alias("rate"), (F.col("p_size") % 7).alias("cap"), (k % 2 == 0).alias("sound"))
    made = P.job_plan(jobs, "settings", F.col("rate"), F.col("cap"), F.col("sound"))
    text = lambda f: F.coalesce((F.col("plan")[f.name].cast("decimal(20,4)") if f.kind in ("float", "positive") else F.col("plan")[f.name]).cast("string"), F.lit("null"))
    errors = F.transform("errors", lambda e: F.concat_ws(":", e["field"], e["said"], e["given"]))
    return made.select("p_partkey", F.concat_ws("|", *[text(f) for f in P.JOB_FIELDS]).alias("plan"), F.array_join(errors, ";").alias("errors"))


_TILES = "SELECT h, least(high, greatest(low, round_even(w0 * 1.0 / h0 * h, 0)::BIGINT)) AS w FROM (SELECT h, greatest(1, ceil(36 / h)::BIGINT) AS low, 38 // h AS high FROM range(1, 39) t(h)) WHERE low <= high"


@query(f"""
WITH s AS (SELECT o_orderkey, (200 + o_orderkey % 1900)::DOUBLE AS w0, (20 + o_orderkey * 7 % 300)::DOUBLE AS h0 FROM orders),
a AS (SELECT *, greatest(28, round_even(h0 / 28, 0) * 28) AS h1, greatest(28, round_even(w0 / 28, 0) * 28) AS w1, sqrt(h0 * w0 / 30000) AS dn, sqrt(28000 / (h0 * w0)) AS up FROM s),
b AS (SELECT *, CASE WHEN h1 * w1 > 30000 THEN greatest(28, floor(greatest(1, floor(h0 / dn)) / 28) * 28) ELSE h1 END AS h2, CASE WHEN h1 * w1 > 30000 THEN greatest(28, floor(greatest(1, floor(w0 / dn)) / 28) * 28) ELSE w1 END AS w2 FROM a),
c AS (SELECT *, CASE WHEN h2 * w2 < 28000 THEN greatest(28, ceil(ceil(h0 * up) / 28) * 28) ELSE h2 END AS h3, CASE WHEN h2 * w2 < 28000 THEN greatest(28, ceil(ceil(w0 * up) / 28) * 28) ELSE w2 END AS w3 FROM b),
d AS (SELECT c.*, (SELECT min({{s: round(abs(ln(t.w * 1.0 / t.h / (w0 / h0))) * 10 + abs(ln(t.h * t.w / (least(30000, greatest(28000, w0 * h0)) / 784.0::DOUBLE))), 9), h: t.h, w: t.w}}) FROM ({_TILES}) t) AS m FROM c)
SELECT o_orderkey, CASE WHEN h3 * w3 BETWEEN 28000 AND 30000 THEN h3 ELSE m.h * 28 END::INT AS height, CASE WHEN h3 * w3 BETWEEN 28000 AND 30000 THEN w3 ELSE m.w * 28 END::INT AS width FROM d""")
def fitted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures between 28000 and 30000 pixels in tiles of 28, wide ones among them, against a scan of all heights."""
    k = F.col("o_orderkey")
    o = spread(table(spark, sf_dir, "orders")).select("o_orderkey", N.fitted_size(20 + k * 7 % 300, 200 + k % 1900, 28, 28_000, 30_000).alias("s"))
    return o.select("o_orderkey", "s.height", "s.width")
