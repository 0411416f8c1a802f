"""Registered queries of file sinks and line sources, scene detectors, speech, throttles and scans of large keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import clips as K, frames as R, render as D, timeline as L
from .queries_plans import _CHANGES, grey, spans
from .registry import query, table
from .scratch import shared_path
from .sources import files as S
from .streaming import events as E

# --- files ---


@query("SELECT source || '/' || (doc_id % 20) || '/' || doc_id || '.txt' AS path, md5(text) AS digest, strlen(text)::BIGINT AS size FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def files_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of its own, read back."""
    folder, i = shared_path(spark, "files"), F.col("doc_id").cast("string")
    path = F.concat("source", F.lit("/"), (F.col("doc_id") % 20).cast("string"), F.lit("/"), i, F.lit(".txt"))
    S.write_files(table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content")), folder)
    return S.read_files(spark, folder).select("path", F.md5("content").alias("digest"), F.length("content").cast("long").alias("size"))


def event_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a file for each user's day, a line an event: worker events, and every third line plain words."""
    said = F.concat(F.lit("heard of "), F.col("event_id").cast("string"))
    line = F.when(F.col("event_id") % 3 == 0, said).otherwise(F.to_json(F.struct(F.col("event_type").alias("ev"), F.col("event_id").alias("id"))))
    day = F.date_format("ts", "yyyy-MM-dd")
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), day, F.lit(".log"))
    lines = table(spark, sf_dir, "events").select(path.alias("path"), "event_id", line.alias("line"))
    whole = lines.groupBy("path").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))
    folder = shared_path(spark, "lines")
    S.write_files(whole, folder)
    return folder


@query("""
WITH l AS (SELECT event_id, 'u' || user_id || '/' || strftime(ts, '%Y-%m-%d') || '.log' AS file, CASE WHEN event_id % 3 = 0 THEN 'stdout' ELSE event_type END AS ev,
  CASE WHEN event_id % 3 = 0 THEN 'heard of ' || event_id ELSE '{"ev":"' || event_type || '","id":' || event_id || '}' END AS line FROM events)
SELECT file, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY file ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", ev, CASE WHEN ev = 'stdout' THEN '{"ev":"stdout","text":"' || line || '"}' ELSE line END AS event FROM l""")
def event_lines_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of files of lines, read in splits of 64 kB."""
    return S.events_of(S.file_lines(spark, event_files(spark, sf_dir), ".log", 1 << 16)).select("file", "offset", "ev", "event")


@query("""
SELECT 'd/' || doc_id || '.json' AS path, CASE doc_id % 4 WHEN 0 THEN 'caption' ELSE 'merged_caption' END AS field, text AS caption FROM documents WHERE doc_id % 4 IN (0, 1) AND text IS NOT NULL AND text <> 'old'""")
def edited_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited captions put into their JSON files: documents of two shapes, one that is no object and one without a caption field."""
    d, i, k = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string"), F.col("doc_id") % 4
    document = F.when(k == 0, '{"n": 1, "caption": "old"}').when(k == 1, '{"caption": "other", "merged_caption": "old"}').when(k == 2, '["caption"]').otherwise('{"caption": 5}')
    edits = d.select(F.concat(F.lit("d/"), i, F.when(k == 0, ".TXT").otherwise(".txt")).alias("path"), "text")
    made = S.synced_sidecars(edits, d.select(F.concat(F.lit("d/"), i, F.lit(".json")).alias("path"), document.alias("content")))
    parsed = F.from_json("content", "map<string,string>")
    field = F.when(parsed["merged_caption"].isNotNull(), "merged_caption").otherwise("caption")
    return made.select("path", field.alias("field"), parsed[field].alias("caption"))


# --- scenes ---


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frame_features(grey(spark, sf_dir), "clip", "frame", "px", 4)


_FEATURES = f"SELECT clip, frame, list_sum(px)::DOUBLE / 16 AS luma, coalesce(change, 0) AS change, row_number() OVER (PARTITION BY clip ORDER BY frame) AS i, min(frame) OVER (PARTITION BY clip) AS first, max(frame) OVER (PARTITION BY clip) AS ending FROM ({_CHANGES})"
_SCENES = "SELECT clip, scene, min(frame) AS first, max(frame) AS last, count(*) AS frames FROM (SELECT clip, frame, (SELECT count(DISTINCT cut) FROM c WHERE c.clip = f.clip AND cut > f.first AND cut <= f.frame) AS scene FROM f) GROUP BY clip, scene"
_FLASHES = """r AS (SELECT clip, i, frame AS last, false AS able, false AS run, 0::BIGINT AS begun, NULL::BIGINT AS cut FROM f WHERE i = 1
UNION ALL SELECT clip, i, pos, able OR plain, (run AND NOT done) OR starts, CASE WHEN starts THEN frame ELSE begun END, CASE WHEN done THEN pos WHEN plain THEN frame END FROM (
SELECT *, run AND met AND NOT up AND pos - begun >= 4 AS done, NOT run AND up AND met AS plain, NOT run AND up AND NOT met AND able AS starts FROM (
SELECT f.clip, f.i, f.frame, r.able, r.run, r.begun, f.change >= 42 AS up, f.frame - r.last >= 4 AS met, CASE WHEN f.change >= 42 THEN f.frame ELSE r.last END AS pos FROM r JOIN f ON f.clip = r.clip AND f.i = r.i + 1)))"""
_FADES = """d AS (SELECT clip, i, luma < 37 AS dark, frame AS since, frame AS last, NULL::BIGINT AS cut FROM f WHERE i = 1
UNION ALL SELECT f.clip, f.i, f.luma < 37, CASE WHEN f.luma < 37 AND NOT d.dark THEN f.frame ELSE d.since END, CASE WHEN d.dark AND f.luma >= 37 AND f.frame - d.last >= 4 THEN f.frame ELSE d.last END,
CASE WHEN d.dark AND f.luma >= 37 AND f.frame - d.last >= 4 THEN (f.frame + d.since) // 2 END FROM d JOIN f ON f.clip = d.clip AND f.i = d.i + 1),
x AS (SELECT clip, cut FROM d WHERE cut IS NOT NULL UNION ALL SELECT d.clip, d.since FROM d JOIN f ON f.clip = d.clip AND f.i = d.i WHERE f.frame = f.ending AND d.dark AND f.ending - d.last >= 4)"""


@query(f"WITH RECURSIVE f AS MATERIALIZED ({_FEATURES}), {_FLASHES}, c AS (SELECT clip, cut FROM r WHERE cut IS NOT NULL) {_SCENES}")
def scenes_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.detect_scenes(features(spark, sf_dir), "clip", "frame", "content", 42.0, 4)


@query(f"""
WITH RECURSIVE f AS MATERIALIZED ({_FEATURES}), q AS (SELECT *, (lag(change, 1) OVER w + lead(change, 1) OVER w + lag(change, 2) OVER w + lead(change, 2) OVER w) / 4 AS mean FROM f WINDOW w AS (PARTITION BY clip ORDER BY frame)),
k AS (SELECT clip, frame, first, row_number() OVER (PARTITION BY clip ORDER BY frame) AS n FROM q WHERE change >= 15 AND mean IS NOT NULL AND CASE WHEN abs(mean) < 1e-5 THEN CASE WHEN change > 0 THEN 255.0 ELSE 0 END ELSE least(change / mean, 255.0) END >= 1.2),
s AS (SELECT clip, n, CASE WHEN frame - first >= 4 THEN frame ELSE first END AS last, frame - first >= 4 AS kept FROM k WHERE n = 1 UNION ALL SELECT k.clip, k.n, CASE WHEN k.frame - s.last >= 4 THEN k.frame ELSE s.last END, k.frame - s.last >= 4 FROM s JOIN k ON k.clip = s.clip AND k.n = s.n + 1),
c AS (SELECT clip, last AS cut FROM s WHERE kept) {_SCENES}""")
def scenes_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.detect_scenes(features(spark, sf_dir), "clip", "frame", "adaptive", 1.2, 4)


@query(f"WITH RECURSIVE f AS MATERIALIZED ({_FEATURES}), {_FADES}, c AS (SELECT * FROM x) {_SCENES}")
def scenes_by_fade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.detect_scenes(features(spark, sf_dir), "clip", "frame", "threshold", 37.0, 4)


@query(f"WITH RECURSIVE f AS MATERIALIZED ({_FEATURES}), {_FLASHES}, {_FADES}, c AS (SELECT clip, cut FROM r WHERE cut IS NOT NULL UNION ALL SELECT * FROM x) {_SCENES}")
def scenes_with_fades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.detect_scenes(features(spark, sf_dir), "clip", "frame", "content", 42.0, 4, fades=37.0)


# --- speech ---


def loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of the components of four vectors each, a frame a component."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return e.select(F.floor(F.col("vec_id") / 4).cast("long").alias("recording"), ((F.col("vec_id") % 4) * 64 + F.col("i")).alias("frame"), (F.abs(F.col("x").cast("double")) * 5).alias("p"))


@query("""
WITH RECURSIVE e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
f AS MATERIALIZED (SELECT vec_id // 4 AS recording, (vec_id % 4 * 64 + i) / 32.0::DOUBLE AS t, abs(x::DOUBLE) * 5 AS p, row_number() OVER (PARTITION BY vec_id // 4 ORDER BY vec_id % 4 * 64 + i) AS n FROM e),
z AS (SELECT recording, max(t) + 0.03125 AS stop, max(n) AS n FROM f GROUP BY recording),
r AS (SELECT recording, n, CASE WHEN p >= 0.6 THEN t END AS begun, NULL::DOUBLE AS quiet, NULL::DOUBLE AS cut, NULL::DOUBLE AS resume, NULL::DOUBLE AS a, NULL::DOUBLE AS b FROM f WHERE n = 1
UNION ALL SELECT recording, n, CASE WHEN fin THEN NULL ELSE begun END, CASE WHEN fin THEN NULL ELSE quiet END, CASE WHEN fin THEN NULL ELSE cut END, CASE WHEN fin THEN NULL ELSE resume END,
  CASE WHEN fin AND quiet - begun > 0.0625 THEN begun ELSE a END, CASE WHEN fin AND quiet - begun > 0.0625 THEN quiet ELSE b END
FROM (SELECT *, coalesce(t - quiet >= 0.25 AND p < 0.45, false) AS fin FROM (SELECT recording, n, t, p, begun, quiet, CASE WHEN p < 0.45 AND t - quiet > 0.09375 THEN quiet ELSE cut END AS cut, resume, a, b
FROM (SELECT recording, n, t, p, begun, CASE WHEN p < 0.45 AND begun IS NOT NULL THEN coalesce(quiet, t) ELSE quiet END AS quiet, cut, resume, a, b
FROM (SELECT recording, n, t, p, CASE WHEN fresh THEN t WHEN NOT far THEN begun WHEN cut IS NOT NULL AND resume >= cut THEN resume END AS begun, CASE WHEN NOT far THEN quiet END AS quiet, CASE WHEN NOT far THEN cut END AS cut, CASE WHEN NOT far THEN resume END AS resume, CASE WHEN far THEN begun END AS a, CASE WHEN far THEN coalesce(cut, t) END AS b
FROM (SELECT *, p >= 0.6 AND begun IS NULL AS fresh, coalesce(t - begun > 1.90625, false) AS far
FROM (SELECT f.recording, f.n, f.t, f.p, r.begun, CASE WHEN f.p < 0.6 THEN r.quiet END AS quiet, r.cut, CASE WHEN f.p >= 0.6 AND r.quiet IS NOT NULL AND r.cut IS NOT NULL AND (r.resume IS NULL OR r.resume < r.cut) THEN f.t ELSE r.resume END AS resume
FROM r JOIN f ON f.recording = r.recording AND f.n = r.n + 1)))))))
, s AS (SELECT recording, a, b FROM r WHERE a IS NOT NULL UNION ALL SELECT recording, begun, stop FROM r JOIN z USING (recording, n) WHERE begun IS NOT NULL AND stop - begun > 0.0625)
SELECT recording, greatest(0, a - least(0.03125, coalesce((a - lag(b) OVER w) / 2, 0.03125))) AS start_s, b + least(0.03125, coalesce((lead(a) OVER w - b) / 2, stop - b)) AS end_s FROM s JOIN z USING (recording) WINDOW w AS (PARTITION BY recording ORDER BY a)""")
def speech_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.speech_ranges(loudness(spark, sf_dir), "recording", 1 / 32, 0.6, 0.45, 0.0625, 0.25, 1 / 32, 2.0, 3 / 32)


@query("""
WITH c AS (SELECT vec_id // 10 AS recording, vec_id % 10 * 10.0::DOUBLE AS a, vec_id % 10 * 10.0::DOUBLE + 1 + vec_id % 7 AS b FROM embeddings),
p AS (SELECT *, sum(b - a) OVER (PARTITION BY recording ORDER BY a) - (b - a) AS p0 FROM c),
q AS (SELECT event_id, event_id % 50 AS recording, value AS at_s FROM events)
SELECT event_id, q.recording, round(at_s - p0 + a, 6) AS source_s FROM q ASOF JOIN p ON q.recording = p.recording AND q.at_s >= p.p0""")
def source_times_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in what is left of recordings when silence is taken out, back in the recordings."""
    v = F.col("vec_id")
    start = ((v % 10) * 10).cast("double")
    chunks = table(spark, sf_dir, "embeddings").select(F.floor(v / 10).alias("recording"), start.alias("c_start"), (start + 1 + v % 7).alias("c_end"))
    points = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 50).alias("recording"), F.col("value").alias("at_s"))
    return L.source_times(points, chunks, "recording").select("event_id", "recording", F.round("source_s", 6).alias("source_s"))


# --- events ---


@query("""
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, epoch_us(ts) AS t, event_type || event_id AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type || event_id) AS i FROM events),
r AS (SELECT user_id, i, t AS last, NULL::VARCHAR AS waits, NULL::BIGINT AS due, NULL::VARCHAR AS was, true AS shown, t, v FROM e WHERE i = 1
UNION ALL SELECT user_id, i, CASE WHEN goes THEN t ELSE last END, CASE WHEN NOT goes THEN v END, due, was, goes, t, v FROM (SELECT *, t - last >= 43200000000 AS goes FROM (
SELECT e.user_id, e.i, e.t, e.v, CASE WHEN r.waits IS NOT NULL AND r.last + 43200000000 < e.t THEN r.last + 43200000000 ELSE r.last END AS last, CASE WHEN r.waits IS NOT NULL AND r.last + 43200000000 < e.t THEN r.last + 43200000000 END AS due, r.waits AS was
FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)))
SELECT user_id, t AS us, v AS value, false AS held FROM r WHERE shown UNION ALL SELECT user_id, due, was, true FROM r WHERE due IS NOT NULL
UNION ALL SELECT user_id, last + 43200000000, waits, true FROM r WHERE waits IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1 AND i = (SELECT max(i) FROM e WHERE e.user_id = r.user_id)""")
def held_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.concat("event_type", F.col("event_id").cast("string")).alias("value"))
    return E.throttled_last(e, ["user_id"], "ts", "value", 43200.0)


@query("""
WITH e AS (SELECT event_type, epoch_us(ts) / 1e6 AS start_s, epoch_us(ts) / 1e6 + value * 6 AS end_s FROM events), m AS (SELECT *, max(end_s) OVER (PARTITION BY event_type ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e WHERE end_s > start_s),
i AS (SELECT *, sum(CASE WHEN start_s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT event_type, round(min(start_s), 3) AS start_s, round(max(end_s), 3) AS end_s, count(*) AS n FROM i GROUP BY event_type, k""")
def islands_of_few_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five keys over the whole table, each cut into buckets of its starts."""
    e = spans(spark, sf_dir).select("event_type", "start_s", (F.col("start_s") + F.col("value") * 6).alias("end_s"))
    out = L.islands(e, ["event_type"], large=100)
    return out.select("event_type", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "n")


@query("""
SELECT e.event_id, o.event_id AS last_error FROM events e ASOF LEFT JOIN (SELECT event_type, user_id, max(event_id) AS event_id, ts FROM events WHERE event_type = 'error' GROUP BY ALL) o ON e.user_id = o.user_id AND e.ts >= o.ts""")
def last_error_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest error of its user at each event."""
    from .operators.scans import asof_join

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    errors = e.filter("event_type = 'error'").select("user_id", F.col("at").alias("began"), F.col("event_id").alias("last_error"))
    return asof_join(e.select("user_id", "event_id", "at"), errors, ["user_id"], "at", "began").select("event_id", "last_error")


# --- words ---


@query("""
WITH w AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(text, '[ \\n\\r\\t\\f\\x0b]+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(string_split_regex(text, '[ \\n\\r\\t\\f\\x0b]+'), lambda x: x <> ''), 1) - 1 AS i FROM conversations),
s AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(word, '[.!?][\"'')\\]}]*$') AND NOT regexp_matches(lower(word), '^(mr|mrs|ms|dr|prof|sen|rep|gov|st|no|jr|sr|inc|ltd)\\.$') AND NOT regexp_matches(word, '^([A-Za-z]\\.){2,}$') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM w)
SELECT conv_id, turn, min(i)::DOUBLE AS start_s, (max(i) + 1)::DOUBLE AS end_s, string_agg(word, ' ' ORDER BY i) AS text FROM s GROUP BY conv_id, turn, k""")
def sentences_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of turns' words, a second each, with no limit to a cue: its sentences."""
    ws = F.filter(F.split("text", r"[ \n\r\t\f\x0b]+"), lambda x: x != "")
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(ws).alias("i", "text"))
    w = w.select("conv_id", "turn", "i", F.col("i").cast("double").alias("start_s"), (F.col("i") + 1.0).alias("end_s"), "text")
    big = 1 << 30
    return D.resegment_words(w, ["conv_id", "turn"], ["i"], big, big, float(big), 4)


@query("""
SELECT user_id, event_id, CASE WHEN o.b IS NULL THEN 0 ELSE round(least(o.b, t + 3000) - t, 3) END AS covered FROM (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events) e
LEFT JOIN (SELECT user_id AS u, min(s) AS a, max(z) AS b FROM (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, z ROWS UNBOUNDED PRECEDING) AS k FROM (
SELECT *, max(z) OVER (PARTITION BY user_id ORDER BY s, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT user_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 60 AS z FROM events WHERE event_id % 2 = 0 AND value > 0))) GROUP BY user_id, k) o ON e.user_id = o.u AND t >= o.a AND t < o.b""")
def time_left_in_island(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each event's island of every other event's range goes on, 3000 seconds at most."""
    e = spans(spark, sf_dir)
    held = L.islands(e.filter("event_id % 2 = 0").select("user_id", "start_s", (F.col("start_s") + F.col("value") * 60).alias("end_s")), ["user_id"])
    points = e.select("user_id", "event_id", F.col("start_s").alias("at"), (F.col("start_s") + 3000).alias("stop"))
    return K.covered_length(held, points, "user_id").select("user_id", "event_id", F.round("covered", 3).alias("covered"))
