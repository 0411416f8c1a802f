"""Registered queries of segment plans, budgets, transcripts and run figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import numeric as N
from .operators import clips as K, conversation as V, frames as R, timeline as L
from .plans import segments as P
from .registry import query, table
from .sources import sinks
from .streaming import events as E


def r6(c):
    return F.round(c, 6)


def _clips(df: DataFrame, plan) -> DataFrame:
    """A row for each segment of a plan with how many warnings it has and the first one."""
    planned = df.withColumn("p", plan)
    said = planned.select("p_partkey", F.size("p.warnings").alias("n_warnings"), F.get("p.warnings", F.lit(0)).alias("warning"), F.posexplode_outer("p.segments").alias("i", "s"))
    return said.select("p_partkey", "i", r6(F.col("s.start_s")).alias("start_s"), r6(F.col("s.end_s")).alias("end_s"), "n_warnings", "warning")


@query("""
WITH p AS (SELECT p_partkey, p_size::DOUBLE AS d, least(p_size, 2.0)::DOUBLE AS a, least(p_size, 40.0)::DOUBLE AS b FROM part), q AS (SELECT *, b - a AS len FROM p),
n AS (SELECT *, CASE WHEN len <= 15 + 1e-9 THEN 1 ELSE 1 + greatest(0, ceil((len - 15 - 1e-9) / 14)) END AS n FROM q WHERE b > a)
SELECT p_partkey, i::INT AS i, round(a + i * 14, 6) AS start_s, round(CASE WHEN n = 1 THEN b ELSE least(b, a + i * 14 + 15) END, 6) AS end_s, (n > 1)::INT AS n_warnings,
  CASE WHEN n > 1 THEN 'Scene 1 (' || len::BIGINT || ' s) exceeds model''s 15 s limit -> split into ' || n::BIGINT || ' clips' END AS warning FROM (SELECT *, unnest(range(0, n::BIGINT)) AS i FROM n)
UNION ALL SELECT p_partkey, NULL, NULL, NULL, 1, 'Trim end must be greater than trim start.' FROM q WHERE b <= a AND d > 0
UNION ALL SELECT p_partkey, NULL, NULL, NULL, 1, 'Source duration is unavailable.' FROM q WHERE d <= 0""")
def planned_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = P.plan_segments("whole", "p_size", limit=F.lit(15.0), overlap=1.0, trim_start=2.0, trim_end=40.0)
    return _clips(table(spark, sf_dir, "part").select("p_partkey", "p_size"), plan)


@query("""
WITH n AS (SELECT p_partkey, p_size::DOUBLE AS d, 1 + greatest(0, ceil((p_size - 81 / 16.0 - 1e-9) / (81 / 16.0 - 0.5))) AS n FROM part)
SELECT p_partkey, i::INT AS i, round(i * (81 / 16.0 - 0.5), 6) AS start_s, round(least(d, i * (81 / 16.0 - 0.5) + 81 / 16.0), 6) AS end_s, 0 AS n_warnings, NULL AS warning FROM (SELECT *, unnest(range(0, n::BIGINT)) AS i FROM n) WHERE d > 0""")
def planned_trainer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clips(table(spark, sf_dir, "part").select("p_partkey", "p_size"), P.plan_segments("trainer", "p_size", target="wan", overlap=0.5))


@query("""
WITH s AS (SELECT p_partkey, p_size, unnest([0, 1, 2]) AS k FROM part), r AS (SELECT p_partkey, k, (k * 7)::DOUBLE AS a, least(p_size, k * 7 + p_size % 9)::DOUBLE AS b FROM s),
c AS (SELECT p_partkey, a, b, row_number() OVER (PARTITION BY p_partkey ORDER BY a, b) - 1 AS i FROM r WHERE b > a),
w AS (SELECT p_partkey, p_size::DOUBLE AS d FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM c))
SELECT p_partkey, i::INT AS i, a AS start_s, b AS end_s, 0 AS n_warnings, NULL AS warning FROM c UNION ALL SELECT p_partkey, 0, 0.0, d, 1, 'Scene detection failed; using the selected range as one clip.' FROM w""")
def planned_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    scenes = F.transform(F.array(F.lit(2), F.lit(0), F.lit(1)), lambda k: F.struct((k * 7).cast("double").alias("start_s"), (k * 7 + size % 9).cast("double").alias("end_s")))
    return _clips(table(spark, sf_dir, "part").select("p_partkey", "p_size"), P.plan_segments("scenes", "p_size", scenes=scenes))


@query("""
SELECT p_partkey, f AS frames, round(f / (p_size % 30 + 10.0), 6) AS seconds FROM (SELECT *, unnest([17, 33, 49, 65, 81, 97, 113, 129]) AS f FROM part)""")
def suggested_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select("p_partkey", F.explode(P.suggested_lengths("wan", F.col("p_size") % 30 + 10)).alias("s"))
    return s.select("p_partkey", "s.frames", r6(F.col("s.seconds")).alias("seconds"))


@query("""
WITH p AS (SELECT p_partkey, (p_size % 5)::DOUBLE AS fps, p_size * 10000 AS px FROM part),
d AS (SELECT *, least(greatest(1, 32768 - 4096) / greatest(1.0, greatest(0.01, fps) * greatest(784, px) / 2048.0 + 13), 768 / greatest(0.01, fps)) AS s FROM p)
SELECT p_partkey, round(s, 6) AS longest, round(CASE WHEN px % 3 = 0 THEN s ELSE least(s, 60) END, 6) AS effective, round(px * 4096.0 / 1073741824, 9) AS cache_gb FROM d""")
def model_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.col("p_size") * 10000
    longest = P.max_duration(F.col("p_size") % 5, px, context=F.lit(32768), audio_rate=13.0, max_frames=768)
    least = P.least_positive(longest, F.when(px % 3 == 0, 0.0).otherwise(60.0))
    return table(spark, sf_dir, "part").select("p_partkey", r6(longest).alias("longest"), r6(least).alias("effective"), F.round(P.kv_cache_gb(px, F.lit(4096)), 9).alias("cache_gb"))


@query("""
WITH n AS (SELECT p_partkey, p_size + 50.0 AS d, greatest(0, ceil((p_size + 50.0 - 5 - 1e-9) / 30)) AS n FROM part WHERE p_size % 3 <> 0)
SELECT p_partkey, round(5 + i * 30, 6) AS start_s, round(least(d, 5 + i * 30 + 30), 6) AS end_s FROM (SELECT *, unnest(range(0, n::BIGINT)) AS i FROM n)""")
def sound_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = P.sound_windows(F.col("p_size") + 50.0, F.col("p_size") % 3 != 0, start=F.lit(5.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(w).alias("w")).select("p_partkey", r6(F.col("w.start_s")).alias("start_s"), r6(F.col("w.end_s")).alias("end_s"))


@query("""
WITH p AS (SELECT p_partkey, greatest(1, ceil(p_size * 2.5))::BIGINT AS requested, greatest(1, floor((16384 - 2048 - p_size * 20 - 512) / 196))::BIGINT AS cap FROM part)
SELECT p_partkey, requested, least(requested, 96, 80, cap)::BIGINT AS selected, cap AS context_cap FROM p""")
def frame_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = P.frame_budget("p_size", F.lit(2.5), max_frames=96, hard_max=80, context=16384, reserve=2048, max_pixels=448 * 448, audio_tokens=F.col("p_size") * 20)
    return table(spark, sf_dir, "part").select("p_partkey", b.alias("b")).select("p_partkey", "b.requested", "b.selected", "b.context_cap")


@query("""
WITH p AS (SELECT p_partkey, (SELECT max(t) FROM (VALUES (6), (8), (10), (12), (16), (24), (32), (48), (80), (96)) v(t) WHERE t <= greatest(6, p_size)) AS tier, greatest(4096, p_size * 1000) AS wanted FROM part),
c AS (SELECT *, least(wanted, CASE WHEN tier <= 16 THEN 8192 WHEN tier <= 24 THEN 16384 ELSE 32768 END)::BIGINT AS context FROM p) SELECT p_partkey, context, context < wanted AS clamped FROM c""")
def server_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.server_context(N.memory_tier("p_size"), F.col("p_size") * 1000)
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.context", "c.clamped")


@query("SELECT p_partkey, least(4, CASE WHEN p_size >= 40 THEN 4 WHEN p_size >= 30 THEN 3 WHEN p_size >= 20 THEN 2 WHEN p_size >= 10 THEN 1 ELSE 0 END)::INT AS layers FROM part")
def layers_that_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.lit(10 * 1024**3).cast("long"))
    return table(spark, sf_dir, "part").select("p_partkey", P.layers_within(sizes, "p_size").alias("layers"))


@query("""
WITH p AS (SELECT p_partkey, p_size * 10000 AS px, p_size % 8 AS f, p_size % 3 AS r FROM part)
SELECT p_partkey, CASE WHEN px > 200000 THEN 'max_pixels ' || px || ' -> ' || greatest(200000, floor(px * 0.75)::BIGINT) WHEN f > 4 THEN 'max_frames ' || f || ' -> ' || greatest(4, floor(f * 0.75)::BIGINT) WHEN r > 1 THEN 'fps ' || r || ' -> 1' END AS change FROM p""")
def degraded_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.degraded(F.col("p_size") * 10000, F.col("p_size") % 8, F.col("p_size") % 3, 200000)
    return table(spark, sf_dir, "part").select("p_partkey", d["change"].alias("change"))


@query("""
WITH s AS (SELECT o_orderkey, (200 + o_orderkey % 1900)::DOUBLE AS w, (150 + o_orderkey % 1100)::DOUBLE AS h FROM orders), t AS (SELECT *, CASE WHEN w < h THEN 480 ELSE 832 END AS tw, CASE WHEN w < h THEN 832 ELSE 480 END AS th FROM s),
k AS (SELECT *, greatest(tw / w, th / h) AS f FROM t), d AS (SELECT o_orderkey, greatest(tw, greatest(2, round_even(w * f / 2, 0)::BIGINT * 2)) - tw AS dx, greatest(th, greatest(2, round_even(h * f / 2, 0)::BIGINT * 2)) - th AS dy FROM k)
SELECT o_orderkey, floor(dx / 2)::BIGINT AS lft, floor(dy / 2)::BIGINT AS top, (dx - floor(dx / 2))::BIGINT AS rgt, (dy - floor(dy / 2))::BIGINT AS bottom FROM d""")
def crop_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", N.bucket_padding(200 + k % 1900, 150 + k % 1100, (832, 480), "crop").alias("m"))
    return o.select("o_orderkey", F.col("m.left").alias("lft"), "m.top", F.col("m.right").alias("rgt"), "m.bottom")


@query("""
SELECT p_partkey, i, CASE WHEN n = 1 THEN 0 ELSE round_even(i * (p_size - 1.0) / (n - 1), 0)::BIGINT END AS at FROM (SELECT p_partkey, p_size, n, unnest(range(0, n)) AS i FROM (SELECT *, least(12, p_size)::BIGINT AS n FROM part))""")
def uniform_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(N.uniform_indexes("p_size", 12)).alias("i", "at"))
    return u.select("p_partkey", F.col("i").cast("long").alias("i"), "at")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN round(30000.0 / (1000 + p_size), 9) WHEN p_size % 4 = 1 THEN p_size::DOUBLE END AS rate FROM part")
def frame_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("p_size").cast("string"), F.col("p_size") % 4
    text = F.when(k == 0, F.concat(F.lit("30000/"), (1000 + F.col("p_size")).cast("string"))).when(k == 1, s).when(k == 2, "N/A").otherwise("5/0")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(N.fraction(text), 9).alias("rate"))


# --- transcripts and figures of runs ---

_EVENTS = "SELECT event_id, user_id, event_type, ts, value, epoch_us(ts) / 1e6 AS start_s, epoch_us(ts) / 1e6 + value * 600 AS end_s FROM events"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value", t.alias("start_s"), (t + F.col("value") * 600).alias("end_s"))


@query(f"""
WITH e AS ({_EVENTS}), c AS (SELECT DISTINCT user_id, floor(start_s / 86400) * 86400 AS a FROM e)
SELECT c.user_id, c.a AS clip, e.event_id, round(greatest(start_s, a) - a, 3) AS at_s, round(greatest(greatest(start_s, a) - a, least(end_s, a + 43200) - a), 3) AS to_s FROM c JOIN e ON c.user_id = e.user_id AND c.a + 43200 > e.start_s AND c.a < e.end_s""")
def clip_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spans(spark, sf_dir)
    clips = e.select("user_id", (F.floor(F.col("start_s") / 86400) * 86400).cast("double").alias("start_s")).distinct().withColumn("end_s", F.col("start_s") + 43200)
    speech = e.select("user_id", "event_id", F.col("start_s").alias("o_start"), F.col("end_s").alias("o_end"))
    out = K.clip_speech(clips, speech, "user_id", 86400.0)
    return out.select("user_id", F.col("start_s").alias("clip"), "event_id", F.round("at_s", 3).alias("at_s"), F.round("to_s", 3).alias("to_s"))


def _reason(e: DataFrame) -> DataFrame:
    return e.withColumn("reason", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")))


@query("""
WITH f AS (SELECT user_id, event_type AS r, min(event_id) AS first FROM events WHERE event_type <> 'view' GROUP BY ALL), l AS (SELECT user_id, count(*) AS n, string_agg('"' || r || '"', ',' ORDER BY first) AS all_of, min(r) AS one FROM f GROUP BY user_id)
SELECT DISTINCT e.user_id, CASE WHEN n = 1 THEN one WHEN n > 1 THEN '[' || all_of || ']' END AS finish_reason FROM events e LEFT JOIN l USING (user_id)""")
def finish_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.finish_reasons(_reason(table(spark, sf_dir, "events")), ["user_id"], "event_id", "reason")


@query("""
WITH e AS (SELECT *, event_type = 'error' AS bad FROM events), m AS (SELECT user_id, event_type AS v, min(event_id) AS first FROM e WHERE NOT bad GROUP BY ALL), l AS (SELECT user_id, count(*) AS n, string_agg('"' || v || '"', ',' ORDER BY first) AS all_of, min(v) AS one FROM m GROUP BY user_id)
SELECT e.user_id, max(CASE WHEN n = 1 THEN one WHEN n > 1 THEN '[' || all_of || ']' END) AS model, CASE WHEN count(*) FILTER (NOT bad) > 0 THEN 'en' END AS language, round(coalesce(sum(value) FILTER (NOT bad), 0), 4) AS duration_s, coalesce(sum(event_id % 7) FILTER (NOT bad), 0)::BIGINT AS words,
  coalesce(bool_or(event_id % 50 = 0) FILTER (NOT bad), false) AS injected, count(*) FILTER (NOT bad) AS records, count(*) FILTER (bad) AS errors FROM e LEFT JOIN l USING (user_id) GROUP BY e.user_id""")
def transcript_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "broken").alias("error"), F.col("event_type").alias("model"), F.lit("en").alias("language"), F.col("value").alias("duration_s"), (F.col("value") / 10).alias("elapsed_s"), (i % 5).alias("segments"), (i % 7).alias("words"), (i % 50 == 0).alias("injected"))
    out = K.transcript_summary(rows, ["user_id"], "event_id")
    return out.select("user_id", "model", "language", F.round("duration_s", 4).alias("duration_s"), "words", "injected", "records", "errors")


@query("""
SELECT p_brand AS variant, max(p_retailprice) AS peak_gib, round(avg(p_size), 6) AS decode_tok_s_mean, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) ELSE 'mixed: ' || string_agg(p_type, ', ' ORDER BY p_partkey) END AS finish_reason, count(*) AS runs FROM part GROUP BY p_brand""")
def bench_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("variant"), "p_partkey", F.col("p_retailprice").alias("peak_gib"), *[F.col("p_size").alias(c) for c in ("prefill_tok_s", "decode_tok_s", "generated_tokens", "wall_clock_s")], F.col("p_type").alias("finish_reason"))
    return K.bench_summary(p, ["variant"], "p_partkey").select("variant", "peak_gib", r6(F.col("decode_tok_s_mean")).alias("decode_tok_s_mean"), "finish_reason", "runs")


@query(r"""
SELECT conv_id, count(*) AS segment_count, sum(CASE WHEN turn % 2 = 0 THEN turn + 1 ELSE len(regexp_extract_all(text, '\S+')) END)::BIGINT AS word_count, max(turn * 2.0) AS duration_s FROM conversations GROUP BY conv_id""")
def result_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "text", (F.col("turn") * 2.0).alias("end_s"), F.when(F.col("turn") % 2 == 0, F.col("turn") + 1).otherwise(0).alias("n_words"))
    return K.result_summary(c, "conv_id")


@query("""
WITH c AS (SELECT conv_id, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, place::INT AS place, turn * 1.5 AS start_s, text FROM c WHERE place <= 4 UNION ALL SELECT DISTINCT conv_id, NULL, NULL, 'showing 4 of ' || n || ' (open the JSON/TSV for all)' FROM c WHERE n > 4""")
def transcript_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("i"), (F.col("turn") * 1.5).alias("start_s"), (F.col("turn") * 1.5 + 1).alias("end_s"), "text")
    return K.transcript_rows(c, "conv_id", 4).drop("end_s")


@query("""
SELECT event_id, round(event_id / greatest((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6, 1e-9), 6) AS rate FROM events""")
def token_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.token_speed(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id")
    return out.select("event_id", r6(F.col("tok_per_s")).alias("rate"))


@query(f"""
WITH e AS ({_EVENTS}), m AS (SELECT *, max(end_s) OVER (PARTITION BY user_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e WHERE end_s > start_s),
k AS (SELECT *, sum(CASE WHEN start_s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS k FROM m), i AS (SELECT user_id, min(start_s) AS a, max(end_s) AS b FROM k GROUP BY user_id, k),
p AS (SELECT DISTINCT user_id, floor(start_s / 86400) * 86400 + 40000 AS at FROM e)
SELECT p.user_id, p.at, round(greatest(0, coalesce(max(CASE WHEN a <= p.at AND p.at < b THEN least(b, p.at + 20000) - p.at END), 0)), 3) AS covered FROM p LEFT JOIN i ON p.user_id = i.user_id GROUP BY ALL""")
def covered_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spans(spark, sf_dir)
    points = e.select("user_id", (F.floor(F.col("start_s") / 86400) * 86400 + 40000).cast("double").alias("at")).distinct().withColumn("stop", F.col("at") + 20000)
    out = K.covered_length(L.islands(e, ["user_id"]), points, "user_id")
    return out.select("user_id", "at", F.round("covered", 3).alias("covered"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round_even((value % 1 + 0.5) / 2, 4) ELSE round_even(exp(-value), 4) END AS probability FROM events")
def segment_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("event_id") % 3 == 0, F.array(F.col("value") % 1, F.lit(0.5)))
    return table(spark, sf_dir, "events").select("event_id", K.segment_probability(known, -F.col("value")).alias("probability"))


# --- frames and sound ---

_FRAMES = "SELECT vec_id // 25 AS clip, vec_id AS frame, list_transform(embedding[:16], lambda x: floor(abs(x::DOUBLE) * 400)::INT) AS px FROM embeddings"


def grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 4 by 4 grey values, 25 to a clip."""
    px = F.transform(F.slice("embedding", 1, 16), lambda x: F.floor(F.abs(x.cast("double")) * 400).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 25).cast("long").alias("clip"), F.col("vec_id").alias("frame"), px.alias("px"))


_CHANGES = f"SELECT *, CASE WHEN last IS NOT NULL THEN list_sum(list_transform(list_zip(px, last), lambda z: abs(z[1] - z[2])::DOUBLE)) / 16 END AS change FROM (SELECT *, lag(px) OVER (PARTITION BY clip ORDER BY frame) AS last FROM ({_FRAMES}))"
_LAPLACE = "list_transform(range(0, 16), lambda i: (px[CASE WHEN i % 4 = 0 THEN i + 2 ELSE i END] + px[CASE WHEN i % 4 = 3 THEN i ELSE i + 2 END] + px[CASE WHEN i < 4 THEN i + 5 ELSE i - 3 END] + px[CASE WHEN i >= 12 THEN i - 3 ELSE i + 5 END] - 4 * px[i + 1])::DOUBLE)"


@query(f"""
WITH f AS (SELECT clip, list_sum(px)::DOUBLE / 16 AS luma, len(list_filter(px, lambda x: x <= 16)) / 16.0 AS black, change, {_LAPLACE} AS e FROM ({_CHANGES})),
v AS (SELECT *, list_sum(list_transform(e, lambda x: x * x)) / 16 - (list_sum(e) / 16) * (list_sum(e) / 16) AS sharp FROM f)
SELECT clip, round(avg(luma), 4) AS mean_luma, round(avg(black), 4) AS black_ratio, round(coalesce(avg(change), 0), 4) AS static_score, round(avg(sharp), 3) AS sharpness FROM v GROUP BY clip""")
def clip_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = R.clip_quality(R.frame_features(grey(spark, sf_dir), "clip", "frame", "px", 4), "clip")
    return q.select("clip", *[F.round(c, 4).alias(c) for c in ("mean_luma", "black_ratio", "static_score")], F.round("sharpness", 3).alias("sharpness"))


@query(f"""
WITH c AS (SELECT clip, frame, sum(CASE WHEN change >= 62 THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY frame ROWS UNBOUNDED PRECEDING)::BIGINT AS scene FROM ({_CHANGES}))
SELECT clip, scene, min(frame) AS first, max(frame) AS last, count(*) AS frames FROM c GROUP BY clip, scene""")
def scene_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scene_cuts(R.frame_features(grey(spark, sf_dir), "clip", "frame", "px", 4), "clip", "frame", 62.0)


@query("""
WITH e AS (SELECT vec_id, embedding[:24] AS s FROM embeddings), p AS (SELECT vec_id, s, unnest(range(0, 16)) AS i FROM e), q AS (SELECT vec_id, s, i, least(i * 1.5::DOUBLE, 23.0) AS x FROM p)
SELECT vec_id, i::INT AS i, round(s[floor(x)::INT + 1]::DOUBLE + (s[least(floor(x)::INT + 2, 24)]::DOUBLE - s[floor(x)::INT + 1]::DOUBLE) * (x - floor(x)), 9) AS value, false AS silent FROM q""")
def resampled_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 24).alias("s"))
    out = s.select("vec_id", R.is_silent("s").alias("silent"), F.posexplode(R.resampled(F.col("s"), 48000, 32000)).alias("i", "value"))
    return out.select("vec_id", "i", F.round("value", 9).alias("value"), "silent")


# --- messages, events, documents ---


@query("""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), r AS (SELECT *, CASE WHEN turn % 7 = 3 THEN 'tool' WHEN turn % 7 = 5 THEN '' ELSE role END AS said FROM c)
SELECT conv_id, turn, said AS role, CASE WHEN said = 'tool' THEN 'Chat message ' || k || ' has an unsupported role: tool' WHEN said = '' THEN 'Chat message ' || k || ' has an unsupported role: <empty>' WHEN turn % 4 = 1 AND said <> 'user' THEN 'Chat message ' || k || ': only user messages can carry media' END AS error FROM r""")
def checked_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"role": F.when(t % 7 == 3, "Tool").when(t % 7 == 5, F.lit(None).cast("string")).otherwise(F.concat(F.lit(" "), F.upper("role"))), "media": F.when(t % 4 == 1, F.array(F.lit("a.mp4"))).when(t % 4 == 2, F.array(F.lit(" ")))})
    return V.normalized(c, "media").select("conv_id", "turn", "role", "error")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tail(table(spark, sf_dir, "events"), ["user_id"], "event_id", 5).select("event_id")


@query("""
WITH e AS (SELECT event_id, ['log', 'segment', 'item_error', 'error', 'other'][event_id % 5 + 1] AS kind, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS m FROM events)
SELECT event_id, CASE kind WHEN 'log' THEN CASE WHEN m <> '' THEN 'log' END WHEN 'segment' THEN 'segment' WHEN 'item_error' THEN 'item' WHEN 'error' THEN 'end' END AS route,
  CASE kind WHEN 'log' THEN nullif(m, '') WHEN 'item_error' THEN coalesce(nullif(m, ''), 'Whisper item failed') WHEN 'error' THEN coalesce(nullif(m, ''), 'Whisper worker failed') END AS said FROM e""")
def routed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("log", "segment", "item_error", "error", "other")])
    e = table(spark, sf_dir, "events").select("event_id", F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("kind"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(" ").alias("m"))
    return E.routed(e, "kind", "m").select("event_id", "route", "said")


@query("""
WITH e AS (SELECT *, event_type IN ('click', 'view') AS done, CASE WHEN event_id % 3 = 0 THEN 'm' || event_id WHEN event_id % 3 = 1 THEN 't' || event_id END AS caption FROM events)
SELECT user_id, arg_max('r' || event_id, event_id) FILTER (event_type = 'signup') AS run_dir, arg_max(caption, event_id) FILTER (done AND caption IS NOT NULL) AS caption_path, arg_max('c' || event_id, event_id) FILTER (done AND event_id % 4 = 0) AS clip_path FROM e GROUP BY user_id""")
def live_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 3
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("click", "view"), "Done").otherwise("running").alias("status"), F.when(F.col("event_type") == "signup", F.concat(F.lit("r"), i)).alias("run_dir"), F.when(k == 0, F.concat(F.lit("m"), i)).otherwise("").alias("merged"), F.when(k == 1, F.concat(F.lit("t"), i)).alias("txt"), F.lit(None).cast("string").alias("video"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("c"), i)).alias("clip_path"))
    return E.live_outputs(e, "user_id", "event_id")


@query("""
SELECT source, '{"_meta":{"format":"run","version":1},"app_version":"2","model_info":{},"settings":{"lang":"any"},"items_results":[' || string_agg('{"path":"p' || doc_id || '","status":"done"}', ',' ORDER BY doc_id) || '],"timings":{}}' AS json FROM documents GROUP BY source""")
def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.lit("done").alias("status"), F.create_map(F.lit("lang"), F.lit("any")).alias("settings"))
    return sinks.metadata_document(d, ["source"], "run", 1, "2", "settings", "doc_id")


@query("""
SELECT source, '{' || coalesce(string_agg('"d/' || lpad(doc_id::VARCHAR, 9, '0') || '.txt":"' || CASE WHEN doc_id % 2 = 0 THEN 'approved' ELSE 'rejected' END || '"', ',' ORDER BY doc_id) FILTER (doc_id % 5 > 1), '') || '}' AS json FROM documents GROUP BY source""")
def flags_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    path = F.concat(F.when(i % 5 == 0, "../").when(i % 5 == 1, "/").otherwise("d\\"), F.lpad(i.cast("string"), 9, "0"), F.lit(".txt"))
    d = table(spark, sf_dir, "documents").select("source", path.alias("path"), F.when(i % 2 == 0, "approved").otherwise("rejected").alias("flag"))
    return sinks.flags_document(d, ["source"], "path", "flag")


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '{"k":"' || p_size || '",' ELSE '{' END || '"video_caption":"' || p_name || '","audio_caption":"a","merged_caption":"' || p_name || ' a"}' AS parts,
  CASE p_size % 4 WHEN 0 THEN '{"k":"' || p_size || '","transcript":{"n":' || p_size || '}}' WHEN 1 THEN '{"transcript":{"n":' || p_size || '}}' WHEN 2 THEN '{"caption":"said \\"' || p_size || '\\"","transcript":{"n":' || p_size || '}}' ELSE '{"k":"' || p_size || '"}' END AS spoken FROM part""".replace("\\\\", "\\"))
def structured_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    own = F.concat(F.lit('{"k":"'), s, F.lit('"}'))
    k = F.col("p_size") % 4
    parts = sinks.with_parts(F.when(F.col("p_size") % 2 == 0, own), F.col("p_name"), F.lit("a"), F.concat("p_name", F.lit(" a")))
    spoken = sinks.with_transcript(F.when(k.isin(0, 3), own).when(k == 2, F.concat(F.lit('said "'), s, F.lit('"'))), F.when(k != 3, F.concat(F.lit('{"n":'), s, F.lit("}"))))
    return table(spark, sf_dir, "part").select("p_partkey", parts.alias("parts"), spoken.alias("spoken"))
