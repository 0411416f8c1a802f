"""Registered queries of the training-data operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C, quality_rules, vector_codes

Query = Callable[[SparkSession, str], DataFrame]


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    rows, _ = mix(C.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op9_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import read_media, store_as_media

    return read_media(store_as_media(C.table(spark, sf_dir, "documents"))).drop("codec", "duration_ms")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(C.table(spark, sf_dir, "documents")).drop("failed_rule")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, predict

    docs = C.table(spark, sf_dir, "documents")
    held_out = F.coalesce(C.crc_mod("doc_id", 5) == 0, F.lit(False))
    langs, prototypes = fit(docs.filter(~held_out).select("text", "lang"))
    return predict(docs, langs, prototypes).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_crf import fit, score

    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    held_out = F.coalesce(C.crc_mod("doc_id", 3) == 1, F.lit(False))
    model = fit(docs, labels.filter(~held_out))
    scored = score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import encode_store, read_store

    folder = C.scratch_path(spark, "shards")
    return read_store(encode_store(C.table(spark, sf_dir, "documents"), folder), folder)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(C.table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import digest

    return digest(C.table(spark, sf_dir, "documents"), count=True)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(C.table(spark, sf_dir, "documents")).drop("text_hash")


def op6_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .attention_lm import score_corpus

    docs = C.table(spark, sf_dir, "documents")
    held_out = F.coalesce(C.crc_mod("doc_id", 7) == 2, F.lit(False))
    scored = score_corpus(docs.select("doc_id", "text", (~held_out).alias("train")))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(C.table(spark, sf_dir, "embeddings"))
    found = vector_codes.with_totals(coded, "label", "error", "label_error")
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    held_out = F.coalesce(C.crc_mod("doc_id", 5) == 0, F.lit(False))
    scored = score(docs, fit(docs, labels.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(C.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_crf": op2_quality_crf,
    "op3_token_store": op3_token_store,
    "op5_bpe": op5_bpe,
    "op4_jaccard_join": op4_jaccard_join,
    "op6_attention_lm": op6_attention_lm,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_iso_media": op9_iso_media,
    "op10_language_id": op10_language_id,
    "op11_vector_codes": op11_vector_codes,
    "op12_toxicity": op12_toxicity,
    "op13_alignment": op13_alignment,
}

#: All pairs that share a shingle, and all that a document reaches over links: for small tables.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.b)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n"""

SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.SQL,
    "op4_jaccard_join": JACCARD_SQL,
    "op11_vector_codes": vector_codes.SQL,
}
