"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and read as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cuemill.llm import common as C
from cuemill.llm.bpe import encode_decode
from cuemill.llm.jaccard_join import keep_one
from cuemill.llm.mixing import mix
from cuemill.llm.quality_rules import keep_good
from cuemill.llm.suffix_dedup import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go.

    Null and empty texts have too few words and go; repeated rows are judged
    alike; other columns stay as they are.
    """
    C.ship_package(spark)
    C.lean_workers(spark)
    return keep_good(docs)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that of the least id, null last.

    Of repeated rows one stays; rows without words (or text) all stay.
    """
    C.ship_package(spark)
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 400 bytes and more, or of over 50 words, that appear twice go, from every text that has them.

    Words are compared one by one; the white space between them doesn't count.

    A character that is cut in part goes too, and no other one; a text of which
    nothing is left goes with its document. Null and empty texts stay; of rows
    that are repeated, every one is a copy of another.
    """
    C.ship_package(spark)
    added = ("_kept", "_n_bytes", "_n_removed", "_n_spans", "_n_repeated")
    clash = {c: free for c, free in zip(added, C.unused(docs, *[f"{c}_given" for c in added]), strict=True) if c in docs.columns}
    done = remove_repeats(docs.withColumnsRenamed(clash), characters=True, passages=True)
    done = done.filter("_n_removed = 0 OR _n_removed < _n_bytes")
    whole = F.col("_n_removed") == 0
    text = F.when(whole, F.col("text")).otherwise(F.col("_kept").cast("string"))
    done = done.withColumn("text", text)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return done.select(*[C.column(clash.get(c, c)).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that the mix takes them: words taken over size, rounded up; those not taken go.

    One document of a source at most is taken in part, at its target; so a
    source's words are within a document of it. Null and blank texts have no
    words and go; rows alike in id, source and size are matched one to one, in
    the order of their texts' hashes.
    """
    C.ship_package(spark)
    doc, source, size, place, taken, words_of, here, copy = C.unused(docs, "_doc", "_source", "_size", "_place", "_taken", "_words", "_here", "_copy")
    rows, _ = mix(docs)
    key = Window.partitionBy(doc, source, size)
    rows = rows.filter("size > 0").select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("size").alias(size), F.col("taken").alias(taken))
    rows = rows.withColumn(place, F.row_number().over(key.orderBy(F.desc(taken)))).filter(F.col(taken) > 0)
    words = docs.withColumn(words_of, C.n_words())
    own = Window.partitionBy("doc_id", "source", words_of)
    words = words.withColumn(here, F.row_number().over(own.orderBy(F.xxhash64("text"))))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(words_of) == F.col(size)) & (F.col(here) == F.col(place))
    times = F.ceil(F.col(taken) / F.col(size)).cast("int")
    joined = words.join(rows, same).withColumn(copy, F.explode(F.sequence(F.lit(1), times)))
    return joined.select(*[C.column(c) for c in docs.columns])


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document in the mix, and digests of ids and decoded text.

    A null text counts as empty; repeated rows are encoded each.
    """
    C.ship_package(spark)
    return encode_decode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("source mix", source_mix),
    ("BPE encoding", bpe),
]

#: The near-duplicate, suffix, mix and BPE stages have no SQL; ``tests/llm`` holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.lean_workers(spark)
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
