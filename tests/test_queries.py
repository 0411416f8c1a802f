"""Registered queries against their SQL, and streams against their batch forms."""

import math
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cuemill import queries as Q
from cuemill.functions import text as X
from cuemill.streaming import events as E

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def rows(found, names):
    return sorted([tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in found], key=str)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, tables, name):
    df = Q.QUERIES[name](spark, SF)
    sql = tables.execute(Q.SQL[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(sql.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_other_queries_run(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_word_replacement(spark):
    docs = {r["doc_id"]: r["text"] for r in Q.table(spark, SF, "documents").collect()}
    import re

    for r in Q.replace_whole_word(spark, SF).collect():
        assert r["text"] == re.sub(r"(?<!\w)the(?!\w)", "THE$1", docs[r["doc_id"]])


def test_joins_are_planned_as_equi_joins(spark):
    for name in ("overlap_pairs", "overlap_words", "corpus_join_status", "orphan_items"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_scans_read_only_what_is_needed(spark):
    plan = Q.tier_lookup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:" in plan and "l_extendedprice" not in plan and "Python" not in plan
    assert "Python" not in Q.curated_corpus(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_let_binds_once(spark):
    n = X.let(F.lit(2), lambda v: v * v)
    assert spark.range(1).select(n).first()[0] == 4


def run(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    deltas = [(1, 0, "<thi"), (1, 1, "nk>why</th"), (1, 2, "ink>ans"), (1, 3, "wer"), (2, 0, "plain")]
    spark.createDataFrame(deltas, "conv_id long, seq long, delta string").coalesce(1).write.parquet(str(tmp_path / "deltas"))
    got = run(E.gather_stream(spark.readStream.schema("conv_id long, seq long, delta string").parquet(str(tmp_path / "deltas"))), "answers", tmp_path).orderBy("conv_id", "seq").collect()
    assert "".join(r["answer_delta"] for r in got if r["conv_id"] == 1) == "answer" and "".join(r["reasoning_delta"] for r in got if r["conv_id"] == 1) == "why"
    ts = [datetime(2024, 1, 1) + timedelta(seconds=s) for s in (0, 0.3, 0.6, 1.2, 5)]
    logs = spark.createDataFrame([("k", t, i) for i, t in enumerate(ts)], "k string, ts timestamp, i int")
    logs.coalesce(1).write.parquet(str(tmp_path / "logs"))
    kept = run(E.gate_stream(spark.readStream.schema(logs.schema).parquet(str(tmp_path / "logs")), ["k"]), "gated", tmp_path)
    assert sorted(r["i"] for r in kept.collect()) == sorted(r["i"] for r in E.without_repeats(logs, ["k"], "ts").collect())


@pytest.mark.parametrize("name", ["scene_texts", "scene_subtitles", "fitted_sizes"])
def test_rows_of_a_small_file_go_to_all_tasks(spark, name):
    found = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
