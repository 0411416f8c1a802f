"""Keys, groups and reasons where they were wrong before."""

from pyspark.sql import functions as F

from cuemill.functions import numeric as N, text as X
from cuemill.operators import clips as K, corpus as C


def test_case_folding_is_full(spark):
    said = ["ﬁn ﬀ Straße", "ſhort ς Σ", "İI", "ΑΣ", "ŉ ǰ", "µ ϐ", "", "plain A"]
    got = spark.createDataFrame([(t,) for t in said], "t string").select("t", X.fold("t").alias("f")).collect()
    assert [r["f"] for r in got] == [r["t"].casefold() for r in got]


def test_groups_of_rows_that_share_an_id(spark):
    rows = [(1, "same cat"), (1, "other dog"), (2, "Same  CAT"), (3, "ﬁne"), (4, "Fine"), (3, "ﬁne"), (5, None), (6, " ")]
    got = C.duplicate_groups(spark.createDataFrame(rows, "i int, t string"), "t", "i").collect()
    assert sorted((r["caption"], r["n"], r["first"]) for r in got) == [("same cat", 2, 1), ("ﬁne", 3, 3)]


def test_reasons_say_what_was_measured(spark):
    why = N.reject_reasons(F.lit(0.4), F.lit(0.955), F.lit(0.1), F.lit(2.0), F.lit(1.0), F.lit(True), F.lit(True), max_static=0.5, min_sharpness=3.0, max_silence=0.9)
    assert spark.range(1).select(why).first()[0] == ["too short (0.40s < 1.00s)", "mostly black (95.5% > 80.0%)", "too static (frame difference 0.100 <= 0.500)", "low sharpness (2.00 < 3.00)", "mostly silent (100.0% > 90.0%)"]
    fine = N.reject_reasons(F.lit(1.0), F.lit(0.9), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(False), F.lit(True), max_silence=1.0)
    assert spark.range(1).select(fine).first()[0] == []


def test_reasons_of_runs_in_the_order_of_their_first_rows(spark):
    rows = [(1, 3, "stop"), (1, 1, "length"), (1, 2, "stop"), (2, 1, "stop"), (2, 2, ""), (3, 1, None), (None, 1, "x")]
    got = K.finish_reasons(spark.createDataFrame(rows, "k int, o int, r string"), ["k"], "o", "r").collect()
    assert {r["k"]: r["finish_reason"] for r in got} == {1: '["length","stop"]', 2: "stop", 3: None, None: "x"}
