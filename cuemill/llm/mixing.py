"""Mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is read at most so many times over.
MAX_EPOCHS = 3
#: Words of a block; smaller where the corpus would have fewer than MIN_SLOTS blocks.
BLOCK_WORDS = 1024
MIN_SLOTS = 32768
#: 2**32 divided by the golden ratio, made odd.
GOLDEN = 2654435769
#: Rows of a bucket or slots of a chunk, over which running sums are taken in one task.
RUN = 4096
#: Cells of [0, 1) by which slots find the source whose interval holds their point.
CELLS = 1024


def golden_point(i: Column) -> Column:
    """frac(i / golden ratio) to 32 bits, in integer arithmetic without overflow."""
    low, high = i.bitwiseAND(0xFFFF), F.shiftright(i, 16).bitwiseAND(0xFFFF)
    product = F.shiftleft((high * GOLDEN).bitwiseAND(0xFFFF), 16) + low * GOLDEN
    return product.bitwiseAND(0xFFFFFFFF) / F.lit(float(2**32))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` for rows of ``source, size``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    the sum of all sizes. A target above ``epochs`` times its source's size is
    cut to that, and what is cut goes to the others by weight until none is
    above. Sorted by cap over weight, the sources that are cut are the first
    ones; taking one more away raises the level (words per weight) of the rest
    until the last one that is cut and lowers it after, so the highest level holds.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(every).cast("double"))
    per = per.withColumn("cut", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("total") - F.col("cut")) / F.col("rest")
    per = per.withColumn("level", F.max(level).over(every))
    target = F.least(F.col("cap"), F.col("level") * F.col("weight"))
    return per.select("source", "source_size", "weight", "total", target.alias("target"))


def running_start(rows: DataFrame, key: list[str], order: list[str], run: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its ``key``.

    ``run`` cuts each key's order into short runs: sums of whole runs are added
    up first, then each run on its own, so that no task holds a whole key.
    """
    before = Window.unboundedPreceding
    runs = rows.groupBy(*key, run).agg(F.sum(value).alias("_sum"))
    runs = runs.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.partitionBy(*key).orderBy(run).rowsBetween(before, -1)), F.lit(0)))
    runs = runs.select(*[F.col(k).alias(f"_of_{k}") for k in [*key, run]], "_base")
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*key, run]]
    both = rows.join(runs, same).select(*rows.columns, "_base")
    inner = Window.partitionBy(*key, run).orderBy(*order).rowsBetween(before, -1)
    return both.withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_base")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, min_slots: int = MIN_SLOTS) -> tuple[DataFrame, DataFrame]:
    """Schedule the words of ``docs`` (``doc_id, text, source``) to the target weights.

    Every source's rows are shuffled by a hash and laid end to end, as often as
    the target asks and at most ``epochs`` times; the stream is cut into blocks
    of equal words. Slot i of the mix takes the point frac(i / golden ratio),
    maps it through the sources' cumulative targets, and gets the next block of
    the source it falls in (its rank among that source's slots). Slots that a
    source still lacks at the end close the schedule; its last block ends at
    the target, rounded to words.

    Returns ``rows`` (``doc_id, source, size, source_size, target, taken``, one
    for each input row) and ``schedule`` (``slot, source, rank, doc_id,
    from_word, to_word``: which words of which document fill a slot).

    A null or blank text has size 0 and is never taken; null sources are one
    source; repeated rows each have their own place; an empty table gives empty
    results. Other columns are ignored.
    """
    sized = C.materialize(docs.select("doc_id", "source", C.n_words().alias("size")), "mix-sizes")
    targets = source_targets(sized, weights, epochs)
    targets = C.materialize(
        targets.withColumn("words", F.least(F.round("target"), F.col("source_size") * epochs).cast("long"))
        .withColumn("high", F.sum("words").over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("all_words", F.sum("words").over(Window.partitionBy())),
        "mix-targets",
    )
    n_rows, all_words = sized.count(), targets.agg(F.coalesce(F.max("all_words"), F.lit(0))).first()[0]
    block = max(1, min(block_words, all_words // min_slots))
    slots = -(-all_words // block)

    # Rows in shuffled order, with the place of their first word in their source's stream.
    runs = max(1, n_rows // RUN)
    placed = sized.withColumn("_h", C.doc_hash("mix", "doc_id")).withColumn("_run", F.pmod(F.shiftright("_h", 32), F.lit(runs)))
    placed = C.materialize(running_start(placed, ["source"], ["_h", "doc_id", "size"], "_run", "size", "start").drop("_h", "_run"), "mix-placed")

    # The pieces of rows that lie in each block of each source.
    joined = placed.filter("size > 0").join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    joined = joined.select("doc_id", "source", "size", "start", "source_size", "words", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    first = F.col("epoch") * F.col("source_size") + F.col("start")
    joined = joined.withColumn("first", first).withColumn("last", F.least(F.col("first") + F.col("size"), F.col("words"))).filter("last > first")
    pieces = joined.withColumn("rank", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("last") - 1) / block))))
    begin, end = F.greatest(F.col("first"), F.col("rank") * block), F.least(F.col("last"), (F.col("rank") + 1) * block)
    pieces = pieces.select("doc_id", "source", "start", "rank", (begin - F.col("first")).alias("from_word"), (end - F.col("first")).alias("to_word"))

    # Slots: point, source, rank among the source's slots.
    cells = targets.filter("words > 0").select("source", "words", ((F.col("high") - F.col("words")) / F.col("all_words")).alias("_from"), (F.col("high") / F.col("all_words")).alias("_to"))
    cells = cells.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") * CELLS), F.least(F.floor(F.col("_to") * CELLS), F.lit(CELLS - 1)))))
    spark = docs.sparkSession
    drawn = spark.range(slots, numPartitions=C.shuffle_partitions(spark)).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("_u"))
    drawn = drawn.withColumn("_cell", F.floor(F.col("_u") * CELLS)).join(cells, "_cell").filter("_u >= _from AND _u < _to")
    drawn = drawn.select("slot", "source", F.lit(1).alias("_one"), F.floor(F.col("slot") / RUN).alias("_run"))
    ranked = running_start(drawn, ["source"], ["slot"], "_run", "_one", "rank").select("slot", "source", F.col("rank").cast("long").alias("rank"))
    ranked = C.materialize(ranked, "mix-slots")
    drawn_by = ranked.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("_n"))
    lacking = targets.join(drawn_by, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    needed = F.ceil(F.col("words") / block)
    lacking = lacking.filter(F.col("_n") < needed).select("source", F.explode(F.sequence(F.col("_n"), needed - 1)).alias("rank"))
    closing = lacking.select(F.lit(slots).alias("slot"), "source", F.col("rank").cast("long").alias("rank"))
    ranked = ranked.unionByName(closing)

    r = ranked.select("slot", F.col("source").alias("_s"), F.col("rank").alias("_r"))
    schedule = pieces.join(r, pieces["source"].eqNullSafe(r["_s"]) & (pieces["rank"] == r["_r"])).drop("_s", "_r")
    taken = schedule.groupBy(F.col("source").alias("_s"), F.col("start").alias("_start")).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    t = targets.select(F.col("source").alias("_t"), "source_size", "target")
    rows = placed.join(t, F.col("source").eqNullSafe(F.col("_t")))
    rows = rows.join(taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
    rows = rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return rows, schedule.select("slot", "source", "rank", "doc_id", "from_word", "to_word")
