"""Sets of changes to JSON documents: merged in any order, applied to the documents they are of.

A change is a row of ``path, field, value, at, writer``: the JSON of a field's
new value, or null where the field is to go. A null field stands for the whole
document, which a change with a null value deletes and one with an object's JSON writes anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: The order in which changes of one field count: the later time, then the larger writer, then the larger value, no value first.
_RANK = ("at", "writer", "value")


def merged_changes(*sets: DataFrame) -> DataFrame:
    """The last change of each field of each document in all ``sets``, and of each document as a whole.

    The order of sets and rows, and whether some of them came before, make no
    difference, so partial sets may be merged step by step, in any tree; a
    path's rows are put together on the map side first. Rows without a path, or
    without a time, are left out; a value that is no JSON deletes nothing and is left out, too.
    """
    rows = reduce(DataFrame.unionByName, [s.select("path", "field", "value", "at", "writer") for s in sets])
    rows = rows.filter(F.col("path").isNotNull() & F.col("at").isNotNull() & (F.col("value").isNull() | F.try_parse_json("value").isNotNull()))
    last = rows.groupBy("path", "field").agg(F.max(F.struct(*_RANK)).alias("_last"))
    return last.select("path", "field", "_last.value", "_last.at", "_last.writer")


def _entries(value: Column) -> Column:
    parsed = F.try_parse_json(value)
    return F.when(F.coalesce(F.schema_of_variant(parsed), F.lit("VOID")).startswith("OBJECT"), parsed).cast("map<string,variant>")


def applied_changes(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """``path, content`` of the documents after the changes; those that were deleted are left out, new ones come in.

    A change of the whole document undoes the fields' changes up to its time.
    Fields that change stand after the others, by name. A document that is no
    object, or null, counts as one without fields once a field of it changes,
    and stays as it is otherwise. Of documents with one path the largest counts.
    """
    last = merged_changes(changes)
    whole = last.filter("field IS NULL").select("path", F.struct(*_RANK).alias("_whole"))
    fields = last.filter("field IS NOT NULL").join(whole.select(F.col("path").alias("_path"), F.col("_whole.at").alias("_since")), F.col("path") == F.col("_path"), "left")
    fields = fields.filter(F.col("_since").isNull() | (F.col("at") > F.col("_since")))
    by_path = fields.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("field", "value"))).alias("_fields"))
    base = documents.filter("path IS NOT NULL").groupBy("path").agg(F.max("content").alias("_content"), F.lit(True).alias("_there"))
    met = base.join(whole, "path", "full").join(by_path, "path", "full")

    start = F.when(F.col("_whole").isNotNull(), F.col("_whole.value")).otherwise(F.col("_content"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    changed = F.transform("_fields", lambda f: f["field"])
    kept = F.map_filter(F.coalesce(_entries(start), empty), lambda k, v: ~F.array_contains(changed, k))
    new = F.map_from_entries(F.transform(F.filter("_fields", lambda f: f["value"].isNotNull()), lambda f: F.struct(f["field"], F.try_parse_json(f["value"]))))
    content = F.when(F.col("_fields").isNull(), start).otherwise(F.to_json(F.map_concat(kept, new)))
    alive = F.when(F.col("_fields").isNotNull(), True).when(F.col("_whole").isNotNull(), F.col("_whole.value").isNotNull()).otherwise(F.coalesce("_there", F.lit(False)))
    return met.filter(alive).select("path", content.alias("content"))
