"""Grouped texts: several units of a record as one text, and spans in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlake.functions.text import is_english


def grouped_units(units: DataFrame) -> DataFrame:
    """English title and abstract units of the records that have both."""
    english = units.where(is_english(F.col("language")) & F.col("unit_type").isin("title", "abstract"))
    both = english.groupBy("source_record_id").agg(F.count_distinct("unit_type").alias("n")).where("n = 2")
    return english.join(both, "source_record_id", "left_semi")


def build(units: DataFrame, keys: tuple[str, ...] = ("source_record_id",), text_col: str = "normalized") -> DataFrame:
    """keys, grouped_text and segments array<struct<unit, start, end>> in unit order.

    A section is a head line, the text and an end line; sections are joined by a
    line break.  Starts come from a running sum over the record's sections.
    """
    head = F.concat(
        F.lit('[[SECTION id="U'), F.col("text_unit_index"), F.lit('" type="'), F.col("unit_type"), F.lit('" locator="'), F.col("locator"), F.lit('"]]\n')
    )
    order = Window.partitionBy(*keys).orderBy("text_unit_index")
    rows = units.select(*keys, "text_unit_index", head.alias("head"), F.col(text_col).alias("body"), F.lit("\n[[END SECTION]]\n").alias("tail"))
    size = F.length("head") + F.length("body") + F.length("tail") + 1
    start = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    placed = rows.select(
        *keys,
        F.struct(
            F.col("text_unit_index").alias("unit"), start.cast("int").alias("start"), (start + F.length("body")).cast("int").alias("end"), F.concat("head", "body", "tail").alias("piece")
        ).alias("s"),
    )
    whole = placed.groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return whole.select(
        *keys,
        F.array_join(F.transform("s", lambda s: s["piece"]), "\n").alias("grouped_text"),
        F.transform("s", lambda s: F.struct(s["unit"].alias("unit"), s["start"].alias("start"), s["end"].alias("end"))).alias("segments"),
    )


def requests(units: DataFrame) -> DataFrame:
    """The texts that are refined at once, from normalised English units: title and abstract of a record as one, other units alone.

    source_record_id, text_unit_index (the first unit's), grouped, text and
    segments; a single unit is one segment.
    """
    rows = units.where(is_english(F.col("language")))
    together = grouped_units(rows)
    whole = build(together).select(
        "source_record_id", F.get("segments", F.lit(0))["unit"].alias("text_unit_index"), F.lit(True).alias("grouped"), F.col("grouped_text").alias("text"), "segments"
    )
    one = F.struct(F.col("text_unit_index").alias("unit"), F.lit(0).alias("start"), F.length("normalized").alias("end"))
    alone = rows.join(together.select("source_record_id", "text_unit_index"), ["source_record_id", "text_unit_index"], "left_anti")
    return whole.unionByName(alone.select("source_record_id", "text_unit_index", F.lit(False).alias("grouped"), F.col("normalized").alias("text"), F.array(one).alias("segments")))


def shifted(candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """Candidates with the request (request_unit) they belong to and their place in its text."""
    rows = candidates.join(asked.select("source_record_id", F.col("text_unit_index").alias("request_unit"), "segments"), "source_record_id")
    rows = rows.withColumn("s", shift(F.col("segments"), F.col("text_unit_index"), F.col("start"), F.col("end"))).where("s is not null")
    return rows.select(*candidates.columns, "request_unit", F.col("s.start").alias("request_start"), F.col("s.end").alias("request_end"))


def shift(segments: Column, unit: Column, start: Column, end: Column) -> Column:
    """A unit's span as struct<start, end> in the grouped text; null if the unit is not in it."""
    at = F.get(F.filter(segments, lambda s: s["unit"] == unit), F.lit(0))["start"]
    return F.when(at.isNotNull(), F.struct((at + start).alias("start"), (at + end).alias("end")))


def local_span(segments: Column, start: Column, end: Column) -> Column:
    """A span of the grouped text as struct<unit, start, end>; null if it crosses a marker."""
    s = F.get(F.filter(segments, lambda s: (s["start"] <= start) & (start < s["end"]) & (end <= s["end"])), F.lit(0))
    return F.when(s.isNotNull(), F.struct(s["unit"].alias("unit"), (start - s["start"]).alias("start"), (end - s["start"]).alias("end")))
