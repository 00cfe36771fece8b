"""Exact-span reconciliation, type hierarchy and best-by-span selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlake import vocab
from termlake.operators.extract import KEYS


def without_ancestors(types: Column) -> Column:
    """Sorted distinct types without those above another of them."""
    above = F.flatten(F.transform(types, lambda t: vocab.ancestor_map()[t]))
    return F.array_sort(F.array_except(F.array_distinct(types), above))


def has_root_conflict(types: Column) -> Column:
    """More than one root among the types, measurements and other concepts apart."""
    counted = F.filter(types, lambda t: ~t.isin("MEASUREMENT", "OTHER_TECHNICAL_CONCEPT"))
    return F.size(F.array_distinct(F.transform(counted, lambda t: vocab.root_map()[t]))) > 1


def reconcile(candidates: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One candidate for each span; spans with a single candidate pass unchanged.

    Candidates of a span are ordered by seq (the order of extractors); the rows
    of one span are few, so a span's group is bounded by the extractors.
    """
    fields = ["seq", "types", "roles", "proposed_definition", "confidence", "extractor", "extractor_version", "raw_label", "needs_review", "metadata"]
    # maps can't be compared: order by what precedes them
    cell = F.struct(*[F.to_json("metadata").alias("metadata") if f == "metadata" else F.col(f) for f in fields])
    groups = candidates.groupBy(*keys, "start", "end", "text").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    c = F.col("c")
    one = F.size(c) == 1
    first = lambda f: F.element_at(c, 1)[f]
    distinct = lambda f: F.array_sort(F.array_distinct(F.flatten(F.transform(c, lambda x: x[f]))))
    merged = F.struct(without_ancestors(F.flatten(F.transform(c, lambda x: x["types"]))).alias("types"))
    grown = groups.withColumn("m", merged)
    types = F.when(one, first("types")).otherwise(F.col("m.types"))
    confidence = F.least(F.lit(0.99), F.array_max(F.transform(c, lambda x: x["confidence"])) + F.lit(0.03) * (F.size(c) - 1))
    names = lambda f: F.to_json(F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: x[f]), lambda v: v.isNotNull()))))
    by_name = F.array_sort(F.transform(c, lambda x, i: F.struct(x["extractor"].alias("e"), i.alias("i"), x["confidence"].alias("v"))))
    described = F.create_map(
        F.lit("extractors"), names("extractor"), F.lit("raw_labels"), names("raw_label"),
        F.lit("component_confidences"), F.to_json(F.transform(by_name, lambda x: x["v"])),
    )
    definition = F.filter(F.transform(c, lambda x: x["proposed_definition"]), lambda d: d.isNotNull() & (d != ""))
    return grown.select(
        *keys, "text", "start", "end",
        types.alias("types"),
        F.when(one, first("roles")).otherwise(distinct("roles")).alias("roles"),
        F.when(one, first("proposed_definition")).otherwise(F.get(definition, F.lit(0))).alias("proposed_definition"),
        F.when(one, first("confidence")).otherwise(confidence).alias("confidence"),
        F.when(one, first("extractor")).otherwise("exact_span_reconciler").alias("extractor"),
        F.when(one, first("extractor_version")).otherwise("1.0").alias("extractor_version"),
        F.when(one, first("raw_label")).otherwise("RECONCILED").alias("raw_label"),
        F.when(one, first("needs_review")).otherwise(F.exists(c, lambda x: x["needs_review"]) | has_root_conflict(F.col("m.types"))).alias("needs_review"),
        F.when(one, F.from_json(first("metadata"), "map<string,string>")).otherwise(described).alias("metadata"),
        first("seq").alias("seq"),
    )


def best_by_span(baseline: DataFrame, refined: DataFrame, refined_units: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Of each unit the refined candidates if the unit was refined (even to nothing), else the baseline's;
    of each span and type list the most confident, the first on ties."""
    unit = ["source_record_id", "text_unit_index"]
    own = refined.join(refined_units, unit, "left_semi")
    rest = baseline.join(refined_units, unit, "left_anti")
    order = Window.partitionBy(*keys, "start", "end", F.to_json("types")).orderBy(F.desc("confidence"), "seq")
    return own.unionByName(rest).withColumn("at", F.row_number().over(order)).where("at = 1").drop("at")
