"""The extraction plan over text units: candidates, refinement by recorded decisions, issues."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlake.functions.text import is_english, normalize_source, original_span
from termlake.operators.extract import extract_phrases, extract_rules
from termlake.operators.grouped import local_span, requests
from termlake.operators.reconcile import reconcile
from termlake.operators.refine import apply_decisions

UNIT = ["source_record_id", "text_unit_index"]


def normalized_units(units: DataFrame, english: bool = True) -> DataFrame:
    """Units (by default the English ones) with normalised text and offsets; the language is filtered before anything is normalised."""
    rows = units.where(is_english(F.col("language"))) if english else units
    rows = rows.withColumn("n", normalize_source(F.col("text")))
    return rows.select("*", "n.normalized", "n.off_start", "n.off_end").drop("n")


def ground(candidates: DataFrame, units: DataFrame, code: str = "INVALID_CANDIDATE_SPAN") -> tuple[DataFrame, DataFrame]:
    """(candidates with source offsets, issues): a candidate's text must stand at its place, its confidence be
    from 0 to 1 and its types not be empty."""
    rows = candidates.join(units.select(*UNIT, "normalized", "off_start", "off_end"), UNIT)
    rows = rows.withColumn("o", original_span(F.col("off_start"), F.col("off_end"), F.col("start"), F.col("end")))
    stands = (F.substr("normalized", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")) & F.col("o").isNotNull()
    ok = F.coalesce(stands & F.col("confidence").between(0, 1) & (F.size("types") > 0), F.lit(False))
    good = rows.where(ok).select(*candidates.columns, F.col("o.start").alias("original_start"), F.col("o.end").alias("original_end"))
    return good, rows.where(~ok).select(*UNIT, F.lit(code).alias("code"), F.col("text").alias("message"))


def extract_english(units: DataFrame, models: Mapping[str, DataFrame] | None = None, failures: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(reconciled candidates with source offsets, issues) of rules, phrases and further candidate tables by name.

    A model is named once, so it is taken once; failures are the texts on which
    models failed (the issues of apply_model), and are part of the issues.
    """
    rows = normalized_units(units)
    every = extract_rules(rows).unionByName(extract_phrases(rows))
    for found in (models or {}).values():
        every = every.unionByName(found)
    grounded, issues = ground(every, rows)
    if failures is not None:
        issues = issues.unionByName(failures.select(*issues.columns))
    return ground(reconcile(grounded.drop("original_start", "original_end")), rows)[0], issues


def model_names(models: Iterable[str] = (), further: str | None = None, reaction_model: str | None = None) -> list[str]:
    """The models of a plan, each once and in order, the reaction-text model last (and only there)."""
    given = [*models, *([further] if further else [])]
    return [*(m for m in dict.fromkeys(given) if m != reaction_model), *([reaction_model] if reaction_model else [])]


def check_records(units: DataFrame, results: DataFrame) -> None:
    """Raises where results name records that units don't have."""
    lost = results.select("source_record_id").distinct().join(units.select("source_record_id").distinct(), "source_record_id", "left_anti")
    if found := [r.source_record_id for r in lost.orderBy("source_record_id").limit(5).collect()]:
        raise ValueError(f"results of records that are not there: {', '.join(map(str, found))}")


def refine(units: DataFrame, decisions: DataFrame, answered: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(refined candidates with source offsets, refined units, issues) of recorded decisions on normalised units.

    Title and abstract of a record are one request (see grouped.requests): its
    decisions name the record and the group's first unit, and their places are
    those of the grouped text.  answered (source_record_id, text_unit_index) names
    requests that were answered with no decision at all: they are refined to
    nothing.  A failed request leaves its units unrefined; a span that crosses
    sections is left out by itself.
    """
    asked = requests(units)
    good, failed = apply_decisions(asked.select(*UNIT, "text"), decisions, tuple(UNIT))
    of = asked.select(*UNIT, "grouped", "segments")
    placed = good.join(of, UNIT).withColumn("local", local_span(F.col("segments"), F.col("start"), F.col("end")))
    inside = placed.where("local is not null").select(
        "source_record_id", F.col("local.unit").alias("text_unit_index"), "text", F.col("local.start").alias("start"), F.col("local.end").alias("end"),
        "types", "roles", "proposed_definition", "confidence", F.lit("recorded_refiner").alias("extractor"), F.lit("1.0").alias("extractor_version"),
        F.lit("REFINED").alias("raw_label"), "needs_review",
        F.create_map(F.lit("decision_source"), "source", F.lit("reason_code"), "reason_code", F.lit("scope"), "scope_decision").alias("metadata"), F.lit(9).alias("seq"), "grouped",
    )
    found, lost = ground(inside.join(units.select(*UNIT, "language"), UNIT).select("source_record_id", "text_unit_index", "language", *inside.columns[2:]), units, "INVALID_REFINED_SPAN")
    code = lambda grouped, alone: F.when(F.col("grouped"), grouped).otherwise(F.lit(alone))
    issues = failed.join(of, UNIT).select(*UNIT, code("GROUPED_REFINER_FAILED", "REFINER_FAILED").alias("code"), "message")
    crossing = placed.where("local is null").select(*UNIT, code("INVALID_GROUPED_REFINED_SPAN", "INVALID_REFINED_SPAN").alias("code"), F.col("text").alias("message"))
    done = decisions.select(*UNIT).distinct()
    if answered is not None:
        done = done.unionByName(answered.select(*UNIT)).distinct()
    done = done.join(failed, UNIT, "left_anti").join(of, UNIT)
    refined_units = done.select("source_record_id", F.explode("segments.unit").alias("text_unit_index"))
    return found.drop("grouped"), refined_units, issues.unionByName(crossing).unionByName(lost)
