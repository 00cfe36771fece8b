"""The two jobs a user runs: extraction of a CSV file and enrichment of its report.

    python -m termlake.plans.commands extract titles.csv out/
    python -m termlake.plans.commands enrich out/ snapshots/ enriched/ --documents titles.csv
"""

from __future__ import annotations

import argparse
import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.functions.text import term_key
from termlake.operators import enrich
from termlake.operators.pairing import map_units
from termlake.operators.reconcile import best_by_span
from termlake.plans.english import check_records, extract_english, model_names, normalized_units, refine
from termlake.sources import csv_units, jsonl


def extract(
    spark: SparkSession,
    path: str | list[str],
    out: str,
    models: dict[str, DataFrame] | None = None,
    refinements: DataFrame | None = None,
    mappings: DataFrame | None = None,
    failures: DataFrame | None = None,
    answered: DataFrame | None = None,
    languages: list[str] | None = None,
) -> DataFrame:
    """Writes one JSON line a record below out; processed, rejected and adapter_issues.

    models are tables of candidates by name, refinements and mappings recorded
    decisions on the requests of english.refine and pairing.map_units; failures are
    the texts that a model failed on, answered the requests that were answered by no
    decision at all; languages bounds the mapping.  What went wrong is told in each
    record's issues.
    """
    units, issues, counters = csv_units.read_units(spark, path)
    candidates, told = extract_english(units, {name: (models or {})[name] for name in model_names(models or {})}, failures)
    refined, done = candidates.where("false"), candidates.select("source_record_id", "text_unit_index").where("false")
    if refinements is not None:
        found, done, more = refine(normalized_units(units), refinements, answered)
        refined, told = found.select(*candidates.columns), told.unionByName(more.select(*told.columns))
        check_records(units, refinements)
    mapped = map_issues = None
    if mappings is not None:
        check_records(units, mappings)
        mapped, map_issues = map_units(normalized_units(units, english=False), best_by_span(candidates, refined, done), mappings, languages)
    lines = jsonl.extraction_lines(units.select("source_record_id").distinct(), candidates, refined, mapped, done, told, map_issues)
    jsonl.write_lines(lines, out)
    return jsonl.run_summary(counters, issues)


def enrichment_lines(terms: DataFrame, references: DataFrame) -> DataFrame:
    """One JSON line a term with its references, types and source documents."""
    best = F.array_sort(F.collect_list(F.struct("needs_review", (-F.col("confidence")).alias("less"), "namespace", "external_id", F.struct("label", "canonical_url", "description", "mapping_type", "confidence").alias("r"))))
    by_term = references.groupBy("proposal_id").agg(best.alias("b"))
    listed = F.transform(
        F.coalesce("b", F.array().cast(by_term.schema["b"].dataType)),
        lambda x: F.struct(x["namespace"].alias("namespace"), x["external_id"].alias("external_id"), x["needs_review"].alias("needs_review"), x["r"].alias("reference")),
    )
    row = F.struct("proposal_id", F.col("text").alias("term"), F.col("types").alias("type_codes"), listed.alias("references"), "source_documents")
    return terms.join(by_term, "proposal_id", "left").select(F.to_json(row).alias("value"))


def enrich_report(spark: SparkSession, reports: str, snapshots: str, out: str, documents: str | None = None) -> DataFrame:
    """Writes the enriched terms of extraction reports below out; coverage and terms by namespace as one JSON value.

    snapshots holds the tables compounds, items and entries (see termlake.operators.enrich).
    """
    terms = enrich.distinct_terms(jsonl.read_refined_terms(spark, reports))
    docs = csv_units.documents(spark, documents) if documents else spark.createDataFrame([], "source_record_id string, publication_number string, family_id string")
    # an id by content: no global order, the same in each run
    named = enrich.with_documents(terms, docs).withColumn("proposal_id", F.concat(F.lit("external:"), F.substring(F.sha2(F.to_json(F.struct("text", "types")), 256), 1, 16)))
    proposals = named.select("proposal_id", F.col("text").alias("term"), F.col("types").alias("type_codes"), term_key(F.col("text")).alias("normalized_term"))
    tables = [spark.read.parquet(f"{snapshots}/{n}") for n in ("compounds", "items", "entries")]
    references = enrich.enrich(proposals, *tables)
    jsonl.write_lines(enrichment_lines(named, references), out)
    spaces = enrich.terms_by_namespace(references).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("namespace", "terms")))).alias("terms_by_namespace"))
    report = enrich.coverage(terms, references).crossJoin(spaces)
    return report.select(F.to_json(F.struct("*")).alias("value"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="termlake")
    jobs = parser.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("extract")
    one.add_argument("input")
    one.add_argument("output")
    one.add_argument("--model", action="append", default=[], metavar="NAME=PATH", help="a Parquet table of a model's candidates")
    for name in ("refinements", "mappings", "failures", "answered"):
        one.add_argument(f"--{name}", help="a Parquet table")
    one.add_argument("--pair-languages", nargs="*")
    two = jobs.add_parser("enrich")
    for name in ("input", "snapshots", "output"):
        two.add_argument(name)
    two.add_argument("--documents")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(PurePosixPath(args.output).name).getOrCreate()
    if args.job == "extract":
        tables = {n: spark.read.parquet(p) for n in ("refinements", "mappings", "failures", "answered") if (p := getattr(args, n))}
        models = {n: spark.read.parquet(p) for n, _, p in (m.partition("=") for m in args.model)}
        print(json.dumps(extract(spark, args.input, args.output, models, languages=args.pair_languages, **tables).first().asDict()))
    else:
        print(enrich_report(spark, args.input, args.snapshots, args.output, args.documents).first().value)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
