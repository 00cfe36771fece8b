"""Reports as JSON lines: readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_INNER = "struct<source_record_id:string,refined_candidates:array<struct<text:string,types:array<string>>>>"


def read_refined_terms(spark: SparkSession, path: str) -> DataFrame:
    """source_record_id, text, types of the refined candidates of the reports below path."""
    return refined_terms(spark.read.text(path))


def refined_terms(lines: DataFrame) -> DataFrame:
    """source_record_id, text, types of the refined candidates of wrapped or bare extraction reports (lines of column value)."""
    lines = lines.where("trim(value) <> ''")
    wrapped = F.from_json("value", f"struct<extraction:{_INNER}>")["extraction"]
    report = F.coalesce(wrapped, F.from_json("value", _INNER))
    return lines.select(report.alias("r")).select("r.source_record_id", F.explode("r.refined_candidates").alias("c")).select(
        "source_record_id", "c.text", "c.types"
    )


def extraction_lines(
    records: DataFrame,
    candidates: DataFrame,
    refined: DataFrame,
    mappings: DataFrame | None = None,
    refined_units: DataFrame | None = None,
    issues: DataFrame | None = None,
    mapping_issues: DataFrame | None = None,
) -> DataFrame:
    """One JSON line a record: the extraction, or extraction and mapping.

    refined_units (source_record_id, text_unit_index) and issues (source_record_id,
    text_unit_index, code, message) are told in every line where they are given: a
    refined unit without candidates was refined to nothing, any other one was not refined.
    """

    def listed(df: DataFrame, name: str) -> DataFrame:
        cell = F.struct(*[c for c in df.columns if c != "source_record_id"])
        # maps can't be ordered: the order is that of the position fields
        first = [c for c in ("text_unit_index", "source_candidate_index", "start", "end", "extractor", "target_language", "code", "message") if c in df.columns]
        rows = F.array_sort(F.collect_list(F.struct(*first, F.to_json(cell).alias("json"))))
        return df.groupBy("source_record_id").agg(F.array_join(F.transform(rows, lambda r: r["json"]), ",").alias(name))

    def units(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("source_record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("text_unit_index")), lambda i: i.cast("string")), ",").alias(name))

    extraction = {"baseline_candidates": (candidates, listed), "refined_candidates": (refined, listed), "refined_text_unit_indices": (refined_units, units), "issues": (issues, listed)}
    mapping = {"mappings": (mappings, listed), "issues": (mapping_issues, listed)}
    out = records.select("source_record_id")

    def body(parts: dict) -> list[Column]:
        nonlocal out
        cells = []
        for field, (df, how) in parts.items():
            if df is not None:
                name = f"_{len(out.columns)}"
                out = out.join(how(df, name), "source_record_id", "left")
                cells.append(F.concat(F.lit(f'"{field}":['), F.coalesce(name, F.lit("")), F.lit("]")))
        return cells

    name = F.to_json(F.struct("source_record_id"))
    head = F.substr(name, F.lit(1), F.length(name) - 1)
    one, two = body(extraction), body(mapping)
    line = F.concat(F.concat_ws(",", head, *one), F.lit("}"))
    if mappings is None:
        return out.select(line.alias("value"))
    return out.select(F.concat(F.lit('{"extraction":'), line, F.lit(',"mapping":{'), F.concat_ws(",", *two), F.lit("}}")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)


def run_summary(counters: DataFrame, issues: DataFrame) -> DataFrame:
    """processed, rejected, adapter_issues."""
    return counters.crossJoin(issues.agg(F.count("*").alias("adapter_issues"))).select(
        F.col("records_emitted").alias("processed"), F.col("records_rejected").alias("rejected"), "adapter_issues"
    )
