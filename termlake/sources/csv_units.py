"""Wide multilingual CSV files to text units and issues."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlake.functions.text import language_tag

PREFIXES = (("title_", "title"), ("abstract_", "abstract"))
BLANK = r"^(?U)[\s\x1c-\x1f]*$"


class ConfigurationError(ValueError):
    """A file without a usable header."""


def _blank(x: Column) -> Column:
    return x.isNull() | F.regexp_like(x, F.lit(BLANK))


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^(?U)[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+$", "")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each record's ordinal in its file, from 2: a file is read by one task, from its start to its end."""
    file, count = None, 0
    for batch in batches:
        files = batch.column("_file").to_pylist()
        numbers = []
        for f in files:
            file, count = (f, count + 1) if f == file else (f, 2)
            numbers.append(count)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "row_number"])


def _plain(path: Column) -> Column:
    """A file's path without percent codes."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def headers(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """Files below path by their first line; files without a line are left out."""
    lines = spark.read.text(path).where("_metadata.file_block_start = 0").select(_plain(F.col("_metadata.file_path")).alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    out: dict[str, list[str]] = {}
    for row in lines.groupBy("file").agg(F.min_by("value", "at").alias("head")).collect():
        out.setdefault(row.head.removeprefix("\ufeff").rstrip("\r"), []).append(row.file)
    return {head: sorted(files) for head, files in sorted(out.items())}


def read_csv(spark: SparkSession, path: str | list[str], source_name: str | None = None) -> DataFrame:
    """The records of CSV files (one, several or all of a folder) as strings, with row_number (long, from 2 in each file) and source_record_id.

    Files with different headers are read by header and joined by column name;
    columns that a file lacks are null.  A header is one line.  Quoted line breaks
    keep a file in one task; records are numbered while they pass, without a shuffle.
    """
    options = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    groups = list(headers(spark, path).values())
    parts = [options.csv(files) for files in groups] if len(groups) > 1 else [options.csv(path)]
    out = None
    for rows in parts:
        kept = rows.withColumn("_file", F.col("_metadata.file_path"))
        schema = T.StructType([*kept.schema.fields, T.StructField("row_number", T.LongType())])
        numbered = kept.mapInArrow(_numbered, schema)
        out = numbered if out is None else out.unionByName(numbered, allowMissingColumns=True)
    name = F.lit(source_name) if source_name else F.element_at(F.split(_plain(F.col("_file")), "/"), -1)
    return out.withColumn("source_record_id", F.concat_ws(":", name, "row_number")).drop("_file")


def text_columns(spark: SparkSession, columns: list[str]) -> tuple[list[tuple[str, str, str]], list[str]]:
    """((column, language, unit type) in header order, columns with a bad tag)."""
    if "publication_number" not in columns:
        raise ConfigurationError("a publication_number column is needed")
    named = [(c, kind, c.removeprefix(p)) for c in columns for p, kind in PREFIXES if c.startswith(p)]
    tags = []
    if named:
        # a few header names: canonicalised by the same expression as data, in one local row
        cells = [language_tag(F.lit(raw)).alias(str(i)) for i, (_, _, raw) in enumerate(named)]
        tags = list(spark.range(1).select(*cells).first())
    good = [(c, tag, kind) for (c, kind, _), tag in zip(named, tags, strict=True) if tag]
    if not good:
        raise ConfigurationError("a title_<language> or abstract_<language> column is needed")
    return good, [c for (c, _, _), tag in zip(named, tags, strict=True) if not tag]


def _issue(code: str, message: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), message.alias("message"))


def declared(value: Column) -> Column:
    """struct<good, bad>: canonical tags and the parts that are none of a |-separated list."""
    parts = F.filter(F.split(F.coalesce(value, F.lit("")), r"\|"), lambda x: ~_blank(x))
    return F.struct(
        F.array_distinct(F.filter(F.transform(parts, language_tag), lambda t: t.isNotNull())).alias("good"),
        F.filter(parts, lambda x: language_tag(x).isNull()).alias("bad"),
    )


def to_units(rows: DataFrame, found: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(text units, issues, counters) of CSV rows."""
    column = lambda c: F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string")
    cells = F.array(
        *[
            F.struct(F.lit(lang).alias("language"), F.col(f"`{c}`").alias("text"), F.lit(kind).alias("unit_type"), F.lit(c).alias("source_column"))
            for c, lang, kind in found
        ]
    )
    uri = F.nullif(column("source_uri"), F.lit(""))
    checked = rows.select(
        "row_number", "source_record_id",
        _strip(F.coalesce(column("publication_number"), F.lit(""))).alias("publication_number"),
        F.nullif(_strip(column("family_id")), F.lit("")).alias("family_id"),
        uri.alias("source_uri"),
        F.filter(cells, lambda x: ~_blank(x["text"])).alias("units"),
        declared(column("languages")).alias("d"),
    )
    have = F.array_distinct(F.transform("units", lambda u: u["language"]))
    broken = (
        ~F.length("publication_number").between(1, 200) | (F.length("source_record_id") > 500) | (F.coalesce(F.length("family_id"), F.lit(0)) > 200)
        | ~F.coalesce(F.regexp_like("source_uri", F.lit(r"^https?://[^\s/?#]+[^\s]*$")), F.lit(True))
    )
    judged = checked.withColumn("verdict", F.when(F.size("units") == 0, "NO_TEXT").when(broken, "CONTRACT_VALIDATION_FAILED")).withColumn("have", have)
    tagged = lambda code, tags: F.transform(tags, lambda t: _issue(code, t))
    text = F.when(
        F.col("verdict").isNull() | (F.col("verdict") != "NO_TEXT"),
        F.concat(
            tagged("MISSING_DECLARED_LANGUAGE", F.array_except("d.good", "have")),
            tagged("UNDECLARED_AVAILABLE_LANGUAGE", F.array_except("have", "d.good")),
            tagged("INVALID_DECLARED_LANGUAGE", F.col("d.bad")),
        ),
    ).otherwise(F.array().cast("array<struct<code:string,message:string>>"))
    verdict = F.when(F.col("verdict").isNotNull(), F.array(_issue("", F.lit("row rejected")).withField("code", F.col("verdict")))).otherwise(
        F.array().cast("array<struct<code:string,message:string>>")
    )
    issues = judged.select("row_number", "source_record_id", F.explode(F.concat(text, verdict)).alias("i")).select(
        F.when(F.col("i.code") != "INVALID_DECLARED_LANGUAGE", F.col("row_number")).alias("row_number"), "source_record_id", "i.code", "i.message"
    )
    units = judged.where("verdict is null").select(
        "source_record_id", "publication_number", "family_id", "source_uri", F.array_sort("d.good").alias("declared_languages"),
        F.posexplode("units").alias("text_unit_index", "u"),
    )
    units = units.select(
        "source_record_id", "publication_number", "family_id", "source_uri", "declared_languages", "text_unit_index", "u.language", "u.unit_type",
        F.col("u.unit_type").alias("locator"), F.lit("unknown").alias("text_origin"), "u.text", "u.source_column",
    )
    counters = judged.agg(
        F.count("*").alias("rows_seen"), F.count_if(F.col("verdict").isNull()).alias("records_emitted"), F.count_if(F.col("verdict").isNotNull()).alias("records_rejected")
    )
    return units, issues, counters


def read_units(spark: SparkSession, path: str | list[str], source_name: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(text units, issues with those of the header, counters) of CSV files (see :func:`read_csv`)."""
    rows = read_csv(spark, path, source_name)
    found, bad = text_columns(spark, [c for c in rows.columns if c not in ("row_number", "source_record_id")])
    units, issues, counters = to_units(rows, found)
    header = spark.createDataFrame([(None, None, "INVALID_LANGUAGE_COLUMN", c) for c in bad], "row_number long, source_record_id string, code string, message string")
    return units, header.unionByName(issues), counters


def documents(spark: SparkSession, path: str | list[str], source_name: str | None = None) -> DataFrame:
    """source_record_id, publication_number, family_id of CSV files, for use as a lookup table."""
    rows = read_csv(spark, path, source_name)
    family = F.col("family_id") if "family_id" in rows.columns else F.lit(None).cast("string")
    return rows.select("source_record_id", "publication_number", F.nullif(family, F.lit("")).alias("family_id"))
