"""The store's tables and their constraints as queries."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlake.staging import Rounds

_TIMES = "created_at timestamp, updated_at timestamp"
# fixed values: columns of the fourteen tables
TABLES: dict[str, str] = {
    "concept_type": f"id string, code string, label string, description string, parent_id string, active boolean, {_TIMES}",
    "term_form": f"id string, code string, label string, description string, active boolean, {_TIMES}",
    "relation_type": f"id string, code string, label string, description string, symmetric boolean, active boolean, {_TIMES}",
    "identifier_namespace": f"id string, code string, label string, description string, value_pattern string, identity_strength string, active boolean, {_TIMES}",
    "pipeline_run": "id string, pipeline_version string, code_revision string, model_versions string, configuration string, status string, started_at timestamp, finished_at timestamp",
    "concept": f"id string, english_definition string, status string, created_by_run_id string, superseded_by_id string, {_TIMES}",
    "concept_type_assignment": "concept_id string, concept_type_id string, confidence decimal(5,4), source string",
    "term": f"id string, concept_id string, text string, normalized_text string, language string, script string, term_form_id string, is_preferred boolean, status string, confidence decimal(5,4), created_by_run_id string, {_TIMES}",
    "concept_identifier": f"id string, concept_id string, namespace_id string, external_id string, mapping_type string, confidence decimal(5,4), source_uri string, {_TIMES}",
    "concept_embedding": f"id string, concept_id string, model_name string, model_version string, content_hash string, embedding array<float>, {_TIMES}",
    "evidence_set": f"id string, concept_id string, family_id string, method string, confidence decimal(5,4), status string, score_components map<string,double>, created_by_run_id string, {_TIMES}",
    "term_evidence": "id string, evidence_set_id string, term_id string, publication_number string, family_id string, locator string, text_origin string, target_form_status string, confidence decimal(5,4), created_at timestamp",
    "concept_relation": f"id string, source_concept_id string, target_concept_id string, relation_type_id string, confidence decimal(5,4), status string, created_by_run_id string, {_TIMES}",
    "review_decision": "id string, evidence_set_id string, decision string, reviewer string, comment string, created_at timestamp",
}
# fixed values: unique keys, references and checks of the tables
UNIQUE: dict[str, list[tuple[str, ...]]] = {
    "concept_type": [("code",)],
    "term_form": [("code",)],
    "relation_type": [("code",)],
    "identifier_namespace": [("code",)],
    "concept_type_assignment": [("concept_id", "concept_type_id")],
    "term": [("concept_id", "language", "normalized_text")],
    "concept_identifier": [("concept_id", "namespace_id", "external_id")],
    "concept_embedding": [("concept_id", "model_name", "model_version")],
    "term_evidence": [("evidence_set_id", "term_id", "publication_number", "locator")],
    "concept_relation": [("source_concept_id", "target_concept_id", "relation_type_id")],
}
REFERENCES: list[tuple[str, str, str]] = [
    ("concept_type", "parent_id", "concept_type"),
    ("concept", "created_by_run_id", "pipeline_run"),
    ("concept", "superseded_by_id", "concept"),
    ("concept_type_assignment", "concept_id", "concept"),
    ("concept_type_assignment", "concept_type_id", "concept_type"),
    ("term", "concept_id", "concept"),
    ("term", "term_form_id", "term_form"),
    ("concept_identifier", "concept_id", "concept"),
    ("concept_identifier", "namespace_id", "identifier_namespace"),
    ("concept_embedding", "concept_id", "concept"),
    ("evidence_set", "concept_id", "concept"),
    ("term_evidence", "evidence_set_id", "evidence_set"),
    ("term_evidence", "term_id", "term"),
    ("concept_relation", "source_concept_id", "concept"),
    ("concept_relation", "target_concept_id", "concept"),
    ("concept_relation", "relation_type_id", "relation_type"),
    ("review_decision", "evidence_set_id", "evidence_set"),
]
# fixed values: what becomes of rows that refer to a deleted one (others forbid the deletion)
CASCADE = {
    "concept_type_assignment.concept_id", "term.concept_id", "concept_identifier.concept_id", "concept_embedding.concept_id", "evidence_set.concept_id",
    "term_evidence.evidence_set_id", "term_evidence.term_id", "concept_relation.source_concept_id", "concept_relation.target_concept_id", "review_decision.evidence_set_id",
}
SET_NULL = {"concept.created_by_run_id", "term.created_by_run_id", "evidence_set.created_by_run_id", "concept_relation.evidence_set_id"}
_STATUS = "status IN ('proposed', 'accepted', 'rejected', 'deprecated')"
_CONFIDENCE = "confidence BETWEEN 0 AND 1"
CHECKS: dict[str, list[str]] = {
    "identifier_namespace": ["identity_strength IN ('authoritative', 'strong', 'supporting')"],
    "pipeline_run": ["status IN ('running', 'completed', 'failed', 'cancelled')"],
    "concept": ["status IN ('proposed', 'accepted', 'rejected', 'deprecated', 'merged')"],
    "concept_type_assignment": [_CONFIDENCE],
    "term": [_STATUS, _CONFIDENCE, "length(language) <= 35"],
    "concept_identifier": ["mapping_type IN ('EXACT', 'CLOSE', 'BROAD', 'NARROW', 'RELATED')", _CONFIDENCE, "length(external_id) <= 255"],
    "concept_embedding": ["length(content_hash) = 64", "size(embedding) = 1024"],
    "evidence_set": [_STATUS, _CONFIDENCE, "length(family_id) <= 120"],
    "term_evidence": [
        "text_origin IN ('original', 'official_translation', 'machine_translation', 'unknown')",
        "target_form_status IN ('TRANSLATED', 'UNCHANGED', 'LANGUAGE_NEUTRAL', 'UNKNOWN')", _CONFIDENCE,
    ],
    "concept_relation": [_STATUS, _CONFIDENCE, "source_concept_id <> target_concept_id"],
    "review_decision": ["decision IN ('accepted', 'rejected', 'deferred')"],
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def create(spark: SparkSession, path: str) -> None:
    """Empty tables below path."""
    for table in TABLES:
        empty(spark, table).write.parquet(f"{path}/{table}")


def drop(spark: SparkSession, path: str) -> None:
    """Deletes the tables below path, those that others refer to last."""
    for table in reversed(TABLES):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


# fixed values: bounds of what may be written
WRITES: dict[str, dict[str, str]] = {
    "concept": {"english_definition": "english_definition IS NULL OR length(english_definition) <= 10000"},
    "term": {
        "text": "length(text) BETWEEN 1 AND 2000",
        "normalized_text": "length(normalized_text) BETWEEN 1 AND 2000",
        "language": "length(language) BETWEEN 2 AND 35",
        "script": "script IS NULL OR length(script) = 4",
        "term_form_code": "term_form_code IS NULL OR length(term_form_code) <= 80",
        "confidence": "confidence IS NULL OR confidence BETWEEN 0 AND 1",
    },
    "concept_identifier": {
        "namespace": "length(namespace) BETWEEN 1 AND 60",
        "external_id": "length(external_id) BETWEEN 1 AND 255",
        "mapping_type": "mapping_type RLIKE '^(exact|close|broad|narrow|related)$'",
        "confidence": "confidence BETWEEN 0 AND 1",
        "source_uri": r"source_uri IS NULL OR source_uri RLIKE '^https?://[^\\s/?#]+[^\\s]*$'",
    },
}


def refused(table: str, rows: DataFrame) -> DataFrame:
    """rows that may not be written to a table, with the sorted names of the columns that are out of bounds."""
    wrong = [F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(column)) for column, rule in WRITES[table].items() if column in rows.columns]
    return rows.withColumn("out_of_bounds", F.array_sort(F.array_compact(F.array(*wrong)))).where(F.size("out_of_bounds") > 0)


def violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, rule and number of rows against it, for the rules that any row breaks."""
    found = []

    def broken(table: str, rule: str, rows: DataFrame) -> None:
        found.append(rows.agg(F.count("*").alias("n")).select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "n"))

    for table, df in tables.items():
        for keys in UNIQUE.get(table, []):
            broken(table, "unique " + ", ".join(keys), df.groupBy(*keys).count().where("count > 1"))
        for check in CHECKS.get(table, []):
            broken(table, check, df.where(f"NOT ({check})"))
        if table == "term":
            broken(table, "one preferred term a concept and language", df.where("is_preferred").groupBy("concept_id", "language").count().where("count > 1"))
        for name, column, target in REFERENCES:
            if name == table and target in tables:
                known = tables[target].select(F.col("id").alias("known_id"))
                broken(table, f"{column} in {target}", df.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("known_id"), "left_anti"))
    return reduce(DataFrame.unionByName, found).where("n > 0")


def delete(tables: Mapping[str, DataFrame], table: str, ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the rows of a table that ids, column id, names; what forbids the deletion).

    Rows that refer to deleted ones go with them, or lose the reference, or forbid the deletion: then the second
    result has table_name, column and the number of such rows, and the deletion must not be written.  Tables come
    with those they refer to before them; each reference is one semi or anti join on a written id set.
    """
    rounds = Rounds(ids.sparkSession, "delete")
    gone: dict[str, DataFrame] = {table: rounds.write(ids.select("id").where("id is not null").distinct())}
    out, blocked = dict(tables), []
    for name in TABLES:
        if name not in tables:
            continue
        rows, lost = tables[name], [gone[name]] if name in gone else []
        links = [(c, target) for n, c, target in REFERENCES if n == name and c in rows.columns]
        links += [(full.partition(".")[2], target) for full, target in (("term.created_by_run_id", "pipeline_run"), ("evidence_set.created_by_run_id", "pipeline_run"), ("concept_relation.evidence_set_id", "evidence_set")) if full.startswith(name + ".") and full.partition(".")[2] in rows.columns]
        rows = rows.withColumn("_gone", F.lit(False))
        for column, target in [("id", name) for _ in lost] + [x for x in links if x[1] in gone and x[1] != name]:
            known = gone[target].select(F.col("id").alias("_id"), F.lit(True).alias("_hit"))
            rows = rows.join(known, F.col(column) == F.col("_id"), "left")
            hit, full = F.coalesce("_hit", F.lit(False)), f"{name}.{column}"
            if column == "id" or full in CASCADE:
                rows = rows.withColumn("_gone", F.col("_gone") | hit)
            elif full in SET_NULL:
                rows = rows.withColumn(column, F.when(~hit, F.col(column)))
            else:
                blocked.append(rows.where(hit & ~F.col("_gone")).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit(column).alias("column"), "n"))
            rows = rows.drop("_id", "_hit")
        if "id" in rows.columns and name not in gone:
            fallen = rounds.write(rows.where("_gone").select("id"))
            gone[name] = fallen
        for column, target in links:
            # a reference within the table (a parent, a successor) forbids the deletion unless its row goes too
            if target == name and name in gone:
                held = rows.where("not _gone").join(gone[name].select(F.col("id").alias("_id")), F.col(column) == F.col("_id"), "left_semi")
                blocked.append(held.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit(column).alias("column"), "n"))
        out[name] = rows.where("not _gone").drop("_gone")
    none = ids.sparkSession.createDataFrame([], "table_name string, column string, n long")
    return out, reduce(DataFrame.unionByName, blocked, none).where("n > 0")


def evidence_errors(sets: DataFrame) -> DataFrame:
    """Evidence sets (family_id, terms array<struct<family_id, target_form_status>>) without terms, with a term of another family, or with a form that is not present."""
    wrong = (
        (F.size("terms") < 1) | F.exists("terms", lambda t: t["family_id"] != F.col("family_id")) | F.exists("terms", lambda t: t["target_form_status"] == "NOT_PRESENT")
    )
    return sets.where(wrong)
