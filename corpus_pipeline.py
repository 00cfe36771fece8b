"""From raw documents to packed training sequences.

Five stages, each one of the operators of the subpackage ``llm``: quality rules
(rejected documents go), n-gram Jaccard join (of each group of near copies the
document with the least id stays), benchmark decontamination (contaminated
documents go), PII (found spans are masked in the texts) and packing (token
windows).  A stage's result is written as Parquet in the shared folder and read
again as the next stage's input, so each stage can be repeated by itself.

Defined results: the verdicts are taken on rows, so a null or repeated doc_id
neither saves a row nor condemns one.  A null, blank or short text is rejected
by the first stage; long texts are judged whole.  Of repeated rows, and of copies
without an id, one stays.  An empty documents or benchmark table gives an empty
result or no contaminated document.  Columns of documents are kept by all stages
but the last, whatever their names.

The packed rows are not expressible in SQL (a tokenizer and an online packing
decide them); the tests hold :func:`run` against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm.common import Tables
from llm.decontaminate import decontaminated
from llm.ngram_join import keep_one_per_group
from llm.packing import pack
from llm.pii import redact
from llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, one after the other."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for _, stage in first:
        docs = tables.last(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
