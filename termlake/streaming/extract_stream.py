"""Extraction over a stream of text units.

Each micro-batch goes through the batch plan (normalisation, rules, phrases,
reconciliation, offsets in the source), which looks at one unit at a time; so the stream
keeps no state and needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from termlake.plans.english import extract_english

UNIT = "source_record_id string, text_unit_index int, language string, text string"


def read_units(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(UNIT).json(path)


def mentions(units: DataFrame) -> DataFrame:
    """Candidates of the English units of a batch, with offsets in the normalised and in the source text."""
    found, _ = extract_english(units)
    return found.select("source_record_id", "text_unit_index", "start", "end", "original_start", "original_end", "text", "raw_label", "types", "confidence")


def start(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends the mentions of all files there are in source; each batch goes to a folder of its own, so a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        mentions(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    out = read_units(spark, source).writeStream.foreachBatch(put)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
