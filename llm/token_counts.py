"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are split at safe boundaries (:mod:`llm.units`), the pieces are encoded in
library calls balanced by bytes, and only lengths are kept of what a call
returns.  One narrow stage, no shuffle; memory is bounded by a megabyte of text
a step plus the bounded cache of unit lengths, or by the longest text.

Defined results: a null text is empty (0 bytes, 0 tokens); a null id stays null;
repeated rows are repeated in the result; an empty table gives no rows; long
texts are cut at safe boundaries and counted whole; other columns, whatever their
names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.units import tokenizer_path, worker_encoder

TOKEN_LIMIT = 4096
MODEL = "piece_bpe_32k.model"


def _count(name: str, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path or tokenizer_path(name), len)
        for batch in batches:
            counts = [sum(kept) for _, kept in encoder.texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(
    docs: DataFrame,
    tokenizer: str = MODEL,
    limit: int = TOKEN_LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    tokenizer names a public vocabulary file; path, when given, is the file itself.
    """
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).alias("text"),
    )
    counted = narrow.mapInArrow(_count(tokenizer, path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
