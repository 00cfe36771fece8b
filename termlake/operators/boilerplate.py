"""Boilerplate: passages that make up at least a share of all passages, found in two passes.

First pass: each task keeps a heavy-hitter summary of ``10 / share`` counters
(counts of a batch are added, then the count of the next counter beyond the bound
is taken off all).  Summaries merge by adding: a passage's summed counter is below its
true count by at most a tenth of the share, so everything below nine tenths of it is
dropped, and at most ``1.2 / share`` candidates are left whatever the data.

Second pass: the candidates, a set of proven size, are sent to all tasks and counted
exactly; so the result equals counting everything, without a shuffle of all passages.

Defined results: null and blank passages do not count; repeated rows count as often
as they occur; an empty table has no boilerplate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlake.operators.align import paragraphs
from termlake.staging import Rounds

#: Share of all passages from which a passage is boilerplate.
SHARE = 0.001
FINER = 10


def _summary(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        total = 0
        for batch in batches:
            seen = pc.value_counts(batch.column("mark"))
            total += batch.num_rows
            for mark, n in zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist(), strict=True):
                held[mark] = held.get(mark, 0) + n
            if len(held) > most:
                cut = sorted(held.values(), reverse=True)[most]
                held = {mark: n - cut for mark, n in held.items() if n > cut}
        yield pa.RecordBatch.from_arrays([pa.array([None, *held], pa.string()), pa.array([total, *held.values()], pa.int64())], ["mark", "n"])

    return run


def heavy_hitters(passages: DataFrame, share: float = SHARE, passage_col: str = "passage") -> DataFrame:
    """passage, n for every passage that is at least the share of all passages (n >= share * rows, exactly)."""
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    rounds = Rounds(passages.sparkSession, "boilerplate")
    rows = passages.select(F.col(passage_col).alias("passage")).where(F.trim("passage") != "").withColumn("mark", F.md5("passage"))
    summed = rounds.write(rows.select("mark").mapInArrow(_summary(math.ceil(FINER / share)), "mark string, n long").groupBy("mark").agg(F.sum("n").alias("n")))
    total = summed.where("mark is null").agg(F.sum("n").alias("n")).first().n or 0
    # at most 1 / (share * (1 - 1 / FINER)) marks have so large a counter
    candidates = summed.where(F.col("mark").isNotNull() & (F.col("n") >= share * total * (1 - 1 / FINER))).select("mark")
    exact = rows.join(F.broadcast(candidates), "mark").groupBy("mark").agg(F.min("passage").alias("passage"), F.count("*").alias("n"))
    return rounds.last(exact.where(F.col("n") >= share * total).select("passage", "n"))


def without_boilerplate(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the boilerplate lines (found by :func:`heavy_hitters`, a bounded set) taken out of their text; other lines stay as they are."""
    known = F.broadcast(found.agg(F.collect_set("passage").alias("_known")))
    lines = F.split(text_col, "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains("_known", F.trim(x)))
    return docs.join(known).withColumn(text_col, F.when(F.size("_known") > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col))).drop("_known")


def lines(text: Column) -> Column:
    """The passages of a text that count: its lines, trimmed, without blank ones."""
    return paragraphs(text)
