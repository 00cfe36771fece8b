"""Conflicts of span boundaries, told by a sweep: nested spans are kept, crossing ones are conflicts.

Spans of a unit are swept by their starts with a stack of the open ones.  A span
that ends within the span it opened in is nested; one that ends behind an open span
that began before it crosses that span.  No span is joined with all spans of its
unit: a span meets the open ones only.

A unit is cut into windows of ``WINDOW`` characters and a span is sent to every window
it touches, so a unit with very many spans is swept in several tasks; a pair
is told in the window where the later span starts.  Equal spans are one span
with a count before they are sent.

Defined results: a span without a positive length, or with a null bound, is left
out; a null unit is a unit; equal spans neither nest nor cross each other; an empty
table gives no rows.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1 << 16
PAIR = "start long, `end` long, other_start long, other_end long, relation string"


def _sweep(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by unit and window, in it by start and falling end."""
        now, open_ = None, []
        for batch in batches:
            names = [batch.column(k).to_pylist() for k in (*keys, "window")]
            starts, ends, firsts = (batch.column(c).to_pylist() for c in ("start", "end", "first"))
            out, of = [], []
            for i, group in enumerate(zip(*names, strict=True)):
                if group != now:
                    now, open_ = group, []
                s, e = starts[i], ends[i]
                # open spans by falling end: (-end, start); those that ended are at the tail
                while open_ and -open_[-1][0] <= s:
                    open_.pop()
                # one that began in an earlier window was told there with all that began before it
                if firsts[i] == group[-1]:
                    for low, began in open_:
                        out.append((s, e, began, -low, "nested" if -low >= e else "crossing"))
                        of.append(i)
                insort(open_, (-e, s))
            if out:
                each = pa.array(of, pa.int64())
                columns = [pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(k).take(each) for k in keys] + columns, [*keys, "start", "end", "other_start", "other_end", "relation"])

    return run


def boundary_pairs(spans: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """keys, start, end, other_start, other_end, relation for each pair of different overlapping spans of a unit.

    The other span began first, or at the same place and ends later; relation is nested (the span lies
    in the other one) or crossing.  Rows are pairs of different (start, end).
    """
    kept = spans.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).where("`end` > start and start >= 0").distinct()
    first = F.expr(f"start div {window}")
    rows = kept.withColumn("first", first).withColumn("window", F.explode(F.sequence(first, F.expr(f"(`end` - 1) div {window}"))))
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, *keys, "window").sortWithinPartitions(*keys, "window", "start", F.desc("end"))
    schema = ", ".join(f"`{k}` {spans.schema[k].dataType.simpleString()}" for k in keys) + ", " + PAIR
    return dealt.mapInArrow(_sweep(keys), schema)


def boundary_report(spans: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """keys, start, end, n_spans (equal ones), n_inside, n_around, n_crossing for every different span."""
    pairs = boundary_pairs(spans, keys, window)
    nested = (F.col("relation") == "nested").cast("long")
    crossing = (F.col("relation") == "crossing").cast("long")
    zero = F.lit(0).cast("long")
    own = pairs.select(*keys, "start", "end", zero.alias("n"), zero.alias("inside"), nested.alias("around"), crossing.alias("crossing"))
    other = pairs.select(*keys, F.col("other_start").alias("start"), F.col("other_end").alias("end"), zero.alias("n"), nested.alias("inside"), zero.alias("around"), crossing.alias("crossing"))
    kept = spans.where("`end` > start and start >= 0").select(
        *keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(1).cast("long").alias("n"), zero.alias("inside"), zero.alias("around"), zero.alias("crossing")
    )
    told = kept.unionByName(own).unionByName(other).groupBy(*keys, "start", "end")
    return told.agg(F.sum("n").alias("n_spans"), F.sum("inside").alias("n_inside"), F.sum("around").alias("n_around"), F.sum("crossing").alias("n_crossing"))
