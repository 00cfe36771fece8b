"""Connected components by alternating large-star and small-star rounds.

All state is DataFrames; after each round the edges are written to the shared
folder.  A star operation is an aggregated minimum per node (combined before the
shuffle) and an equi-join with one row a node on its right side.  While the
edges are few, as counted, the minima are broadcast.  Beyond that, minima and
edges are written before they are joined, so that both sides of the join are
plain shuffles and adaptive skew handling can split a node with very many edges.

Defined results: nulls are refused by the callers, loops are dropped, repeated
edges count once, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import BROADCAST_BYTES, Tables


#: Edges up to which the minima of their nodes (at most two a edge, 96 bytes each) are broadcast.
FEW = BROADCAST_BYTES // 192


def _star(edges: DataFrame, large: bool, tables: Tables | None) -> DataFrame:
    """One star operation; with tables, for many edges, minima and result are written."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    low = low.hint("broadcast") if tables is None else tables.write(low)
    joined = both.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    out = out.where("u <> v").distinct()
    return out if tables is None else tables.write(out)


def _state(edges: DataFrame) -> tuple[int, int | None]:
    """Number and sum of hashes of the edges."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def connected_components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(u, v) edges to (node, root): the least node reachable from each node with an edge.

    Nodes are their own roots only if an edge names them; loops are dropped.
    """
    now = tables.write(edges.select("u", "v").where("u <> v").distinct())
    state = _state(now)
    while state[0]:
        first, before = tables.count, state
        many = tables if state[0] > FEW else None
        now = _star(_star(now, True, many), False, many)
        now = now if many else tables.write(now)
        state = _state(now)
        tables.drop(first, tables.count)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
