"""Concepts out of links, without transitive closure: pivot rounds with cannot-link edges.

Transitive closure would put A and C together because both resemble B.  Here a
cluster is a pivot and members that are linked to the pivot itself, and no two
members (nor a member and the pivot) hold a cannot-link edge.

A round, all in joins and combined aggregations over written tables:

1. Each free node proposes to its best open pivot: the linked one of the highest
   score that no member of its cluster forbids (ties: lesser pivot).
2. Of the proposals to one pivot, those are taken that no better proposal to the
   same pivot (higher score, then lesser node) forbids; the others try again.
3. A free node without an open pivot becomes a pivot if none of its linked free
   nodes comes before it (by hash, then by node).

Every round takes a proposal or makes a pivot, and with hashed priorities the
number of rounds is logarithmic in expectation.  The result is a function of the
edges alone, whatever the partitioning.

Defined results: edges are symmetric; of repeated links the highest score counts, a
null score is 0; edges that name a null, and loops, are left out; a pair that is both
linked and forbidden is forbidden; nodes without links, or whose
links all lead to clusters that forbid them, are pivots of themselves (round 0).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlake.staging import Rounds


def _both(edges: DataFrame, more: list[str]) -> DataFrame:
    """Edges in both directions, without loops and nulls."""
    kept = edges.where("a is not null and b is not null and a <> b")
    return kept.select("a", "b", *more).unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b"), *more))


def pivot_clusters(nodes: DataFrame, links: DataFrame, forbidden: DataFrame, most_rounds: int = 200) -> DataFrame:
    """node, pivot, score (of the link to the pivot; null for the pivot itself), round for every node.

    nodes has node; links a, b, score; forbidden a, b.
    """
    rounds = Rounds(nodes.sparkSession, "clusters")
    cannot = rounds.write(_both(forbidden, []).distinct())
    scored = links.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
    pairs = _both(scored, ["score"]).groupBy("a", "b").agg(F.max("score").alias("score"))
    # links between free nodes, and links of free nodes to pivots that they may join
    free = rounds.write(pairs.join(cannot, ["a", "b"], "left_anti"))
    offers = free.limit(0).select(F.col("a").alias("node"), F.col("b").alias("pivot"), "score")
    everyone = rounds.write(nodes.select("node").where("node is not null").unionByName(free.select(F.col("a").alias("node"))).distinct())
    placed: list[DataFrame] = []
    for number in range(1, most_rounds + 1):
        better = F.struct((-F.col("score")).alias("low"), F.col("pivot").alias("pivot"))
        asked = offers.groupBy("node").agg(F.min(better).alias("best")).select("node", F.col("best.pivot").alias("pivot"), (-F.col("best.low")).alias("score"))
        asked = rounds.write(asked)
        rival = asked.select(F.col("node").alias("rival"), F.col("pivot").alias("rival_pivot"), F.col("score").alias("rival_score"))
        clash = asked.join(cannot, asked.node == cannot.a).join(rival, (F.col("b") == F.col("rival")) & (F.col("pivot") == F.col("rival_pivot")))
        first = (F.col("rival_score") > F.col("score")) | ((F.col("rival_score") == F.col("score")) & (F.col("rival") < F.col("node")))
        taken = asked.join(clash.where(first).select("node").distinct(), "node", "left_anti")
        place = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        leading = free.groupBy("a").agg(F.max(place("b") < place("a")).alias("later")).where("not later").select(F.col("a").alias("node"))
        pivots = leading.join(asked.select("node"), "node", "left_anti").select("node", F.col("node").alias("pivot"), F.lit(None).cast("double").alias("score"))
        now = rounds.write(taken.select("node", "pivot", "score").unionByName(pivots))
        placed.append(now.withColumn("round", F.lit(number)))
        # placed nodes leave, offers of new pivots come, offers that a new member forbids go
        gone = now.select(F.col("node").alias("gone"))
        new = free.join(now.where("node = pivot").select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), F.col("b").alias("pivot"), "score")
        forbidden_now = now.join(cannot, now.node == cannot.a).select(F.col("b").alias("node"), "pivot").distinct()
        left = offers.unionByName(new)
        left = left.join(gone, left.node == F.col("gone"), "left_anti").join(forbidden_now, ["node", "pivot"], "left_anti")
        offers, free = rounds.write(left), rounds.write(free.join(gone, free.a == F.col("gone"), "left_anti").join(gone, free.b == F.col("gone"), "left_anti"))
        if free.isEmpty() and offers.isEmpty():
            break
    else:
        raise ValueError(f"clusters are not complete after {most_rounds} rounds")
    found = reduce(DataFrame.unionByName, placed)
    alone = everyone.join(found.select("node"), "node", "left_anti")
    alone = alone.select("node", F.col("node").alias("pivot"), F.lit(None).cast("double").alias("score"), F.lit(0).alias("round"))
    return rounds.last(found.unionByName(alone))
