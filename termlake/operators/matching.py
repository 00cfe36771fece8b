"""Pairing of publications by bibliographic evidence, with the reason and a confidence for every pair.

Tiers of keys are tried from the strongest to the weakest; within a tier pairs are
one to one and the pairing is maximal: no two rows that share a key of the tier
stay unpaired on both sides.

A round of a tier deals the free rows of each key by rank on both sides and joins
equal ranks, so a key with many rows gives as many candidates as its smaller side has
rows, never the product.  Ranks are taken without a group being in one task
(:func:`termlake.staging.rank_in_groups`).  Of the candidates, locally dominant
ones are kept: those that are the best of both their rows.  Matched rows leave, and
the round is repeated while a key has free rows on both sides.  Where every row has
one key of the tier at most, equal ranks are the pairing itself and nothing is repeated.

Order of candidates: number of shared keys of the tier, then left id, then right id; so
ties are the same on any partitioning.

Defined results: null keys and null ids pair nothing; repeated ids count once;
repeated keys of a row count once; empty sides give no pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlake.staging import Rounds, rank_in_groups

#: Tier, confidence and label, from the strongest evidence to the weakest.
TIERS = (
    ("publication", 0.99, "parallel"),
    ("application", 0.95, "parallel"),
    ("family_priority", 0.85, "near_parallel"),
    ("applicant_date", 0.60, "comparable"),
)


def _keys(side: DataFrame, tier: str, once: bool = False) -> DataFrame:
    """(key, id) of a side's rows; a tier's column is an array of keys or one key.  With one key a row and no id twice no pair can recur."""
    kind = side.schema[tier].dataType.typeName()
    key = F.explode(F.array_distinct(tier)) if kind == "array" else F.col(tier)
    rows = side.where("id is not null").select(key.alias("key"), "id").where("key is not null")
    return rows if once else rows.distinct()


def _once(side: DataFrame) -> bool:
    """Whether no id is repeated."""
    return side.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()


def match_tier(left: DataFrame, right: DataFrame, tier: str, rounds: Rounds, once: bool = False) -> DataFrame:
    """left_id, right_id: a maximal one-to-one pairing of rows that share a key of the tier; once tells that no side repeats an id."""
    kinds = lambda side: (side.schema[tier].dataType, side.schema["id"].dataType)
    single = once and kinds(left) == kinds(right) and kinds(left)[0].typeName() != "array"
    a, b = _keys(left, tier, single), _keys(right, tier, single)
    if single:
        both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
        ranked = rank_in_groups(both, ["key", "side"], ["id"], rounds)
        x, y = (ranked.where(F.col("side") == k).select("key", "at", F.col("id").alias(name)) for k, name in enumerate(("left_id", "right_id")))
        return x.join(y, ["key", "at"]).select("left_id", "right_id")
    a, b = rounds.write(a), rounds.write(b)
    found: list[DataFrame] = []
    while True:
        # keys that both sides still have; others can pair nothing any more
        a, b = a.join(b.select("key").distinct(), "key", "left_semi"), b.join(a.select("key").distinct(), "key", "left_semi")
        x = rank_in_groups(a, ["key"], ["id"], rounds).withColumnRenamed("id", "left_id")
        y = rank_in_groups(b, ["key"], ["id"], rounds).withColumnRenamed("id", "right_id")
        met = rounds.write(x.join(y, ["key", "at"]).groupBy("left_id", "right_id").agg(F.count("*").alias("shared")))
        if met.isEmpty():
            break
        low = (-F.col("shared")).alias("low")
        best_l = met.groupBy("left_id").agg(F.min(F.struct(low, F.col("left_id").alias("l"), F.col("right_id").alias("r"))).alias("p")).select(F.col("p.l").alias("left_id"), F.col("p.r").alias("right_id"))
        best_r = met.groupBy("right_id").agg(F.min(F.struct(low, F.col("left_id").alias("l"), F.col("right_id").alias("r"))).alias("p")).select(F.col("p.l").alias("left_id"), F.col("p.r").alias("right_id"))
        now = rounds.write(best_l.join(best_r, ["left_id", "right_id"]))
        found.append(now)
        a = rounds.write(a.join(now.select(F.col("left_id").alias("id")), "id", "left_anti").select("key", "id"))
        b = rounds.write(b.join(now.select(F.col("right_id").alias("id")), "id", "left_anti").select("key", "id"))
    if not found:
        return met.select("left_id", "right_id")
    return reduce(DataFrame.unionByName, found)


def pair_publications(left: DataFrame, right: DataFrame, tiers: tuple[tuple[str, float, str], ...] = TIERS) -> DataFrame:
    """left_id, right_id, reason, confidence, label: each row of either side is in one pair at most.

    Both sides have id and a column for each tier that they can be paired by; rows matched by a
    stronger tier are left out of the weaker ones.
    """
    rounds = Rounds(left.sparkSession, "pairs")
    a, b = left, right
    once = _once(left) and _once(right)
    out: list[DataFrame] = []
    for tier, confidence, label in tiers:
        found = match_tier(a, b, tier, rounds, once)
        told = rounds.write(found.select("left_id", "right_id", F.lit(tier).alias("reason"), F.lit(confidence).alias("confidence"), F.lit(label).alias("label")))
        out.append(told)
        a = a.join(told.select(F.col("left_id").alias("id")), "id", "left_anti")
        b = b.join(told.select(F.col("right_id").alias("id")), "id", "left_anti")
    return rounds.last(reduce(DataFrame.unionByName, out))
