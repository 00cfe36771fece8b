"""Where merged and split concepts are now: chains of supersession, contracted and then followed by pointer jumping.

The edit log says which concept another one has taken the place of.  Edges are
dealt by ranges of concepts, and each stretch of bounded size follows its chains as
far as they stay in it.  Only the concepts where a chain enters another stretch
go on: each round joins each of them with what its present end points to, so a
chain over n stretches takes about log2 n rounds.  When a round ends no chain that the one
before left open, none that is left has an end (any longer chain has places at all
smaller distances from its end); these lead to cycles and are not given one.

Cycles are what is left of such concepts when their successors are taken 1, 2, 4, ...
edits on until no fewer remain.

Splits move named terms: a term follows its concept's chain, but a split of a
concept on that chain that names the term sends it elsewhere, from where it goes
on.  Terms that no split names are where their concept is; only the others are
taken from split concept to split concept.

Defined results: rows with a null concept are left out; a concept that names itself
is a cycle of one; of several edits of one concept the last counts (highest seq,
then least successor); repeated rows count once; empty logs leave all where it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlake.staging import Rounds

#: Concepts whose chains are followed at once in a task.
STRETCH = 1 << 18


def _last(log: DataFrame, keys: list[str], target: str) -> DataFrame:
    """The last edit of each key: highest seq, then least target."""
    return log.groupBy(*keys).agg(F.min(F.struct((-F.coalesce(F.col("seq"), F.lit(0))).alias("late"), F.col(target).alias("to"))).alias("e")).select(*keys, F.col("e.to").alias("to"))


def _followed(following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each place (following has the next one, -1 outside): the last place of its chain, edits up to the exit, whether it never leaves, whether it is on a cycle."""
    last, steps, ahead = np.arange(len(following)), np.ones(len(following), np.int64), following.copy()
    endless, ring = np.zeros(len(following), bool), np.zeros(len(following), bool)
    open_, before = np.flatnonzero(ahead >= 0), -1
    while len(open_) and len(open_) != before:
        before, to = len(open_), ahead[open_]
        last[open_], steps[open_], ahead[open_] = last[to], steps[open_] + steps[to], ahead[to]
        open_ = open_[ahead[open_] >= 0]
    endless[open_] = True
    jump, left = following.copy(), open_
    while len(left):
        image = np.unique(jump[left])
        if len(image) == len(left):
            break
        left, jump[open_] = image, jump[jump[open_]]
    ring[left] = True
    return last, steps, endless, ring


def _stretches(size: int):
    """concept, to (sorted) with the place where each chain leaves its stretch, in how many edits, and what never leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            concept, to = rows.column("concept").combine_chunks(), rows.column("to").combine_chunks()
            following = pc.fill_null(pc.index_in(to.cast(concept.type), value_set=concept), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            last, steps, endless, ring = _followed(following)
            out = pa.table({"concept": concept, "to": to, "at": to.take(pa.array(last)), "steps": steps, "endless": endless, "ring": ring})
            yield from out.to_batches(max_chunksize=1 << 16)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= size:
                yield from told()
                held = []
        if held:
            yield from told()

    return run


def supersession(merges: DataFrame, rounds: Rounds | None = None, stretch: int = STRETCH) -> DataFrame:
    """concept, current, steps, on_cycle for every concept that was merged; current is null where a cycle is reached.

    merges has concept, successor, seq.  steps is the number of edits followed (null for cycles).
    """
    rounds = rounds or Rounds(merges.sparkSession, "lineage")
    return _chains(_last(merges.where("concept is not null and successor is not null"), ["concept"], "successor"), rounds, stretch)


def _chains(edges: DataFrame, rounds: Rounds, stretch: int = STRETCH) -> DataFrame:
    """supersession of edges (concept, to), one a concept."""
    kinds = {f.name: f.dataType for f in edges.schema}
    flag = T.BooleanType()
    schema = T.StructType([T.StructField(n, t) for n, t in (("concept", kinds["concept"]), ("to", kinds["to"]), ("at", kinds["to"]), ("steps", T.LongType()), ("endless", flag), ("ring", flag))])
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = edges.select("concept", "to").repartitionByRange(parts, "concept").sortWithinPartitions("concept")
    near = rounds.write(dealt.mapInArrow(_stretches(stretch), schema))
    entered = near.where("not endless").select(F.col("at").alias("key")).distinct()
    far = rounds.write(near.join(entered, F.col("concept") == F.col("key"), "left_semi").select("concept", "at", "steps", "endless", F.lit(False).alias("moved")))
    before = -1
    while True:
        ahead = far.select(F.col("concept").alias("key"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("endless").alias("lost"))
        lost = F.col("endless") | F.coalesce("lost", F.lit(False))
        joined = far.join(ahead, (F.col("at") == F.col("key")) & ~F.col("endless"), "left")
        far = rounds.write(
            joined.select(
                "concept", F.coalesce("next", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), lost.alias("endless"), (F.col("key").isNotNull() & ~lost).alias("moved")
            )
        )
        open_ = far.where("moved").count()
        if open_ in (0, before):
            break
        before = open_
    # moved in the last round: leads to a cycle over several stretches
    ends = far.select(F.col("concept").alias("key"), F.col("at").alias("end"), F.col("steps").alias("more"), F.col("endless").alias("lost"), "moved")
    out = near.join(ends, (near.at == F.col("key")) & ~near.endless, "left")
    none = F.col("endless") | F.coalesce(F.col("lost") | F.col("moved"), F.lit(False))
    out = out.select(
        "concept", "to", F.when(~none, F.coalesce("end", "at")).alias("current"), F.when(~none, F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
        F.col("ring").alias("on_cycle"), F.coalesce("moved", F.lit(False)).alias("wide"),
    )
    if open_:
        out = rounds.write(out)
        ring = _ring(out.where("wide").select("concept", "to"), rounds).withColumn("wide_ring", F.lit(True))
        out = out.join(ring.withColumnRenamed("node", "concept"), "concept", "left").withColumn("on_cycle", F.col("on_cycle") | F.coalesce("wide_ring", F.lit(False)))
    return out.select("concept", "current", "steps", "on_cycle")


def _ring(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """The nodes on cycles, of edges (concept, to) whose targets all go on."""
    jump = rounds.write(edges.select(F.col("concept").alias("a"), F.col("to").alias("b")))
    left = jump.select(F.col("a").alias("node"))
    size = left.count()
    while True:
        image = rounds.write(left.join(jump, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct())
        if (n := image.count()) == size:
            return image
        twice = jump.join(jump.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        left, size, jump = image, n, rounds.write(twice)


def current_terms(terms: DataFrame, merges: DataFrame, splits: DataFrame) -> DataFrame:
    """term, concept, current, moves: where each term belongs after all merges and splits.

    terms has term, concept; splits has concept, term, successor, seq: the term goes from the concept to another.  A split
    of a concept takes a term before a merge of that concept does.  moves counts the splits that
    a term went through; both are null for a term that runs in a circle.
    """
    rounds = Rounds(terms.sparkSession, "terms")
    split = rounds.write(_last(splits.where("concept is not null and term is not null and successor is not null"), ["concept", "term"], "successor"))
    whole = rounds.write(_last(merges.where("concept is not null and successor is not null"), ["concept"], "successor"))

    def settled(rows: DataFrame, stops: DataFrame) -> DataFrame:
        """Rows with at moved to the stop of its chain; null where the chain is a circle."""
        joined = rows.join(stops, F.col("at") == F.col("from_"), "left")
        return joined.withColumn("at", F.when(F.col("from_").isNotNull(), F.col("stop")).otherwise(F.col("at"))).drop("from_", "stop")

    stops_of = lambda edges: _chains(edges, rounds).select(F.col("concept").alias("from_"), F.col("current").alias("stop"))
    known = terms.select("term", "concept", F.col("concept").alias("at")).join(split.select(F.col("term").alias("t")).distinct(), F.col("term") == F.col("t"), "left")
    every = rounds.write(settled(known.select("term", "concept", "at", F.col("t").isNotNull().alias("named")), stops_of(whole)))
    kept = rounds.count

    # chains of named terms stop at concepts that were split: there each term may go its own way
    cut = rounds.write(split.select(F.col("concept").alias("key")).distinct())
    stops = rounds.write(stops_of(whole.join(cut, whole.concept == F.col("key"), "left_anti")))
    named = rounds.write(settled(split.select(F.col("concept").alias("c"), F.col("term").alias("t"), F.col("to").alias("at")), stops).withColumnRenamed("at", "goes"))
    on = whole.join(cut, whole.concept == F.col("key"), "left_semi").select(F.col("concept").alias("m"), F.col("to").alias("at"))
    on = rounds.write(settled(on, stops).withColumnRenamed("at", "merges_into"))
    seen = F.array().cast(T.ArrayType(terms.schema["concept"].dataType))
    now = settled(every.where("named").select("term", "concept", F.col("concept").alias("at"), F.lit(0).alias("moves"), seen.alias("seen")), stops)
    arrived = [every.limit(0).select("term", "concept", F.col("at").alias("current"), F.lit(0).alias("moves"))]
    while True:
        step = now.join(named, (F.col("at") == F.col("c")) & (F.col("term") == F.col("t")), "left").join(on, F.col("at") == F.col("m"), "left")
        by_split, goes = F.col("c").isNotNull(), F.col("c").isNotNull() | F.col("m").isNotNull()
        to = F.when(by_split, F.col("goes")).otherwise(F.col("merges_into"))
        step = rounds.write(step.select("term", "concept", "at", "moves", "seen", by_split.cast("int").alias("by_split"), goes.alias("moving"), to.alias("to")))
        arrived.append(step.where("not moving").select("term", "concept", F.col("at").alias("current"), F.when(F.col("at").isNotNull(), F.col("moves")).alias("moves")))
        if step.where("moving").isEmpty():
            break
        # a split concept that a term comes to again is a circle
        passed = F.array_append("seen", F.col("at"))
        now = step.where("moving").select(
            "term", "concept", F.when(~F.array_contains(passed, F.col("to")), F.col("to")).alias("at"), (F.col("moves") + F.col("by_split")).alias("moves"), passed.alias("seen")
        )
    moved = rounds.write(reduce(DataFrame.unionByName, arrived))
    rounds.drop(1, kept)
    rounds.drop(kept + 1, rounds.count)
    return every.where("not named").select("term", "concept", F.col("at").alias("current"), F.when(F.col("at").isNotNull(), F.lit(0)).alias("moves")).unionByName(moved)
