"""Measures of extraction, ranking, calibration and frequency, and leak-free splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def precision_recall(found: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 over distinct keys."""
    f = found.select(*keys).distinct().withColumn("f", F.lit(1))
    g = gold.select(*keys).distinct().withColumn("g", F.lit(1))
    both = f.join(g, keys, "full").agg(
        F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn")
    )
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return both.select("*", part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"))


def ranking(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Mean reciprocal rank, mean average precision, precision and recall at k of (query_id, item_id, rank) against (query_id, item_id)."""
    total = gold.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = ranked.join(gold.distinct(), ["query_id", "item_id"]).withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    per = hits.groupBy("query_id").agg(
        (1 / F.min("rank")).alias("rr"), F.sum(F.col("i") / F.col("rank")).alias("ap"), F.count_if(F.col("rank") <= k).alias("at_k")
    )
    rows = total.join(per, "query_id", "left").na.fill(0, ["rr", "ap", "at_k"])
    return rows.agg(
        F.avg("rr").alias("mrr"), F.avg(F.col("ap") / F.col("n")).alias("map"), F.avg(F.col("at_k") / k).alias("p_at_k"), F.avg(F.col("at_k") / F.col("n")).alias("r_at_k")
    )


def brier(predictions: DataFrame) -> DataFrame:
    """Mean squared difference of confidence and outcome (0 or 1)."""
    return predictions.agg(F.avg(F.pow(F.col("confidence") - F.col("outcome"), 2)).alias("brier"))


def split(df: DataFrame, family_col: str, train: int = 80, valid: int = 10) -> DataFrame:
    """df with column split; a family is in one part as a whole."""
    bucket = F.pmod(F.xxhash64(family_col), F.lit(100))
    return df.withColumn("split", F.when(bucket < train, "train").when(bucket < train + valid, "valid").otherwise("test"))


def termhood(mentions: DataFrame) -> DataFrame:
    """text, words, frequency, records and C-value of (source_record_id, text): frequency less that of longer terms
    around it, weighted by length."""
    stats = mentions.groupBy("text").agg(F.count("*").alias("freq"), F.count_distinct("source_record_id").alias("records")).withColumn("w", F.split("text", " ")).withColumn("n", F.size("w"))
    starts = F.flatten(
        F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("n") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " ")))
    )
    inner = stats.where("n > 1").select(F.col("text").alias("outer_text"), "freq", F.explode(F.array_distinct(starts)).alias("text"))
    around = inner.groupBy("text").agg(F.sum("freq").alias("outer_freq"), F.count("*").alias("outer_terms"))
    nested = F.when(F.col("outer_terms") > 0, F.col("outer_freq") / F.col("outer_terms")).otherwise(0.0)
    return stats.join(around, "text", "left").select("text", F.col("n").alias("words"), "freq", "records", (F.log2(F.col("n") + 1) * (F.col("freq") - nested)).alias("c_value"))


def pairwise_f1(members: DataFrame, gold: str = "gold", found: str = "found") -> DataFrame:
    """tp, found_pairs, gold_pairs, precision, recall, f1 over all pairs of items that a cluster joins, from counts alone.

    Each row is an item with its gold and its found cluster.  No pair is made: the
    pairs of a cluster of n items are n (n - 1) / 2, those of both clusterings the same over the cells of the
    contingency table, whose counts are combined before the shuffle.  An item without a cluster
    (null) is alone in it.  Ratios without a denominator are null.
    """
    cells = members.groupBy(F.col(gold).alias("g"), F.col(found).alias("f")).agg(F.count("*").alias("n"))
    # rows, columns and cells of the table in one pass over the cells
    known = cells.groupingSets([["g"], ["f"], ["g", "f"]], "g", "f").agg(F.sum("n").alias("n"), F.grouping_id().alias("kind"))
    known = known.where("(kind in (2) or g is not null) and (kind in (1) or f is not null)")
    pairs = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n").cast("decimal(38,0)") * (F.col("n") - 1) / 2)), F.lit(0)).cast("long")
    sums = known.agg(pairs(0).alias("tp"), pairs(2).alias("found_pairs"), pairs(1).alias("gold_pairs"))
    p, r = F.col("tp") / F.nullif(F.col("found_pairs"), F.lit(0)), F.col("tp") / F.nullif(F.col("gold_pairs"), F.lit(0))
    rated = sums.withColumn("precision", p.cast("double")).withColumn("recall", r.cast("double"))
    both = F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    return rated.select("tp", "found_pairs", "gold_pairs", "precision", "recall", (2 * F.col("precision") * F.col("recall") / both).alias("f1"))


def nc_value(mentions: DataFrame, top_terms: int = 100, share: float = 0.2) -> DataFrame:
    """text, words, freq, records, families, c_value, nc_value of (source_record_id, family_id, text, context).

    The words (context, an array) that stand beside the top_terms terms of the highest
    C-value are evidence of a term: a word weighs the share of these terms it stands
    beside, and a term gains the weights of the words beside its mentions, as often as they stand
    there.  families is the number of publication families that a term recurs in.  A null context
    is empty; a null family is none.  The weights, words beside a bounded number of
    terms, are joined as they are counted; nothing is collected.
    """
    stats = termhood(mentions)
    best = stats.orderBy(F.round("c_value", 9).desc(), "text").limit(top_terms).select("text")
    beside = mentions.select("text", F.explode("context").alias("word")).groupBy("text", "word").agg(F.count("*").alias("times"))
    size = best.agg(F.count("*").alias("size"))
    weights = beside.join(F.broadcast(best), "text").groupBy("word").agg(F.count("*").alias("terms")).join(F.broadcast(size)).select("word", (F.col("terms") / F.col("size")).alias("weight"))
    gained = beside.join(weights, "word").groupBy("text").agg(F.sum(F.col("times") * F.col("weight")).alias("gained"))
    families = mentions.groupBy("text").agg(F.count_distinct("family_id").alias("families"))
    nc = (1 - share) * F.col("c_value") + share * F.coalesce("gained", F.lit(0.0))
    return stats.join(families, "text").join(gained, "text", "left").select("text", "words", "freq", "records", "families", "c_value", nc.alias("nc_value"))


def log_likelihood(domain: DataFrame, general: DataFrame) -> DataFrame:
    """text, domain_freq, general_freq, log_likelihood of mentions (text) in two corpora: how surely the frequencies differ.

    The value is positive where a text is more frequent in the domain than in general, negative where it is less so;
    a corpus without mentions gives nulls.
    """
    side = lambda df, name: df.groupBy("text").agg(F.count("*").alias(name))
    both = side(domain, "a").join(side(general, "b"), "text", "full_outer").na.fill(0, ["a", "b"])
    totals = F.broadcast(both.agg(F.sum("a").alias("c"), F.sum("b").alias("d")))
    part = lambda n, whole: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) * (F.col("c") + F.col("d")) / (F.nullif(F.col(whole), F.lit(0)) * (F.col("a") + F.col("b"))))).otherwise(0.0)
    more = F.col("a") * F.col("d") >= F.col("b") * F.col("c")
    value = 2 * (part("a", "c") + part("b", "d"))
    known = (F.col("c") > 0) & (F.col("d") > 0)
    return both.join(totals).select("text", F.col("a").alias("domain_freq"), F.col("b").alias("general_freq"), F.when(known, F.when(more, value).otherwise(-value)).alias("log_likelihood"))


def review_queue(items: DataFrame, most: int, weights: dict[str, float], penalty: float = 0.1, depth: int = 8) -> DataFrame:
    """The most urgent items for review, with rank and priority: uncertainty, impact and novelty, spread over groups.

    items has item, group and the columns of weights, from 0 to 1 (null is 0).  An item's priority is the weighted
    sum of its scores, less the penalty for every item of its group with a higher sum.

    Threshold algorithm: the best ``depth * most`` items of each score's own sorted
    list are read; an item outside of all of these heads has at most the weighted sum of the last
    scores of the heads.  If the last of the chosen items is at least that high, the
    heads hold the whole answer; else they are deepened eightfold and read again.  Heads are top-k
    scans, so no sort of all items is made unless the heads come to hold them.
    """
    if not weights or min(weights.values()) < 0 or penalty < 0:
        raise ValueError("weights and penalty must not be negative")
    score = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = items.where("item is not null").select("item", "group", *[score(c).alias(c) for c in weights])
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    while True:
        size = depth * most
        heads = [rows.orderBy(F.desc(c), "item").limit(size) for c in weights]
        last = [h.agg(F.min(c).alias("low"), F.count("*").alias("n")).first() for c, h in zip(weights, heads, strict=True)]
        seen = heads[0]
        for h in heads[1:]:
            seen = seen.unionByName(h)
        placed = seen.distinct().withColumn("total", total)
        # an item's better ones of its group are all in the heads, if it is above what the heads leave out
        before = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("total"), "item")) - 1
        ranked = placed.withColumn("priority", F.col("total") - penalty * before)
        chosen = ranked.orderBy(F.desc("priority"), "item").limit(most)
        bound = sum((w * r.low for w, r in zip(weights.values(), last, strict=True)), 0.0) if last[0].n >= size else float("-inf")
        found = chosen.agg(F.min("priority").alias("low"), F.count("*").alias("n")).first()
        if bound == float("-inf") or (found.n == most and found.low > bound):
            order = Window.orderBy(F.desc("priority"), "item")
            return chosen.withColumn("rank", F.row_number().over(order)).select("rank", "item", "group", "priority")
        depth *= 8
