"""Recorded refinement decisions applied to texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ground(text: Column, copied: Column, start: Column, end: Column) -> Column:
    """struct<start, end>: the hint where it is right, else the occurrence nearest to it (the first without
    a hint); null where the copied text is absent."""
    right = (start >= 0) & (start < end) & (end <= F.length(text)) & (F.substr(text, start + 1, end - start) == copied)
    hint = F.coalesce(start, F.lit(0))
    size = F.length(copied)
    head = F.substr(text, F.lit(1), F.greatest(hint, F.lit(-1)) + size)  # up to the end of an occurrence at the hint
    back = F.call_function("locate", F.reverse(copied), F.reverse(head))
    before = F.when(back > 0, F.length(head) - back + 1 - size)
    ahead = F.call_function("locate", copied, text, F.greatest(hint, F.lit(0)) + 1)
    after = F.when(ahead > 0, ahead - 1)
    near = F.when(size > 0, F.when(after.isNull() | (hint - before <= after - hint), before).otherwise(after))
    first = F.instr(text, copied) - 1
    at = F.when(start.isNull(), F.nullif(first, F.lit(-1))).otherwise(near)
    return F.when(F.coalesce(right, F.lit(False)), F.struct(start.alias("start"), end.alias("end"))).when(
        at.isNotNull(), F.struct(at.cast("int").alias("start"), (at + F.length(copied)).cast("int").alias("end"))
    )


def definition(x: Column) -> Column:
    """Null for texts that stand for no definition."""
    return F.when(~F.lower(F.trim(x)).isin("null", "none", "n/a"), x)


def apply_decisions(texts: DataFrame, decisions: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(refined candidates, issues) of recorded decisions over texts (keys, text).

    Out-of-scope decisions go; the rest are grounded.  A decision whose text is
    absent, or two with one span and types, fail all decisions of their text.
    A text whose decisions are all out of scope is refined to nothing.
    """
    kept = decisions.where("scope_decision <> 'OUT_OF_SCOPE'").withColumnRenamed("text", "copied").withColumnRenamed("start", "s").withColumnRenamed("end", "e")
    rows = kept.join(texts, list(keys)).withColumn("span", ground(F.col("text"), F.col("copied"), F.col("s"), F.col("e")))
    same = Window.partitionBy(*keys, "span.start", "span.end", F.to_json("types"))
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("bad", F.when(F.col("span").isNull(), "copied text is absent").when(F.count("*").over(same) > 1, "duplicate decision"))
    rows = rows.withColumn("failed", F.max("bad").over(whole))
    issues = rows.groupBy(*keys).agg(F.max("failed").alias("message")).where("message is not null").select(*keys, F.lit("REFINER_FAILED").alias("code"), "message")
    good = rows.where("failed is null").select(
        *keys, F.col("copied").alias("text"), F.col("span.start").alias("start"), F.col("span.end").alias("end"), "types", "roles",
        definition(F.col("proposed_definition")).alias("proposed_definition"), "confidence",
        (F.col("needs_review") | (F.col("scope_decision") == "REVIEW")).alias("needs_review"), "scope_decision", "source", "reason_code",
    )
    return good, issues
