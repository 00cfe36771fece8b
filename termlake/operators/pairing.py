"""Parallel units, recorded target mappings and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlake.functions.text import is_english, original_span, surface_key
from termlake.operators.grouped import build, grouped_units, local_span
from termlake.operators.refine import ground

SHAPE = ["source_record_id", "unit_type", "locator"]


def parallel_units(units: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Each English unit with each unit of its record, type and locator in another (allowed) language."""
    other = units.where(~is_english(F.col("language")))
    if languages is not None:
        other = other.where(F.col("language").isin(*languages))
    e = units.where(is_english(F.col("language"))).select(*SHAPE, F.col("text_unit_index").alias("source_unit"), F.col("text").alias("source_text"))
    t = other.select(*SHAPE, F.col("language").alias("target_language"), F.col("text_unit_index").alias("target_unit"), F.col("text").alias("target_text"))
    return e.join(t, SHAPE)


def grouped_pairs(units: DataFrame) -> DataFrame:
    """record, target language and target units for English groups of title and abstract: the units of a
    language whose shapes the English group has."""
    parts = units.where(F.col("unit_type").isin("title", "abstract"))
    english = parts.where(is_english(F.col("language")))
    both = english.groupBy("source_record_id").agg(F.count_distinct("unit_type").alias("n")).where("n = 2")
    shapes = english.join(both, "source_record_id", "left_semi").select(*SHAPE).distinct()
    found = parts.where(~is_english(F.col("language"))).join(shapes, SHAPE, "left_semi")
    return found.groupBy("source_record_id", F.col("language").alias("target_language")).agg(F.array_sort(F.collect_list("text_unit_index")).alias("target_units"))


def form_status(source: Column, target: Column, proposed: Column) -> Column:
    """How a target form realises the source form; source and target are surface keys."""
    return (
        F.when(target.isNull(), "NOT_PRESENT")
        .when(source == target, F.when(proposed == "LANGUAGE_NEUTRAL", proposed).otherwise(F.lit("UNCHANGED")))
        .otherwise("TRANSLATED")
    )


def mapping_requests(units: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """The texts that source terms are looked up in at once, from normalised units.

    source_record_id, source_unit and target_unit (the first of either side),
    target_language, grouped, source_units, text and segments.  Title and abstract
    of a record are one request a language; any other English unit is one request
    for each unit of its type and locator in another language.
    """
    english = units.where(is_english(F.col("language")))
    together = grouped_units(english)
    other = units.where(~is_english(F.col("language")))
    if languages is not None:
        other = other.where(F.col("language").isin(*languages))
    sources = together.groupBy("source_record_id").agg(F.array_sort(F.collect_list("text_unit_index")).alias("source_units"))
    shaped = other.withColumnRenamed("language", "target_language").join(together.select(*SHAPE).distinct(), SHAPE, "left_semi")
    texts = build(shaped, ("source_record_id", "target_language")).join(sources, "source_record_id")
    first = lambda c: F.get(c, F.lit(0))
    whole = texts.select(
        "source_record_id", first("source_units").alias("source_unit"), first("segments")["unit"].alias("target_unit"), "target_language", F.lit(True).alias("grouped"),
        "source_units", F.col("grouped_text").alias("text"), "segments",
    )
    alone = english.join(together.select("source_record_id", "text_unit_index"), ["source_record_id", "text_unit_index"], "left_anti")
    e = alone.select(*SHAPE, F.col("text_unit_index").alias("source_unit"))
    t = other.select(*SHAPE, F.col("language").alias("target_language"), F.col("text_unit_index").alias("target_unit"), F.col("normalized").alias("text"))
    segment = F.struct(F.col("target_unit").alias("unit"), F.lit(0).alias("start"), F.length("text").alias("end"))
    pairs = e.join(t, SHAPE).select(
        "source_record_id", "source_unit", "target_unit", "target_language", F.lit(False).alias("grouped"), F.array("source_unit").alias("source_units"), "text", F.array(segment).alias("segments")
    )
    return whole.unionByName(pairs)


def numbered_candidates(candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """source_record_id, source_unit, source_index (from 0, by unit and place), source_text_unit_index, source_text, source_types of each request's candidates."""
    sources = asked.select("source_record_id", "source_unit", F.explode("source_units").alias("text_unit_index")).distinct()
    order = Window.partitionBy("source_record_id", "source_unit").orderBy("text_unit_index", "start", "end", "text", F.to_json("types"))
    return candidates.join(sources, ["source_record_id", "text_unit_index"]).select(
        "source_record_id", "source_unit", (F.row_number().over(order) - 1).alias("source_index"), F.col("text_unit_index").alias("source_text_unit_index"),
        F.col("text").alias("source_text"), F.col("types").alias("source_types"),
    )


def coverage_errors(numbered: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """keys and message of the requests whose decisions (source_index) are not one for each candidate: doubled, missing or unknown ones."""
    want = numbered.groupBy("source_record_id", "source_unit").agg(F.collect_set("source_index").alias("want"))
    got = decisions.groupBy(*keys).agg(F.collect_list(F.coalesce("source_index", F.lit(-1))).alias("got"))
    rows = got.join(want, ["source_record_id", "source_unit"], "left").withColumn("want", F.coalesce("want", F.array().cast("array<int>")))
    missing, extra = F.array_sort(F.array_except("want", "got")), F.array_sort(F.array_except("got", "want"))
    told = lambda name, ids: F.when(F.size(ids) > 0, F.concat(F.lit(f"{name} "), F.array_join(F.transform(ids, lambda i: F.concat(F.lit("E"), i)), ", ")))
    message = F.when(F.size("got") > F.size(F.array_distinct("got")), "more than one decision for a candidate").otherwise(
        F.nullif(F.concat_ws("; ", told("missing", missing), told("unknown", extra)), F.lit(""))
    )
    return rows.select(*keys, message.alias("message")).where("message is not null")


def map_units(units: DataFrame, candidates: DataFrame, decisions: DataFrame, languages: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(mappings, issues) of recorded decisions on normalised units (with offsets) and the best candidates of the English ones.

    decisions: source_record_id, source_unit, target_unit (the request, see
    mapping_requests), source_id E{i}, target_text, target_start, target_end (in
    the request's text), relation, target_form_status, confidence, needs_review,
    reason_code.  One decision for each candidate, or the request fails; so does a
    request with a target that crosses sections.  A target text that is not in the
    request's text is rejected by itself.  A request's failure leaves the others
    of its record alone.
    """
    keys = ["source_record_id", "source_unit", "target_unit"]
    asked = mapping_requests(units, languages)
    numbered = numbered_candidates(candidates, asked)
    d = decisions.withColumn("source_index", F.expr("try_cast(substr(source_id, 2) AS int)")).join(asked.drop("source_units"), keys)
    of = [*keys, "target_language", "grouped"]
    uncovered = coverage_errors(numbered, d, of)
    rows = d.join(uncovered, keys, "left_anti").join(numbered, ["source_record_id", "source_unit", "source_index"])
    rows = rows.withColumn("span", F.when(F.col("target_text").isNotNull(), ground(F.col("text"), F.col("target_text"), F.col("target_start"), F.col("target_end"))))
    rows = rows.withColumn("lost", F.col("target_text").isNotNull() & F.col("span").isNull())
    rows = rows.withColumn("local", local_span(F.col("segments"), F.col("span.start"), F.col("span.end")))
    crossing = rows.where("span is not null and local is null").groupBy(*of).agg(F.concat(F.lit("a target crosses sections: "), F.min("target_text")).alias("message"))
    code = F.when(F.col("grouped"), "GROUPED_TARGET_MAPPING_FAILED").otherwise("TARGET_MAPPING_FAILED")
    issues = uncovered.unionByName(crossing).select(
        "source_record_id", F.col("target_unit").alias("text_unit_index"), "target_language", code.alias("code"), "message"
    )
    own = units.select("source_record_id", F.col("text_unit_index").alias("target_text_unit_index"), "off_start", "off_end")
    rows = rows.join(crossing, keys, "left_anti").withColumn("target_text_unit_index", F.coalesce("local.unit", "target_unit")).join(own, ["source_record_id", "target_text_unit_index"])
    rows = rows.withColumn("original", original_span(F.col("off_start"), F.col("off_end"), F.col("local.start"), F.col("local.end")))
    rows = rows.withColumn("target_text", F.when(~F.col("lost"), F.col("target_text")))
    rows = rows.withColumn("source_key", surface_key(F.col("source_text"))).withColumn("target_key", surface_key(F.col("target_text")))
    mappings = rows.select(
        "source_record_id", "source_text_unit_index", F.col("source_index").alias("source_candidate_index"), "source_text", "source_types", "target_language",
        "target_text_unit_index", "target_text", F.col("local.start").alias("target_start"), F.col("local.end").alias("target_end"),
        F.col("original.start").alias("target_original_start"), F.col("original.end").alias("target_original_end"),
        F.when(F.col("lost"), "NO_MATCH").otherwise(F.col("relation")).alias("relation"),
        form_status(F.col("source_key"), F.col("target_key"), F.col("target_form_status")).alias("target_form_status"),
        F.when(F.col("lost"), 0.0).otherwise(F.col("confidence")).alias("confidence"),
        (F.col("lost") | F.col("needs_review") | F.col("relation").isin("AMBIGUOUS", "BROADER", "NARROWER", "RELATED")).alias("needs_review"),
        F.when(F.col("lost"), "UNGROUNDED_LLM_TARGET_REJECTED").otherwise(F.col("reason_code")).alias("reason_code"),
    )
    return mappings, issues


def incoherent_mappings(mappings: DataFrame) -> DataFrame:
    """Mappings against the contract: target fields all or none, a span unless NO_MATCH or AMBIGUOUS and
    none with NO_MATCH, no text exactly where the status is NOT_PRESENT."""
    have = [F.col(c).isNotNull() for c in ("target_text", "target_start", "target_end")]
    every, some = have[0] & have[1] & have[2], have[0] | have[1] | have[2]
    wrong = (
        (some & ~every) | (~F.col("relation").isin("NO_MATCH", "AMBIGUOUS") & ~every) | ((F.col("relation") == "NO_MATCH") & some)
        | (have[0] == (F.col("target_form_status") == "NOT_PRESENT"))
    )
    return mappings.where(wrong)


def first_failure(checked: DataFrame, group: list[str], ok: str = "ok", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Group-atomic gate: rows of groups in which all are ok, and the first failure of each other group."""
    rows = checked.withColumn("all_ok", F.min(F.col(ok)).over(Window.partitionBy(*group)))
    failed = rows.where(~F.col(ok)).groupBy(*group).agg(F.min(seq).alias("first_failure"))
    return rows.where("all_ok").drop("all_ok"), failed
