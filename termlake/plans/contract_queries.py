"""Named queries of contracts, decisions, authorities and vocabularies, each with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake import schemas, vocab
from termlake.functions import text as tx
from termlake.operators import enrich, extract, pairing, reconcile, resolve, store
from termlake.plans.english import ground, normalized_units, refine
from termlake.plans import inputs
from termlake.plans.inputs import derived, query, table
from termlake.sources import jsonl


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# --- refinement and mapping of grouped texts -----------------------------------------------------

_GROUPS = """both_ AS (SELECT source_record_id AS r FROM sections WHERE language = 'en' AND unit_type IN ('title', 'abstract') GROUP BY 1 HAVING count(DISTINCT unit_type) = 2),
english AS (SELECT s.*, r IS NOT NULL AND unit_type <> 'claim' AS grouped FROM sections s LEFT JOIN both_ ON r = source_record_id WHERE language = 'en'),
requested AS (SELECT *, CASE WHEN grouped THEN min(text_unit_index) OVER (PARTITION BY source_record_id, grouped) ELSE text_unit_index END AS request FROM english)"""


@query(f"""WITH {_GROUPS}, told AS (SELECT *, text_unit_index % 11 = 0 AS absent, text_unit_index % 5 = 0 AS outside FROM requested),
failed AS (SELECT source_record_id, request, grouped FROM told WHERE absent AND NOT outside GROUP BY ALL)
SELECT source_record_id, text_unit_index, text AS what, CAST(0 AS INT) AS start, CAST(length(text) AS INT) AS "end", CAST(length(text) AS INT) AS original_end FROM told t
WHERE NOT outside AND NOT EXISTS (SELECT 1 FROM failed f WHERE f.source_record_id = t.source_record_id AND f.request = t.request)
UNION ALL SELECT source_record_id, request, CASE WHEN grouped THEN 'GROUPED_REFINER_FAILED' ELSE 'REFINER_FAILED' END, NULL, NULL, NULL FROM failed
UNION ALL SELECT source_record_id, text_unit_index, 'refined', NULL, NULL, NULL FROM told t
WHERE NOT EXISTS (SELECT 1 FROM failed f WHERE f.source_record_id = t.source_record_id AND f.request = t.request)""")
def grouped_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded decisions on title and abstract as one text: refined candidates in their units, failed requests, refined units."""
    units = normalized_units(derived(spark, sf_dir, "sections"))
    request = F.min("text_unit_index").over(_by("source_record_id", "grouped"))
    kinds = F.collect_set(F.when(F.col("unit_type") != "claim", F.col("unit_type"))).over(_by("source_record_id"))
    told = units.withColumn("grouped", (F.size(kinds) == 2) & (F.col("unit_type") != "claim")).select(
        "source_record_id", F.when(F.col("grouped"), request).otherwise(F.col("text_unit_index")).alias("at"),
        F.when(F.col("text_unit_index") % 11 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("text_unit_index") % 5 == 0, "OUT_OF_SCOPE").otherwise("IN_SCOPE").alias("scope_decision"),
    )
    decisions = told.select(
        "source_record_id", F.col("at").alias("text_unit_index"), "text", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.array(F.lit("MATERIAL")).alias("types"),
        F.array().cast("array<string>").alias("roles"), F.lit("n/a").alias("proposed_definition"), "scope_decision", F.lit(0.9).alias("confidence"), F.lit("llm").alias("source"),
        F.lit(False).alias("needs_review"), F.lit("c").alias("reason_code"),
    )
    found, done, issues = refine(units, decisions)
    none = F.lit(None).cast("int")
    out = found.select("source_record_id", "text_unit_index", F.col("text").alias("what"), "start", "end", "original_end")
    out = out.unionByName(issues.select("source_record_id", "text_unit_index", F.col("code").alias("what"), none.alias("start"), none.alias("end"), none.alias("original_end")))
    return out.unionByName(done.select("source_record_id", "text_unit_index", F.lit("refined").alias("what"), none.alias("start"), none.alias("end"), none.alias("original_end")))


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


_REQUESTS = """shapes AS (SELECT DISTINCT source_record_id, unit_type FROM requested WHERE grouped),
whole AS (SELECT t.source_record_id, a.source_unit, t.language AS target_language, true AS grouped, t.text_unit_index AS unit, min(t.text_unit_index) OVER (PARTITION BY t.source_record_id, t.language) AS target_unit
  FROM sections t JOIN shapes s ON s.source_record_id = t.source_record_id AND s.unit_type = t.unit_type JOIN (SELECT source_record_id, min(request) AS source_unit FROM requested WHERE grouped GROUP BY 1) a ON a.source_record_id = t.source_record_id
  WHERE t.language <> 'en'),
single AS (SELECT a.source_record_id, a.text_unit_index AS source_unit, t.language AS target_language, false AS grouped, t.text_unit_index AS unit, t.text_unit_index AS target_unit
  FROM requested a JOIN sections t ON t.source_record_id = a.source_record_id AND t.unit_type = a.unit_type WHERE NOT a.grouped AND t.language <> 'en'),
requests AS (SELECT * FROM whole UNION ALL SELECT * FROM single),
terms_ AS (SELECT source_record_id, request AS source_unit, text_unit_index, text, row_number() OVER (PARTITION BY source_record_id, request ORDER BY text_unit_index) - 1 AS i FROM requested),
pairs AS (SELECT r.*, t.text_unit_index AS source_text_unit_index, t.text AS source_text, t.i, s.text AS own, row_number() OVER (PARTITION BY r.source_record_id, r.source_unit, r.target_unit, t.i ORDER BY r.unit DESC) AS k
  FROM requests r JOIN terms_ t ON t.source_record_id = r.source_record_id AND t.source_unit = r.source_unit JOIN sections s ON s.source_record_id = r.source_record_id AND s.text_unit_index = r.unit)"""


@query(f"""WITH {_GROUPS}, {_REQUESTS},
told AS (SELECT *, (target_unit + source_unit) % 7 = 0 AND i = 0 AS doubled, (target_unit + source_unit) % 13 = 0 AND i = 0 AS wrong, (source_text_unit_index + target_unit) % 3 = 0 AS lost FROM pairs WHERE k = 1),
bad AS (SELECT source_record_id, source_unit, target_unit, target_language, grouped, bool_or(doubled) AS d, bool_or(wrong) AS w FROM told GROUP BY ALL HAVING d OR w)
SELECT source_record_id, target_language, CAST(source_text_unit_index AS INT) AS source_unit, CAST(CASE WHEN lost THEN target_unit ELSE unit END AS INT) AS target_unit, source_text AS what, CASE WHEN lost THEN 'NO_MATCH' ELSE 'EXACT_EQUIVALENT' END AS relation,
  CASE WHEN lost THEN 'NOT_PRESENT' ELSE 'TRANSLATED' END AS status, CAST(CASE WHEN NOT lost THEN 0 END AS INT) AS target_start, CAST(CASE WHEN NOT lost THEN length(own) END AS INT) AS target_original_end
FROM told t WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.source_record_id = t.source_record_id AND b.source_unit = t.source_unit AND b.target_unit = t.target_unit)
UNION ALL SELECT source_record_id, target_language, NULL, CAST(target_unit AS INT), CASE WHEN grouped THEN 'GROUPED_' ELSE '' END || 'TARGET_MAPPING_FAILED',
  CASE WHEN d THEN 'more than one decision for a candidate' ELSE 'missing E0; unknown E99' END, NULL, NULL, NULL FROM bad""")
def grouped_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded mappings of all requests, title and abstract together: places in the target units, rejected targets, failed requests."""
    from pyspark.sql import Window

    units = normalized_units(derived(spark, sf_dir, "sections"), english=False)
    candidates = units.where("language = 'en'").select("source_record_id", "text_unit_index", "text", F.lit(0).alias("start"), F.length("text").alias("end"), F.array(F.lit("MATERIAL")).alias("types"))
    asked = pairing.mapping_requests(units)
    last = F.element_at("segments", -1)
    own = F.substr("text", last["start"] + 1, last["end"] - last["start"])
    sources = asked.select("source_record_id", "source_unit", "target_unit", own.alias("own"), F.explode("source_units").alias("unit"))
    i = F.row_number().over(Window.partitionBy("source_record_id", "source_unit", "target_unit").orderBy("unit")) - 1
    rows = sources.withColumn("i", i)
    key = F.col("target_unit") + F.col("source_unit")
    wrong = (key % 13 == 0) & (F.col("i") == 0) & (key % 7 != 0)
    times = F.when((key % 7 == 0) & (F.col("i") == 0), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    decisions = rows.withColumn("time", F.explode(times)).select(
        "source_record_id", "source_unit", "target_unit", F.concat(F.lit("E"), F.when(wrong, 99).otherwise(F.col("i"))).alias("source_id"),
        F.when((F.col("unit") + F.col("target_unit")) % 3 == 0, F.concat("own", F.lit("?"))).otherwise(F.col("own")).alias("target_text"), F.lit(None).cast("int").alias("target_start"),
        F.lit(None).cast("int").alias("target_end"), F.lit("EXACT_EQUIVALENT").alias("relation"), F.lit("TRANSLATED").alias("target_form_status"), F.lit(0.9).alias("confidence"),
        F.lit(False).alias("needs_review"), F.lit("c").alias("reason_code"),
    )
    found, issues = pairing.map_units(units, candidates, decisions)
    out = found.select(
        "source_record_id", "target_language", F.col("source_text_unit_index").alias("source_unit"), F.col("target_text_unit_index").alias("target_unit"), F.col("source_text").alias("what"), "relation",
        F.col("target_form_status").alias("status"), "target_start", "target_original_end",
    )
    none = F.lit(None).cast("int")
    return out.unionByName(
        issues.select(
            "source_record_id", "target_language", none.alias("source_unit"), F.col("text_unit_index").alias("target_unit"), F.col("code").alias("what"), F.col("message").alias("relation"),
            F.lit(None).cast("string").alias("status"), none.alias("target_start"), none.alias("target_original_end"),
        )
    )


# --- contracts and decisions -----------------------------------------------------------------------


@query("""WITH c AS (SELECT p_partkey AS k, p_name AS t, 'x ' || p_name AS n, p_size AS z FROM part)
SELECT k, 'good' AS verdict, CAST(2 AS INT) AS original_start FROM c WHERE z % 4 <> 0 AND z % 5 <> 0 AND z % 6 <> 0 AND z % 7 <> 0
UNION ALL SELECT k, 'INVALID_CANDIDATE_SPAN', NULL FROM c WHERE NOT (z % 4 <> 0 AND z % 5 <> 0 AND z % 6 <> 0 AND z % 7 <> 0)""")
def span_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that don't stand at their place, lie outside, have no type or an impossible confidence."""
    part = table(spark, sf_dir, "part")
    units = normalized_units(part.select(F.col("p_partkey").cast("string").alias("source_record_id"), F.lit(0).alias("text_unit_index"), F.lit("en-GB").alias("language"), F.concat(F.lit("x "), "p_name").alias("text")))
    z = F.col("p_size")
    rows = part.select(
        F.col("p_partkey").cast("string").alias("source_record_id"), F.lit(0).alias("text_unit_index"), F.col("p_name").alias("text"),
        F.when(z % 4 == 0, 1).otherwise(2).alias("start"), (F.length("p_name") + F.when((z % 4 == 0) | (z % 5 == 0), 1).otherwise(2) + F.when(z % 5 == 0, 900).otherwise(0)).alias("end"),
        F.when(z % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("MATERIAL"))).alias("types"), F.when(z % 7 == 0, 1.5).otherwise(0.5).alias("confidence"),
    )
    good, issues = ground(rows, units)
    out = good.select(F.col("source_record_id").cast("long").alias("k"), F.lit("good").alias("verdict"), "original_start")
    return out.unionByName(issues.select(F.col("source_record_id").cast("long").alias("k"), F.col("code").alias("verdict"), F.lit(None).cast("int").alias("original_start")))


@query("""SELECT mapping_id FROM target_mappings WHERE NOT (
  ((target_text IS NULL AND target_start IS NULL AND target_end IS NULL) OR (target_text IS NOT NULL AND target_start IS NOT NULL AND target_end IS NOT NULL))
  AND (relation IN ('NO_MATCH', 'AMBIGUOUS') OR target_start IS NOT NULL) AND (relation <> 'NO_MATCH' OR (target_text IS NULL AND target_start IS NULL AND target_end IS NULL))
  AND ((target_text IS NULL) = (target_form_status = 'NOT_PRESENT')))""")
def mapping_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings with half a target, a relation without its span, or a status that the text belies."""
    return pairing.incoherent_mappings(derived(spark, sf_dir, "target_mappings")).select("mapping_id")


@query("""SELECT CAST(o_orderkey AS BIGINT) AS set_id FROM orders LEFT JOIN (SELECT l_orderkey, bool_or(l_linenumber = 5 AND l_returnflag = 'R') AS other, bool_or(l_quantity = 7) AS absent FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
WHERE l_orderkey IS NULL OR other OR absent""")
def evidence_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence sets without terms, with a term of another family, or with a form that is not present."""
    term = F.struct(
        F.when((F.col("l_linenumber") == 5) & (F.col("l_returnflag") == "R"), "other").otherwise("f").alias("family_id"), F.when(F.col("l_quantity") == 7, "NOT_PRESENT").otherwise("TRANSLATED").alias("target_form_status")
    )
    terms = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(term).alias("terms"))
    sets = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("f").alias("family_id")).join(terms, "o_orderkey", "left")
    sets = sets.withColumn("terms", F.coalesce("terms", F.array().cast(terms.schema["terms"].dataType)))
    return schemas.evidence_errors(sets).select(F.col("o_orderkey").cast("long").alias("set_id"))


@query("""WITH w AS (SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS text, repeat(p_name, CASE WHEN p_size % 7 = 0 THEN 200 ELSE 1 END) AS normalized_text,
  CASE WHEN p_size % 3 = 0 THEN 'e' ELSE 'en' END AS language, CASE WHEN p_size % 4 = 0 THEN 'Latin' WHEN p_size % 4 = 1 THEN 'Latn' END AS script, p_size / 40.0 AS confidence FROM part),
j AS (SELECT k, list_filter([CASE WHEN confidence > 1 THEN 'confidence' END, CASE WHEN length(language) < 2 THEN 'language' END, CASE WHEN length(normalized_text) > 2000 THEN 'normalized_text' END,
  CASE WHEN length(script) <> 4 THEN 'script' END, CASE WHEN text = '' THEN 'text' END], lambda x: x IS NOT NULL) AS o FROM w)
SELECT k, array_to_string(o, ',') AS out_of_bounds FROM j WHERE len(o) > 0""")
def write_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that may not be written, with the columns that are out of bounds."""
    z = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), F.when(z % 5 == 0, "").otherwise(F.col("p_name")).alias("text"), F.expr("repeat(p_name, CASE WHEN p_size % 7 = 0 THEN 200 ELSE 1 END)").alias("normalized_text"),
        F.when(z % 3 == 0, "e").otherwise("en").alias("language"), F.when(z % 4 == 0, "Latin").when(z % 4 == 1, "Latn").alias("script"), (z / 40.0).alias("confidence"),
    )
    return schemas.refused("term", rows).select("k", F.array_join("out_of_bounds", ",").alias("out_of_bounds"))


@query("""WITH have AS (SELECT CAST(s_suppkey AS BIGINT) AS p FROM supplier WHERE s_suppkey % 4 <> 0),
d AS (SELECT CAST(s_suppkey AS BIGINT) AS p, CASE s_suppkey % 6 WHEN 0 THEN 'SAME_CONCEPT' WHEN 1 THEN 'RELATED_NOT_SAME' WHEN 2 THEN 'NEW_CONCEPT' WHEN 3 THEN 'AMBIGUOUS' WHEN 4 THEN 'SAME_CONCEPT' ELSE 'MAYBE' END AS outcome,
  CASE WHEN s_suppkey % 6 IN (0, 2) AND s_suppkey % 5 <> 0 THEN s_suppkey * 10 WHEN s_suppkey % 6 = 4 THEN -1 END AS cid, CASE WHEN s_suppkey % 6 = 1 AND s_suppkey % 5 <> 0 THEN s_suppkey * 10 + 1 END AS rid, s_suppkey % 2 = 0 OR s_suppkey % 9 = 0 AS review FROM supplier)
SELECT p, 'NEW_CONCEPT' AS outcome, 'NO_CANDIDATE' AS why FROM d WHERE p NOT IN (SELECT p FROM have)
UNION ALL SELECT p, outcome, CASE WHEN p NOT IN (SELECT p FROM have) THEN 'unknown proposal or no candidates' WHEN outcome = 'MAYBE' THEN 'unknown outcome'
  WHEN outcome = 'SAME_CONCEPT' AND cid IS NULL THEN 'the same concept needs its id' WHEN outcome = 'RELATED_NOT_SAME' AND rid IS NULL THEN 'a related concept needs its id'
  WHEN outcome = 'NEW_CONCEPT' AND cid IS NOT NULL THEN 'a new concept has no id' WHEN outcome = 'AMBIGUOUS' AND NOT review THEN 'ambiguity needs review' WHEN cid = -1 THEN 'the id is not among the candidates' ELSE 'recorded' END FROM d""")
def decision_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded resolutions that are coherent, those that are not and why, and new concepts where nothing was retrieved."""
    supplier = table(spark, sf_dir, "supplier").withColumn("p", F.col("s_suppkey").cast("long"))
    proposals = supplier.select(F.col("p").alias("proposal_id"))
    ranked = supplier.where("s_suppkey % 4 <> 0").select(F.col("p").alias("proposal_id"), F.explode(F.array(F.col("p") * 10, F.col("p") * 10 + 1)).alias("concept_id"))
    decisions = supplier.selectExpr(
        "p AS proposal_id",
        "CASE s_suppkey % 6 WHEN 0 THEN 'SAME_CONCEPT' WHEN 1 THEN 'RELATED_NOT_SAME' WHEN 2 THEN 'NEW_CONCEPT' WHEN 3 THEN 'AMBIGUOUS' WHEN 4 THEN 'SAME_CONCEPT' ELSE 'MAYBE' END AS outcome",
        "CASE WHEN s_suppkey % 6 IN (0, 2) AND s_suppkey % 5 <> 0 THEN p * 10 WHEN s_suppkey % 6 = 4 THEN -1 END AS concept_id",
        "CASE WHEN s_suppkey % 6 = 1 AND s_suppkey % 5 <> 0 THEN p * 10 + 1 END AS related_concept_id", "0.9D AS confidence", "'recorded' AS reason_code", "s_suppkey % 2 = 0 OR s_suppkey % 9 = 0 AS needs_review",
    )
    good, bad = resolve.resolve(proposals, ranked, decisions)
    out = good.select(F.col("proposal_id").alias("p"), "outcome", F.col("reason_code").alias("why"))
    return out.unionByName(bad.select(F.col("proposal_id").alias("p"), "outcome", F.col("error").alias("why")))


# --- external authorities --------------------------------------------------------------------------

def _asked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "asked_terms")
    return rows.withColumn("type_codes", F.when(F.col("types_text") == "", F.array().cast("array<string>")).otherwise(F.split("types_text", ",")))


_COMPOUND = _list(vocab.COMPOUND_TYPES)


@query(f"""WITH p AS (SELECT * FROM asked_terms WHERE types_text = '' OR len(list_intersect(string_split(types_text, ','), {_COMPOUND})) > 0),
m AS (SELECT p.proposal_id, p.term, r.*, count(*) OVER (PARTITION BY p.proposal_id) > 1 AS ambiguous, row_number() OVER (PARTITION BY p.proposal_id ORDER BY position, external_id) AS at_ FROM p JOIN compound_records r ON r.query_key = lower(p.term)),
l AS (SELECT *, coalesce(nullif(title, ''), nullif(iupac_name, ''), term) AS label FROM m WHERE at_ <= 3)
SELECT proposal_id, external_id, label, CASE WHEN lower(label) = lower(term) THEN 'EXACT' ELSE 'CLOSE' END AS mapping_type, CAST(CASE WHEN lower(label) = lower(term) AND NOT ambiguous THEN 0.96 ELSE 0.72 END AS DOUBLE) AS confidence,
  NOT (lower(label) = lower(term) AND NOT ambiguous) AS needs_review FROM l""")
def compound_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound records of terms whose types allow them, the first three of each."""
    rows = enrich.compound_references(_asked_terms(spark, sf_dir), derived(spark, sf_dir, "compound_records"))
    return rows.select("proposal_id", "external_id", "label", "mapping_type", "confidence", "needs_review")


def _score(description: str) -> str:
    count = lambda words: "(" + " + ".join(f"CAST(contains(lower(coalesce({description}, '')), '{w}') AS INT)" for w in words) + ")"
    return f"CASE WHEN {count(vocab.NON_DOMAIN_WORDS)} > 0 THEN -1 ELSE {count(vocab.CHEMISTRY_WORDS)} END"


@query(f"""WITH known AS (SELECT *, {_score("description")} AS score, coalesce(nullif(match_text, ''), label) AS other FROM item_records WHERE position < 10),
k AS (SELECT DISTINCT ON (item_key, external_id) * FROM (SELECT *, lower(form) AS item_key FROM (SELECT *, unnest([other, label]) AS form FROM known WHERE score >= 0))),
f AS (SELECT p.proposal_id, p.term, k.*, 0 AS probe FROM asked_terms p JOIN k ON k.item_key = lower(p.term)),
none AS (SELECT * FROM asked_terms WHERE lower(term) LIKE '%s' AND proposal_id NOT IN (SELECT proposal_id FROM f WHERE score > 0)),
s AS (SELECT p.proposal_id, p.term, k.*, 1 AS probe FROM none p JOIN k ON k.item_key = lower(left(p.term, -1))),
b AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY score DESC, position, probe, external_id) AS at_ FROM (SELECT * FROM f UNION ALL SELECT * FROM s))
SELECT proposal_id, 'WIKIDATA' AS namespace, external_id, label, CAST(CASE WHEN score > 0 THEN 0.92 ELSE 0.65 END AS DOUBLE) AS confidence, score <= 0 AS needs_review FROM b WHERE at_ = 1
UNION ALL SELECT proposal_id, 'WIKIPEDIA_EN', page_title, page_title, CAST(CASE WHEN score > 0 THEN 0.9 ELSE 0.62 END AS DOUBLE), score <= 0 FROM b WHERE at_ = 1 AND page_url IS NOT NULL""")
def item_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best knowledge-base item of each term by domain and position, plurals as singulars where needed, and its page."""
    rows = enrich.item_references(_asked_terms(spark, sf_dir), derived(spark, sf_dir, "item_records"))
    return rows.select("proposal_id", "namespace", "external_id", "label", "confidence", "needs_review")


_CONTEXT = " OR ".join(f"contains(lower(raw), '{w}')" for w in vocab.CHEMISTRY_WORDS)


@query(rf"""WITH e AS (SELECT *, unnest(string_split(terms_text, '|')) AS label FROM entry_records WHERE position < 5), h AS (SELECT DISTINCT ON (proposal_id, external_id) p.proposal_id, p.term, e.* FROM asked_terms p JOIN e ON lower(e.label) = lower(p.term)),
n AS (SELECT *, count(*) OVER (PARTITION BY proposal_id) > 1 AS ambiguous, row_number() OVER (PARTITION BY proposal_id ORDER BY position, external_id) AS at_, ({_CONTEXT}) AS context FROM h)
SELECT proposal_id, external_id, trim(regexp_replace(definition, '<[^>]+>', ' ', 'g')) AS description, CASE WHEN context THEN 'EXACT' ELSE 'CLOSE' END AS mapping_type,
  CAST(CASE WHEN context AND NOT ambiguous THEN 0.9 ELSE 0.68 END AS DOUBLE) AS confidence, NOT (context AND NOT ambiguous) AS needs_review FROM n WHERE at_ <= 3""")
def entry_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term-bank entries with an equal term, the first three of each term."""
    rows = enrich.entry_references(_asked_terms(spark, sf_dir), derived(spark, sf_dir, "entry_records").withColumn("terms", F.split("terms_text", r"\|")))
    return rows.select("proposal_id", "external_id", "description", "mapping_type", "confidence", "needs_review")


@query("""WITH r AS (SELECT CASE WHEN p_size % 3 = 0 THEN 'IATE' WHEN p_size % 3 = 1 THEN 'NOPE' || p_size ELSE 'OLD' END AS namespace FROM part)
SELECT array_to_string(list_sort(list(DISTINCT namespace)), ',') AS missing FROM r WHERE namespace <> 'IATE'""")
def namespace_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that references use and no active namespace has."""
    refs = table(spark, sf_dir, "part").select(F.expr("CASE WHEN p_size % 3 = 0 THEN 'IATE' WHEN p_size % 3 = 1 THEN concat('NOPE', p_size) ELSE 'OLD' END").alias("namespace"))
    names = spark.createDataFrame([("IATE", True), ("OLD", False)], "code string, active boolean")
    return store.missing_namespaces(refs, names).select(F.array_join("missing", ",").alias("missing"))


# --- texts, labels, vocabularies --------------------------------------------------------------------


@query(r"""SELECT page_id, substr(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '^[\x09-\x0D\x20\x{85}\x{A0}]+|[\x09-\x0D\x20\x{85}\x{A0}]+$', '', 'g'), 1, 5000) AS plain FROM pages""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without markup, cut to the length that references keep."""
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("plain"))


@query("SELECT page_id, url_encode(url) AS quoted FROM pages")
def quoted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls percent-coded as one path segment."""
    return table(spark, sf_dir, "pages").select("page_id", tx.path_quote(F.col("url")).alias("quoted"))


@query("""SELECT p_partkey, 'preferred term: ' || p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'aliases: ' || least(p_type, p_brand) || '; ' || greatest(p_type, p_brand) ELSE '' END || chr(10) || 'types: MATERIAL; SALT'
  || CASE WHEN p_size % 3 = 0 THEN chr(10) || 'identifiers: CAS_RN:' || p_size || '; CHEBI:1' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN chr(10) || 'definition: ' || p_type ELSE '' END AS concept_text,
  sha256('term: ' || p_name || chr(10) || 'types: SALT; MATERIAL' || CASE WHEN p_size % 5 = 0 THEN chr(10) || 'context: ' || p_type ELSE '' END) AS proposal_hash FROM part""")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of concepts and the hashes of the texts of proposals."""
    pair = F.struct(F.lit("CHEBI").alias("namespace"), F.lit("1").alias("value"))
    own = F.struct(F.lit("CAS_RN").alias("namespace"), F.col("p_size").cast("string").alias("value"))
    none = lambda kind: F.array().cast(kind)
    ids = F.when(F.col("p_size") % 3 == 0, F.array(pair, own)).otherwise(none("array<struct<namespace:string,value:string>>"))
    aliases = F.when(F.col("p_size") % 2 == 0, F.array("p_type", "p_brand")).otherwise(none("array<string>"))
    types, said = F.array(F.lit("SALT"), F.lit("MATERIAL")), F.when(F.col("p_size") % 5 == 0, F.col("p_type"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", tx.concept_document(F.col("p_name"), aliases, types, ids, said).alias("concept_text"),
        tx.content_hash(tx.proposal_document(F.col("p_name"), types, none("array<struct<namespace:string,value:string>>"), said)).alias("proposal_hash"),
    )


_LABELS = "['B-SOLVENT', 'I-REAGENT_CATALYST', 'YIELD_PERCENT', 'EXAMPLE_LABEL', 'B-chem_x', 'RAW_MATERIAL_Z', 'SUBSTANCES', 'THING', 'B-I-TIME']"


@query(f"""WITH l AS (SELECT o_orderkey AS k, {_LABELS}[1 + o_orderkey % 9] AS label FROM orders), r AS (SELECT k, regexp_replace(regexp_replace(label, '^B-', ''), '^I-', '') AS raw FROM l)
SELECT k, raw AS raw_label, CASE WHEN raw IN ({", ".join(f"'{x}'" for x in vocab.REACTION_LABEL_TYPE if vocab.REACTION_LABEL_TYPE[x] == "CHEMICAL_ENTITY")}) THEN 'CHEMICAL_ENTITY' WHEN raw IN ('TEMPERATURE', 'TIME', 'YIELD_PERCENT', 'YIELD_OTHER') THEN 'MEASUREMENT'
  WHEN raw = 'EXAMPLE_LABEL' THEN 'OTHER_TECHNICAL_CONCEPT' WHEN upper(raw) LIKE '%CHEM%' OR upper(raw) LIKE '%COMPOUND%' OR upper(raw) LIKE '%SUBSTANCE%' THEN 'CHEMICAL_ENTITY' WHEN upper(raw) LIKE '%MATERIAL%' THEN 'MATERIAL' ELSE 'OTHER_TECHNICAL_CONCEPT' END AS kind,
  CASE raw WHEN 'SOLVENT' THEN 'SOLVENT' WHEN 'REAGENT_CATALYST' THEN 'REAGENT' ELSE '' END AS roles, raw = 'REAGENT_CATALYST' AS needs_review FROM r""")
def model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and roles of model labels, prefixes stripped, unknown labels by their words."""
    label = F.expr(f"array({_LABELS[1:-1]})")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("source_record_id"), F.lit("x").alias("text"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.element_at(label, (F.col("o_orderkey") % 9 + 1).cast("int")).alias("label"), F.lit(0.5).alias("score")
    )
    found = extract.model_labels(rows, "m", vocab.REACTION_LABEL_TYPE, vocab.REACTION_LABEL_ROLE, 2, ("source_record_id",))
    return found.select(F.col("source_record_id").alias("k"), "raw_label", F.element_at("types", 1).alias("kind"), F.array_join("roles", ",").alias("roles"), "needs_review")


_EDGE_ROWS = ", ".join(f"('{c}', '{label}', {f"'{p}'" if p else 'NULL'})" for c, label, p in vocab.CONCEPT_TYPES)


inputs.INPUTS |= {
    "store_types": """SELECT CAST(p_partkey AS STRING) AS id, concat(p_brand, '-', p_partkey) AS code, p_name AS label, concat('all of ', p_type) AS description,
      CASE WHEN p_size % 4 > 0 THEN CAST(p_partkey - p_size % 4 AS STRING) END AS parent_id, p_size % 6 > 0 AS active FROM {part}""",
    "nation_types": """SELECT CAST(n_nationkey AS STRING) AS id, concat('T_', n_nationkey) AS code, n_name AS label, concat('of ', n_name) AS description,
      CASE WHEN n_nationkey % 4 > 0 THEN CAST(n_nationkey - n_nationkey % 4 AS STRING) END AS parent_id, n_nationkey % 6 > 0 AS active FROM {nation}""",
    "region_namespaces": """SELECT concat('NS_', r_regionkey) AS code, r_name AS label, concat('numbers of ', r_name) AS description, 'strong' AS identity_strength,
      r_regionkey % 5 > 0 AS active FROM {region}""",
    "store_namespaces": """SELECT concat('NS_', s_suppkey) AS code, s_name AS label, concat('numbers of ', s_name) AS description,
      CASE s_suppkey % 3 WHEN 0 THEN 'authoritative' WHEN 1 THEN 'strong' ELSE 'supporting' END AS identity_strength, s_nationkey % 5 > 0 AS active FROM {supplier}""",
}


@query("""WITH on_ AS (SELECT * FROM store_types WHERE active)
SELECT 'type' AS kind, o.code, o.label, o.description, p.code AS parent_or_strength FROM on_ o LEFT JOIN on_ p ON p.id = o.parent_id
UNION ALL SELECT 'namespace', code, label, description, identity_strength FROM store_namespaces WHERE active""")
def vocabulary_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active types of a store, with the code of an active parent, and its active namespaces."""
    types, names = resolve.vocabulary(derived(spark, sf_dir, "store_types"), derived(spark, sf_dir, "store_namespaces"))
    row = lambda df, kind, last: df.select(F.lit(kind).alias("kind"), "code", "label", "description", F.col(last).alias("parent_or_strength"))
    return row(types, "type", "parent_code").unionByName(row(names, "namespace", "identity_strength"))


@query("""WITH on_ AS (SELECT * FROM nation_types WHERE active), spaces AS (SELECT count(*) AS n FROM region_namespaces WHERE active)
SELECT o_orderkey AS proposal_id, count(*) AS candidates, min(l_linenumber) AS first_rank, (SELECT count(*) FROM on_) AS types, (SELECT n FROM spaces) AS namespaces, CAST(7 AS INT) AS rules
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def resolver_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to a resolver, read back: each has its candidates in rank order, the active vocabulary and the non-merge rules."""
    proposals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("proposal_id"), F.col("o_orderpriority").alias("term"))
    cards = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("proposal_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("concept_id"))
    asked = resolve.resolver_payloads(proposals, cards, derived(spark, sf_dir, "nation_types"), derived(spark, sf_dir, "region_namespaces"))
    inner = "struct<proposal:struct<proposal_id:bigint>,candidates:array<struct<rank:int>>,vocabulary:struct<types:array<struct<code:string>>,identifier_namespaces:array<struct<code:string>>,non_merge_rules:array<string>>>"
    read = asked.select(F.from_json("payload", inner).alias("p"))
    size = lambda c: F.size(c).cast("long")
    return read.select(
        "p.proposal.proposal_id", size("p.candidates").alias("candidates"), F.element_at("p.candidates", 1)["rank"].alias("first_rank"), size("p.vocabulary.types").alias("types"),
        size("p.vocabulary.identifier_namespaces").alias("namespaces"), F.size("p.vocabulary.non_merge_rules").alias("rules"),
    )


@query(f"""WITH RECURSIVE t(code, label, parent) AS (VALUES {_EDGE_ROWS}), up(code, top) AS (SELECT code, code FROM t WHERE parent IS NULL UNION ALL SELECT t.code, up.top FROM t JOIN up ON up.code = t.parent),
m AS (SELECT l_orderkey AS k, kind FROM (SELECT l_orderkey, CASE l_partkey % 5 WHEN 0 THEN 'HYDRATE' WHEN 1 THEN 'CHEMICAL_ENTITY' WHEN 2 THEN 'MATERIAL' WHEN 3 THEN 'MEASUREMENT' ELSE 'COMPOUND' END AS kind FROM lineitem) GROUP BY ALL),
above AS (SELECT DISTINCT a.k, b.kind FROM m a JOIN m b USING (k) WHERE (a.kind = 'HYDRATE' AND b.kind IN ('COMPOUND', 'CHEMICAL_ENTITY')) OR (a.kind = 'COMPOUND' AND b.kind = 'CHEMICAL_ENTITY'))
SELECT k, array_to_string(list_sort(list(kind) FILTER (WHERE (k, kind) NOT IN (SELECT k, kind FROM above))), ',') AS kinds,
  count(DISTINCT top) FILTER (WHERE kind NOT IN ('MEASUREMENT', 'OTHER_TECHNICAL_CONCEPT')) > 1 AS conflict FROM m JOIN up ON up.code = m.kind GROUP BY k""")
def root_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of each group without those above another, and whether they have several roots."""
    kind = F.expr("CASE l_partkey % 5 WHEN 0 THEN 'HYDRATE' WHEN 1 THEN 'CHEMICAL_ENTITY' WHEN 2 THEN 'MATERIAL' WHEN 3 THEN 'MEASUREMENT' ELSE 'COMPOUND' END")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(kind).alias("t"))
    return rows.select("k", F.array_join(reconcile.without_ancestors(F.col("t")), ",").alias("kinds"), reconcile.has_root_conflict(F.col("t")).alias("conflict"))


@query("""SELECT source_record_id, text_unit_index, text FROM tagged_units WHERE language IN ('en', 'en-US', 'en-Latn-GB')
UNION ALL SELECT source_record_id, text_unit_index, 'exactly US: ' || text FROM tagged_units WHERE language = 'en-US'""")
def english_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units in any English, and those of one canonical tag however it is written."""
    units = derived(spark, sf_dir, "tagged_units")
    exact = tx.in_language(units, " EN_us ").select("source_record_id", "text_unit_index", F.concat(F.lit("exactly US: "), "text").alias("text"))
    return units.where(tx.is_english(F.col("language"))).select("source_record_id", "text_unit_index", "text").unionByName(exact)


@query("""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN 'accepted' ELSE 'proposed' END AS status FROM customer), ok AS (SELECT id FROM c WHERE status = 'accepted'),
t AS (SELECT o_orderkey AS id, o_custkey AS cid FROM orders WHERE o_orderstatus = 'F'), tt AS (SELECT * FROM t WHERE cid IN (SELECT id FROM ok))
SELECT 'concept' AS table_name, count(*) AS n FROM ok UNION ALL SELECT 'term', count(*) FROM tt
UNION ALL SELECT 'term_evidence', count(*) FROM lineitem WHERE l_orderkey IN (SELECT id FROM tt) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey IN (SELECT id FROM ok))
UNION ALL SELECT 'concept_relation', count(*) FROM orders WHERE o_custkey IN (SELECT id FROM ok) AND o_orderkey % 1000 IN (SELECT id FROM ok)""")
def release_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the released tables: accepted concepts and what belongs to them."""
    t = lambda name: table(spark, sf_dir, name)
    accepted = F.lit("accepted").alias("status")
    concepts = t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 2 == 0, "accepted").otherwise("proposed").alias("status"))
    empty = concepts.select(F.col("id").alias("concept_id")).where("false")
    out = store.release(
        {
            "concept": concepts, "concept_type_assignment": empty, "concept_identifier": empty,
            "term": t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("concept_id"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("rejected").alias("status")),
            "evidence_set": t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("concept_id"), F.when(F.col("s_suppkey") % 3 == 0, "accepted").otherwise("rejected").alias("status")),
            "term_evidence": t("lineitem").select(F.col("l_orderkey").alias("term_id"), F.col("l_suppkey").alias("evidence_set_id")),
            "concept_relation": t("orders").select(F.col("o_custkey").alias("source_concept_id"), (F.col("o_orderkey") % 1000).alias("target_concept_id"), accepted),
        }
    )
    counts = [out[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in ("concept", "term", "term_evidence", "concept_relation")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


# --- reports and injected callables ---------------------------------------------------------------


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY source_record_id ORDER BY start, "end", extractor, text, seq, kind, confidence) - 1 AS n FROM spans)
SELECT source_record_id, CAST(n AS INT) AS place, start, "end", extractor, 'all' AS part FROM p
UNION ALL SELECT source_record_id, NULL, start, "end", kind, 'refined' FROM spans WHERE seq % 2 = 0""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction reports as JSON lines, read back: candidates in their order, refined candidates with their types."""
    rows = derived(spark, sf_dir, "spans").withColumn("types", F.array("kind")).withColumn("text", F.concat_ws("|", "start", "end", "kind"))
    lines = jsonl.extraction_lines(rows.select("source_record_id").distinct(), rows.drop("kind"), rows.where("seq % 2 = 0").drop("kind"), rows.where("false"))
    inner = "struct<extraction:struct<source_record_id:string,baseline_candidates:array<struct<start:int,`end`:int,extractor:string>>>>"
    read = lines.select(F.from_json("value", inner)["extraction"].alias("e")).select("e.source_record_id", F.posexplode("e.baseline_candidates").alias("place", "c"))
    out = read.select("source_record_id", "place", "c.start", "c.end", "c.extractor", F.lit("all").alias("part"))
    parts = F.split("text", "[|]")
    refined = jsonl.refined_terms(lines).select(
        "source_record_id", F.lit(None).cast("int").alias("place"), parts[0].cast("int").alias("start"), parts[1].cast("int").alias("end"), F.element_at("types", 1).alias("extractor"), F.lit("refined").alias("part")
    )
    return out.unionByName(refined)


@query("""SELECT p_partkey AS k, p_name || ' é Å é & ộ' AS normalized, CAST(length(p_name) + 20 AS INT) AS last_end, CAST(2 AS INT) AS e_length FROM part""")
def composed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters with combining marks and entities for them, composed; a composed letter's range is that of its parts."""
    marks = " e\u0301 A\u030a &#233;  & o\u0323\u0302 "
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", tx.normalize_source(F.concat("p_name", F.lit(marks))).alias("n"))
    at = F.length("p_name") + 1
    e = tx.original_span(F.col("n.off_start"), F.col("n.off_end"), at, at + 1)
    last = F.element_at("n.off_end", -1)
    return rows.select(F.col("p_partkey").alias("k"), F.col("n.normalized").alias("normalized"), last.alias("last_end"), (e["end"] - e["start"]).alias("e_length"))


@query("""SELECT p_partkey AS k, 'LOOKUP_FAILED' AS found, 'no answer for ' || p_name AS message FROM part WHERE left(p_name, 1) = 'b'
UNION ALL SELECT p_partkey, p_name || '/' || i, NULL FROM part, (VALUES (0), (1)) v(i) WHERE left(p_name, 1) <> 'b' AND (i = 0 OR p_size % 2 = 0)""")
def injected_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An injected provider that fails on some terms: references of the others, failures as issues."""

    def load():
        def look(term: str, types: list[str]) -> list[dict]:
            if term.startswith("b"):
                raise RuntimeError(f"no answer for {term}")
            return [{"namespace": "X", "external_id": f"{term}/{i}", "confidence": 0.5} for i in range(1 + ("EVEN" in types))]

        return look

    proposals = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("proposal_id"), F.col("p_name").alias("term"), F.array(F.when(F.col("p_size") % 2 == 0, "EVEN").otherwise("ODD")).alias("type_codes"))
    found, issues = enrich.apply_lookup(proposals, "own", load)
    out = found.select(F.col("proposal_id").alias("k"), F.col("external_id").alias("found"), F.lit(None).cast("string").alias("message"))
    return out.unionByName(issues.select(F.col("proposal_id").alias("k"), F.col("code").alias("found"), "message"))


@query("""WITH v AS (SELECT p_partkey AS k, CAST(length(p_name) AS DOUBLE) AS a, CAST(length(p_type) AS DOUBLE) AS b FROM part)
SELECT k, round(a / sqrt(a * a + b * b + 1), 4) AS x, round(1 / sqrt(a * a + b * b + 1), 4) AS z FROM v""")
def injected_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of unit length by an injected model."""

    def load():
        return lambda texts: [[len(t.split("|")[0]), len(t.split("|")[1]), 1.0] for t in texts]

    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_name", "p_type").alias("text"))
    made = resolve.embed(rows, load, 3)
    part = lambda i: F.round(F.element_at("embedding", i).cast("double"), 4)
    return made.select(F.col("p_partkey").alias("k"), part(1).alias("x"), part(3).alias("z"))


@query("""WITH w AS (SELECT CAST(p_partkey AS VARCHAR) AS r, p_name AS t, length(string_split(p_name, ' ')[1]) AS n FROM part)
SELECT r, left(t, n) AS what, 'CHEMICAL_ENTITY' AS kind, CAST(0.5 AS DOUBLE) AS confidence FROM w WHERE n % 3 <> 0 UNION ALL SELECT r, left(t, n), 'CHEMICAL_ENTITY', 0.9 FROM w WHERE n % 3 <> 0
UNION ALL SELECT r, 'EXTRACTOR_FAILED', CASE WHEN n % 2 = 0 THEN 'too long' ELSE 'span [0, 9999) is not in the text' END, NULL FROM w WHERE n % 3 = 0""")
def injected_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An injected model that fails, or gives impossible spans, on some texts: candidates under two adapters, failures as issues."""

    def load():
        def model(text: str) -> list[dict]:
            n = len(text.split(" ")[0])
            if n % 3 == 0 and n % 2 == 0:
                raise RuntimeError("too long")
            return [{"start": 0, "end": 9999 if n % 3 == 0 else n, "entity": "B-SOLVENT", "score": 0.5}]

        return model

    units = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source_record_id"), F.lit(0).alias("text_unit_index"), F.lit("en").alias("language"), F.col("p_name").alias("normalized"))
    found, issues = extract.apply_model(units, load)
    labelled = extract.model_labels(found, "m", vocab.REACTION_LABEL_TYPE, vocab.REACTION_LABEL_ROLE, 2)
    mentions = found.drop("score").withColumn("score", F.lit(None).cast("double")).join(units, list(extract.KEYS))
    both = labelled.unionByName(extract.mention_candidates(mentions, "cde", 4))
    out = both.select(F.col("source_record_id").alias("r"), F.col("text").alias("what"), F.element_at("types", 1).alias("kind"), "confidence")
    return out.unionByName(issues.select(F.col("source_record_id").alias("r"), F.col("code").alias("what"), F.col("message").alias("kind"), F.lit(None).cast("double").alias("confidence")))
