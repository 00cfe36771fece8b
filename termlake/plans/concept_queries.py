"""Named queries of alignment, pairing, clustering and curation of concepts; SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake import schemas
from termlake.operators import align, boilerplate, boundaries, changes, cluster, enrich, evaluate, lineage, matching, resolve, vector_index
from termlake.plans import commands, inputs
from termlake.plans.inputs import derived, query, table
from termlake.sources import csv_units, vocabulary_export
from termlake.staging import Rounds

inputs.INPUTS |= {
    "merges": """SELECT o_orderkey AS concept, CASE WHEN o_orderkey % 97 = 5 THEN o_orderkey + 1 WHEN o_orderkey % 97 = 6 THEN o_orderkey - 1
      ELSE o_orderkey - 1 - o_custkey % 3 END AS successor, CAST(o_custkey AS BIGINT) AS seq FROM {orders} WHERE o_orderkey % 97 IN (5, 6) OR o_orderkey % 50 > 2""",
    "line_terms": """SELECT DISTINCT concat(l_orderkey, '-', l_linenumber) AS term, l_orderkey AS concept FROM {lineitem}""",
    "splits": """SELECT l_orderkey - CASE l_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 7 END AS concept, concat(l_orderkey, '-', l_linenumber) AS term,
      min(l_orderkey - 20 - l_partkey % 4) AS successor, CAST(1 AS BIGINT) AS seq FROM {lineitem} WHERE l_linenumber % 3 = 0 AND l_orderkey % 9 = 4 GROUP BY 1, 2""",
    "publications": """SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS english, CASE WHEN o_orderkey % 7 < 4 THEN concat(o_custkey, o_orderstatus, o_orderpriority) END AS publication,
      CASE WHEN o_orderkey % 7 > 1 THEN concat(o_custkey, o_orderstatus) END AS application, CAST(o_custkey AS STRING) AS family_priority,
      concat(CAST(o_orderdate AS STRING), o_orderstatus) AS applicant_date FROM {orders}""",
    "line_spans": """SELECT l_orderkey AS unit, l_partkey % 40 AS start, l_partkey % 40 + CAST(l_quantity AS BIGINT) % 15 AS "end" FROM {lineitem}""",
    "term_mentions": """SELECT CAST(l_orderkey AS STRING) AS source_record_id, CAST(l_suppkey % 7 AS STRING) AS family_id, l_returnflag = 'R' AS domain,
      CASE l_linenumber % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(lower(p_type), ' ', p_name) ELSE substr(p_name, instr(p_name, ' ') + 1) END AS text, p_brand AS near, l_linestatus AS far
      FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
    "review_items": """SELECT o_orderkey AS item, o_custkey AS group_id, CAST(o_orderkey * 37 % 101 AS DOUBLE) / 101 AS uncertainty,
      CAST(o_orderkey * 53 % 211 AS DOUBLE) / 211 AS impact, CAST(o_orderkey * 71 % 307 AS DOUBLE) / 307 AS novelty FROM {orders}""",
    "part_clusters": """SELECT p_partkey AS item, CASE WHEN p_size % 9 > 0 THEN p_brand END AS gold, CASE WHEN p_size % 7 > 0 THEN concat(p_brand, p_size % 3) END AS found FROM {part}""",
}


@query(None)
def passage_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and sentences of every document aligned with a version that lacks some lines, has others and joins some."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.lit("text").alias("section"), align.paragraphs(F.col("text")).alias("left_units"))
    changed = F.flatten(
        F.transform("left_units", lambda x, i: F.when(i % 7 == 3, F.array().cast("array<string>")).when(i % 5 == 1, F.array(x, F.lit("Added line 17."))).otherwise(F.array(x)))
    )
    return align.align_sections(docs.withColumn("right_units", changed), ["doc_id", "section"])


@query("""WITH s AS (SELECT unit, start, "end", count(*) AS n_spans FROM line_spans WHERE "end" > start GROUP BY ALL),
p AS (SELECT a.unit, a.start, a."end", b.start AS s2, b."end" AS e2, b."end" >= a."end" AS inside FROM s a JOIN s b ON a.unit = b.unit AND b.start < a."end" AND a.start < b."end"
  AND (b.start < a.start OR (b.start = a.start AND b."end" > a."end"))),
own AS (SELECT unit, start, "end", count(*) FILTER (inside) AS around, count(*) FILTER (NOT inside) AS crossing FROM p GROUP BY ALL),
other AS (SELECT unit, s2, e2, count(*) FILTER (inside) AS inside, count(*) FILTER (NOT inside) AS crossing FROM p GROUP BY ALL)
SELECT s.unit, s.start, s."end", CAST(n_spans AS BIGINT) AS n_spans, CAST(coalesce(inside, 0) AS BIGINT) AS n_inside, CAST(coalesce(around, 0) AS BIGINT) AS n_around,
  CAST(coalesce(own.crossing, 0) + coalesce(other.crossing, 0) AS BIGINT) AS n_crossing
FROM s LEFT JOIN own ON own.unit = s.unit AND own.start = s.start AND own."end" = s."end" LEFT JOIN other ON other.unit = s.unit AND s2 = s.start AND e2 = s."end\"""")
def boundary_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every different span of a unit: how many equal ones, spans inside it, around it and across it."""
    return boundaries.boundary_report(derived(spark, sf_dir, "line_spans"), ["unit"])


@query(f"""WITH l AS (SELECT unnest(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS passage FROM documents)
SELECT passage, count(*) AS n FROM l GROUP BY 1 HAVING count(*) >= {boilerplate.SHARE} * (SELECT count(*) FROM l)""")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that make up at least a thousandth of all lines of all documents."""
    docs = table(spark, sf_dir, "documents")
    return boilerplate.heavy_hitters(docs.select(F.explode(boilerplate.lines(F.col("text"))).alias("passage")))


@query(None)
def concept_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts clustered by links between neighbouring lines of an order; lines two apart with another brand forbid a cluster."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    following = rows.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("b"), F.col("p_brand").alias("b_brand"))
    near = lambda k: rows.join(following.withColumn("l_linenumber", F.col("l_linenumber") - k), ["l_orderkey", "l_linenumber"])
    links = near(1).select(F.col("l_partkey").alias("a"), "b", F.round(1 - F.col("l_discount"), 2).alias("score"))
    forbidden = near(2).where("p_brand <> b_brand").select(F.col("l_partkey").alias("a"), "b")
    return cluster.pivot_clusters(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), links, forbidden)


@query("""WITH RECURSIVE e AS (SELECT concept, successor FROM merges),
walk(concept, place, steps) AS (SELECT concept, successor, 1 FROM e UNION ALL SELECT w.concept, e.successor, steps + 1 FROM walk w JOIN e ON e.concept = w.place WHERE steps < 120),
ends AS (SELECT concept, place AS current, CAST(steps AS BIGINT) AS steps FROM walk w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.concept = w.place)),
rings AS (SELECT DISTINCT concept FROM walk WHERE place = concept)
SELECT e.concept, current, steps, rings.concept IS NOT NULL AS on_cycle FROM e LEFT JOIN ends ON ends.concept = e.concept LEFT JOIN rings ON rings.concept = e.concept""")
def superseded_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every merged concept is now, after how many edits; concepts on cycles are told."""
    return lineage.supersession(derived(spark, sf_dir, "merges"))


@query("""WITH RECURSIVE walk(term, concept, place, moves, steps) AS (
  SELECT term, concept, concept, 0, 0 FROM line_terms
  UNION ALL SELECT w.term, w.concept, coalesce(s.successor, m.successor), moves + CASE WHEN s.successor IS NOT NULL THEN 1 ELSE 0 END, steps + 1
  FROM walk w LEFT JOIN splits s ON s.concept = w.place AND s.term = w.term LEFT JOIN merges m ON m.concept = w.place
  WHERE coalesce(s.successor, m.successor) IS NOT NULL AND steps < 150)
SELECT term, concept, CASE WHEN last.steps < 150 THEN place END AS current, CASE WHEN last.steps < 150 THEN moves END AS moves
FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY steps DESC) AS r FROM walk) AS last WHERE r = 1""")
def current_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every term belongs after all merges and splits (null where it runs in a circle)."""
    return lineage.current_terms(derived(spark, sf_dir, "line_terms"), derived(spark, sf_dir, "merges"), derived(spark, sf_dir, "splits"))


def _tiers_sql() -> str:
    parts, out = [], []
    for k, (tier, confidence, label) in enumerate(matching.TIERS):
        free = " AND ".join(["true"] + [f"id NOT IN (SELECT {{side}} FROM m{j})" for j in range(k)])
        side = lambda english, name: f"SELECT id AS {name}, {tier} AS key, row_number() OVER (PARTITION BY {tier} ORDER BY id) AS place FROM publications WHERE {english} AND {tier} IS NOT NULL AND {free.format(side=name)}"  # noqa: B023, E731
        parts.append(f"m{k} AS (SELECT left_id, right_id, '{tier}' AS reason, CAST({confidence} AS DOUBLE) AS confidence, '{label}' AS label FROM ({side('english', 'left_id')}) a JOIN ({side('NOT english', 'right_id')}) b USING (key, place))")
        out.append(f"SELECT * FROM m{k}")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)}"


@query(_tiers_sql())
def publication_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English publications paired with others by the strongest evidence that both have, one to one."""
    rows = derived(spark, sf_dir, "publications")
    return matching.pair_publications(rows.where("english"), rows.where("not english"))


@query("""WITH p AS (SELECT a.gold = b.gold AS g, a.found = b.found AS f FROM part_clusters a JOIN part_clusters b ON a.item < b.item AND (a.gold = b.gold OR a.found = b.found)),
c AS (SELECT count(*) FILTER (g AND f) AS tp, count(*) FILTER (f) AS found_pairs, count(*) FILTER (g) AS gold_pairs FROM p)
SELECT tp, found_pairs, gold_pairs, round(tp / found_pairs, 6) AS precision, round(tp / gold_pairs, 6) AS recall, round(2 * tp / (found_pairs + gold_pairs), 6) AS f1 FROM c""")
def cluster_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise precision, recall and F1 of one clustering of all parts against another."""
    told = evaluate.pairwise_f1(derived(spark, sf_dir, "part_clusters"))
    return told.select("tp", "found_pairs", "gold_pairs", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'added' ELSE 'changed' END AS status FROM documents WHERE doc_id % 13 = 0 OR doc_id % 17 = 0
UNION ALL SELECT -1 - doc_id, 'gone' FROM documents WHERE doc_id % 19 = 0""")
def changed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were added, changed or dropped since an older snapshot, from the buckets whose checksums differ."""
    new = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    old = new.where("doc_id % 13 <> 0").withColumn("lang", F.when(F.col("doc_id") % 17 == 0, F.concat("lang", F.lit("-x"))).otherwise(F.col("lang")))
    old = old.unionByName(new.where("doc_id % 19 = 0").withColumn("doc_id", -1 - F.col("doc_id")))
    rounds = Rounds(spark, "snapshots")
    changes.write_snapshot(old, ["doc_id"], f"{rounds.base}/old", 16)
    changes.write_snapshot(new, ["doc_id"], f"{rounds.base}/new", 16)
    return changes.changed_rows(spark, f"{rounds.base}/old", f"{rounds.base}/new", ["doc_id"])


@query("SELECT vec_id % 50 = 0 AS asked, true AS enough FROM embeddings WHERE vec_id % 50 = 0 LIMIT 1")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the partitioned index finds at least nine tenths of the exact sixteen nearest vectors of the asked ones (ids divisible by 50)."""
    stored, asked = derived(spark, sf_dir, "vectors"), derived(spark, sf_dir, "asked_vectors")
    index = vector_index.build(stored)
    found = vector_index.search(index, asked, 16, index.probes(0.97))
    return vector_index.recall(found, resolve.vector_signal(asked, stored)).select((F.col("asked") > 0).alias("asked"), (F.col("recall") >= 0.9).alias("enough"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY concept_id, language ORDER BY is_preferred DESC, text) AS r FROM terms)
SELECT CAST(concept_id AS VARCHAR) AS concept_id, CASE WHEN is_preferred AND r = 1 THEN 'prefLabel' ELSE 'altLabel' END AS kind, language, text AS value FROM l
UNION ALL SELECT CAST(o_custkey AS VARCHAR), CASE WHEN o_orderstatus = 'F' THEN 'narrower' ELSE 'related' END, NULL, CAST(o_orderkey AS VARCHAR) FROM orders""")
def vocabulary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and relations of a terminology exported as N-Triples by the data source, read back."""
    t = lambda name: table(spark, sf_dir, name)
    terms = derived(spark, sf_dir, "terms")
    relations = t("orders").select(
        F.col("o_custkey").alias("source_concept_id"), F.when(F.col("o_orderstatus") == "F", "BROADER_THAN").otherwise("SALT_OF").alias("relation_type"), F.col("o_orderkey").alias("target_concept_id")
    )
    identifiers = t("supplier").select(F.col("s_suppkey").alias("concept_id"), F.concat(F.lit("https://example.org/"), "s_suppkey").alias("uri"), F.lit("exact").alias("mapping_type"))
    concepts = terms.select(F.col("concept_id").alias("id")).unionByName(relations.select(F.col("source_concept_id").alias("id")))
    path = f"{Rounds(spark, 'export').base}/skos"
    vocabulary_export.export(vocabulary_export.concept_rows(concepts, terms, relations, identifiers), path)
    labels, links = vocabulary_export.read_skos(spark, path)
    return labels.select("concept_id", "kind", "language", F.col("text").alias("value")).unionByName(links.select("concept_id", "kind", F.lit(None).cast("string").alias("language"), F.col("target").alias("value")))


@query("""WITH s AS (SELECT text, count(*) AS freq, count(DISTINCT source_record_id) AS records, count(DISTINCT family_id) AS families, len(string_split(text, ' ')) AS words FROM term_mentions GROUP BY 1),
o AS (SELECT a.text, sum(b.freq) / count(*) AS nested FROM s a JOIN s b ON a.text <> b.text AND contains(' ' || b.text || ' ', ' ' || a.text || ' ') GROUP BY 1),
c AS (SELECT s.*, log2(words + 1) * (freq - coalesce(nested, 0)) AS c_value FROM s LEFT JOIN o USING (text)),
t AS (SELECT text FROM c ORDER BY round(c_value, 9) DESC, text LIMIT 40),
b AS (SELECT text, word, count(*) AS times FROM (SELECT text, near AS word FROM term_mentions UNION ALL SELECT text, far FROM term_mentions) GROUP BY 1, 2),
w AS (SELECT word, count(*) / (SELECT count(*) FROM t) AS weight FROM b JOIN t USING (text) GROUP BY 1),
g AS (SELECT text, sum(times * weight) AS gained FROM b JOIN w USING (word) GROUP BY 1),
f AS (SELECT text, count(*) FILTER (domain) AS a, count(*) FILTER (NOT domain) AS b FROM term_mentions GROUP BY 1),
n AS (SELECT sum(a) AS c, sum(b) AS d FROM f),
l AS (SELECT text, (CASE WHEN a * d >= b * c THEN 2 ELSE -2 END) * (CASE WHEN a > 0 THEN a * ln(a * (c + d) / (c * (a + b))) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b * (c + d) / (d * (a + b))) ELSE 0 END) AS ll FROM f, n)
SELECT text, CAST(words AS INT) AS words, freq, records, families, round(c_value, 6) AS c_value, round(0.8 * c_value + 0.2 * coalesce(gained, 0), 6) AS nc_value, round(ll, 6) AS log_likelihood
FROM c LEFT JOIN g USING (text) JOIN l USING (text)""")
def domain_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency, recurrence over families, C-value, NC-value and log-likelihood against general mentions of every term."""
    rows = derived(spark, sf_dir, "term_mentions").withColumn("context", F.array("near", "far"))
    known = evaluate.nc_value(rows, 40)
    surely = evaluate.log_likelihood(rows.where("domain"), rows.where("not domain"))
    value = lambda c: F.round(c, 6).alias(c)
    return known.join(surely, "text").select("text", "words", "freq", "records", "families", value("c_value"), value("nc_value"), value("log_likelihood"))


@query("""WITH t AS (SELECT *, CAST(0.5 AS DOUBLE) * uncertainty + CAST(0.3 AS DOUBLE) * impact + CAST(0.2 AS DOUBLE) * novelty AS total FROM review_items),
p AS (SELECT *, total - CAST(0.05 AS DOUBLE) * (row_number() OVER (PARTITION BY group_id ORDER BY total DESC, item) - 1) AS priority FROM t)
SELECT CAST(row_number() OVER (ORDER BY priority DESC, item) AS INT) AS rank, item, group_id, round(priority, 6) AS priority FROM p ORDER BY priority DESC, item LIMIT 25""")
def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 items to review first (the feature is a top list), from the heads of three sorted lists."""
    items = derived(spark, sf_dir, "review_items").withColumnRenamed("group_id", "group")
    queue = evaluate.review_queue(items, 25, {"uncertainty": 0.5, "impact": 0.3, "novelty": 0.2}, 0.05)
    return queue.select("rank", "item", F.col("group").alias("group_id"), F.round("priority", 6).alias("priority"))


@query("""SELECT concat('EP-', c_custkey) AS publication_number, concat('F', c_nationkey) AS family_id, 'en' AS language, concat(c_name, ', "', c_mktsegment, '"', chr(10), 'x') AS text, true AS numbered FROM customer
UNION ALL SELECT concat('EP-', c_custkey), concat('F', c_nationkey), 'de-DE', c_mktsegment, true FROM customer WHERE c_custkey % 3 > 0""")
def csv_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as a folder of CSV files with quoted commas and line breaks, and read back as text units numbered from 2 in each file."""
    title = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"\nx'))
    rows = table(spark, sf_dir, "customer").repartition(5, "c_custkey").select(
        F.concat(F.lit("EP-"), "c_custkey").alias("publication_number"), F.concat(F.lit("F"), "c_nationkey").alias("family_id"),
        title.alias("title_en"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("title_de_de"), F.lit("z").alias("title_not_a_tag"),
    )
    path = f"{Rounds(spark, 'csv').base}/titles"
    rows.write.option("header", True).option("escape", '"').csv(path)
    units, _, _ = csv_units.read_units(spark, path)
    numbers = csv_units.documents(spark, path).select(F.split_part("source_record_id", F.lit(":"), F.lit(1)).alias("file"), F.split_part("source_record_id", F.lit(":"), F.lit(2)).cast("long").alias("k"))
    whole = numbers.groupBy("file").agg(((F.min("k") == 2) & (F.max("k") == F.count("*") + 1) & (F.countDistinct("k") == F.count("*"))).alias("numbered"))
    named = units.withColumn("file", F.split_part("source_record_id", F.lit(":"), F.lit(1))).join(whole, "file")
    return named.select("publication_number", "family_id", "language", "text", "numbered")


@query("""WITH t AS (SELECT text, kind, list_sort(list(DISTINCT source_record_id)) AS docs FROM found_terms GROUP BY 1, 2),
r AS (SELECT p_name AS term, max(p_retailprice) AS best, count(*) AS n FROM part GROUP BY 1)
SELECT t.text AS term, kind, len(docs) AS documents, docs[1] AS first_document, coalesce(n, 0) AS n_references FROM t LEFT JOIN r ON term = t.text""")
def enrichment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched terms as JSON lines, read back: types, references in order and source documents sorted by id."""
    found = derived(spark, sf_dir, "found_terms")
    terms = enrich.distinct_terms(found.select("source_record_id", "text", F.array("kind").alias("types")))
    docs = found.select("source_record_id", F.lit("P").alias("publication_number"), F.lit("F").alias("family_id")).distinct()
    named = enrich.with_documents(terms, docs).withColumn("proposal_id", F.concat_ws("|", "text", F.element_at("types", 1)))
    none = F.lit(None).cast("string")
    refs = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("text"), F.lit("IATE").alias("namespace"), F.col("p_partkey").cast("string").alias("external_id"), none.alias("label"), none.alias("canonical_url"), none.alias("description"),
        F.lit("EXACT").alias("mapping_type"), F.lit(0.9).alias("confidence"), F.lit(False).alias("needs_review"),
    )
    lines = commands.enrichment_lines(named, named.select("proposal_id", "text").join(refs, "text").drop("text"))
    inner = "struct<term:string,type_codes:array<string>,references:array<struct<external_id:string>>,source_documents:array<struct<source_record_id:string>>>"
    r = lines.select(F.from_json("value", inner).alias("r")).select("r.*")
    return r.select("term", F.element_at("type_codes", 1).alias("kind"), F.size("source_documents").cast("long").alias("documents"), F.element_at("source_documents", 1)["source_record_id"].alias("first_document"), F.size("references").cast("long").alias("n_references"))


@query("""WITH gone AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 7 = 0), terms_gone AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM gone)),
sets_gone AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey * 3 IN (SELECT id FROM gone))
SELECT 'concept' AS table_name, 'left' AS what, count(*) AS n FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT 'term', 'left', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT id FROM terms_gone)
UNION ALL SELECT 'evidence_set', 'left', count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT id FROM sets_gone)
UNION ALL SELECT 'term_evidence', 'left', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM terms_gone) AND l_suppkey NOT IN (SELECT id FROM sets_gone)
UNION ALL SELECT 'concept', 'superseded_by_id', count(*) FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 10 = 1 AND (c_custkey + 1) % 7 = 0""")
def cascading_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left after concepts are deleted with all that hangs on them, and references that forbid the deletion."""
    t = lambda name: table(spark, sf_dir, name)
    concepts = t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 1, F.col("c_custkey") + 1).alias("superseded_by_id"))
    tables = {
        "concept": concepts,
        "term": t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("concept_id")),
        "evidence_set": t("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 3).alias("concept_id")),
        "term_evidence": t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("term_id"), F.col("l_suppkey").alias("evidence_set_id")),
    }
    left, blocked = schemas.delete(tables, "concept", concepts.where("id % 7 = 0").select("id"))
    out = blocked.select("table_name", F.col("column").alias("what"), "n")
    for name in tables:
        out = out.unionByName(left[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit("left").alias("what"), "n"))
    return out
