"""The registry of named queries, and the inputs that they derive from the driver's tables.

Terminology inputs are derived by SQL that both engines read; ``{part}`` and the
like stand for a DataFrame in Spark and a view in DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Derived inputs, by name; an input may use others.
INPUTS = {
    "chem": """SELECT CAST(p_partkey AS STRING) AS source_record_id, 0 AS text_unit_index, 'en' AS language,
      concat(CASE p_size % 4 WHEN 0 THEN 'Compound ' WHEN 1 THEN 'Example ' WHEN 2 THEN 'intermediate ' ELSE 'PREPARATION A' END, p_partkey, ' contains NaCl at ', p_size,
        CASE p_size % 3 WHEN 0 THEN '-20' WHEN 1 THEN ' to 30.5' ELSE '.25' END, CASE p_size % 11 WHEN 0 THEN ' °C' WHEN 1 THEN ' °F' WHEN 2 THEN ' K' WHEN 3 THEN ' wt.%' WHEN 4 THEN 'mol%' WHEN 5 THEN ' ppm'
        WHEN 6 THEN ' mmol' WHEN 7 THEN 'mg' WHEN 8 THEN ' mL' WHEN 9 THEN ' MPa' ELSE ' nm' END, '; pH', CASE p_size % 2 WHEN 0 THEN ' 7.' ELSE ' of 4-6.' END, p_size % 10, '; SMILES: CCO; CAS ', 100 + p_partkey % 900, '-', 10 + p_size,
        '-', p_partkey % 10, ' (', upper(substr(p_name, 1, 3)), ') InChI=1S/H2O/h1H2 AAAAAAAAAAAAAA-BBBBBBBBBB-C by ', p_name, ' alloy coating') AS normalized
      FROM {part}""",
    "wide": """SELECT CAST(c_custkey + 2 AS INT) AS row_number, concat('customers:', c_custkey + 2) AS source_record_id,
      CASE WHEN c_custkey % 11 = 0 THEN ' ' WHEN c_custkey % 23 = 0 THEN repeat('9', 201) ELSE concat('EP-', c_custkey) END AS publication_number, concat('F', c_nationkey) AS family_id,
      CASE c_custkey % 19 WHEN 0 THEN 'ftp://e.org/x' WHEN 1 THEN 'https://e.org/x' WHEN 2 THEN 'https://' WHEN 3 THEN '' END AS source_uri,
      CASE WHEN c_custkey % 17 = 0 THEN 'en|no_language_tag| ' ELSE CASE c_custkey % 3 WHEN 0 THEN 'en|DE' WHEN 1 THEN 'en|fr' ELSE 'en' END END AS languages,
      CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_name END AS title_en, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS title_de,
      CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS abstract_zh_hans FROM {customer}""",
    "spans": """SELECT CAST(l_orderkey AS STRING) AS source_record_id, 0 AS text_unit_index, 'en' AS language,
      concat('t', l_linenumber % 3) AS text, CAST(l_linenumber % 3 AS INT) AS start, CAST(l_linenumber % 3 + 2 AS INT) AS "end",
      CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN 'CHEMICAL_ENTITY' WHEN 1 THEN 'COMPOUND' WHEN 2 THEN 'HYDRATE' ELSE 'MATERIAL' END AS kind,
      round(l_discount * 5 + 0.3, 2) AS confidence, concat('x', l_suppkey % 3) AS extractor, CAST(l_suppkey AS INT) AS seq, l_partkey % 5 = 0 AS needs_review
      FROM {lineitem}""",
    "units": """SELECT CAST(CAST(floor(c_custkey / 5) AS INT) AS STRING) AS source_record_id, CAST(c_custkey AS INT) AS text_unit_index,
      CASE c_nationkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'ja' END AS language,
      CASE WHEN c_custkey % 2 = 0 THEN 'title' ELSE 'abstract' END AS unit_type, CASE WHEN c_custkey % 2 = 0 THEN 'title' ELSE 'abstract' END AS locator,
      c_name AS text FROM {customer}""",
    "terms": """SELECT p_partkey AS id, p_partkey % 500 AS concept_id, concat(p_name, ' ', lower(p_type), ' ', p_size) AS text,
      concat(p_name, ' ', lower(p_type), ' ', p_size) AS normalized_text, CASE WHEN CAST(floor(p_partkey / 500) AS INT) % 4 = 3 THEN 'de' ELSE 'en' END AS language,
      CASE p_size % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'accepted' ELSE 'proposed' END AS status, p_size % 7 = 0 AS is_preferred FROM {part}""",
    "proposals": """SELECT concat('p', s_suppkey) AS proposal_id, CAST(s_suppkey AS BIGINT) AS k, 'en' AS language,
      concat(p_name, ' ', lower(p_type), ' ', p_size) AS normalized_term FROM {supplier} JOIN {part} ON p_partkey = s_suppkey * 17""",
    "namespaces": """SELECT * FROM (VALUES (1, 'CHEBI', 'authoritative'), (2, 'PUBCHEM_CID', 'strong'), (3, 'WIKIDATA', 'supporting')) AS v(id, code, identity_strength)""",
    "identifiers": """SELECT p_partkey % 500 AS concept_id, 1 + p_partkey % 3 AS namespace_id, CAST(p_partkey % 97 AS STRING) AS external_id FROM {part}""",
    "asked": """SELECT proposal_id, c AS code, CAST(k % 97 AS STRING) AS external_id FROM proposals, (VALUES ('CHEBI'), ('WIKIDATA')) AS v(c)""",
    "sections": """SELECT CAST(CAST(floor(c_custkey / 7) AS INT) AS STRING) AS source_record_id, CAST(c_custkey AS INT) AS text_unit_index,
      CASE c_nationkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS language, CASE c_custkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'abstract' ELSE 'claim' END AS unit_type,
      CASE c_custkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'abstract' ELSE 'claim' END AS locator, c_name AS text FROM {customer}""",
    "tagged_units": """SELECT CAST(c_custkey AS STRING) AS source_record_id, 0 AS text_unit_index,
      CASE c_nationkey % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'en-US' WHEN 2 THEN 'en-Latn-GB' WHEN 3 THEN 'de' WHEN 4 THEN 'eng' ELSE 'fr-CA' END AS language, c_name AS text FROM {customer}""",
    "target_mappings": """SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS mapping_id, CASE WHEN l_partkey % 4 <> 0 THEN 'x' END AS target_text,
      CASE WHEN l_partkey % 4 <> 0 AND l_partkey % 7 <> 0 THEN 0 END AS target_start, CASE WHEN l_partkey % 4 <> 0 THEN 1 END AS target_end,
      CASE l_suppkey % 4 WHEN 0 THEN 'NO_MATCH' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'EXACT_EQUIVALENT' ELSE 'BROADER' END AS relation,
      CASE WHEN l_partkey % 4 = 0 OR l_suppkey % 11 = 0 THEN 'NOT_PRESENT' ELSE 'TRANSLATED' END AS target_form_status FROM {lineitem}""",
    "asked_terms": """SELECT concat('p', p_partkey) AS proposal_id, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN concat(p_name, 's') ELSE p_brand END AS term,
      CASE p_retailprice > 1400 WHEN true THEN '' ELSE CASE p_size % 3 WHEN 0 THEN 'MATERIAL' WHEN 1 THEN 'MATERIAL,SALT' ELSE 'COMPOUND' END END AS types_text FROM {part}""",
    "compound_records": """SELECT CASE WHEN p_size % 2 = 0 THEN lower(p_name) ELSE lower(p_brand) END AS query_key, p_partkey AS position, CAST(p_partkey AS STRING) AS external_id,
      CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN '' ELSE p_brand END AS title, CASE WHEN p_size % 5 = 0 THEN p_name ELSE '' END AS iupac_name FROM {part}""",
    "item_records": """SELECT p_name AS label, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN '' END AS match_text, p_partkey % 13 AS position, concat('Q', p_partkey) AS external_id,
      CASE p_size % 6 WHEN 0 THEN 'chemical compound' WHEN 1 THEN 'a film album' WHEN 2 THEN 'polymer material' WHEN 3 THEN 'family name' ELSE p_type END AS description,
      CASE WHEN p_partkey % 2 = 0 THEN p_name END AS page_title, CASE WHEN p_partkey % 2 = 0 THEN concat('https://x/', p_partkey) END AS page_url FROM {part}""",
    "entry_records": """SELECT CAST(p_partkey AS STRING) AS external_id, p_size % 6 AS position, concat(p_name, '|', p_brand, '|', p_name) AS terms_text,
      concat('<b>', p_type, '</b> of <i>', p_brand, '</i>') AS definition, CASE WHEN p_partkey % 2 = 0 THEN concat('Chemical ', p_type) ELSE p_type END AS raw FROM {part}""",
    "vectors": """SELECT vec_id AS concept_id, embedding FROM {embeddings}""",
    "asked_vectors": """SELECT concat('p', vec_id) AS proposal_id, embedding AS query_embedding FROM {embeddings} WHERE vec_id % 50 = 0""",
    "refs": """SELECT concat('p', l_partkey) AS proposal_id, CASE l_linenumber % 3 WHEN 0 THEN 'IATE' WHEN 1 THEN 'WIKIDATA' ELSE 'PUBCHEM_CID' END AS namespace,
      CAST(l_suppkey % 5 AS STRING) AS external_id, round(l_tax * 10 + 0.1, 2) AS confidence, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS provider_order FROM {lineitem}""",
    "found_terms": """SELECT DISTINCT CAST(l_orderkey AS STRING) AS source_record_id, p_name AS text, p_type AS kind FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
    "reviews": """SELECT event_id AS id, user_id AS evidence_set_id, event_type AS decision, ts AS created_at FROM {events}""",
}


def _needs(sql: str) -> list[str]:
    """The derived inputs that SQL text uses, in order of definition."""
    wanted: set[str] = set()

    def look(s: str) -> None:
        for name in INPUTS:
            if name not in wanted and re.search(rf"\b(?:FROM|JOIN|,)\s*{name}\b", s):
                wanted.add(name)
                look(INPUTS[name])

    look(sql)
    return [n for n in INPUTS if n in wanted]


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame."""
    body = INPUTS[name]
    with_ = ", ".join(f"{n} AS ({INPUTS[n]})" for n in _needs(body))
    sql = (f"WITH {with_} " if with_ else "") + body
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{([a-z]+)\}", sql))}
    return spark.sql(sql.replace('"end"', "`end`"), **tables)


def query(sql: str | None):
    def add(function: Query) -> Query:
        name = function.__name__
        QUERIES[name] = function
        if sql is not None:
            recursive = "RECURSIVE " if "WITH RECURSIVE" in sql else ""
            body = sql.strip().replace("WITH RECURSIVE ", "WITH ")
            with_ = ", ".join(f"{n} AS ({INPUTS[n]})" for n in _needs(sql))
            text = f"WITH {recursive}{with_}, {body[5:]}" if with_ and body.startswith("WITH ") else f"WITH {with_} {body}" if with_ else sql.strip()
            SQL[name] = re.sub(r"\{([a-z]+)\}", r"\1", text)
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
