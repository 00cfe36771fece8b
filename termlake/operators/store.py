"""Upserts, seeding, release and queries of the terminology store.

Parquet tables have no in-place merge: an upsert is a function of the old rows
and the new ones, and a table is replaced by writing it anew and then swapping
its folder.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termlake import vocab
from termlake.functions.text import content_hash


def stable_id(*parts) -> F.Column:
    """The id of a row by its natural key, the same in each run."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """existing with rows of equal keys replaced by those of updates."""
    return existing.join(updates.select(*keys), keys, "left_anti").unionByName(updates)


def missing_namespaces(references: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Sorted codes that references use and no active namespace has."""
    active = namespaces.where("active").select(F.col("code").alias("namespace"))
    return references.select("namespace").distinct().join(active, "namespace", "left_anti").agg(F.sort_array(F.collect_set("namespace")).alias("missing"))


def upsert_identifiers(identifiers: DataFrame, references: DataFrame, namespaces: DataFrame, include_review: bool = False) -> DataFrame:
    """identifiers (concept_id, namespace, external_id, mapping_type, confidence, source_uri) with the references put in."""
    lost = missing_namespaces(references, namespaces).first().missing
    if lost:
        raise ValueError("unknown or inactive namespaces: " + ", ".join(lost))
    rows = references if include_review else references.where("not needs_review")
    new = rows.select("concept_id", "namespace", "external_id", "mapping_type", F.col("confidence").cast("decimal(5,4)").alias("confidence"), F.col("canonical_url").alias("source_uri"))
    order = Window.partitionBy("concept_id", "namespace", "external_id").orderBy(F.desc("confidence"), "mapping_type", "source_uri")
    new = new.withColumn("at", F.row_number().over(order)).where("at = 1").drop("at")
    return upsert(identifiers, new, ["concept_id", "namespace", "external_id"])


def changed_documents(embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    """The documents (concept_id, model_name, model_version, text) whose hash is not that of the stored embedding."""
    keys = ["concept_id", "model_name", "model_version"]
    old = embeddings.select(*keys, F.col("content_hash").alias("old_hash"))
    hashed = documents.withColumn("content_hash", content_hash(F.col("text")))
    return hashed.join(old, keys, "left").where(~F.col("content_hash").eqNullSafe(F.col("old_hash"))).drop("old_hash")


def upsert_embeddings(embeddings: DataFrame, embedded: DataFrame, dimensions: int) -> DataFrame:
    """embeddings with those of changed documents (with column embedding) put in; other vector lengths are an error."""
    wrong = F.raise_error(F.concat(F.lit("a vector has length "), F.size("embedding")))
    checked = embedded.withColumn("embedding", F.when(F.size("embedding") == dimensions, F.col("embedding")).otherwise(wrong.cast("array<float>")))
    keys = ["concept_id", "model_name", "model_version"]
    return upsert(embeddings, checked.select(*keys, "content_hash", "embedding"), keys)


#: Columns that a new seeding overwrites in rows that are there: those of types only; other tables keep what curators wrote.
REFRESHED: dict[str, tuple[str, ...]] = {"concept_type": ("label", "description")}


def seed(spark: SparkSession) -> dict[str, DataFrame]:
    """code, label and the further columns of the four vocabulary tables."""
    types = [(code, label, vocab.TYPE_DESCRIPTIONS[code], parent) for code, label, parent in vocab.CONCEPT_TYPES]
    names = [(code, label, vocab.NAMESPACE_DESCRIPTIONS[code], strength) for code, label, strength in vocab.IDENTIFIER_NAMESPACES]
    return {
        "concept_type": spark.createDataFrame(types, "code string, label string, description string, parent_code string"),
        "term_form": spark.createDataFrame(vocab.TERM_FORMS, "code string, label string"),
        "relation_type": spark.createDataFrame(vocab.RELATION_TYPES, "code string, label string, symmetric boolean"),
        "identifier_namespace": spark.createDataFrame(names, "code string, label string, description string, identity_strength string"),
    }


def seed_tables(existing: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The vocabulary tables with missing codes added, and labels and descriptions of known types refreshed."""
    return {name: seed_into(table, seed(table.sparkSession)[name].select(*table.columns), REFRESHED.get(name, ())) for name, table in existing.items()}


def seed_into(existing: DataFrame, seeds: DataFrame, refresh: tuple[str, ...] = ()) -> DataFrame:
    """existing with missing codes added; the columns in refresh take the seed's values (labels of types)."""
    new = seeds.join(existing.select("code"), "code", "left_anti")
    if refresh:
        named = seeds.select("code", *[F.col(c).alias(f"new_{c}") for c in refresh])
        existing = existing.join(named, "code", "left")
        for c in refresh:
            existing = existing.withColumn(c, F.coalesce(f"new_{c}", c)).drop(f"new_{c}")
    return existing.unionByName(new)


#: Terms in a block of a concept and language, and copies of one term that go to a block together.
BLOCK, PIECE = 256, 32


def translations(terms: DataFrame) -> DataFrame:
    """Pairs of terms of one concept in different languages; repeated terms are paired as often as they come.

    The pairs are far larger than the terms, so tasks dealt by bytes of terms would be
    few and long.  The terms of a concept and language are therefore dealt to blocks of
    about BLOCK, and pairs of blocks to all tasks: none makes a whole concept.  A source
    term meets a block of targets as one row, so terms move once for BLOCK pairs.
    """
    parts = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal terms are counted and dealt in pieces, so a row's block depends on nothing but its values
    counted = terms.where("concept_id is not null and language is not null").groupBy("concept_id", "language", "text").agg(F.count("*").alias("n"))
    sizes = counted.groupBy("concept_id", "language").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("n_blocks"))
    pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / PIECE).cast("int"))))
    copies = F.array_repeat("text", F.least(F.lit(PIECE), F.col("n") - F.col("piece") * PIECE).cast("int"))
    block = F.pmod(F.xxhash64("text", "piece"), F.col("n_blocks")).cast("int")
    placed = pieces.join(sizes, ["concept_id", "language"]).select("concept_id", "language", block.alias("block"), copies.alias("texts"))
    name = lambda df, side: df.withColumnsRenamed({c: f"{side}_{c}" for c in df.columns if c != "concept_id"})
    asked = name(sizes, "source").join(name(sizes, "target"), "concept_id").where("source_language <> target_language")
    keys = ["concept_id", "source_language", "source_block", "target_language", "target_block"]

    def dealt(rows: DataFrame, side: str, other: str) -> DataFrame:
        """The rows of one side, once for each block of the other side."""
        met = name(rows, side).join(asked.drop(f"{side}_n_blocks"), ["concept_id", f"{side}_language"])
        met = met.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(f"{other}_n_blocks") - 1))).drop(f"{other}_n_blocks")
        return met.repartition(parts, *keys)  # by number: tasks of few bytes stay apart

    sources = dealt(placed.select("concept_id", "language", "block", F.explode("texts").alias("text")), "source", "target")
    targets = dealt(placed.groupBy("concept_id", "language", "block").agg(F.flatten(F.collect_list("texts")).alias("texts")), "target", "source")
    return sources.join(targets, keys).select("concept_id", "source_language", "source_text", "target_language", F.explode("target_texts").alias("target_text"))


def provenance(concepts: DataFrame, terms: DataFrame, evidence: DataFrame, sets: DataFrame) -> DataFrame:
    """concept, term, evidence and evidence set, one row a piece of evidence."""
    out = concepts.select(F.col("id").alias("concept_id")).join(terms.select("concept_id", F.col("id").alias("term_id"), "text"), "concept_id")
    out = out.join(evidence.select("term_id", "evidence_set_id", "publication_number", "locator"), "term_id")
    return out.join(sets.select(F.col("id").alias("evidence_set_id"), "family_id", "method"), "evidence_set_id")


def latest_reviews(decisions: DataFrame) -> DataFrame:
    """The last decision of each evidence set."""
    order = Window.partitionBy("evidence_set_id").orderBy(F.desc("created_at"), F.desc("id"))
    return decisions.withColumn("at", F.row_number().over(order)).where("at = 1").drop("at")


def release(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Accepted concepts and what belongs to them."""
    accepted = tables["concept"].where("status = 'accepted'")
    ids = accepted.select(F.col("id").alias("concept_id"))
    of = lambda df, c="concept_id": df.join(ids, df[c] == ids.concept_id, "left_semi")
    terms = of(tables["term"].where("status = 'accepted'"))
    relations = of(of(tables["concept_relation"].where("status = 'accepted'"), "source_concept_id"), "target_concept_id")
    sets = of(tables["evidence_set"].where("status = 'accepted'"))
    evidence = tables["term_evidence"]
    evidence = evidence.join(terms.select(F.col("id").alias("t")), F.col("term_id") == F.col("t"), "left_semi")
    evidence = evidence.join(sets.select(F.col("id").alias("s")), F.col("evidence_set_id") == F.col("s"), "left_semi")
    return {
        "concept": accepted, "term": terms, "concept_type_assignment": of(tables["concept_type_assignment"]), "concept_identifier": of(tables["concept_identifier"]),
        "concept_relation": relations, "evidence_set": sets, "term_evidence": evidence,
    }


def write_release(tables: Mapping[str, DataFrame], path: str) -> DataFrame:
    """Writes the released tables below path; table_name and number of rows of each (the manifest, written too)."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in release(tables).items():
        df.write.parquet(f"{path}/{name}")
    counts = [spark.read.parquet(f"{path}/{n}").agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in release(tables)]
    manifest = counts[0]
    for c in counts[1:]:
        manifest = manifest.unionByName(c)
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


def swap(df: DataFrame, path: str) -> None:
    """Replaces the table at path: written beside it first, then the folders change names.

    The old table is deleted only when the new one is in place; where a rename
    fails, the old one is put back and the error is raised.  An old folder that an
    earlier swap left behind is the last whole table if there is none at path, and
    rubbish otherwise.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    old, new, gone = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.old"))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def rename(a, b) -> None:
        if fs.exists(b) or not fs.rename(a, b):
            raise OSError(f"{a.toString()} could not be renamed to {b.toString()}")

    df.write.mode("overwrite").parquet(f"{path}.new")
    had = fs.exists(old)
    if had:
        fs.delete(gone, True)
        rename(old, gone)
    try:
        rename(new, old)
    except Exception:
        if had and not fs.exists(old):
            rename(gone, old)
        raise
    fs.delete(gone, True)
