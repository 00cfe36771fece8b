import random
import re
import time

import pytest
from pyspark.sql import functions as F

from termlake import schemas, vocab
from termlake.functions import similarity
from termlake.operators import enrich, evaluate, extract, grouped, pairing, reconcile, refine, resolve, store
from termlake.plans.english import check_records, extract_english, model_names, normalized_units
from termlake.plans.english import refine as refine_units


def units(spark, *texts):
    return spark.createDataFrame([("r", i, "en", t, t) for i, t in enumerate(texts)], "source_record_id string, text_unit_index int, language string, text string, normalized string")


def found(spark, text):
    return {(r.start, r.end, r.raw_label) for r in extract.extract_rules(units(spark, text)).collect()}


def test_rules(spark):
    assert found(spark, "Compound 17 contains NaCl at 25 °C.") == {(0, 11, "PATENT_LABEL"), (21, 25, "MOLECULAR_FORMULA"), (29, 34, "QUANTITY")}
    text = "CAS 64-17-5; SMILES: CCO; pH 7.4; heated at 20-25 °C and 5 wt.% solids."
    assert found(spark, text) == {(4, 11, "CAS_RN"), (21, 24, "SMILES"), (26, 32, "PH"), (44, 52, "QUANTITY"), (57, 63, "QUANTITY"), (21, 24, "MOLECULAR_FORMULA")}
    assert not found(spark, "64-17-6")
    assert found(spark, "é25 K and 😀 (ABS)") == {(13, 16, "ABBREVIATION")}
    assert found(spark, "") == set()


def test_formula_of_many_tokens(spark):
    assert len(found(spark, "CH2" * 20_000)) == 1


def test_phrases(spark):
    rows = extract.extract_phrases(units(spark, "a gold alloy coating of steel, process")).collect()
    got = {(r.text, r.types[0], r.raw_label) for r in rows}
    assert got == {("gold alloy", "MATERIAL", "MATERIAL_PHRASE"), ("alloy coating", "MATERIAL", "MATERIAL_PHRASE"), ("gold alloy coating", "MATERIAL", "MATERIAL_PHRASE")}
    by = {r.text: r for r in rows}
    assert by["gold alloy coating"].roles == ["COATING"] and by["gold alloy coating"].confidence == pytest.approx(0.79)


def test_model_hook(spark):
    def load():
        def model(text):
            if text == "bad":
                raise RuntimeError("no")
            return [{"start": 0, "end": 3, "entity_group": "B-SOLVENT", "score": 0.5}]

        return model

    rows, issues = extract.apply_model(units(spark, "THF used", "bad"), load)
    got = extract.model_labels(rows, "m", vocab.REACTION_LABEL_TYPE, vocab.REACTION_LABEL_ROLE, 2).collect()
    assert [(r.text, r.types, r.roles, r.raw_label) for r in got] == [("THF", ["CHEMICAL_ENTITY"], ["SOLVENT"], "SOLVENT")]
    assert [r.code for r in issues.collect()] == ["EXTRACTOR_FAILED"]


def test_types(spark):
    assert vocab.ancestors("HYDRATE") == ["SOLVATE", "COMPOUND", "CHEMICAL_ENTITY"]
    assert len(vocab.CONCEPT_TYPES) == 25 and sum(p is None for _, _, p in vocab.CONCEPT_TYPES) == 9
    assert len(vocab.ELEMENTS) == 118 and len(vocab.HEAD_TYPE) == 78 and len(vocab.BOUNDARY_WORDS) == 19
    row = spark.sql("SELECT array('COMPOUND', 'CHEMICAL_ENTITY', 'MATERIAL') t")
    got = row.select(reconcile.without_ancestors(F.col("t")).alias("a"), reconcile.has_root_conflict(F.col("t")).alias("b")).first()
    assert got.a == ["COMPOUND", "MATERIAL"] and got.b


def test_reconcile_and_plan(spark):
    u = spark.createDataFrame([("r", 0, "en", "NaCl &amp; gold alloy coating"), ("r", 1, "de", "NaCl")], "source_record_id string, text_unit_index int, language string, text string")
    model = spark.createDataFrame(
        [("r", 0, "en", "NaCl", 0, 4, ["COMPOUND"], [], "salt", 0.9, "m", "1", "X", False, None, 2), ("r", 0, "en", "nope", 0, 4, ["COMPOUND"], [], None, 0.9, "m", "1", "X", False, None, 2)],
        "source_record_id string, text_unit_index int, language string, " + extract.CANDIDATE,
    )
    rows, issues = extract_english(u, {"m": model})
    by = {r.text: r for r in rows.collect()}
    nacl = by["NaCl"]
    assert nacl.types == ["COMPOUND"] and nacl.confidence == pytest.approx(0.95) and nacl.extractor == "exact_span_reconciler" and nacl.proposed_definition == "salt"
    assert (by["gold alloy"].original_start, by["gold alloy"].original_end) == (11, 21)
    assert [r.code for r in issues.collect()] == ["INVALID_CANDIDATE_SPAN"]


def test_best_by_span_prefers_refined_units(spark):
    rows = spark.createDataFrame(
        [("r", 0, "en", 0, 3, ["A"], 0.5, 1), ("r", 0, "en", 0, 3, ["A"], 0.5, 0), ("r", 1, "en", 0, 3, ["A"], 0.9, 0)],
        "source_record_id string, text_unit_index int, language string, start int, end int, types array<string>, confidence double, seq int",
    )
    refined = spark.createDataFrame([("r", 1)], "source_record_id string, text_unit_index int")
    got = reconcile.best_by_span(rows, rows.where("false"), refined).collect()
    assert [(r.text_unit_index, r.seq) for r in got] == [(0, 0)]


def test_grouped_text(spark):
    u = spark.createDataFrame(
        [("r", 0, "en", "title", "title", "Gold"), ("r", 1, "en", "abstract", "abstract", "Copper"), ("s", 0, "en", "title", "title", "x")],
        "source_record_id string, text_unit_index int, language string, unit_type string, locator string, normalized string",
    )
    rows = grouped.build(grouped.grouped_units(u)).collect()
    assert len(rows) == 1
    row = rows[0]
    assert [row.grouped_text[s.start : s.end] for s in row.segments] == ["Gold", "Copper"]
    assert row.grouped_text.startswith('[[SECTION id="U0" type="title" locator="title"]]\nGold\n[[END SECTION]]\n\n[[SECTION')


def test_grounding_and_decisions(spark):
    text = spark.createDataFrame([("r", "gold and gold")], "source_record_id string, text string")
    at = lambda s, e: text.select(refine.ground(F.col("text"), F.lit("gold"), F.lit(s).cast("int"), F.lit(e).cast("int")).alias("x")).first().x
    assert tuple(at(9, 13)) == (9, 13) and tuple(at(8, 12)) == (9, 13) and tuple(at(None, None)) == (0, 4) and tuple(at(2, 6)) == (0, 4)
    schema = "source_record_id string, text string, start int, end int, types array<string>, roles array<string>, proposed_definition string, scope_decision string, confidence double, source string, needs_review boolean, reason_code string"
    row = lambda t, a, b, scope: ("r", t, a, b, ["MATERIAL"], [], "None", scope, 0.5, "llm", False, "x")
    good, issues = refine.apply_decisions(text, spark.createDataFrame([row("gold", 1, 2, "REVIEW"), row("and", 0, 0, "OUT_OF_SCOPE")], schema), ("source_record_id",))
    got = good.collect()
    assert [(r.start, r.end, r.needs_review, r.proposed_definition) for r in got] == [(0, 4, True, None)] and not issues.collect()
    good, issues = refine.apply_decisions(text, spark.createDataFrame([row("gold", 0, 4, "IN_SCOPE"), row("zinc", 0, 4, "IN_SCOPE")], schema), ("source_record_id",))
    assert not good.collect() and [r.code for r in issues.collect()] == ["REFINER_FAILED"]


UNITS = "source_record_id string, text_unit_index int, language string, unit_type string, locator string, text string"


def normalised(spark, rows):
    return held(normalized_units(spark.createDataFrame(rows, UNITS), english=False))


GROUP = [
    ("r", 0, "en", "title", "title", " Gold  alloy"), ("r", 1, "en", "abstract", "abstract", "A copper coating protects."),
    ("r", 2, "de", "title", "title", "Goldlegierung"), ("r", 3, "de", "abstract", "abstract", "Eine  Kupferbeschichtung schützt."),
    ("s", 0, "en", "title", "title", "Zinc film"), ("s", 1, "fr", "title", "title", "Film de zinc"), ("s", 2, "ja", "title", "title", "亜鉛膜"),
]
DECISIONS = (
    "source_record_id string, text_unit_index int, text string, start int, end int, types array<string>, roles array<string>, proposed_definition string, "
    "scope_decision string, confidence double, source string, needs_review boolean, reason_code string"
)
MAPPED = (
    "source_record_id string, source_unit int, target_unit int, source_id string, target_text string, target_start int, target_end int, relation string, "
    "target_form_status string, confidence double, needs_review boolean, reason_code string"
)


def held(df):
    """The rows of a small plan, so that what is built on it does not repeat it."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def candidates_of(units):
    return held(extract_english(units.drop("normalized", "off_start", "off_end"))[0])


def test_title_and_abstract_are_refined_together(spark):
    units = normalised(spark, GROUP)
    english = units.where("language = 'en'")
    asked = {(r.source_record_id, r.text_unit_index): r for r in grouped.requests(english).collect()}
    assert {k: r.grouped for k, r in asked.items()} == {("r", 0): True, ("s", 0): False}
    text = asked["r", 0].text
    at = text.index("copper coating")
    shifted = {(r.text, r.request_unit): text[r.request_start : r.request_end] for r in grouped.shifted(candidates_of(units).where("source_record_id = 'r'"), grouped.requests(english)).collect()}
    assert shifted[("copper coating", 0)] == "copper coating"
    row = lambda rec, unit, t, a, b: (rec, unit, t, a, b, ["MATERIAL"], [], None, "IN_SCOPE", 0.9, "llm", False, "c")
    decisions = spark.createDataFrame([row("r", 0, "Gold alloy", None, None), row("r", 0, "copper coating", at, at + 14)], DECISIONS)
    found, done, issues = refine_units(english, decisions)
    got = {(r.text, r.text_unit_index, r.start, r.original_start, r.original_end) for r in found.collect()}
    assert got == {("Gold alloy", 0, 0, 1, 12), ("copper coating", 1, 2, 2, 16)}
    assert {tuple(r) for r in done.collect()} == {("r", 0), ("r", 1)} and not issues.collect()


def test_failures_of_refinement_are_told_apart(spark):
    english = normalised(spark, GROUP).where("language = 'en'")
    row = lambda rec, t, confidence=0.9: (rec, 0, t, None, None, ["MATERIAL"], [], None, "IN_SCOPE", confidence, "llm", False, "c")
    codes = lambda rows: sorted((r.source_record_id, r.code) for r in rows.collect())
    found, done, issues = refine_units(english, spark.createDataFrame([row("r", "nowhere"), row("s", "nowhere")], DECISIONS))
    assert not found.collect() and not done.collect() and codes(issues) == [("r", "GROUPED_REFINER_FAILED"), ("s", "REFINER_FAILED")]
    crossing = "alloy\n[[END SECTION]]"
    found, done, issues = refine_units(english, spark.createDataFrame([row("r", crossing), row("r", "copper"), row("s", "Zinc", 1.5)], DECISIONS))
    assert [r.text for r in found.collect()] == ["copper"]
    assert codes(issues) == [("r", "INVALID_GROUPED_REFINED_SPAN"), ("s", "INVALID_REFINED_SPAN")] and done.count() == 3
    none = spark.createDataFrame([], DECISIONS)
    answered = spark.createDataFrame([("r", 0)], "source_record_id string, text_unit_index int")
    found, done, issues = refine_units(english, none, answered)
    assert not found.collect() and {tuple(r) for r in done.collect()} == {("r", 0), ("r", 1)}


def test_title_and_abstract_are_mapped_together(spark):
    units = normalised(spark, GROUP)
    best = candidates_of(units)
    asked = {(r.source_record_id, r.source_unit, r.target_unit): r for r in pairing.mapping_requests(units).collect()}
    assert {k: (r.target_language, r.grouped, r.source_units) for k, r in asked.items()} == {
        ("r", 0, 2): ("de", True, [0, 1]), ("s", 0, 1): ("fr", False, [0]), ("s", 0, 2): ("ja", False, [0]),
    }
    assert {k[2] for k in [(r.source_record_id, r.source_unit, r.target_unit) for r in pairing.mapping_requests(units, ["fr"]).collect()]} == {1}
    text = asked["r", 0, 2].text
    at = text.index("Kupferbeschichtung")
    row = lambda rec, target, i, t, a=None, rel="EXACT_EQUIVALENT", status="TRANSLATED": (rec, 0, target, i, t, a, None if a is None else a + len(t), rel, status, 0.9, False, "c")
    rows = [row("r", 2, "E0", "Goldlegierung"), row("r", 2, "E1", "Kupferbeschichtung", at), row("s", 1, "E0", "Film"), row("s", 2, "E0", "Zink")]
    got, issues = pairing.map_units(units, best, spark.createDataFrame(rows, MAPPED))
    by = {(r.source_record_id, r.target_language, r.source_text): r for r in got.collect()}
    place = lambda r: (r.target_text_unit_index, r.target_start, r.target_original_start, r.target_original_end)
    assert place(by["r", "de", "Gold alloy"]) == (2, 0, 0, 13) and place(by["r", "de", "copper coating"]) == (3, 5, 6, 24)
    assert by["r", "de", "copper coating"].source_text_unit_index == 1 and by["s", "fr", "Zinc film"].source_types == ["MATERIAL"]
    lost = by["s", "ja", "Zinc film"]
    assert (lost.relation, lost.target_form_status, lost.reason_code, lost.needs_review) == ("NO_MATCH", "NOT_PRESENT", "UNGROUNDED_LLM_TARGET_REJECTED", True)
    assert len(by) == 4 and not issues.collect()
    assert not pairing.incoherent_mappings(got).collect()


def test_a_failed_mapping_leaves_its_siblings_alone(spark):
    units = normalised(spark, GROUP)
    row = lambda rec, target, i, t: (rec, 0, target, i, t, None, None, "EXACT_EQUIVALENT", "TRANSLATED", 0.9, False, "c")
    rows = [row("r", 2, "E0", "Goldlegierung"), row("r", 2, "E7", "Eine"), row("s", 1, "E0", "Film"), row("s", 2, "E0", "亜"), row("s", 2, "E0", "亜")]
    got, issues = pairing.map_units(units, candidates_of(units), spark.createDataFrame(rows, MAPPED))
    assert [(r.source_record_id, r.target_language) for r in got.collect()] == [("s", "fr")]
    assert sorted((r.source_record_id, r.text_unit_index, r.code, r.message) for r in issues.collect()) == [
        ("r", 2, "GROUPED_TARGET_MAPPING_FAILED", "missing E1; unknown E7"), ("s", 2, "TARGET_MAPPING_FAILED", "more than one decision for a candidate"),
    ]
    rows = [row("r", 2, "E0", "Goldlegierung\n[[END SECTION]]"), row("r", 2, "E1", "Eine")]
    got, issues = pairing.map_units(units, candidates_of(units), spark.createDataFrame(rows, MAPPED))
    assert not got.collect() and [r.code for r in issues.collect()] == ["GROUPED_TARGET_MAPPING_FAILED"]


def test_models_of_a_plan_and_records_of_results(spark):
    assert model_names(["a", "b", "a"], "b") == ["a", "b"] and model_names(["chemu", "a"], reaction_model="chemu") == ["a", "chemu"]
    rows = normalised(spark, GROUP)
    check_records(rows, rows.limit(2))
    with pytest.raises(ValueError, match="zz"):
        check_records(rows, spark.createDataFrame([("r",), ("zz",)], "source_record_id string"))


def test_spans_of_long_texts(spark):
    n = 60_000
    rows = units(spark, "gold alloy é of NaCl at 25 °C " * n)
    found = extract.extract_phrases(rows).agg(F.count("*").alias("n"), F.max("start").alias("s")).first()
    assert (found.n, found.s) == (2 * n - 1, 30 * (n - 1))  # from the second on "C gold alloy", too
    quantity = extract.extract_rules(rows).where("raw_label = 'QUANTITY'").agg(F.count("*").alias("n"), F.max("end").alias("e")).first()
    assert (quantity.n, quantity.e) == (n, 30 * n - 1)


def test_mentions_of_a_recogniser(spark):
    rows = [("r", 0, "en", "use NaCl now", "NaCl", 4, 8, None), ("r", 0, "en", "use NaCl now", "use", 0, 3, 0.5)]
    df = spark.createDataFrame(rows, "source_record_id string, text_unit_index int, language string, normalized string, text string, start int, end int, score double")
    got = extract.mention_candidates(df, "cde", 4).collect()
    assert [(r.text, r.types, r.confidence, r.raw_label) for r in got] == [("NaCl", ["CHEMICAL_ENTITY"], 0.9, "CEM"), ("use", ["CHEMICAL_ENTITY"], 0.5, "CEM")]
    with pytest.raises(Exception, match="does not stand"):
        extract.mention_candidates(df.withColumn("start", F.col("start") + 1), "cde", 4).collect()


def test_embedding_hook_and_vector_search(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0, 0.0] for t in texts]

    rows = spark.createDataFrame([("a", "xx"), ("b", None), ("c", "")], "proposal_id string, text string")
    got = {r.proposal_id: r.embedding for r in resolve.embed(rows, load, 3).collect()}
    assert got["a"] == pytest.approx([2 / 5**0.5, 1 / 5**0.5, 0]) and got["b"] is None and got["c"] == [0, 1, 0]
    for bad in (lambda: lambda texts: [[1.0]] * len(texts), lambda: lambda texts: []):
        with pytest.raises(Exception, match="instead of|0 vectors"):
            resolve.embed(rows, bad, 3).collect()
    stored = spark.createDataFrame(
        [(1, "m", "1", [1.0, 0.0]), (2, "m", "2", [1.0, 0.0]), (3, "n", "1", [1.0, 0.0]), (4, "m", "1", [0.0, 0.0]), (5, "m", "1", [0.0, 1.0])],
        "concept_id int, model_name string, model_version string, embedding array<float>",
    )
    asked = spark.createDataFrame([(f"p{i}", [1.0, float(i)]) for i in range(9)] + [("none", None)], "proposal_id string, query_embedding array<float>")
    one = resolve.vector_signal(asked, stored, 5, "m", "1").collect()
    assert {r.concept_id for r in one} == {1, 5} and len(one) == 18
    assert sorted(one) == sorted(resolve.vector_signal(asked, stored, 5, "m", "1", block_bytes=200).collect())
    with pytest.raises(Exception, match="dimension"):
        resolve.vector_signal(spark.createDataFrame([("p", [1.0])], "proposal_id string, query_embedding array<float>"), stored).collect()


def test_vectors_of_blocks_equal_all_pairs_and_copies_tie_by_id(spark):
    rng = random.Random(5)
    pool = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(300)]
    stored = [(i, pool[i % 300] if i % 7 else pool[3]) for i in range(12_000)] + [(20_000, None), (20_001, [0.0] * 64)]
    asked = [(f"p{i}", pool[i % 300]) for i in range(4_000)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    a = spark.createDataFrame(asked, "proposal_id string, query_embedding array<double>")
    s = spark.createDataFrame(stored, "concept_id int, embedding array<double>")
    began = time.time()
    got = {}
    for r in resolve.vector_signal(a, s, 5, block_bytes=1 << 20).collect():
        got.setdefault(r.proposal_id, []).append((-r.semantic, r.concept_id))
    assert len(got) == 4_000 and time.time() - began < 60
    for name, q in asked[:40]:
        near = sorted((-dot(q, v) / (dot(q, q) ** 0.5 * dot(v, v) ** 0.5), i) for i, v in ((i, pool[i % 300] if i % 7 else pool[3]) for i in range(12_000)))[:5]
        assert [i for _, i in sorted(got[name])] == [i for _, i in near]


def test_equal_questions_are_answered_once(spark):
    n = 30_000  # the products would be 900,000,000 rows
    began = time.time()
    p = spark.range(n).select(F.concat(F.lit("p"), "id").alias("proposal_id"), F.lit("en").alias("language"), F.lit("gold alloy").alias("normalized_term"), F.array(F.struct(F.lit("CHEBI").alias("namespace"), F.lit("1").alias("value"))).alias("identifiers"))
    ids = spark.range(n).select((F.col("id") % 3).alias("concept_id"), F.lit(1).alias("namespace_id"), F.lit("1").alias("external_id"))
    names = spark.createDataFrame([(1, "CHEBI", "strong")], "id int, code string, identity_strength string")
    assert {(r.concept_id, r.strength, r["count"]) for r in resolve.identifier_signal(p.union(p), ids, names).groupBy("concept_id", "strength").count().collect()} == {(i, "strong", n) for i in range(3)}
    terms = spark.range(n).select(F.col("id").alias("concept_id"), F.lit("en").alias("language"), F.lit("gold alloy").alias("normalized_text"), F.lit("accepted").alias("status"))
    assert {(r.concept_id, r["count"]) for r in resolve.trigram_signal(p, terms, most=4).groupBy("concept_id").count().collect()} == {(i, n) for i in range(4)}
    assert time.time() - began < 60


def test_trigrams_of_blocks_equal_pairwise_similarity(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 4)))
    p = spark.createDataFrame([(f"p{i}", rng.choice(("en", "de")), text()) for i in range(40)] + [("same", "en", "ab abé"), ("null", "en", None)], "proposal_id string, language string, normalized_term string")
    t = spark.createDataFrame(
        [(i % 30, rng.choice(("en", "de")), text(), rng.choice(("accepted", "rejected"))) for i in range(90)] + [(1, "en", "ab abé", "accepted")], "concept_id int, language string, normalized_text string, status string"
    )
    sim = similarity.trigram_similarity(similarity.trigrams(F.col("normalized_term")), similarity.trigrams(F.col("normalized_text")))
    pairs = p.join(t.where("status = 'accepted'"), "language").withColumn("trigram", sim).where("trigram >= 0.25").groupBy("proposal_id", "concept_id").agg(F.max("trigram").alias("trigram"))
    want = {(r.proposal_id, r.concept_id): pytest.approx(r.trigram) for r in pairs.collect()}
    for grams in (1_000_000, 25):
        got = {(r.proposal_id, r.concept_id): r.trigram for r in resolve.trigram_signal(p, t, most=99, hot_list=grams).collect()}
        assert got == want and len(got) > 50
    assert resolve.trigram_signal(p.where("false"), t).count() == 0 and resolve.trigram_signal(p, t.where("false")).count() == 0


def test_a_failed_lookup_leaves_the_others_alone(spark):
    def load():
        def look(term, types):
            if term == "bad":
                raise RuntimeError("timeout")
            return [{"namespace": "X", "external_id": term, "confidence": 0.5, "needs_review": not types}]

        return look

    p = spark.createDataFrame([("p0", "water", ["COMPOUND"]), ("p1", "bad", None), ("p2", "gold", None)], "proposal_id string, term string, type_codes array<string>")
    found, issues = enrich.apply_lookup(p, "own", load)
    assert {(r.proposal_id, r.external_id, r.needs_review) for r in found.collect()} == {("p0", "water", False), ("p2", "gold", True)}
    assert [tuple(r) for r in issues.collect()] == [("p1", "own", "LOOKUP_FAILED", "timeout")]


def test_swap_keeps_the_table_when_a_rename_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    store.swap(spark.range(4), path)
    (tmp_path / "t.old").mkdir()
    (tmp_path / "t.old/left").write_text("x")
    store.swap(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "t.old").exists()
    (tmp_path / "t.new").mkdir(exist_ok=True)
    with pytest.raises(Exception, match=r"no such column|missing|cannot be resolved|UNRESOLVED"):
        store.swap(spark.range(3).select("missing"), path)
    assert spark.read.parquet(path).count() == 2


def test_refused_writes_and_dropped_tables(spark, tmp_path):
    rows = spark.createDataFrame([("t", "t", "en", None, 0.5), ("", "t", "e", "Latin", 2.0), (None, "x" * 2001, "en", "Latn", None)], "text string, normalized_text string, language string, script string, confidence double")
    got = [r.out_of_bounds for r in schemas.refused("term", rows).collect()]
    assert got == [["confidence", "language", "script", "text"], ["normalized_text", "text"]]
    ids = spark.createDataFrame([("CAS_RN", "1", "exact", 1.0), ("", "", "same", None)], "namespace string, external_id string, mapping_type string, confidence double")
    assert [r.out_of_bounds for r in schemas.refused("concept_identifier", ids).collect()] == [["confidence", "external_id", "mapping_type", "namespace"]]
    schemas.create(spark, str(tmp_path / "s"))
    schemas.drop(spark, str(tmp_path / "s"))
    assert not any((tmp_path / "s").iterdir())


def test_release(spark, tmp_path):
    rows = lambda table, *given: spark.createDataFrame(given, schemas.schema(table))
    pad = lambda table, **v: tuple(v.get(f.name) for f in schemas.schema(table))
    tables = {
        "concept": rows("concept", pad("concept", id="a", status="accepted"), pad("concept", id="b", status="proposed")),
        "term": rows("term", pad("term", id="t", concept_id="a", status="accepted"), pad("term", id="u", concept_id="a", status="rejected"), pad("term", id="v", concept_id="b", status="accepted")),
        "concept_type_assignment": rows("concept_type_assignment", pad("concept_type_assignment", concept_id="a", concept_type_id="1"), pad("concept_type_assignment", concept_id="b", concept_type_id="1")),
        "concept_identifier": rows("concept_identifier", pad("concept_identifier", id="i", concept_id="b")),
        "concept_relation": rows("concept_relation", pad("concept_relation", id="x", source_concept_id="a", target_concept_id="b", status="accepted"), pad("concept_relation", id="y", source_concept_id="a", target_concept_id="a", status="accepted")),
        "evidence_set": rows("evidence_set", pad("evidence_set", id="s", concept_id="a", status="accepted"), pad("evidence_set", id="z", concept_id="a", status="rejected")),
        "term_evidence": rows("term_evidence", *[pad("term_evidence", id=f"{t}{s}", term_id=t, evidence_set_id=s) for t in "tu" for s in "sz"]),
    }
    manifest = store.write_release(tables, str(tmp_path / "out"))
    assert {r.table_name: r.n_rows for r in manifest.collect()} == {
        "concept": 1, "term": 1, "concept_type_assignment": 1, "concept_identifier": 0, "concept_relation": 1, "evidence_set": 1, "term_evidence": 1,
    }


def test_resolve(spark):
    p = spark.createDataFrame([("a",), ("b",), ("c",)], "proposal_id string")
    ranked = spark.createDataFrame([("a", "1"), ("b", "2")], "proposal_id string, concept_id string")
    d = spark.createDataFrame(
        [("a", "SAME_CONCEPT", "1", None, 0.9, "IDENTIFIER_EXACT", False), ("b", "SAME_CONCEPT", "9", None, 0.9, "IDENTIFIER_EXACT", False)],
        "proposal_id string, outcome string, concept_id string, related_concept_id string, confidence double, reason_code string, needs_review boolean",
    )
    good, bad = resolve.resolve(p, ranked, d)
    assert {(r.proposal_id, r.outcome) for r in good.collect()} == {("a", "SAME_CONCEPT"), ("c", "NEW_CONCEPT")}
    assert [(r.proposal_id, r.error) for r in bad.collect()] == [("b", "the id is not among the candidates")]


def test_enrichment(spark):
    p = spark.createDataFrame([("p0", "Membranes", ["MATERIAL"]), ("p1", "water", ["COMPOUND"])], "proposal_id string, term string, type_codes array<string>")
    compounds = spark.createDataFrame([("water", 0, "962", "Water", "oxidane")], "query_key string, position int, external_id string, title string, iupac_name string")
    items = spark.createDataFrame(
        [("membranes", None, 0, "Q1", "2011 album", None, None), ("membrane", None, 0, "Q2", "selective material", "Membrane", "https://en.wikipedia.org/wiki/Membrane")],
        "label string, match_text string, position int, external_id string, description string, page_title string, page_url string",
    )
    entries = spark.createDataFrame([("7", 0, ["water"], "<b>wet</b>", '{"d": "chemical"}')], "external_id string, position int, terms array<string>, definition string, raw string")
    got = {(r.proposal_id, r.namespace): r for r in enrich.enrich(p, compounds, items, entries).collect()}
    assert set(got) == {("p0", "WIKIDATA"), ("p0", "WIKIPEDIA_EN"), ("p1", "PUBCHEM_CID"), ("p1", "IATE")}
    assert got["p0", "WIKIDATA"].external_id == "Q2" and got["p0", "WIKIDATA"].confidence == 0.92
    assert got["p1", "PUBCHEM_CID"].confidence == 0.96 and got["p1", "IATE"].description == "wet"


@pytest.mark.parametrize("operator", ["compound", "item", "entry"])
def test_references_of_a_very_common_key_are_cut_before_they_meet_its_terms(spark, operator):
    n = 40_000  # the product would be 1,600,000,000 rows
    p = spark.range(n).select(F.concat(F.lit("p"), "id").alias("proposal_id"), F.lit("Waters").alias("term"), F.array(F.lit("COMPOUND")).alias("type_codes"))
    r = spark.range(n).select(F.col("id").cast("string").alias("external_id"), (F.col("id") % 5 + F.when(F.col("id") < 7, 1).otherwise(0)).cast("int").alias("position"))
    began = time.time()
    if operator == "compound":
        got = enrich.compound_references(p, r.select("*", F.lit("waters").alias("query_key"), F.lit("").alias("title"), F.lit("x").alias("iupac_name")))
        want = ["10", "100", "1000"]
    elif operator == "item":
        url = F.lit(None).cast("string")
        got = enrich.item_references(p, r.select("*", F.lit("water").alias("label"), url.alias("match_text"), F.lit("material").alias("description"), url.alias("page_title"), url.alias("page_url")))
        want = ["10"]
    else:
        got = enrich.entry_references(p, r.select("*", F.array(F.lit("waters"), F.lit("WATERS")).alias("terms"), F.lit("d").alias("definition"), F.lit("chemical").alias("raw")))
        want = ["10", "100", "1000"]
    counts = {x.external_id: (x["count"], x.sure) for x in got.groupBy("external_id").agg(F.count("*").alias("count"), F.bool_or(~F.col("needs_review")).alias("sure")).collect()}
    assert counts == dict.fromkeys(want, (n, operator == "item")) and time.time() - began < 60


def test_store(spark, tmp_path):
    assert len(schemas.TABLES) == 14
    schemas.create(spark, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store/term")).schema == schemas.schema("term")
    seeds = store.seed(spark)["identifier_namespace"].withColumn("active", F.lit(True))
    refs = spark.createDataFrame([("c", "NOPE", "1", "EXACT", 0.5, "u", False)], "concept_id string, namespace string, external_id string, mapping_type string, confidence double, canonical_url string, needs_review boolean")
    none = spark.createDataFrame([], "concept_id string, namespace string, external_id string, mapping_type string, confidence decimal(5,4), source_uri string")
    with pytest.raises(ValueError, match="NOPE"):
        store.upsert_identifiers(none, refs, seeds)
    good = refs.withColumn("namespace", F.lit("IATE"))
    once = store.upsert_identifiers(none, good, seeds)
    assert once.collect() == store.upsert_identifiers(once, good, seeds).collect()
    path = str(tmp_path / "swap")
    store.swap(spark.range(3), path)
    store.swap(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_translations_of_one_concept_are_dealt_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(store, "BLOCK", 32, raising=False)
    monkeypatch.setattr(store, "PIECE", 8, raising=False)
    terms = [("big", "en", f"e{i % 150}") for i in range(200)] + [("big", "de", f"d{i % 3 * i}") for i in range(100)]
    terms += [("small", "en", "a"), ("small", "en", "a"), ("small", "de", None), ("alone", "en", "x"), ("alone", "en", "y"), (None, "en", "n"), (None, "de", "m"), ("small", None, "l")]
    rows = spark.createDataFrame(terms, "concept_id string, language string, text string")
    got = store.translations(rows)
    a, b = (rows.select("concept_id", F.col("language").alias(f"{s}_language"), F.col("text").alias(f"{s}_text")) for s in ("source", "target"))
    want = a.join(b, "concept_id").where("source_language <> target_language").select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.where("concept_id = 'small' and source_text = 'a' and target_text is null").count() == 2
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(tasks) == 4 and max(tasks) < sum(tasks) / 2  # a task made all pairs of a concept in one direction
    assert store.translations(rows.limit(0)).isEmpty()


def test_termhood_and_split(spark):
    m = spark.createDataFrame([("1", "gold alloy coating"), ("2", "gold alloy"), ("3", "gold alloy")], "source_record_id string, text string")
    by = {r.text: r for r in evaluate.termhood(m).collect()}
    assert by["gold alloy"].c_value == pytest.approx(1.584962500721156 * (2 - 1))
    rows = evaluate.split(spark.createDataFrame([("f", i) for i in range(5)], "family string, i int"), "family").select("split").distinct().collect()
    assert len(rows) == 1


def test_spans_pass_over_a_text_once(spark, monkeypatch):
    texts = ["", "NaCl", "x NaCl, H2O and NaCl", "x😀NaCl é H2O ", f"{extract.MARK} NaCl {extract.MARK}H2O", None, "none", " ".join(["NaCl x"] * 700), "a$1\\NaCl"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in rows.select("i", extract.spans(F.col("t"), extract.FORMULA).alias("s")).collect()}
    for i, t in enumerate(texts):
        hits = None if t is None else [(m.start(), m.end(), m[0]) for m in re.finditer(r"\b(?:[A-Z][a-z]?[0-9]*){2,}\b", t)]
        assert (got[i] and [(s.start, s.end, s.text) for s in got[i]]) == hits
        assert hits is None or "".join(s.gap + s.text for s in got[i]) == t[: hits[-1][1] if hits else 0]
    splits, split = [], F.split
    monkeypatch.setattr(F, "split", lambda text, pattern, *more: splits.append(pattern) or split(text, pattern, *more))
    extract.spans(F.col("t"), extract.FORMULA)
    assert extract.MARK in splits
