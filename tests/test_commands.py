import json

from termlake.plans import commands


def test_extract_and_enrich(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("publication_number,languages,title_en,title_de\nEP-1,en|de,gold alloy coating,Goldlegierung\n,en,x,\n", encoding="utf-8")
    decisions = spark.createDataFrame(
        [("t.csv:2", 0, "gold alloy", 3, 9, ["MATERIAL"], [], "n/a", "IN_SCOPE", 0.9, "llm", False, "c")],
        "source_record_id string, text_unit_index int, text string, start int, end int, types array<string>, roles array<string>, proposed_definition string, scope_decision string, confidence double, source string, needs_review boolean, reason_code string",
    )
    mapped = spark.createDataFrame(
        [("t.csv:2", 0, 1, "E0", "Goldlegierung", None, None, "EXACT_EQUIVALENT", "TRANSLATED", 0.9, False, "c")],
        "source_record_id string, source_unit int, target_unit int, source_id string, target_text string, target_start int, target_end int, relation string, target_form_status string, confidence double, needs_review boolean, reason_code string",
    )
    summary = commands.extract(spark, str(path), str(tmp_path / "out"), refinements=decisions, mappings=mapped).first()
    assert (summary.processed, summary.rejected, summary.adapter_issues) == (1, 1, 1)
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 1
    assert {c["text"] for c in lines[0]["extraction"]["baseline_candidates"]} == {"gold alloy", "alloy coating", "gold alloy coating"}
    assert [(c["text"], c["start"]) for c in lines[0]["extraction"]["refined_candidates"]] == [("gold alloy", 0)]
    assert [(m["target_text"], m["target_start"]) for m in lines[0]["mapping"]["mappings"]] == [("Goldlegierung", 0)]

    snap = tmp_path / "snap"
    spark.createDataFrame([], "query_key string, position int, external_id string, title string, iupac_name string").write.parquet(str(snap / "compounds"))
    spark.createDataFrame([("gold alloy", None, 0, "Q9", "an alloy", None, None)], "label string, match_text string, position int, external_id string, description string, page_title string, page_url string").write.parquet(str(snap / "items"))
    spark.createDataFrame([], "external_id string, position int, terms array<string>, definition string, raw string").write.parquet(str(snap / "entries"))
    report = json.loads(commands.enrich_report(spark, str(tmp_path / "out"), str(snap), str(tmp_path / "rich"), str(path)).first().value)
    assert report == {"unique_terms": 1, "terms_with_external_references": 1, "coverage": 1.0, "terms_by_namespace": {"WIKIDATA": 1}}
    row = json.loads(spark.read.text(str(tmp_path / "rich")).first().value)
    assert row["term"] == "gold alloy" and row["references"][0]["external_id"] == "Q9" and row["source_documents"][0]["publication_number"] == "EP-1"


def test_issues_reach_the_lines(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("publication_number,title_en,title_de\nEP-1,gold alloy,x\nEP-2,pure water,y\nEP-3,cold resin,z\n", encoding="utf-8")
    decision = lambda r, text: (r, 0, text, 0, 9, ["MATERIAL"], [], "n/a", "IN_SCOPE", 0.9, "llm", False, "c")
    decisions = spark.createDataFrame(
        [decision("t.csv:2", "gold alloy"), decision("t.csv:3", "invented")],
        "source_record_id string, text_unit_index int, text string, start int, end int, types array<string>, roles array<string>, proposed_definition string, scope_decision string, confidence double, source string, needs_review boolean, reason_code string",
    )
    failures = spark.createDataFrame([("t.csv:4", 0, "EXTRACTOR_FAILED", "boom")], "source_record_id string, text_unit_index int, code string, message string")
    answered = spark.createDataFrame([("t.csv:4", 0)], "source_record_id string, text_unit_index int")
    commands.extract(spark, str(path), str(tmp_path / "out"), refinements=decisions, failures=failures, answered=answered)
    lines = {r["source_record_id"]: r for r in (json.loads(x.value) for x in spark.read.text(str(tmp_path / "out")).collect())}
    assert lines["t.csv:2"]["refined_text_unit_indices"] == [0] and lines["t.csv:2"]["issues"] == []
    assert lines["t.csv:3"]["refined_text_unit_indices"] == [] and [i["code"] for i in lines["t.csv:3"]["issues"]] == ["REFINER_FAILED"]
    assert lines["t.csv:4"]["refined_text_unit_indices"] == [0] and lines["t.csv:4"]["refined_candidates"] == []
    assert [(i["code"], i["message"]) for i in lines["t.csv:4"]["issues"]] == [("EXTRACTOR_FAILED", "boom")]
