import json

import pytest

from termlake.sources import csv_units, jsonl


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_quoted_commas_and_missing_language(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        'publication_number,family_id,languages,title_en,title_nl,title_zh_hans,title_ja,title_ru\nEP-1-A1,F1,en|nl|zh-Hans|ja|ru,"Polymer, coating",,聚合物涂层,ポリマーコーティング,полимерное покрытие\n',
    )
    units, issues, counters = csv_units.read_units(spark, path)
    assert [(u.language, u.text_unit_index) for u in units.orderBy("text_unit_index").collect()] == [("en", 0), ("zh-Hans", 1), ("ja", 2), ("ru", 3)]
    assert [i.code for i in issues.collect()] == ["MISSING_DECLARED_LANGUAGE"]
    assert tuple(counters.first()) == (1, 1, 0)
    assert units.first().source_record_id == "a.csv:2"


def test_rejected_rows(spark, tmp_path):
    path = write(tmp_path / "b.csv", "publication_number,family_id,languages,title_en,title_de\n,F1,en|de,polymer,Polymer\nEP-2-A1,F2,en|de,,\n")
    units, issues, counters = csv_units.read_units(spark, path)
    assert units.count() == 0 and {i.code for i in issues.collect()} == {"CONTRACT_VALIDATION_FAILED", "NO_TEXT"}
    assert tuple(counters.first()) == (2, 0, 2)


def test_bom_quotes_line_breaks_and_blank_lines(spark, tmp_path):
    path = write(tmp_path / "c.csv", '﻿publication_number,languages,title_en\nA,en,"x ""q"""\n\nB,en,"two\nlines"\nC,en\n')
    rows = csv_units.read_csv(spark, path, "s").orderBy("row_number").collect()
    assert [(r.source_record_id, r.publication_number, r.title_en) for r in rows] == [("s:2", "A", 'x "q"'), ("s:3", "B", "two\nlines"), ("s:4", "C", None)]


def test_headers(spark, tmp_path):
    for head in ("languages,title_en", "publication_number,languages"):
        with pytest.raises(csv_units.ConfigurationError):
            csv_units.read_units(spark, write(tmp_path / f"{len(head)}.csv", head + "\n1,2\n"))
    _, issues, _ = csv_units.read_units(spark, write(tmp_path / "d.csv", "publication_number,title_en,title_not_a_tag\nA,x,y\n"))
    assert "INVALID_LANGUAGE_COLUMN" in {i.code for i in issues.collect()}


def test_report_lines(spark, tmp_path):
    inner = {"source_record_id": "r", "refined_candidates": [{"text": "gold", "types": ["ELEMENT"]}], "baseline_candidates": [{"text": "no", "types": []}]}
    path = write(tmp_path / "r.jsonl", json.dumps(inner) + "\n\n" + json.dumps({"extraction": inner, "mapping": {}}) + "\n")
    assert [tuple(r) for r in jsonl.read_refined_terms(spark, path).collect()] == [("r", "gold", ["ELEMENT"])] * 2
    c = spark.createDataFrame([("r", 0, "é")], "source_record_id string, text_unit_index int, text string")
    line = jsonl.extraction_lines(c.select("source_record_id"), c, c.where("false")).first().value
    assert json.loads(line) == {"source_record_id": "r", "baseline_candidates": [{"text_unit_index": 0, "text": "é"}], "refined_candidates": []} and "é" in line


def test_a_folder_of_files_with_different_headers(spark, tmp_path):
    for k in range(40):
        head, row = ("publication_number,title_en,title_de", "{},x {},y") if k % 2 else ("title_fr,publication_number,family_id,title_en", "z,{},F,\"a\nb {}\"")
        lines = [head, *(row.format(f"P{k}-{i}", i) for i in range(k % 5))]
        write(tmp_path / f"f {k:02}+.csv", "\n".join(lines) + "\n")
    write(tmp_path / "empty.csv", "")
    rows = csv_units.read_csv(spark, str(tmp_path)).collect()
    assert {(r.source_record_id, r.publication_number) for r in rows} == {(f"f {k:02}+.csv:{i + 2}", f"P{k}-{i}") for k in range(40) for i in range(k % 5)}
    assert {(r.title_fr, r.title_de) for r in rows} == {("z", None), (None, "y")}
    units, issues, counters = csv_units.read_units(spark, str(tmp_path))
    assert tuple(counters.first()) == (80, 80, 0) and units.count() == 160


def test_lines_tell_issues_and_refined_units(spark):
    c = spark.createDataFrame([("r", 0, "é")], "source_record_id string, text_unit_index int, text string")
    issues = spark.createDataFrame([("r", 2, "B", "m"), ("r", 1, "A", "n")], "source_record_id string, text_unit_index int, code string, message string")
    records = spark.createDataFrame([("r",), ("s",)], "source_record_id string")
    lines = [json.loads(x.value) for x in jsonl.extraction_lines(records, c, c.where("false"), c.where("false"), c, issues, issues.limit(1)).collect()]
    by = {x["extraction"]["source_record_id"]: x for x in lines}
    assert by["r"]["extraction"]["refined_text_unit_indices"] == [0] and [i["code"] for i in by["r"]["extraction"]["issues"]] == ["A", "B"]
    assert by["r"]["mapping"]["issues"] and by["s"] == {
        "extraction": {"source_record_id": "s", "baseline_candidates": [], "refined_candidates": [], "refined_text_unit_indices": [], "issues": []},
        "mapping": {"mappings": [], "issues": []},
    }
