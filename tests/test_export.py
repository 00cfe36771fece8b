"""The vocabulary export: parts that parse, what comes back, and what a failed job leaves."""

import xml.etree.ElementTree as ET
from pathlib import Path

import pytest

from termlake.sources import vocabulary_export as vx

ROWS = [
    ("1", [("en", 'a "quoted"\nline \\n', True), ("en", "also preferred", True), ("de", "Übung & <b>", False), ("en", None, True)], [("BROADER_THAN", "2"), ("SALT_OF", "3")], [("https://x/1 2", "exact")]),
    ("2", None, None, None),
    ("3 +%", [(None, "no language", False)], [], []),
]


def test_round_trip_of_labels_and_relations(spark, tmp_path):
    df = spark.createDataFrame(ROWS, vx.SCHEMA).repartition(3)
    vx.export(df, str(tmp_path / "out"))
    labels, relations = vx.read_skos(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in labels.collect()} == {
        ("1", "prefLabel", "en", 'a "quoted"\nline \\n'), ("1", "altLabel", "en", "also preferred"), ("1", "altLabel", "de", "Übung & <b>"), ("3 +%", "altLabel", None, "no language"),
    }
    assert {tuple(r) for r in relations.collect()} == {("1", "narrower", "2"), ("1", "related", "3")}
    lines = [x for p in (tmp_path / "out").glob("*.nt") for x in p.read_text(encoding="utf-8").splitlines()]
    assert all(x.startswith("<urn:") and x.endswith(" .") for x in lines) and sum("Concept>" in x for x in lines) == 3
    assert not list((tmp_path / "out/_parts").iterdir()) and len(list((tmp_path / "out").glob("_COMMITTED-*"))) == 1


def test_tbx_parts_parse(spark, tmp_path):
    vx.export(spark.createDataFrame(ROWS, vx.SCHEMA), str(tmp_path / "out"), "tbx")
    space = "{urn:iso:std:iso:30042:ed-2}"
    roots = [ET.parse(p).getroot() for p in (tmp_path / "out").glob("*.tbx")]
    entries = [e for r in roots for e in r.iter(f"{space}conceptEntry")]
    assert {e.get("id") for e in entries} == {"1", "2", "3 +%"}
    assert {t.text for r in roots for t in r.iter(f"{space}term")} == {'a "quoted"\nline \\n', "also preferred", "Übung & <b>", "no language"}


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([*ROWS, (None, None, None, None)], vx.SCHEMA).repartition(4)
    with pytest.raises(Exception, match="without an id"):
        vx.export(bad, str(tmp_path / "out"))
    assert not [p for p in Path(tmp_path / "out").rglob("*") if p.is_file()]
    with pytest.raises(Exception, match="kind"):
        vx.export(bad, str(tmp_path / "other"), "csv")
