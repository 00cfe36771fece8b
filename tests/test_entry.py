import json

import duckdb
import pytest

import __spark_entry__
from termlake.plans import english
from termlake.plans.queries import QUERIES, SQL
from termlake.streaming import extract_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def canon(rows):
    cell = lambda v: None if v is None else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted([tuple(map(cell, r)) for r in rows], key=repr)


@pytest.mark.parametrize("name", [name for name in QUERIES if name in SQL])
def test_queries_equal_their_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    other = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({SQL[name]})").fetchall()
    assert canon(df.select(*[f"`{c}`" for c in columns]).collect()) == canon(other)


def test_formulas_beside_letters_beyond_ascii_equal_their_sql(spark, tmp_path):
    texts = ["NaClß", "éH2O", "STRAßE", "NaCl_", "x NaCl y", "SS", None]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = canon(QUERIES["formula_mentions"](spark, str(tmp_path)).select("text", "mentions").collect())
    assert got == canon(c.execute(f"SELECT text, mentions FROM ({SQL['formula_mentions']})").fetchall()) and ("H2O", "1.000000") in got


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["text", "mentions"]
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"source_record_id": "r", "text_unit_index": i, "language": "en", "text": f"NaCl at {i} °C"} for i in range(4)]
    (tmp_path / "in").mkdir()
    for i, r in enumerate(rows):
        (tmp_path / f"in/{i}.json").write_text(json.dumps(r) + "\n", encoding="utf-8")
    extract_stream.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    batch = extract_stream.mentions(spark.read.schema(extract_stream.UNIT).json(str(tmp_path / "in")))
    stream = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert canon(stream.select(*batch.columns).collect()) == canon(batch.collect())


def test_stream_equals_the_batch_plan(spark, tmp_path):
    texts = ["Compound&nbsp;7 at 20&nbsp;&deg;C   and  NaCl", "porous gold alloy coating", None, "Übergröße"]
    rows = [{"source_record_id": f"r{i}", "text_unit_index": i, "language": "de" if i == 3 else "en", "text": t} for i, t in enumerate(texts)]
    (tmp_path / "in").mkdir()
    for i, r in enumerate(rows):
        (tmp_path / f"in/{i}.json").write_text(json.dumps(r) + "\n", encoding="utf-8")
    extract_stream.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    units = spark.createDataFrame([(r["source_record_id"], r["text_unit_index"], r["language"], r["text"]) for r in rows], extract_stream.UNIT)
    want = english.extract_english(units)[0].select("source_record_id", "start", "end", "original_start", "original_end", "text")
    got = spark.read.parquet(str(tmp_path / "out")).select(*want.columns)
    assert canon(got.collect()) == canon(want.collect()) and want.where("source_record_id = 'r0'").count() == 3
