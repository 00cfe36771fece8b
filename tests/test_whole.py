import random

import pyspark.sql.functions as F

from termlake.functions import text as tx
from termlake.operators import refine
from termlake.plans import queries

DOCS = "doc_id long, text string, lang string"


def documents(spark, folder, texts):
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def nearest(text, copied, hint):
    """Start of the occurrence nearest to a hint, the first of two; overlapping ones count."""
    at = [i for i in range(len(text) - len(copied) + 1) if text[i : i + len(copied)] == copied] if copied else []
    return min(at, key=lambda i: (abs(i - hint), i), default=None)


def test_grounding_of_every_document(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", "short", "0123456789ab", "0123456789abcd", "é漢" * 300, "aaaa" * 50]
    texts += ["".join(rng.choice("abé") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    got = {r.doc_id: r for r in queries.QUERIES["ground_exact_span_nearest"](spark, documents(spark, tmp_path, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        copied = None if t is None else t[10:14]
        assert (got[i].copied, got[i].start) == (copied, None if t is None else nearest(t, copied, 20)), t


def test_grounding_with_any_hint(spark):
    rng = random.Random(8)
    cases = [("".join(rng.choice("ab😀") for _ in range(rng.randint(0, 20))), "".join(rng.choice("ab😀") for _ in range(rng.randint(1, 3))), rng.randint(-5, 25)) for _ in range(500)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, text string, copied string, hint int")
    got = {r.i: r.at for r in rows.select("i", refine.ground(F.col("text"), F.col("copied"), F.col("hint"), F.col("hint"))["start"].alias("at")).collect()}
    assert [got[i] for i in range(len(cases))] == [nearest(*c) for c in cases]


def test_normalisation_of_every_document(spark, tmp_path):
    texts = [None, "", "a &amp; b &#233;", "é café", " x\n\ty ", "AT&T &nosuch; &lt;b&gt;", "plain"]
    got = {r.doc_id: r.normalized for r in queries.QUERIES["source_normalize"](spark, documents(spark, tmp_path, texts)).collect()}
    assert got == {i: None if t is None else tx.normalize(t)[0] for i, t in enumerate(texts)}
    assert (got[2], got[3], got[4]) == ("a & b é", "é café", "x y")
