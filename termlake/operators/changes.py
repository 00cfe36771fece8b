"""Added, changed and gone rows between two snapshots, read only where their checksums differ.

A snapshot is a folder of buckets by the hash of the key, with a manifest: rows and
two order-free checksums (sums of 64-bit row hashes) of each bucket.  Two
snapshots are compared by their manifests, a row a bucket; only buckets that differ
are read, by a partition filter, so the cost is that of what changed.

Defined results: rows with equal keys are compared as a whole (their number and the
sum of their hashes); null keys are keys; columns are hashed in order of their names,
so their order does not matter; snapshots with different columns or numbers of
buckets are refused; empty snapshots have no buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def _hashes(columns: list[str]) -> tuple[Column, Column]:
    cells = [F.col(f"`{c}`") for c in sorted(columns)]
    marks = [c.isNull() for c in cells]
    return F.xxhash64(*cells, *marks), F.xxhash64(F.lit("second"), *reversed(cells), *marks)


def _sums(columns: list[str]) -> list[Column]:
    one, two = _hashes(columns)
    return [F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("sum_1"), F.sum(two.cast("decimal(38,0)")).alias("sum_2")]


def write_snapshot(rows: DataFrame, keys: list[str], path: str, buckets: int = BUCKETS) -> None:
    """Writes rows in buckets below path, and the manifest of the buckets last: a snapshot without manifest is not whole."""
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")
    rows.withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(f"{path}/rows")
    written = rows.sparkSession.read.schema(rows.withColumn("_bucket", bucket).schema).parquet(f"{path}/rows")
    manifest = written.groupBy("_bucket").agg(*_sums(rows.columns)).withColumn("buckets", F.lit(buckets)).withColumn("columns", F.lit(",".join(sorted(rows.columns))))
    manifest.coalesce(1).write.parquet(f"{path}/manifest")


def differing_buckets(spark: SparkSession, old: str, new: str) -> list[int]:
    """The buckets whose contents differ, from the manifests alone (a row a bucket)."""
    a, b = (spark.read.parquet(f"{p}/manifest") for p in (old, new))
    kinds = a.select("buckets", "columns").unionByName(b.select("buckets", "columns")).distinct()
    if kinds.count() > 1:
        raise ValueError("the snapshots have different columns or numbers of buckets")
    both = a.unionByName(b).groupBy("_bucket", "n", "sum_1", "sum_2").agg(F.count("*").alias("sides")).where("sides = 1")
    return sorted(r._bucket for r in both.select("_bucket").distinct().collect())


def _side(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows")
    return rows.where(F.col("_bucket").isin(buckets)).drop("_bucket")


def changed_rows(spark: SparkSession, old: str, new: str, keys: list[str]) -> DataFrame:
    """keys and status (added, changed, gone) of the keys whose rows differ; one shuffle of what the differing buckets hold."""
    buckets = differing_buckets(spark, old, new)
    a, b = _side(spark, old, buckets), _side(spark, new, buckets)
    columns = b.columns or a.columns
    one, two = _hashes(columns)
    told = lambda df, side: df.select(*keys, F.lit(side).alias("_side"), one.alias("_one"), two.alias("_two"))
    of = lambda side, what: F.sum(F.when(F.col("_side") == side, F.col(what).cast("decimal(38,0)")))
    n = lambda side: F.count_if(F.col("_side") == side)
    rows = told(a, 0).unionByName(told(b, 1)).groupBy(*keys)
    counted = rows.agg(n(0).alias("_a"), n(1).alias("_b"), *[of(s, w).alias(f"{w}{s}") for s in (0, 1) for w in ("_one", "_two")])
    same = (F.col("_a") == F.col("_b")) & (F.col("_one0") == F.col("_one1")) & (F.col("_two0") == F.col("_two1"))
    status = F.when(F.col("_a") == 0, "added").when(F.col("_b") == 0, "gone").when(~same, "changed")
    return counted.select(*keys, status.alias("status")).where("status is not null")


def duplicates(rows: DataFrame, id_col: str, content: list[str]) -> DataFrame:
    """id, first: the rows whose content (columns) another row has too, with the least id of the same content; null ids are left out.

    Ids are gathered by a hash of the content, as counts and least ids combined before the shuffle.
    """
    one, two = _hashes(content)
    marked = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), one.alias("one"), two.alias("two"))
    groups = marked.groupBy("one", "two").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return marked.join(groups.select("one", "two", "first"), ["one", "two"]).select("id", "first")
