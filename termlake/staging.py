"""Tables that iterative operators write between their rounds, and joins whose broadcast side is counted first."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that a side of a join may have, as counted, to be broadcast.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only in one local process a temporary one is made where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Rounds:
    """Written tables of one run: a lost executor repeats one round and nothing before it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, first: int, end: int) -> None:
        """Deletes the tables numbered from first to end, the end excluded."""
        for k in range(first, end):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{k}")
            path.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).delete(path, True)

    def last(self, df: DataFrame) -> DataFrame:
        """Writes a result and deletes every table before it."""
        kept = self.write(df)
        self.drop(1, self.count)
        return kept


def small_side(written: DataFrame, row_bytes: int = 160) -> DataFrame:
    """A written table with a broadcast hint if its counted rows are within the bound; beyond it the join shuffles."""
    return written.hint("broadcast") if written.count() * row_bytes <= BROADCAST_BYTES else written


def rank_in_groups(df: DataFrame, keys: list[str], order: list[str], rounds: Rounds, name: str = "at") -> DataFrame:
    """df with the place (from 0) of each row in its group, without a group ever being in one task.

    Rows are dealt by ranges of keys and order, so a large group lies in several
    partitions; a row's place is its place in the partition plus the rows of its
    group in the partitions before, which are counted in one row a group and partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    dealt = df.repartitionByRange(parts, *at).sortWithinPartitions(*at)
    rows = rounds.write(dealt.withColumn("_id", F.monotonically_increasing_id()))
    low = (1 << 33) - 1
    rows = rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(F.lit(low)))
    runs = rounds.write(rows.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n")))
    # a group's runs are one row a partition: at most as many as there are partitions
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = rounds.write(runs.select(*keys, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")))
    right = small_side(runs).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_shift")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(right, same).select(*df.columns, (F.col("_row") + F.col("_shift")).alias(name))
