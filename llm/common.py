"""What the operators share: tables in the shared folder and streams of groups."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


#: Bytes that a side of a join may have, as counted, to be broadcast.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the setting is absent and the master is one local process (tests,
    the bench) a new temporary folder is made and set on the session; on a
    cluster an absent setting is an error, as executors would write to disks
    of their own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            where = known.get()
        elif re.match(r"local(\[|$)", context.master):
            where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Tables:
    """Intermediate tables of one query, written once to the shared folder.

    A written table cuts the lineage: when an executor is lost, later stages
    read the files again and nothing before them is repeated.  :meth:`last`
    writes the one table that a result still reads and deletes the others.
    """

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
        """Writes df and deletes every table written before."""
        kept = self.write(df)
        self.drop(1, self.count)
        return kept


def broadcast_if_small(df: DataFrame, items: str | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast only when the counted bytes of a written table are within the bound; else the join shuffles.

    A row counts 64 bytes, 16 for a number and 80 for a string (digests and names
    only), as measured of broadcast tables; items names an array column, whose
    elements count 8 bytes each.
    """
    width = 64 + sum(80 if kind in ("string", "binary") else 16 for _, kind in df.dtypes)
    row = df.agg(F.count("*").alias("n"), *([F.sum(F.size(items).cast("long")).alias("i")] if items else [])).first()
    return df.hint("broadcast") if row.n * width + 8 * ((row.i or 0) if items else 0) <= most else df


def without_rows(docs: DataFrame, id_col: str, text_col: str, gone: DataFrame) -> DataFrame:
    """docs less the rows whose id and text hash are in gone (a written table of doc_id and mark); null ids are compared like values."""
    gone = broadcast_if_small(gone.select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")))
    same = docs[f"`{id_col}`"].cast("long").eqNullSafe(gone.gone_id) & (F.xxhash64(docs[f"`{text_col}`"]) == gone.gone_mark)
    return docs.join(gone, same, "left_anti")


def has_twins(rows: DataFrame) -> bool:
    """Whether two rows have equal doc_id and mark (text hash): a fetch by these then finds both."""
    return not rows.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, as tables; the rows must be sorted by the keys.

    A group may reach over several Arrow batches; only one group is held.
    """
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).combine_chunks() for k in keys]
        rows = list(zip(*[c.to_pylist() for c in columns], strict=True))
        lo = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[lo]:
                part = table.slice(lo, i - lo)
                if rows[lo] != last and held:
                    yield pa.concat_tables(held)
                    held = []
                held.append(part)
                last = rows[lo]
                lo = i
    if held:
        yield pa.concat_tables(held)
