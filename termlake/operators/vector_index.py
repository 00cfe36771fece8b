"""A partitioned index of vectors: nearest rows by cosine without a look at every row.

Cells are fitted by k-means on a bounded sample: the ``SAMPLE`` rows of least id hash
(documented bound; every row is indexed).  An index is a written table of unit
vectors with their cell and part; a part has about ``PART_ROWS`` rows, so a cell that very
many rows fall into is split over tasks.  A search sends each asked vector to the
``probes`` nearest cells and scores the parts of those cells by one matrix product each,
keeping the best of a part before the next shuffle.

How many cells have to be searched is calibrated on the sample for a wanted recall
(:meth:`VectorIndex.probes`); ``recall`` holds the index against exact search.  Exact search is
:func:`termlake.operators.resolve.vector_signal`.

Defined results: null vectors, vectors without length or with another dimension
than most of the sample, and null ids are left out; ties are broken by id; repeated rows
are repeated; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlake.staging import Rounds

SAMPLE = 20_000
CELL_ROWS = 1_000
MOST_CELLS = 4_096
STEPS = 12
PART_ROWS = 4_000


def _unit(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of usable vectors, and the vectors at unit length."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.flatnonzero(np.asarray(column.is_valid()) & (lengths == d))
    block = values[starts[rows][:, None] + np.arange(d)] if len(rows) else np.zeros((0, d))
    norm = np.linalg.norm(block, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], block[good] / norm[good, None]


def fit_cells(sample: np.ndarray, cells: int, steps: int = STEPS) -> np.ndarray:
    """Unit centres of spherical k-means; first centres are spread over the sample, empty cells keep theirs."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(steps):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1)
        centres[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centres


def cell_ranks(sample: np.ndarray, centres: np.ndarray, most: int = 16, asked: int = 500) -> np.ndarray:
    """For sample vectors and their nearest others in the sample: how many cells are nearer than the one the other lies in, sorted."""
    queries = sample[:asked]
    near = queries @ sample.T
    near[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(most, len(sample) - 1)]
    order = np.argsort(np.argsort(-(queries @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")
    cells = np.argmax(sample @ centres.T, axis=1)
    return np.sort(np.take_along_axis(order, cells[best], 1).ravel())


@dataclass
class VectorIndex:
    centres: np.ndarray
    ranks: np.ndarray
    rows: DataFrame
    parts: DataFrame

    def probes(self, recall: float) -> int:
        """The least number of cells to search that finds the share of the nearest vectors, as calibrated on the sample."""
        return int(self.ranks[min(len(self.ranks) - 1, int(np.ceil(recall * len(self.ranks))))]) + 1 if len(self.ranks) else len(self.centres)


def build(vectors: DataFrame, id_col: str = "concept_id", vector_col: str = "embedding", sample: int = SAMPLE, rounds: Rounds | None = None) -> VectorIndex | None:
    """The index of all rows; None where no row can be indexed."""
    rounds = rounds or Rounds(vectors.sparkSession, "vectors")
    v = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    taken = v.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    taken = taken if isinstance(taken, pa.Array) else pa.concat_arrays(taken.chunks)
    sizes = Counter(n for n in taken.value_lengths().to_pylist() if n)
    if not sizes:
        return None
    d = max(sizes, key=lambda n: (sizes[n], n))
    units = _unit(taken, d)[1]
    if not len(units):
        return None
    count = v.count()
    centres = fit_cells(units, max(1, min(MOST_CELLS, len(units), int(np.sqrt(count)), -(-count // CELL_ROWS) * 8)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit = _unit(batch.column("v"), d)
            if len(rows):
                cell = np.argmax(unit @ centres.T, axis=1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * d, pa.int32()), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(cell, pa.int32()), flat], ["id", "cell", "v"])

    schema = T.StructType([v.schema["id"], T.StructField("cell", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    placed = rounds.write(v.mapInArrow(place, schema))
    parts = placed.groupBy("cell").agg(F.expr(f"CAST(count(*) div {PART_ROWS} + 1 AS INT)").alias("parts"))
    parts = rounds.write(parts)
    rows = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")
    return VectorIndex(centres, cell_ranks(units, centres), rounds.write(rows), parts)


def search(index: VectorIndex, asked: DataFrame, most: int, probes: int, id_col: str = "proposal_id", vector_col: str = "query_embedding") -> DataFrame:
    """id_col, concept_id, semantic: for each asked vector the most nearest rows of the probed cells."""
    centres = index.centres
    d = centres.shape[1]

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit = _unit(batch.column("q"), d)
            if len(rows):
                k = min(probes, len(centres))
                cells = np.argpartition(-(unit @ centres.T), k - 1, axis=1)[:, :k]
                each = np.repeat(np.arange(len(rows)), k)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1) * d, pa.int32()), pa.array(unit[each].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(rows[each])), pa.array(cells.ravel(), pa.int32()), flat], [id_col, "cell", "q"])

    key = asked.schema[id_col]
    q = asked.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(id_col, F.col(vector_col).cast("array<double>").alias("q"))
    aimed = q.mapInArrow(aim, T.StructType([key, T.StructField("cell", T.IntegerType()), T.StructField("q", T.ArrayType(T.DoubleType()))]))
    aimed = aimed.join(F.broadcast(index.parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    key_type = T.StructType([key, T.StructField("concept_id", index.rows.schema["id"].dataType), T.StructField("semantic", T.DoubleType())])

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).reshape(-1, d)

    def score(group: pa.Table, known: pa.Table) -> pa.Table:
        names = [id_col, "concept_id", "semantic"]
        if not group.num_rows or not known.num_rows:
            return pa.table([group.column(id_col).slice(0, 0), known.column("id").slice(0, 0), pa.array([], pa.float64())], names)
        known = known.sort_by("id")
        value, asks, out = matrix(known.column("v")), matrix(group.column("q")), []
        for lo in range(0, len(asks), 1_000):
            near = asks[lo : lo + 1_000] @ value.T
            best = np.argsort(-near, axis=1, kind="stable")[:, :most]
            each = pa.array(np.repeat(np.arange(lo, lo + len(near)), best.shape[1]))
            out.append(pa.table([group.column(id_col).take(each), known.column("id").take(pa.array(best.ravel())), pa.array(np.take_along_axis(near, best, 1).ravel())], names))
        return pa.concat_tables(out)

    found = aimed.groupBy("cell", "part").cogroup(index.rows.groupBy("cell", "part")).applyInArrow(score, key_type)
    from termlake.operators.resolve import top

    return top(found, [id_col], [F.desc("semantic"), F.col("concept_id")], most)


def recall(found: DataFrame, exact: DataFrame, id_col: str = "proposal_id") -> DataFrame:
    """asked, hits, recall: what share of the exact pairs the index found."""
    both = exact.select(id_col, "concept_id").join(found.select(id_col, "concept_id").distinct().withColumn("hit", F.lit(1)), [id_col, "concept_id"], "left")
    return both.agg(F.countDistinct(id_col).alias("asked"), F.count("hit").alias("hits"), (F.count("hit") / F.nullif(F.count("*"), F.lit(0))).alias("recall"))


