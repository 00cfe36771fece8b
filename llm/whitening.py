"""Embedding whitening by TSQR: no covariance matrix of the input is ever formed.

1. One pass sums the integer vectors exactly (whole numbers, no rounding).
2. Each partition centres its rows with these sums and keeps one R factor of a QR
   decomposition, folded block by block, so a task holds one block and one d x d
   triangle.  R factors are merged in a tree, ``FAN`` at a time, each round a
   written table; the last one, d x d, is all that reaches the driver.
3. The right singular vectors of the last R are the components: rows are
   projected on them and divided by the root of the eigenvalue.
4. One more pass gathers the k x k covariance of the whitened rows, whose distance
   from the identity is reported.

No row is shuffled; what is merged is one triangle a partition.

Defined results: a row whose vector is null or holds null or non-finite entries
is left out of the fit and of the result; so is a row whose vector has not the
length that most of the remaining rows have (of equally frequent lengths the
longest).  Entries are cut to +-2^52 before they become integers.  Repeated rows
count and are returned as often as they occur; a null id stays null.  A
component without variance (fewer independent rows than components) has null
whitened values and takes no part in the identity error, which is null if there
is no other.  A deviation that a long cannot hold is null.  An empty table gives
no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import Tables

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: R factors merged by one task of the tree.
FAN = 8
#: Rows folded into R at a time.
BLOCK = 4096
#: Result rows that a task makes at a time.
OUT = 1 << 16
CLIP = float(1 << 52)
_BIG = 1 << 62


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, integer vectors) of the rows without null or non-finite entries, by length."""
    column = batch.column("vector")
    lengths = np.asarray(column.value_lengths().fill_null(0))
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    present = np.asarray(column.is_valid())
    for d in np.unique(lengths[present]):
        rows = np.flatnonzero(present & (lengths == d))
        block = values[starts[rows][:, None] + np.arange(d)]
        good = np.isfinite(block).all(axis=1)
        if good.any():
            yield int(d), rows[good], np.floor(np.clip(block[good] * SCALE, -CLIP, CLIP)).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, k, n, s) for each length d and dimension k; k is -1 for the number of rows alone."""
    counts: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for batch in batches:
        for d, rows, x in _vectors(batch):
            exact = x if np.abs(x).max(initial=0) < _BIG // max(len(x), 1) else x.astype(object)
            counts[d] = counts.get(d, 0) + len(rows)
            sums[d] = [a + int(b) for a, b in zip(sums.get(d, [0] * d), exact.sum(axis=0), strict=True)]
    out = [(d, -1, n, "0") for d, n in counts.items()] + [(d, k, 0, str(s)) for d, row in sums.items() for k, s in enumerate(row)]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["d", "k", "n", "s"])


class Centre:
    """Exact centring: x - S/n is split into a whole part and a rest below one."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.d = n, len(sums)
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def rows(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, x - floor(S/n) as integers, and x - S/n."""
        for d, rows, x in _vectors(batch):
            if d == self.d:
                whole = x - self.whole
                return rows, whole, whole - self.part
        return np.zeros(0, np.int64), np.zeros((0, self.d), np.int64), np.zeros((0, self.d))

    def deviation(self, whole: np.ndarray) -> pa.Array:
        """Sum of (n x - S)^2 over the dimensions, exact."""
        top = self.n * (int(np.abs(whole).max(initial=0)) + 1)
        if self.d * top * top < 1 << 63:
            z = self.n * whole - np.array(self.rest, dtype=np.int64)
            return pa.array((z * z).sum(axis=1), pa.int64())
        z = self.n * whole.astype(object) - np.array(self.rest, dtype=object)
        return pa.array([v if v < 1 << 63 else None for v in map(int, (z * z).sum(axis=1))], pa.int64())


def _triangle(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(parts), mode="r")


def _factors(centre: Centre):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, count = np.zeros((0, centre.d)), [], 0
        for batch in batches:
            y = centre.rows(batch)[2]
            held.append(y)
            count += len(y)
            if count >= BLOCK:
                r, held, count = _triangle([r, *held]), [], 0
        if count:
            r = _triangle([r, *held])
        if len(r):
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    return run


def _merge(d: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("r").to_pylist(), strict=True))
        r = _triangle([np.frombuffer(b).reshape(-1, d) for _, b in rows])
        return pa.table({"part": pa.array([rows[0][0] // FAN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    return run


def tsqr(vectors: DataFrame, centre: Centre, tables: Tables) -> np.ndarray:
    """The R factor of all centred rows: one a partition, merged FAN at a time."""
    rs = tables.write(vectors.select("vector").mapInArrow(_factors(centre), "part long, r binary"))
    parts = vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")
    while (top := rs.agg(F.max("part").alias("m")).first().m) is not None and top > 0:
        width = min(int(parts), top // FAN + 1)
        rs = tables.write(rs.repartition(width, F.expr(f"part div {FAN}")).groupBy(F.expr(f"part div {FAN}").alias("g")).applyInArrow(_merge(centre.d), "part long, r binary"))
    found = rs.select("r").first()
    return np.zeros((0, centre.d)) if found is None else np.frombuffer(found.r).reshape(-1, centre.d)


def _gram(centre: Centre, turn: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = turn.shape[1]
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = centre.rows(batch)[2] @ turn
            total += w.sum(axis=0)
            square += w.T @ w
        at = [(i, j, square[i, j]) for i in range(k) for j in range(k)] + [(i, -1, total[i]) for i in range(k)]
        if at:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*at, strict=True)], ["i", "j", "v"])

    return run


def identity_error(vectors: DataFrame, centre: Centre, turn: np.ndarray) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = turn.shape[1]
    if not k:
        return None
    summed = vectors.select("vector").mapInArrow(_gram(centre, turn), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean, cov = np.zeros(k), np.zeros((k, k))
    for row in summed:
        if row.j < 0:
            mean[row.i] = row.v / centre.n
        else:
            cov[row.i, row.j] = row.v / centre.n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max())


def _whiten(centre: Centre, turn: np.ndarray, shown: int, explained: np.ndarray, error: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, OUT // max(shown, 1))
        for batch in batches:
            rows, whole, y = centre.rows(batch)
            ids = batch.column("vec_id").take(pa.array(rows))
            for lo in range(0, len(rows), step):
                hi = min(lo + step, len(rows))
                m = hi - lo
                white = np.full((m, shown), np.nan)
                white[:, : turn.shape[1]] = y[lo:hi] @ turn
                each = pa.array(np.repeat(np.arange(m), shown))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, m).take(each),
                        pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * shown, centre.n, dtype=np.int64)),
                        centre.deviation(whole[lo:hi]).take(each),
                        pa.array(white.ravel(), from_pandas=True),
                        pa.array(np.tile(explained, m)),
                        pa.array([error] * (m * shown), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every remaining row and component."""
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    tables = Tables(spark, "whitening")
    parts = tables.write(vectors.select("vector").mapInArrow(_sums, "d long, k long, n long, s string"))
    # a row for each length that occurs; only the most frequent one's sums, d numbers, are read
    first = parts.where("k = -1").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if first is None or not first.d:
        tables.drop(1, tables.count + 1)
        return spark.createDataFrame([], RESULT)
    summed = parts.where(f"k >= 0 and d = {first.d}").groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()
    centre = Centre(first.n, [int(r.s) for r in summed])
    r = tsqr(vectors, centre, tables)
    tables.drop(1, tables.count + 1)
    _, s, vt = np.linalg.svd(r)
    s = np.concatenate([s, np.zeros(centre.d - len(s))])
    values = s * s / centre.n
    shown = min(components, centre.d)
    rank = int((s[:shown] > s[0] * max(centre.d, 1) * np.finfo(float).eps).sum()) if s[0] > 0 else 0
    turn = vt[:rank].T / np.sqrt(values[:rank])
    explained = values[:shown] / values.sum() if values.sum() > 0 else np.zeros(shown)
    error = identity_error(vectors, centre, turn)
    return vectors.mapInArrow(_whiten(centre, turn, shown, explained, error), RESULT)
