"""Token-id output: ids in files of checksummed, context-mixed blocks, in order of doc_id, and back.

Rows are dealt by ranges of (doc_id, text hash), so a document id that very many rows
carry is split too, and sorted in each part; a task encodes its texts, appends the end
id and writes frames of at most ``FRAME`` ids (:mod:`llm.token_coding`).  Spark's own
text writer writes the frames as they are, one a line, so lost tasks are repeated
and committed by Spark.  Files are read whole, one frame decoded at a time; starts
are sums over the files before, one row a file.

Defined results: a null text is empty (the end id alone); null ids come first;
rows of one id follow the hash of their text; repeated rows are all written; an
empty table gives no files and no rows; texts of any length are encoded whole
and may go over several frames; other columns, whatever their names, are left
out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm import token_coding
from llm.common import Tables, broadcast_if_small
from llm.units import Encoder, TokenizersTexts, tokenizer_path, worker_encoder

MODEL = "byte_bpe_50k.json"
END_ID = 0
#: Bytes of text a file has, about.
FILE_BYTES = 48 << 20
#: Bytes of text that are encoded at once.
COLUMN_BYTES = 16 << 20
FRAME = token_coding.LANES * token_coding.BLOCK
_ROW = 64


def _ids(ids: list[int]) -> np.ndarray:
    return np.array(ids, dtype=np.uint32)


def _encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple[int | None, np.ndarray]]:
    """Document id and ids of every row."""
    for batch in batches:
        docs, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        if not isinstance(encoder.units, TokenizersTexts):
            yield from ((doc, np.concatenate([_ids([]), *kept])) for doc, (_, kept) in zip(docs, encoder.texts(texts), strict=True))
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
        lo = 0
        while lo < len(docs):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + COLUMN_BYTES, "right")))
            ids, each = encoder.units.encode_column(texts.slice(lo, hi - lo))
            yield from zip(docs[lo:hi], np.split(ids, np.cumsum(each)[:-1]), strict=True)
            lo = hi


def _frames(name: str, path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path or tokenizer_path(name), _ids)
        held: list[np.ndarray] = []
        pieces: list[tuple[int | None, int, bool]] = []
        room = FRAME

        def frame() -> pa.RecordBatch:
            ids = np.concatenate(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([token_coding.encode(ids, pieces)], pa.binary())], ["value"])

        for doc, own in _encoded(batches, encoder):
            ids = np.concatenate([own, _ids([end_id])])
            while len(ids) > room:
                held.append(ids[:room])
                pieces.append((doc, room, True))
                yield frame()
                ids, pieces, room = ids[room:], [], FRAME
            held.append(ids)
            pieces.append((doc, len(ids), False))
            room -= len(ids)
            if not room:
                yield frame()
                pieces, room = [], FRAME
        if held:
            yield frame()

    return run


def write_token_files(
    docs: DataFrame, out: str, tokenizer: str = MODEL, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> None:
    """Writes the ids of every text, in ascending order of its id, to files below out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + _ROW).alias("n")).first().n or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("mark").asc_nulls_first()]
    dealt = rows.repartitionByRange(size // FILE_BYTES + 1, *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(_frames(tokenizer, path, end_id), "value binary").select(F.col("value").cast("string")).write.text(out)


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                raw, at, start, crc, count, whole = memoryview(content.as_buffer()), 0, 0, 0, 0, []
                while at < len(raw):
                    ids, pieces, at = token_coding.decode(raw, at)
                    if bytes(raw[at : at + 1]) != b"\n":
                        raise ValueError(f"the frame before {at} has no end")
                    at += 1
                    out, lo = [], 0
                    for doc, n, on in pieces:
                        part = ids[lo : lo + n].astype("<u4")
                        lo += n
                        crc, count = zlib.crc32(part.tobytes(), crc), count + n
                        if with_ids:
                            whole.append(part)
                        if not on:
                            out.append((file, doc, start, count, crc, np.concatenate(whole) if with_ids else None))
                            start, crc, count, whole = start + count, 0, 0, []
                    if out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.list_(pa.int64())], strict=True)],
                            ["file", "doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                        )

    return run


def read_token_files(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """file, doc_id, start (in its file), n_tokens, ids_crc32, ids (null unless wanted) of every document in the files."""
    files = spark.read.format("binaryFile").load(out).where("length > 0")
    files = files.select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long").alias("file"), "content")
    return files.mapInArrow(_documents(with_ids), "file long, doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def token_files_round_trip(docs: DataFrame, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, as read back from the files that were written."""
    spark = docs.sparkSession
    tables = Tables(spark, "token-files")
    out = f"{tables.base}/ids"
    write_token_files(docs, out, **options)
    told = tables.write(read_token_files(spark, out).drop("ids"))
    sizes = told.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    begin = broadcast_if_small(tables.write(sizes.select("file", F.coalesce(before, F.lit(0)).alias("begin"))))
    return told.join(begin, "file").select("doc_id", (F.col("begin") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
