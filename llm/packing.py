"""Packing: sum-of-squares online packing of documents into token windows.

Each task packs the rows of its partition as they come.  A document longer than
a window first fills whole windows; the remainder is one item.  An item of s
tokens goes to the fill level h (0 is a new window) that gives the least sum of
squared counts of partially filled windows, N(h)^2 over all levels h; the
counts are kept in a level array of one integer a level, so a placement looks
at a window's number of levels and not at the windows.  The pieces of open
windows are held back until their window is full.

When a task's rows end, the fullest open windows keep what they hold and are
filled, in order of their levels, with pieces cut from the emptiest; the last
window is cut into sequences whose lengths are powers of two, which need no padding.
Memory is bounded by the open windows of one task; no row leaves its task, so
there is no shuffle.  Sequence ids carry the partition id in their upper bits;
the packed table is written once, so that ids are stable afterwards.

Defined results: null text is empty (its one id is the end mark); a null id
stays null; repeated rows are packed each; of fill levels with equal costs the
fullest is taken, a new window only where every level costs more; an empty table
gives no rows; long texts are encoded whole, and a task holds the ids of one text
and of its open windows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import Tables
from llm.units import tokenizer_path, worker_encoder

WINDOW = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Sum-of-squares packing of one task's items; a piece is (doc row fields, ids, start, length)."""

    def __init__(self, window: int, first_sequence: int):
        self.window = window
        self.level = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.next = first_sequence
        #: Tokens that were taken out of the window the level array had chosen.
        self.moved = 0
        self.out: list[tuple] = []

    def _emit(self, pieces: list, sequence: int | None = None) -> None:
        sequence = self.next if sequence is None else sequence
        self.next = max(self.next, sequence + 1)
        offset = 0
        for doc, ids, start, length, total in pieces:
            crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
            self.out.append((doc, start, length, crc, total, sequence, offset))
            offset += length

    def add(self, doc: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            self._emit([(doc, ids, start, self.window, total)])
        size = total - whole
        if not size:
            return
        # only the item's own ids are held while its window is open
        piece = (doc, ids, whole, size, total) if not whole else (doc, _Tail(ids, whole), whole, size, total)
        level, w = self.level, self.window
        if level[0]:
            raise AssertionError("level 0 stands for a new window")
        from_ = np.flatnonzero(level[: w - size + 1])
        best, best_cost = 0, 2 * level[size] + 1
        if len(from_):
            to = from_ + size
            cost = 1 - 2 * level[from_] + np.where(to < w, 2 * level[np.minimum(to, w - 1)] + 1, 0)
            k = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[k] <= best_cost:
                best = int(from_[k])
        pieces = []
        if best:
            level[best] -= 1
            pieces = self.open[best].pop()
        pieces.append(piece)
        if best + size == w:
            self._emit(pieces)
        else:
            level[best + size] += 1
            self.open.setdefault(best + size, []).append(pieces)

    def close(self) -> None:
        """Fills the fullest open windows with pieces cut from the emptiest; the last becomes powers of two."""
        windows = [[h, pieces] for h in sorted(self.open, reverse=True) for pieces in self.open[h]]
        self.open, self.level[:] = {}, 0
        first, last = 0, len(windows) - 1
        while first < last:
            room, pieces = self.window - windows[first][0], windows[first][1]
            while room and first < last:
                self.moved += (part := self._cut(windows[last], room, pieces))
                room -= part
                if not windows[last][0]:
                    last -= 1
            if room:
                break
            self._emit(pieces)
            first += 1
        if first == last:
            rest = [sum(p[3] for p in windows[first][1]), windows[first][1]]
            while rest[0]:
                pieces = []
                want = min(self.window, 1 << (rest[0].bit_length() - 1))
                while want:
                    want -= self._cut(rest, want, pieces)
                self._emit(pieces)

    def _cut(self, window: list, room: int, pieces: list) -> int:
        """Moves the first piece of a window, or as much of it as there is room for, to pieces; the tokens moved."""
        doc, ids, start, length, total = window[1][0]
        take = min(room, length)
        pieces.append((doc, ids, start, take, total))
        window[0] -= take
        window[1][:1] = [(doc, ids, start + take, length - take, total)] if take < length else []
        return take


class _Tail:
    """The last ids of a document, addressed like the whole."""

    def __init__(self, ids: bytes, start: int):
        self.ids, self.start = ids[4 * start :], 4 * start

    def __getitem__(self, part: slice) -> bytes:
        return self.ids[part.start - self.start : part.stop - self.start]


def id_bytes(ids: list[int]) -> bytes:
    """Ids as unsigned little-endian 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def _pack(name: str, path: str | None, window: int, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path or tokenizer_path(name), id_bytes)
        packer = Packer(window, TaskContext.get().partitionId() << 36)

        def flush() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            for doc, (_, kept) in zip(batch.column("doc_id").to_pylist(), encoder.texts(batch.column("text")), strict=True):
                packer.add(doc, b"".join(kept) + end)
                if len(packer.out) > 20_000:
                    yield flush()
        packer.close()
        if packer.out:
            yield flush()

    return run


def pack(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return Tables(docs.sparkSession, "packing").write(rows.mapInArrow(_pack(tokenizer, path, window, end_id), SCHEMA))
