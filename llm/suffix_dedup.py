"""Removal of byte strings that start more than once in a collection.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else
(in any document, the same one included) is removed.  The work follows the
column-wise construction of a collection's Burrows-Wheeler order and common
prefixes: strings stand below each other, each round inserts one symbol of every
string in front of its suffix, the order is updated by one stable sort on the
new symbols, and the common prefix of two neighbours is one more than the
minimum over the range between their old places.  A suffix whose common prefix
with a neighbour reaches LENGTH starts a repeated string.

Running the rounds over whole documents would take as many passes over the
collection as the longest document has bytes.  So the collection is cut first,
exactly:

1. *Anchors.*  Of every window of LENGTH bytes the leftmost least hash of
   ``GRAM`` bytes is an anchor.  Equal windows have equal anchors at equal
   places, so only anchors that occur twice matter, and a window's partners
   are found among the contexts (LENGTH bytes to either side) of its anchor.
2. *Classes.*  Contexts that are equal as a whole are counted before anything
   is moved; in a class of two or more every window repeats, and one
   representative stands for all of them.
3. *Buckets.*  The representatives of one anchor are aligned at the anchor and
   the rounds run over their at most ``2 * LENGTH`` columns; the rows come sorted
   from Spark's shuffle files and are read in sequence.
4. *Refinement.*  An anchor with more than ``MOST`` different contexts is never
   held by a task.  The windows of these contexts are dealt by where they start,
   ``STEPS[0]`` starts at a time, to the bucket of the bytes that all of them
   contain (a longer core).  Rows and cores go through steps 2 and 3 again, as
   digests that Spark counts; a core that still has more than MOST different rows
   is refined by the next step.  With one start at a time the core is the
   window itself and a class of two is a repeat, so this ends, and every bucket
   that a task holds has at most MOST rows, whatever the collection.

Documents are never joined into one string, so matches never cross them.

Defined results: null text is empty; texts shorter than LENGTH keep all bytes;
repeated rows repeat each other; a null id stays null; an empty table gives no
rows; long texts are anchored in segments and cut in batches of their own; other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import Tables, broadcast_if_small, has_twins
from llm.shingles import _MIX, _power, mix64, text_buffer

LENGTH = 400
GRAM = 24
SEGMENT = 1 << 19
#: Different rows of one bucket that a task may hold.
MOST = 1_500
#: Window starts dealt to one core, refinement by refinement; the last must be 1.
STEPS = (126, 18, 3, 1)
#: Rows of whole buckets that a task solves together.
BUCKET_ROWS = 8_000


def _sliding(values: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over every window of w values, in two passes over blocks of w."""
    n = len(values)
    blocks = np.full(-(-n // w) * w, fill, dtype=values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, w)
    head = op.accumulate(blocks, axis=1).ravel()
    tail = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[: n - w + 1], head[w - 1 : n])


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(position, gram hash) of the anchors of all windows of a text, in bounded segments."""
    found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    windows = len(raw) - length + 1
    w = length - gram + 1
    for lo in range(0, max(windows, 0), SEGMENT):
        hi = min(lo + SEGMENT, windows)
        part = raw[lo : hi + length - 1]
        n = len(part)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_MIX[part] * _power("f", n), out=prefix[1:])
        h = mix64((prefix[gram:] - prefix[:-gram]) * _power("i", n - gram + 1))
        least = _sliding(h, w, np.minimum, 2**64 - 1)
        padded = np.zeros(len(least) + 2 * (w - 1), dtype=np.uint64)
        padded[w - 1 : w - 1 + len(least)] = least
        at = np.flatnonzero(h == _sliding(padded, w, np.maximum, 0))
        found_at.append(at + lo)
        found.append(h[at])
    at, h = np.concatenate(found_at), np.concatenate(found)
    if windows > SEGMENT:
        at, first = np.unique(at, return_index=True)
        h = h[first]
    return at, h


def _before(length: int, gram: int) -> int:
    return length - gram


def _anchor_rows(length: int, gram: int):
    before = _before(length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            raw, off = text_buffer(batch.column("text"))
            hs, ats, ones, twos, count = [], [], [], [], [0]
            for i in range(batch.num_rows):
                text = raw[off[i] : off[i + 1]]
                at, h = anchors(text, length, gram)
                count.append(count[-1] + len(at))
                hs.append(h.view(np.int64))
                ats.append(at.astype(np.int32))
                whole = text.tobytes() if len(at) else b""
                for p in at.tolist():
                    lo = max(0, p - before)
                    d = hashlib.blake2b(whole[lo : p + length], digest_size=16, salt=(p - lo).to_bytes(4, "little")).digest()
                    ones.append(int.from_bytes(d[:8], "little", signed=True))
                    twos.append(int.from_bytes(d[8:], "little", signed=True))
            offsets = pa.array(np.array(count, dtype=np.int32))
            lists = [np.concatenate(hs), np.array(ones, np.int64), np.array(twos, np.int64), np.concatenate(ats)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(rid, rid + batch.num_rows)), batch.column("doc_id"), batch.column("mark"), *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in lists]],
                ["rid", "doc_id", "mark", "h", "f1", "f2", "at"],
            )
            rid += batch.num_rows

    return run


def _contexts(length: int, span: int):
    """(bucket, rid, base, pin, bytes): for each wanted place the bytes of the up to span windows that start there or before.

    The bucket is the digest of the core, the bytes that all of these windows contain.
    """
    salt = span.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column("text"))
            rows: list[tuple] = []
            size = 0
            for i, (rid, wanted) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
                text = raw[off[i] : off[i + 1]].tobytes()
                for at in wanted:
                    lo, hi = max(0, at - span + 1), min(len(text), at + length)
                    core = hashlib.blake2b(text[at : at + length - span + 1], digest_size=16, salt=salt).digest()
                    rows.append((core, rid, lo, at - lo, text[lo:hi]))
                    size += hi - lo
                    if size > 4 << 20:
                        yield _context_batch(rows)
                        rows, size = [], 0
            if rows:
                yield _context_batch(rows)

    return run


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["bucket", "rid", "base", "pin", "bytes"])


def _refined(length: int, span: int, step: int):
    """(rid, h, f1, f2, at): the windows that start at a wanted place or up to span - 1 before it, step starts at a time.

    h is a digest of the core of these windows, f1 and f2 of their bytes and the core's place in them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column("text"))
            rids, ats, digests = [], [], []
            for i, (rid, wanted) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
                text = raw[off[i] : off[i + 1]].tobytes()
                for c in sorted({c for at in wanted for c in range(at, max(at - span, -1), -step)}):
                    lo, hi = max(0, c - step + 1), min(len(text), c + length)
                    if hi - lo >= length and c + length - step < len(text):
                        digests.append(hashlib.blake2b(text[c : c + length - step + 1], digest_size=8).digest())
                        digests.append(hashlib.blake2b(text[lo:hi], digest_size=16, salt=(c - lo).to_bytes(4, "little")).digest())
                        rids.append(rid)
                        ats.append(c)
            d = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), *[pa.array(d[:, k]) for k in range(3)], pa.array(ats, pa.int32())], ["rid", "h", "f1", "f2", "at"])

    return run


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo..hi], both ends included, from a table of power-of-two ranges."""
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), dtype=values.dtype)
    table, k, top = values, 0, int(level.max(initial=0))
    while True:
        here = level == k
        if here.any():
            out[here] = np.minimum(table[lo[here]], table[hi[here] - (1 << k) + 1])
        if k == top:
            return out
        table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
        k += 1


def repeated_starts(strings: list[bytes], pins: list[int], group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each string and column, whether a window of length bytes that starts there also starts at
    that column of another string of its group.

    Strings are aligned at their pins.  Returns booleans [string, column]; column c is byte
    c - (max(pins) - pin) of a string.
    """
    m, left = len(strings), max(pins)
    width = max(left - p + len(s) for s, p in zip(strings, pins, strict=True))
    cells = np.full((width, m), 256, dtype=np.uint16)
    for i, (s, p) in enumerate(zip(strings, pins, strict=True)):
        cells[left - p : left - p + len(s), i] = np.frombuffer(s, dtype=np.uint8)
    starts = width - length + 1
    out = np.zeros((m, max(starts, 0)), dtype=bool)
    order = np.argsort(group, kind="stable")
    base = group.astype(np.int64) * 257
    common = np.full(m, length, dtype=np.int16)  # of a string with the one before it; the empty suffixes are equal
    place = np.arange(m)
    for c in range(width - 1, -1, -1):
        symbol = cells[c, order]
        key = base[order] + symbol
        moved = key[1:] < key[:-1]
        if moved.any():
            place = np.argsort(key, kind="stable")
            order, key, symbol = order[place], key[place], symbol[place]
            joined = (key[1:] == key[:-1]) & (symbol[1:] < 256)
            now = np.zeros(m, dtype=np.int16)
            j = np.flatnonzero(joined) + 1
            if len(j):
                now[j] = np.minimum(_range_min(common, place[j - 1] + 1, place[j]) + 1, length)
            if c == width - 1:
                now[j] = 1
            common = now
        else:
            joined = np.concatenate(([False], (key[1:] == key[:-1]) & (symbol[1:] < 256)))
            common = np.where(joined, 1 if c == width - 1 else np.minimum(common + 1, length), 0).astype(np.int16)
        if c < starts:
            full = common >= length
            hit = full.copy()
            hit[:-1] |= full[1:]
            out[order[hit], c] = True
    return out


def _buckets(length: int):
    def solve(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        names = [r[0] for r in rows]
        group = np.cumsum(np.array([0, *[a != b for a, b in zip(names, names[1:], strict=False)]]))
        sizes = np.bincount(group)
        keep = np.flatnonzero(sizes[group] > 1)
        if not len(keep):
            return
        rows = [rows[i] for i in keep]
        pins = [r[3] for r in rows]
        hits = repeated_starts([r[4] for r in rows], pins, group[keep], length)
        left = max(pins)
        edges = np.diff(np.pad(hits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        who, first = np.nonzero(edges == 1)
        _, last = np.nonzero(edges == -1)
        for i, a, b in zip(who.tolist(), first.tolist(), last.tolist(), strict=True):
            at = rows[i][2] - (left - pins[i])
            yield rows[i][1], at + a, at + b - 1 + length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["rid", "a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "rid", "base", "pin", "bytes")), strict=True):
                if len(held) >= BUCKET_ROWS and held[-1][0] != row[0]:
                    out += solve(held)
                    held = []
                held.append(row)
            if len(out) > 10_000:
                yield batch_of()
                out = []
        out += solve(held) if held else []
        if out:
            yield batch_of()

    return run


def _with_lists(source: DataFrame, lists: DataFrame, items: str, how: str) -> DataFrame:
    lists = broadcast_if_small(lists, items)
    on = source.doc_id.eqNullSafe(lists.fetch_id) & (source.mark == lists.fetch_mark)
    return source.join(lists, on, how).drop("fetch_id", "fetch_mark")


def repeated_spans(docs: DataFrame, tables: Tables, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """fetch_id, fetch_mark (doc_id and text hash) and spans array<struct<a long, b long>> of removed byte runs, for documents that have any."""
    base = tables.write(docs.mapInArrow(_anchor_rows(length, gram), "rid long, doc_id long, mark long, h array<long>, f1 array<long>, f2 array<long>, at array<int>"))
    names = base.select("rid", F.col("doc_id").alias("fetch_id"), F.col("mark").alias("fetch_mark"))
    twins = has_twins(base)
    cells = base.select("rid", F.explode(F.arrays_zip("h", "f1", "f2", "at")).alias("x")).select("rid", "x.h", "x.f1", "x.f2", "x.at")
    twice = tables.write(cells.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    cells = tables.write(cells.join(broadcast_if_small(twice), "h").select("rid", "h", "f1", "f2", "at"))

    def fetched(wanted: DataFrame) -> DataFrame:
        """text, rid and the list of wanted places of every document that has any."""
        lists = tables.write(wanted.groupBy("rid").agg(F.collect_list("at").alias("wanted")).join(names, "rid"))
        found = _with_lists(docs, lists, "wanted", "inner").select("text", "rid", "wanted")
        return found.groupBy("rid").agg(F.min("text").alias("text"), F.min("wanted").alias("wanted")) if twins else found

    repeats, contexts, span = [], [], length - gram + 1
    for step in (*(x for x in STEPS if x < span), 0):
        classes = tables.write(cells.groupBy("h", "f1", "f2").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("first")))
        several = tables.write(classes.where("n > 1").select("h", "f1", "f2"))
        equal = cells.join(broadcast_if_small(several), ["h", "f1", "f2"], "left_semi")
        repeats.append(equal.select("rid", F.greatest(F.col("at") - (span - 1), F.lit(0)).cast("long").alias("a"), (F.col("at") + length).cast("long").alias("b")))
        if span == 1:
            break
        kinds = tables.write(classes.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"))
        wanted = classes.join(broadcast_if_small(kinds), "h").select("first.rid", "first.at", "kinds")
        contexts.append(fetched(wanted.where(F.col("kinds") <= most)).mapInArrow(_contexts(length, span), "bucket binary, rid long, base long, pin int, bytes binary"))
        if kinds.where(F.col("kinds") > most).isEmpty():
            break
        refined = fetched(wanted.where(F.col("kinds") > most)).mapInArrow(_refined(length, span, step), "rid long, h long, f1 long, f2 long, at int")
        cells, span = tables.write(refined), step
    parts = reduce(DataFrame.unionByName, contexts).repartition("bucket").sortWithinPartitions("bucket", "rid", "base").mapInArrow(_buckets(length), "rid long, a long, b long")

    by_doc = Window.partitionBy("rid").orderBy("a", "b")
    spans = reduce(DataFrame.unionByName, [*repeats, parts])
    seen = spans.withColumn("past", F.max("b").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)))
    runs = seen.withColumn("run", F.sum(F.when(F.col("a") <= F.col("past"), 0).otherwise(1)).over(by_doc))
    merged = runs.groupBy("rid", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    lists = merged.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans")).join(names, "rid")
    return tables.last(lists.groupBy("fetch_id", "fetch_mark").agg(F.min("spans").alias("spans")) if twins else lists.drop("rid"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = text_buffer(batch.column("text"))
        lo = 0
        while lo < batch.num_rows:
            hi = lo + 1
            while hi < batch.num_rows and off[hi + 1] - off[lo] <= 4 << 20:
                hi += 1
            kept, removed, count = [], [], []
            for i in range(lo, hi):
                text = raw[off[i] : off[i + 1]].tobytes()
                spans = [(x["a"], min(x["b"], len(text))) for x in batch.column("spans")[i].as_py() or ()]
                at, out = 0, []
                for a, b in spans:
                    out.append(text[at:a])
                    at = b
                kept.append(b"".join([*out, text[at:]]))
                removed.append(len(text) - len(kept[-1]))
                count.append(len(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array(off[lo + 1 : hi + 1] - off[lo:hi]), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )
            lo = hi


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for every row of docs."""
    if not 0 < gram <= length:
        raise ValueError("gram must be from 1 to length")
    tables = Tables(docs.sparkSession, "suffix")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    spans = repeated_spans(source, tables, length, gram, most)
    return _with_lists(source, spans, "spans", "left").select("doc_id", "text", "spans").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
