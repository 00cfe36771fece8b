"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are word sequences (letters and digits, lower
case).  Karp-Rabin fingerprints of every run of ``SEED_WORDS`` words are joined
between documents and benchmark; seeds on one diagonal are run together into
maximal matches.  The longest match of words not yet marked is marked again and
again, in document and item, so matches never overlap and their order does not
matter: a passage whose sentences were moved is covered all the same.  A
document is contaminated by an item when the tiles cover at least
``PERCENT`` per cent of the item's words.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words, counted by
the same rule as the words that are matched (an item of more words is a block of
its own), so what is sent to the executors and held by the driver at a time has
a fixed bound; each block is one pass over the documents without a shuffle, and
its findings are written before the next block is fetched.

Defined results: null text has no words; items of fewer than SEED_WORDS words
can't be told from chance and match nothing; repeated rows of documents are
judged each, repeated rows of the benchmark count once; of equally long tiles
the one with the least place in document and item is marked first; one row for
each contaminated document and item, none for clean documents; empty tables give
no rows; long texts are hashed in numpy as a whole; other columns, whatever
their names, are left out.  :func:`decontaminated` judges rows and not ids: a
clean row that shares its id with a contaminated one stays, a contaminated row
without an id goes.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import Tables, without_rows
from llm.shingles import PUNCTUATION, combine, text_words

SEED_WORDS = 5
PERCENT = 50
BLOCK_WORDS = 2_000_000
#: Hash places a block, by which the benchmark is dealt into blocks.
FINE = 64
#: The words of Seeds as a regular expression: runs of letters, digits and non-ASCII characters.
ITEM_WORD = r"[0-9A-Za-z[^\x00-\x7F]]+"
SCHEMA = "doc_id long, mark long, item_id long, n_covered long, n_item_words long, n_tiles long"


class Seeds:
    """The fingerprints of a benchmark block, sorted, with item and position of each."""

    def __init__(self, ids: list[int | None], texts: list[str | None], k: int = SEED_WORDS):
        self.k = k
        self.ids = ids
        words = [w for _, w in text_words(pa.array(texts, pa.large_string()), gap=PUNCTUATION)]
        self.size = [len(w) for w in words]
        grams = [combine(w, k) if len(w) >= k else w[:0] for w in words]
        h = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)])
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.at = h[order], item[order], at[order]
        bits = max(16, int(len(h)).bit_length() + 4)
        self.mask = np.uint64((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[(self.h & self.mask).astype(np.int64)] = True

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in the document, item, position in the item) of every shared run of k words."""
        none = np.zeros(0, dtype=np.int64)
        if len(words) < self.k or not len(self.h):
            return none, none, none
        g = combine(words, self.k)
        i = np.flatnonzero(self.seen[(g & self.mask).astype(np.int64)])
        lo = np.searchsorted(self.h, g[i], side="left")
        count = np.searchsorted(self.h, g[i], side="right") - lo
        if not count.any():
            return none, none, none
        row = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        return np.repeat(i, count), self.item[row], self.at[row]


def tile(i: np.ndarray, j: np.ndarray, n_doc: int, n_item: int, k: int) -> tuple[int, int]:
    """Greedy tiling from seeds (i, j): words of the item covered and the number of tiles."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    breaks = np.flatnonzero((np.diff(i - j) != 0) | (np.diff(i) != 1)) + 1
    first = np.concatenate(([0], breaks))
    run = np.diff(np.concatenate((first, [len(i)])))
    heap = [(-int(r) - k + 1, int(i[f]), int(j[f])) for f, r in zip(first, run, strict=True)]
    heapq.heapify(heap)
    doc, item, tiles = np.zeros(n_doc, dtype=bool), np.zeros(n_item, dtype=bool), 0
    while heap:
        size, a, b = heapq.heappop(heap)
        size = -size
        taken = doc[a : a + size] | item[b : b + size]
        if not taken.any():
            doc[a : a + size] = item[b : b + size] = True
            tiles += 1
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
        for lo, hi in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            if hi - lo >= k:
                heapq.heappush(heap, (lo - hi, a + lo, b + lo))
    return int(item.sum()), tiles


def covered(seeds: Seeds, words: np.ndarray, percent: int) -> list[tuple[int, int, int]]:
    """(item, words covered, tiles) of the items that contaminate a document."""
    i, item, j = seeds.hits(words)
    if not len(i):
        return []
    by_item: dict[int, list[int]] = defaultdict(list)
    for at, x in enumerate(item.tolist()):
        by_item[x].append(at)
    out = []
    for x, rows in by_item.items():
        n = seeds.size[x]
        reach = np.zeros(n + 1, dtype=np.int64)
        np.add.at(reach, j[rows], 1)
        np.add.at(reach, j[rows] + seeds.k, -1)
        if 100 * np.count_nonzero(np.cumsum(reach)[:n]) < percent * n:
            continue
        lo = int(i[rows].min())
        count, tiles = tile(i[rows] - lo, j[rows], int(i[rows].max()) - lo + seeds.k, n, seeds.k)
        if 100 * count >= percent * n:
            out.append((x, count, tiles))
    return out


def _scan(seeds: Seeds, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids, marks = batch.column("doc_id"), batch.column("mark")
            for at, words in text_words(batch.column("text"), gap=PUNCTUATION):
                for x, count, tiles in covered(seeds, words, percent):
                    rows.append((ids[at].as_py(), marks[at].as_py(), seeds.ids[x], count, seeds.size[x], tiles))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    return run


def _blocks(items: DataFrame) -> Iterator[list]:
    """The distinct rows of a benchmark in blocks of at most BLOCK_WORDS words, one fetched at a time.

    Rows are dealt by hash to FINE places a block, whose words are counted;
    neighbouring places make a block as long as it stays within the bound.
    """
    sized = items.distinct().withColumn("n", F.regexp_count("text", F.lit(ITEM_WORD)))
    words = sized.agg(F.sum("n").alias("n")).first().n or 0
    places = FINE * -(-words // BLOCK_WORDS)
    if not places:
        return
    while True:
        place = F.pmod(F.xxhash64("item_id", "text"), F.lit(places))
        counts = sized.groupBy(place.alias("place")).agg(F.sum("n").alias("n"), F.count("*").alias("rows")).orderBy("place").collect()
        if all(c.rows == 1 or c.n <= BLOCK_WORDS for c in counts):
            break
        places *= 2
    first, size = None, 0
    for c, after in zip(counts, [*counts[1:], None], strict=True):
        first, size = c.place if first is None else first, size + c.n
        if after is None or size + after.n > BLOCK_WORDS:
            yield sized.where(place.between(first, c.place)).select("item_id", "text").collect()
            first, size = None, 0


def _findings(docs: DataFrame, benchmark: DataFrame, percent: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    spark = docs.sparkSession
    tables = Tables(spark, "tiling")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    out = spark.createDataFrame([], SCHEMA)
    for block in _blocks(items):
        seeds = Seeds([r.item_id for r in block], [r.text for r in block])
        out = out.unionByName(tables.write(rows.mapInArrow(_scan(seeds, percent), SCHEMA)))
    return out


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, n_covered, n_item_words, n_tiles of every contaminated document and item."""
    return _findings(docs, benchmark, percent, id_col, text_col, item_col, item_text_col).drop("mark")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that no benchmark item contaminates."""
    found = _findings(docs, benchmark, PERCENT, id_col, text_col, "item_id", "text")
    return without_rows(docs, id_col, text_col, found.select("doc_id", "mark").distinct())
