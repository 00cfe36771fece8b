r"""Spelling variants: words one edit apart, found by a positional q-gram inverted index.

*Words.*  Each task counts the runs of letters of its documents and hands on
one row a distinct word; counts are combined before and after one shuffle.

*Blocks.*  A word is cut into three pieces; one edit leaves two of them as they are,
each at its place or one letter later.  A block is all words of a length that
have two pieces in common (a long positional gram), as its index, with the
words of that length or of one letter less as its queries.  So near words meet
in a block, mostly in one, and few others do.

*Index and count filter.*  Inside a block an inverted index maps each gram to
postings (word, place).  The postings of a query's grams that lie within the
place limit are merged by a heap; a word that is met at least as often as one
edit must leave grams (max length - 2 Q + 1) is kept and verified letter by letter.

A block with more than ``BLOCK_WORDS`` rows is cut into salted parts: each pair of
parts is a block of its own, so no group is unbounded.

Forms are followed to their roots by pointer jumping; n grows tenfold at every
step, so five rounds are enough.

Defined results: a null text has no words; a null id is hashed as an empty
string; repeated rows count as often as they occur; an empty table gives no
rows; words of any length are compared whole; other columns, whatever their
names, are left out.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import Tables, broadcast_if_small

Q = 3
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: How many times as frequent as a word its form is at least.
FACTOR = 10
#: Runs whose hash this number divides lose one letter.
TYPO = 31
#: Words of a block that are indexed in one task.
BLOCK_WORDS = 2_000
#: Pairs handed on at a time.
OUT = 50_000
#: Bytes of words that a task counts before it hands them on.
HELD_BYTES = 32 << 20
_UPPER = {c: c + 32 for c in range(65, 91)}


def typed(doc: str, run: str) -> str:
    """A run, lower-cased, as it was typed in a document: some lose a letter."""
    low = run.lower() if run.isascii() else run.translate(_UPPER)
    h = zlib.crc32(f"{doc}:{low}".encode())
    return low if h % TYPO else low[: h % len(low)] + low[h % len(low) + 1 :]


def _count(least: int):
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc, text in zip(ids, batch.column("text"), strict=True):
                doc = "" if doc is None else str(doc)
                for found, n in Counter(runs.findall(text.as_py() or "")).items():
                    word = typed(doc, found)
                    if len(word) >= least:
                        if word not in total:
                            total[word] = n
                            size += len(word) + 100
                        else:
                            total[word] += n
                if size > HELD_BYTES:
                    yield out()
                    total, size = {}, 0
        if total:
            yield out()

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of all distinct words of the length or more that occur at least LEAST_COUNT times."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_count(least), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def grams(word: str) -> list[str]:
    """A word's q-grams, in order of their places."""
    return [word[i : i + Q] for i in range(len(word) - Q + 1)]


def _pieces(shorter: Column, later: int) -> list[Column]:
    """Hashes of the pairs of pieces of a word, cut where a word of the shorter length is cut; later: letters that it has more."""
    word, size = F.col("word"), F.length("word")
    one, two = (shorter / 3).cast("int"), (shorter * 2 / 3).cast("int")
    head = lambda n: F.substring(word, F.lit(1), n)
    tail = lambda n: F.substring(word, n + later + 1, size)
    return [
        F.xxhash64(F.lit(2), shorter, head(two)),
        F.xxhash64(F.lit(1), shorter, head(one), tail(two)),
        F.xxhash64(F.lit(0), shorter, tail(one)),
    ]


def blocks(words: DataFrame) -> DataFrame:
    """(key, role, word, n): the blocks of each word; role 1 indexes and asks among words of its length, 0 is indexed, 3 asks for words one letter longer."""
    size = F.length("word")
    longer = F.xxhash64(F.lit("longer"), F.col("k"))
    same = [F.struct(k.alias("k"), F.lit(1).alias("role")) for k in _pieces(size, 0)]
    indexed = [F.struct(k.alias("k"), F.lit(0).alias("role")) for k in _pieces(size - 1, 1)]
    asks = [F.struct(k.alias("k"), F.lit(3).alias("role")) for k in _pieces(size, 0)]
    rows = words.select("word", "n", F.explode(F.array(*same, *indexed, *asks)).alias("b")).select("b.*", "word", "n")
    return rows.select(F.when(F.col("role") == 1, F.col("k")).otherwise(longer).alias("key"), "role", "word", "n")


def one_edit(a: str, b: str) -> bool:
    """Whether the words, a not longer than b, differ by exactly one inserted, deleted or replaced letter."""
    if a == b or len(b) - len(a) > 1:
        return False
    half = len(a) // 2
    at = half if a[:half] == b[:half] else 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Index:
    """Positional postings of the words of one block: (gram, place) to the numbers of its words, ascending."""

    def __init__(self, words: list[str]):
        self.words = words
        self.postings: dict[tuple[int, str], list[int]] = {}
        for w, word in enumerate(words):
            for at in enumerate(grams(word)):
                self.postings.setdefault(at, []).append(w)

    def near(self, query: str, length: int, before: int | None = None) -> Iterator[int]:
        """Numbers of the words of the length (the query's or one more) that are one edit from the query, those below before only.

        A word has to be on ``least`` of the query's lists.  So it is on one of those that
        remain without the ``least - 1`` longest: these are merged by a heap, and what
        comes out is looked up in the longest ones.
        """
        least = length - 2 * Q + 1
        lists = []
        postings = self.postings
        for place, gram in enumerate(grams(query)):
            for p in range(place, place + length - len(query) + 1):
                found = postings.get((p, gram))
                if found and before is not None:
                    found = found[: bisect_left(found, before)]
                if found:
                    lists.append(found)
        lists.sort(key=len)
        cut = len(lists) - least + 1
        if cut < 1:
            return
        long = lists[cut:]
        for w, group in groupby(heapq.merge(*lists[:cut]) if cut > 1 else lists[0]):
            met = sum(1 for _ in group)
            for held in long:
                if met >= least:
                    break
                at = bisect_left(held, w)
                met += at < len(held) and held[at] == w
            if met >= least and one_edit(query, self.words[w]):
                yield w


def _groups_of_two(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[list[list]]:
    """The columns, as lists, of consecutive rows with equal (integer) keys, at least two; only one group is held beside a batch."""
    last, held = None, [[] for _ in columns]
    for batch in batches:
        if not batch.num_rows:
            continue
        ks = [batch.column(k).to_numpy() for k in keys]
        values = [batch.column(c).to_pylist() for c in columns]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in ks], axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        first = [int(k[0]) for k in ks]
        if first == last:
            for h, v in zip(held, values, strict=True):
                h += v[: edges[1]]
            edges = edges[1:]
        if len(edges) > 1:
            if len(held[0]) > 1:
                yield held
            for lo, hi in zip(edges[:-2], edges[1:-1], strict=True):
                if hi - lo > 1:
                    yield [v[lo:hi] for v in values]
            held = [v[edges[-2] :] for v in values]
        last = [int(k[-1]) for k in ks]
    if len(held[0]) > 1:
        yield held


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near pairs of each block; rows are sorted by block, and in it the index comes first."""
    out: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(out), OUT):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out[lo : lo + OUT], strict=True)], ["word", "n", "other", "other_n"])
        out.clear()

    for roles, words, ns in _groups_of_two(batches, ["key", "left", "right"], ["role", "word", "n"]):
        # role 0: in the index; 1: index and query; 2: query of the same length; 3: query one letter shorter
        known = sum(r < 2 for r in roles)
        if not known or not roles[-1]:
            continue
        index = Index(words[:known])
        for i, r in enumerate(roles):
            if r:
                for w in index.near(words[i], len(words[i]) + (r == 3), i if r == 1 else None):
                    out.append((words[i], ns[i], words[w], ns[w]))
        if len(out) >= OUT:
            yield from flush()
    yield from flush()


def near_pairs(words: DataFrame, tables: Tables) -> DataFrame:
    """(word, n, other, other_n): every pair of words one edit apart, once and in one direction."""
    rows = blocks(words)
    large = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("role").alias("least")).where(f"m > {BLOCK_WORDS}")
    large = tables.write(large.where("least < 2").select("key", F.expr(f"CAST(m div {BLOCK_WORDS} + 1 AS INT)").alias("cut")))
    cut = rows.join(broadcast_if_small(large), "key", "left").withColumn("cut", F.coalesce("cut", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("word"), F.col("cut")).cast("int"))
    # part h is indexed in the blocks (h, j) and asks in the blocks (i, h); two parts of words of one length meet in (i, j) with i < j
    parts_of = lambda last, left, right, role: F.transform(F.sequence(F.lit(0), last), lambda p: F.struct(left(p).alias("left"), right(p).alias("right"), role(p).alias("role")))
    salt, last = F.col("salt"), F.col("cut") - 1
    indexed = parts_of(last, lambda p: salt, lambda p: p, lambda p: F.when((p == salt) & (F.col("role") == 1), 1).otherwise(0))
    asks = parts_of(last, lambda p: p, lambda p: salt, lambda p: F.lit(3))
    before = F.when((F.col("role") == 1) & (salt > 0), parts_of(salt - 1, lambda p: p, lambda p: salt, lambda p: F.lit(2))).otherwise(F.array())
    dealt = cut.select("key", "word", "n", F.explode(F.when(F.col("role") < 2, F.concat(indexed, before)).otherwise(asks)).alias("b")).select("key", "b.*", "word", "n")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "key", "left", "right").sortWithinPartitions("key", "left", "right", "role", "word")
    return dealt.mapInArrow(_pairs, "word string, n long, other string, other_n long").distinct()


def follow(forms: DataFrame, tables: Tables) -> DataFrame:
    """(word, form) to (word, root): the end of each chain of forms, by pointer jumping."""
    now = tables.write(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = broadcast_if_small(now.select(F.col("word").alias("at"), F.col("root").alias("further")))
        following = tables.write(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if following.where("moved").isEmpty():
            return following.select("word", "root")
        now = following.select("word", "root")


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of at least LEAST_LENGTH letters and LEAST_COUNT occurrences."""
    tables = Tables(docs.sparkSession, "spelling")
    words = tables.write(word_counts(docs, id_col, text_col))
    pairs = tables.write(near_pairs(words, tables))
    better = lambda n, other, other_n: F.when(F.col(other_n) >= FACTOR * F.col(n), F.struct((-F.col(other_n)).alias("low"), F.col(other).alias("form")))
    none = F.lit(None).cast("struct<low:bigint,form:string>")
    rows = words.select("word", "n", F.lit(0).alias("near"), none.alias("best"))
    rows = rows.unionByName(pairs.select("word", "n", F.lit(1).alias("near"), better("n", "other", "other_n").alias("best")))
    rows = rows.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.lit(1).alias("near"), better("other_n", "word", "n").alias("best")))
    told = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best"))
    told = tables.write(told.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.low")).alias("form_n")))
    roots = broadcast_if_small(follow(told.where("form is not null"), tables))
    return tables.last(told.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")))
