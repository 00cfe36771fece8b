"""N-gram Jaccard join: a blocked sparse product of the document by n-gram matrix.

Rows are documents, columns are hashed five-word shingles.  Two documents link
when ``100 * |A & B| >= 80 * |A | B|``.  The work has three parts.

1. *Column bounds.*  Shingles have one global (hash) order.  A document of n
   shingles can only link to one that shares at least ``o = ceil(0.8 n)`` of
   them, so two linking documents share at least ``l`` shingles of their first
   ``n - o + l``.  Of these the document frequency over the whole corpus is
   counted, and each document leaves out its ``l - SHARED`` most frequent ones:
   the SHARED rarest of l shared shingles are left in either document.  A
   passage that millions of documents share is thus never a join key unless
   nearly the whole document consists of such passages.
2. *Counted pairs.*  Of the remaining keys those with at most ``LIST`` documents
   are multiplied: keys with the same documents are one list with a weight, the
   weights are summed by pair, and a pair that shares fewer keys than is
   guaranteed (less those of its keys that have longer lists) is dropped.  Only
   documents that have the guaranteed number of keys with longer lists are
   connected by single keys.
3. *Blocks.*  The pairs left connect documents into candidate clusters
   (connected components, never collected).  Each cluster is dealt into blocks
   of bounded token and row count; every pair of blocks is one unit of work.
   Blocks grow with their cluster up to a bound, so a text is sent to 16 units
   until its cluster has ``16 * BLOCK_TOKENS[1]`` tokens.
4. *Products.*  For a pair of blocks the incidence rows are multiplied column
   block by column block and overlap counts accumulated.  A pair is discarded
   where the sizes alone, or the overlap so far and what is left of the smaller
   row, rule out the threshold; rows without pairs leave the product.  What
   leaves a task is a spanning forest of the links plus each row's number of
   links, linear in its rows.

Documents with equal shingle sets are one matrix row with a weight.  Tables of
counts by key are written before they are joined, so that adaptive skew handling
can split a hot key; those with a row a key grow with the corpus and are never
broadcast.

Defined results: null or blank text has no shingles and links to nothing; a
null doc_id is kept and cannot be a component's id while a non-null id is in it;
repeated rows and repeated ids are separate rows; of equal sizes and ties
nothing depends; long texts are hashed in numpy as a whole; an empty table gives
no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import WORD, Tables, broadcast_if_small, groups, has_twins, without_rows
from llm.components import connected_components
from llm.shingles import shingle_set, text_words

PERCENT = 80
#: Shared keys kept in reserve: at least so many, and this share of a document's shingles.
RESERVE, RESERVE_SHARE = 32, 0.05
#: Keys that two linking documents are left with (fewer in short ones), and documents up to which a key's pairs are counted.
SHARED, LIST = 8, 64
#: Least and most shingles of a block, and rows.
BLOCK_TOKENS = (25_000, 1_000_000)
BLOCK_ROWS = 2_000
COLUMN_BLOCK = 2048


def required(n: np.ndarray | int, percent: int = PERCENT):
    """Fewest shared shingles with which a document of n shingles can link to any other."""
    return -(-percent * n // 100)


def reserve(n, percent: int = PERCENT):
    """l: how many shared keys a prefix guarantees; never falls as n grows."""
    return np.minimum(required(n, percent), np.maximum(RESERVE, (RESERVE_SHARE * n).astype(np.int64) + 1))


def _prefixes(percent: int):
    """One row a document: number of shingles, digest of the set, first shingles by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            sizes, digests, prefix = [], [], []
            for _, words in text_words(batch.column("text")):
                s = shingle_set(words)
                n = np.int64(len(s))
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                prefix.append(s[: n - required(n, percent) + reserve(n, percent)] if n else s)
            lengths = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
            flat = np.concatenate(prefix).view(np.int64) if prefix else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(rid, rid + batch.num_rows)),
                    batch.column("doc_id"),
                    batch.column("mark"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)),
                ],
                ["rid", "doc_id", "mark", "n", "digest", "keys"],
            )
            rid += batch.num_rows

    return run


def _links(sets: list[np.ndarray], side: np.ndarray, same: bool, percent: int) -> list[tuple[int, int]]:
    """Linking index pairs of the rows' sets; unless the pair is a block with itself, only pairs across the two."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    left = np.flatnonzero(side == side[0])
    right = left if same else np.flatnonzero(side != side[0])
    if not len(right):
        return []
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), n)
    _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    column, row = column[seen[column] > 1], row[seen[column] > 1]
    order = np.argsort(column, kind="stable")
    _, column = np.unique(column[order], return_inverse=True)
    row = row[order]
    exact = np.float32 if n.max() < 1 << 24 else np.float64
    columns = int(column[-1]) + 1 if len(column) else 0
    wide = min(COLUMN_BLOCK, columns)
    overlap = np.zeros((len(left), len(right)), dtype=exact)
    remaining = np.bincount(row, minlength=len(n)).astype(exact)
    for lo in range(0, columns, COLUMN_BLOCK):
        # pairs that even all of the smaller row's remaining columns cannot bring to the threshold are discarded
        most = overlap + np.minimum(remaining[left][:, None], remaining[right][None, :])
        alive = 100 * most >= percent * (n[left][:, None] + n[right][None, :] - most)
        if same:
            alive &= left[:, None] < right[None, :]
        if not alive.any():
            return []
        rows, cols = alive.any(axis=1), alive.any(axis=0)
        left, right, overlap = left[rows], right[cols], overlap[np.ix_(rows, cols)]
        a, b = np.searchsorted(column, (lo, lo + COLUMN_BLOCK))
        dense = np.zeros((len(sets), wide), dtype=exact)
        dense[row[a:b], column[a:b] - lo] = 1
        overlap += dense[left] @ dense[right].T
        remaining -= np.bincount(row[a:b], minlength=len(n)).astype(exact)
    i, j = np.nonzero(100 * overlap >= percent * (n[left][:, None] + n[right][None, :] - overlap))
    i, j = left[i], right[j]
    keep = i < j if same else n[i] > 0
    return list(zip(i[keep].tolist(), j[keep].tolist(), strict=True))


def _products(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for table in groups(batches, ["cluster", "bi", "bj"]):
            rids = table.column("rid").to_pylist()
            weights = table.column("weight").to_pylist()
            sets = [shingle_set(w) for _, w in text_words(table.column("text").combine_chunks())]
            side = table.column("block").to_numpy()
            root = list(range(len(rids)))
            links = [0] * len(rids)

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            same = table.column("bi")[0].as_py() == table.column("bj")[0].as_py()
            for i, j in _links(sets, side, same, percent):
                links[i] += weights[j]
                links[j] += weights[i]
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
            for i, rid in enumerate(rids):
                if links[i]:
                    out.append((rid, rids[find(i)], links[i]))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v", "links"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v", "links"])

    return run


def _candidates(keys: DataFrame, tables: Tables) -> DataFrame:
    """(u, v) edges from a written table of h, rid, least: of pairs that share enough keys, and of keys with long lists."""
    lists = tables.write(keys.groupBy("h").agg(F.min("rid").alias("v"), F.count("*").alias("c")).where("c > 1"))
    met = keys.join(lists, "h")
    # keys with the same documents are one list; the weights of its pairs are summed
    same = met.where(F.col("c") <= LIST).groupBy("h").agg(F.sort_array(F.collect_list("rid")).alias("rids")).groupBy("rids").agg(F.count("*").alias("c"))
    first = same.select("rids", "c", F.posexplode("rids").alias("at", "v"))
    pairs = first.select("v", "c", F.explode(F.slice("rids", F.col("at") + 2, F.size("rids"))).alias("u"))
    counted = tables.write(pairs.groupBy("u", "v").agg(F.sum("c").alias("shared")))
    long = tables.write(met.where(F.col("c") > LIST).groupBy("rid").agg(F.count("*").alias("long"), F.max("least").alias("least")))
    short = broadcast_if_small(tables.write(keys.where(F.col("least") < SHARED).groupBy("rid").agg(F.max("least").alias("least"))))
    others = broadcast_if_small(long.select("rid", "long"))
    for end in ("u", "v"):
        counted = counted.join(short.select(F.col("rid").alias(end), F.col("least").alias(f"{end}_least")), end, "left")
        counted = counted.join(others.select(F.col("rid").alias(end), F.col("long").alias(f"{end}_long")), end, "left")
    other = F.least(F.coalesce("u_long", F.lit(0)), F.coalesce("v_long", F.lit(0)))
    bound = F.greatest(F.coalesce("u_least", F.lit(SHARED)), F.coalesce("v_least", F.lit(SHARED)))
    enough = counted.where(F.col("shared") >= bound - other).select("u", "v")
    heavy = broadcast_if_small(tables.write(long.where("long >= least").select("rid")))
    chained = met.where(F.col("c") > LIST).join(heavy, "rid").select("h", "rid")
    pivot = tables.write(chained.groupBy("h").agg(F.min("rid").alias("v")))
    return enough.unionByName(chained.join(pivot, "h").select(F.col("rid").alias("u"), "v"))


def _linked(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, bool]:
    """For every row doc_id, mark (text hash), n, component_id, n_links and the id and mark that stand for its component; whether rows repeat."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark: SparkSession = docs.sparkSession
    tables = Tables(spark, "ngram")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    base = tables.write(source.mapInArrow(_prefixes(percent), "rid long, doc_id long, mark long, n long, digest binary, keys array<long>"))
    twins = has_twins(base)

    classes = tables.write(
        base.where("n > 0").groupBy("digest").agg(
            F.count("*").alias("weight"),
            F.min("doc_id").alias("doc_id"),
            F.min(F.struct("rid", "doc_id", "mark", "n")).alias("first"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("stays"),
        ).select("digest", "weight", "doc_id", "stays", "first.rid", "first.n", F.col("first.doc_id").alias("fetch_id"), F.col("first.mark").alias("fetch_mark"))
    )

    # keys shared by documents, with their document frequency; then each document's rarest
    rows = base.select("rid", F.explode("keys").alias("h"))
    frequent = tables.write(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    shared = rows.join(frequent, "h")
    sizes = classes.select("rid", "n")
    least = F.floor((F.col("n") * percent + 99) / 100)
    guaranteed = lambda n: F.least(
        F.floor((n * percent + 99) / 100), F.greatest(F.lit(RESERVE), (n * RESERVE_SHARE).cast("long") + 1)
    )
    ranked = shared.join(sizes, "rid").select(
        "h", "rid", guaranteed(least).alias("g"), F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("df"), "h")).alias("at")
    )
    keys = tables.write(ranked.where(F.col("at") > F.col("g") - SHARED).select("h", "rid", F.least("g", F.lit(SHARED)).alias("least")))
    edges = _candidates(keys, tables)
    clusters = connected_components(edges, tables).select(F.col("node").alias("rid"), F.col("root").alias("cluster"))

    # blocks: every row goes to each pair of blocks that its own block is in
    members = tables.write(clusters.join(classes.select("rid", "n", "weight", "fetch_id", "fetch_mark"), "rid"))
    tokens = F.sum("n")
    size = F.least(F.greatest(tokens / 16, F.lit(BLOCK_TOKENS[0])), F.lit(BLOCK_TOKENS[1]))
    per = tables.write(members.groupBy("cluster").agg(F.ceil(F.greatest(tokens / size, F.count("*") / BLOCK_ROWS)).alias("blocks")))
    dealt = members.join(broadcast_if_small(per), "cluster").withColumn("block", F.pmod(F.xxhash64("rid"), "blocks").cast("int"))
    dealt = broadcast_if_small(tables.write(dealt.drop("n")))
    texts = source.join(
        dealt, source.doc_id.eqNullSafe(F.col("fetch_id")) & (source.mark == F.col("fetch_mark"))
    ).select("cluster", "blocks", "block", "rid", "weight", "text")
    if twins:
        texts = texts.groupBy("rid").agg(*[F.min(c).alias(c) for c in texts.columns if c != "rid"])
    pairs = texts.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).select(
        "cluster", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "rid", "weight", "text"
    )
    units = pairs.repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj", "rid")
    linked = tables.write(units.mapInArrow(_products(percent), "u long, v long, links long"))

    roots = connected_components(linked.select("u", "v"), tables)
    degree = linked.groupBy(F.col("u").alias("rid")).agg(F.sum("links").alias("links"))
    named = tables.write(
        classes.select("digest", "rid", "doc_id", "weight", "stays")
        .join(roots.withColumnRenamed("node", "rid"), "rid", "left")
        .join(degree, "rid", "left")
        .select("digest", "doc_id", "stays", F.coalesce("root", "rid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    ids = tables.write(named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min("stays").alias("stays")))
    found = named.select("digest", "root", "n_links").join(broadcast_if_small(ids), "root")
    found = tables.write(found.select("digest", "component_id", "n_links", F.col("stays.doc_id").alias("stays_id"), F.col("stays.mark").alias("stays_mark")))
    every = base.select("doc_id", "mark", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(broadcast_if_small(found), "digest", "left")
    return tables.last(every.drop("digest")), twins


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of docs.

    component_id is the least doc_id reachable by links, n_links the number of
    other rows the row links to.
    """
    return _linked(docs, id_col, text_col, percent)[0].select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each link component of docs: of those with the least id (null after all others), one.

    The verdict is taken on rows: of rows that share an id but not their text
    each is judged by its own text.  Rows without words all stay.
    """
    found, twins = _linked(docs, id_col, text_col, PERCENT)
    other = ~(F.col("doc_id").eqNullSafe(F.col("stays_id")) & (F.col("mark") == F.col("stays_mark")))
    gone = Tables(docs.sparkSession, "ngram").write(found.where((F.col("n") > 0) & other).select("doc_id", "mark").distinct())
    kept = without_rows(docs, id_col, text_col, gone)
    if not twins:
        return kept
    row = F.struct(*[kept[f"`{c}`"] for c in kept.columns]).alias("row")
    blank = ~F.coalesce(F.rlike(kept[f"`{text_col}`"], F.lit(WORD)), F.lit(False))
    own = F.when(blank, F.monotonically_increasing_id())
    rows = kept.select(row, kept[f"`{id_col}`"].alias("id"), F.xxhash64(kept[f"`{text_col}`"]).alias("mark"), own.alias("own"))
    return rows.dropDuplicates(["id", "mark", "own"]).select("row.*")
