"""Concept retrieval for many proposals at once, ranking, cards and decision checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlake import vocab
from termlake.functions.similarity import trigrams
from termlake.staging import Rounds

ACTIVE = ("proposed", "accepted")
TOP_K, FUZZY = 8, 0.25
DIMENSIONS = 1024
#: Bytes of a block of asked and of stored vectors, as doubles, and values of a product of them.
QUERY_BYTES, STORED_BYTES, BLOCK_VALUES = 4 << 20, 32 << 20, 4 << 20
DIMENSION_ERROR = "a query vector has another dimension than the stored vectors"
#: Known and asked texts of a block, so the most texts of a gram's list.
HOT_LIST, ASKED_TEXTS = 20_000, 2_000


def exact_signal(proposals: DataFrame, terms: DataFrame) -> DataFrame:
    """proposal_id, concept_id of equal keys in one language."""
    t = terms.where(F.col("status").isin(*ACTIVE)).select("concept_id", "language", F.col("normalized_text").alias("normalized_term"))
    return proposals.select("proposal_id", "language", "normalized_term").join(t, ["language", "normalized_term"]).select("proposal_id", "concept_id").distinct()


def identifier_signal(proposals: DataFrame, identifiers: DataFrame, namespaces: DataFrame) -> DataFrame:
    """proposal_id, concept_id, strength: the strongest shared identifier.

    Proposals that ask for the same identifiers have the same answer, which is made once, and
    identifiers that a concept has repeatedly count once; so only the answers grow with the proposals.
    """
    pair = lambda i: F.struct(i["namespace"].alias("code"), i["value"].alias("external_id"))
    # one row a proposal, however often it is repeated
    asked = proposals.groupBy("proposal_id").agg(F.flatten(F.collect_list(F.transform("identifiers", pair))).alias("asked"))
    asked = asked.select("proposal_id", F.array_sort(F.array_distinct("asked")).alias("asked"))
    each = asked.select("asked").distinct().select("asked", F.explode("asked").alias("i")).select("asked", "i.*")
    known = identifiers.select("namespace_id", "external_id", "concept_id").distinct()
    known = known.join(namespaces.select(F.col("id").alias("namespace_id"), "code", "identity_strength"), "namespace_id").drop("namespace_id")
    rank = vocab.map_column(vocab.STRENGTH_RANK)
    found = each.join(known, ["code", "external_id"]).groupBy("asked", "concept_id").agg(F.max_by("identity_strength", rank[F.col("identity_strength")]).alias("strength"))
    return asked.join(found, "asked").select("proposal_id", "concept_id", "strength")


def _named(rows: DataFrame, text: str) -> DataFrame:
    """Two hashes that stand for a text in its language, and the 64-bit hashes of its grams in that language."""
    key = [F.xxhash64("language", text).alias("a"), F.hash("language", text).alias("b")]
    named = F.transform(trigrams(F.col(text)), lambda x: F.xxhash64("language", x))
    return rows.select(*key, named.alias("g")).where("size(g) > 0")


def _alike(asked: pa.Table, known: pa.Table, threshold: float) -> pa.Table:
    """pa, pb, ta, tb, trigram of the pairs of asked and known texts at the threshold, by the known texts' lists of grams."""
    at = pa.array([], pa.int64())
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if asked.num_rows and known.num_rows:
        lists = known.column("g").combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        grams, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(grams, kind="stable")
        owner = owner[order]
        names, begin = np.unique(grams[order], return_index=True)
        end = np.append(begin[1:], len(owner))
        for row, chunk in enumerate(x for c in asked.column("g").chunks for x in c):
            mine = np.asarray(chunk.values)
            where = np.minimum(np.searchsorted(names, mine), len(names) - 1)
            where = where[names[where] == mine]
            if len(where):
                shared = np.bincount(np.concatenate([owner[begin[w] : end[w]] for w in where]), minlength=len(sizes))
                share = shared / (len(mine) + sizes - shared)
                good = np.flatnonzero(share >= threshold)
                out.append((np.full(len(good), row), good, share[good]))
    if out:
        of, at, share = (np.concatenate(x) for x in zip(*out, strict=True))
    else:
        of, share = at, pa.array([], pa.float64())
    of, at = pa.array(of), pa.array(at)
    return pa.table([asked.column("a").take(of), asked.column("b").take(of), known.column("a").take(at), known.column("b").take(at), pa.array(share)], ["pa", "pb", "ta", "tb", "trigram"])


def similar_texts(asked: DataFrame, known: DataFrame, threshold: float, rounds: Rounds, hot_list: int = HOT_LIST) -> DataFrame:
    """(pa, pb, ta, tb, trigram) of the pairs of asked and known texts (a, b, g) at the threshold.

    Both sides are different texts, counted and dealt into blocks; each pair of blocks is one group.  In
    it the known texts' grams are lists of texts, and the lists of an asked text's grams are counted together, so a
    pair costs what its grams have in common and no candidate is shuffled.  A block has about ``hot_list`` known texts,
    so no list is longer.
    """
    asked, known = rounds.write(asked), rounds.write(known)
    asks, parts = max(1, -(-asked.count() // ASKED_TEXTS)), max(1, -(-known.count() // hot_list))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.withColumn("ask", F.pmod("a", F.lit(asks)).cast("int")).withColumn("part", spread(parts))
    k = known.withColumn("part", F.pmod("a", F.lit(parts)).cast("int")).withColumn("ask", spread(asks))
    return q.groupBy("ask", "part").cogroup(k.groupBy("ask", "part")).applyInArrow(lambda x, y: _alike(x, y, threshold), "pa long, pb int, ta long, tb int, trigram double")


def trigram_signal(proposals: DataFrame, terms: DataFrame, threshold: float = FUZZY, most: int = 2 * TOP_K, hot_list: int = HOT_LIST) -> DataFrame:
    """proposal_id, concept_id, trigram: the most similar concepts of a proposal, at least at the threshold.

    Equal texts are one text, named by 96 hash bits (see :func:`similar_texts`), and have their best concepts
    chosen once; the proposals come last.  Of a known text's concepts the least ids, as many as are
    wanted, are enough: any other one comes after all of these.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rounds = Rounds(proposals.sparkSession, "trigrams")
    active = terms.where(F.col("status").isin(*ACTIVE))
    asked = _named(proposals.select("language", F.col("normalized_term").alias("s")).distinct(), "s")
    known = _named(active.select("language", F.col("normalized_text").alias("s")).distinct(), "s")
    alike = similar_texts(asked, known, threshold, rounds, hot_list)
    p = proposals.select("proposal_id", F.xxhash64("language", "normalized_term").alias("pa"), F.hash("language", "normalized_term").alias("pb"))
    concepts = active.select("concept_id", F.xxhash64("language", "normalized_text").alias("ta"), F.hash("language", "normalized_text").alias("tb")).distinct()
    concepts = top(concepts, ["ta", "tb"], [F.col("concept_id")], most)
    best = alike.join(concepts, ["ta", "tb"]).groupBy("pa", "pb", "concept_id").agg(F.max("trigram").alias("trigram"))
    best = rounds.last(top(best, ["pa", "pb"], [F.desc("trigram"), F.col("concept_id")], most))
    return top(best.join(p, ["pa", "pb"]).select("proposal_id", "concept_id", "trigram"), ["proposal_id"], [F.desc("trigram"), F.col("concept_id")], most)


def _sequential(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of a and b, summed in the order of the entries, so equal vectors have equal values wherever they stand."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension as rows of doubles."""
    column = column.combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    sizes = np.unique(column.value_lengths().to_numpy())
    if len(sizes) > 1:
        raise ValueError(DIMENSION_ERROR)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(asked: pa.Table, known: pa.Table, most: int) -> pa.Table:
    """proposal_id, concept_id, semantic: the best known rows of each asked one, as a whole table would give them.

    A product in single precision leaves out what is surely not among the best; the rest is
    computed in double precision.  Equal known vectors are one vector with its least ids.
    """
    names = ["proposal_id", "concept_id", "semantic"]
    none = pa.table([asked.column("proposal_id").slice(0, 0), known.column("concept_id").slice(0, 0), pa.array([], pa.float64())], names)
    if not asked.num_rows or not known.num_rows:
        return none
    known = known.take(pc.sort_indices(known, [("concept_id", "ascending")], null_placement="at_start"))
    q, e = _matrix(asked.column("q")), _matrix(known.column("e"))
    if q.shape[1] != e.shape[1]:
        raise ValueError(DIMENSION_ERROR)
    if not q.shape[1]:
        return none
    _, first, group = np.unique(np.ascontiguousarray(e).view(np.dtype((np.void, e.itemsize * e.shape[1]))).ravel(), return_index=True, return_inverse=True)
    u, group = e[first], group.ravel()
    ids = np.argsort(group, kind="stable")
    begin = np.searchsorted(group[ids], np.arange(len(u)))
    held = np.minimum(np.diff(np.append(begin, len(ids))), most)
    qn, un = np.sqrt(_sequential(q, q)), np.sqrt(_sequential(u, u))
    with np.errstate(all="ignore"):
        unit = (u / un[:, None]).astype(np.float32).T
    # single precision is off by less than this
    slack = np.float32(4 * (q.shape[1] + 8) * np.finfo(np.float32).eps)
    step, k, out = max(1, BLOCK_VALUES // len(u)), min(most, len(u)), []
    for lo in range(0, len(q), step):
        with np.errstate(all="ignore"):
            near = (q[lo : lo + step] / qn[lo : lo + step, None]).astype(np.float32) @ unit
            # vectors without length are similar to none; what is no number comes first, as in the order of a column
            near[:, un == 0] = -np.inf
            least = np.partition(near, len(u) - k, axis=1)[:, len(u) - k]
            row, at = np.nonzero(~(near < (least - slack)[:, None]))
            row += lo
            size = qn[row] * un[at]
            row, at, size = row[size != 0], at[size != 0], size[size != 0]
            score = _sequential(q[row], u[at]) / size
        each = np.repeat(np.arange(len(row)), held[at])
        place = np.arange(len(each)) - np.repeat(np.cumsum(held[at]) - held[at], held[at])
        row, score, at = row[each], score[each], ids[begin[at[each]] + place]
        order = np.lexsort((at, np.where(np.isnan(score), -np.inf, -score), row))
        row, score, at = row[order], score[order], at[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < most
        out.append(pa.table([asked.column("proposal_id").take(pa.array(row[kept])), known.column("concept_id").take(pa.array(at[kept])), pa.array(score[kept])], names))
    return pa.concat_tables(out) if out else none


def vector_signal(
    proposals: DataFrame, embeddings: DataFrame, most: int = 2 * TOP_K, model_name: str | None = None, model_version: str | None = None, block_bytes: int = QUERY_BYTES
) -> DataFrame:
    """proposal_id, concept_id, semantic: the nearest concepts by cosine (exact).

    Only vectors of the named model and version are compared.  Asked and stored
    vectors are counted and dealt into blocks of bounded bytes; each pair of blocks
    is one group, whose vectors are multiplied as matrices and of which each asked vector's best
    are kept.  Rows without a vector, with a null entry or without length are near to none.
    An asked vector of another dimension than the stored ones is an error.
    """
    for column, value in (("model_name", model_name), ("model_version", model_version)):
        if value is not None:
            embeddings = embeddings.where(F.col(column) == value)
    whole = lambda c: F.col(c).isNotNull() & (F.size(F.array_compact(c)) == F.size(c))
    q = proposals.where(whole("query_embedding")).select("proposal_id", F.col("query_embedding").alias("q"))
    e = embeddings.where(whole("embedding")).select("concept_id", F.col("embedding").alias("e"))
    sums = lambda df, c: df.agg(F.sum(F.size(c).cast("long") * 8).alias("bytes")).first().bytes or 0
    asks, parts = max(1, -(-sums(q, "q") // block_bytes)), max(1, -(-sums(e, "e") // STORED_BYTES))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("ask", F.pmod(F.xxhash64("proposal_id", "q"), F.lit(asks)).cast("int")).withColumn("part", spread(parts))
    e = e.withColumn("part", F.pmod(F.xxhash64("concept_id", "e"), F.lit(parts)).cast("int")).withColumn("ask", spread(asks))
    schema = T.StructType([q.schema["proposal_id"], e.schema["concept_id"], T.StructField("semantic", T.DoubleType())])
    best = q.groupBy("ask", "part").cogroup(e.groupBy("ask", "part")).applyInArrow(lambda a, b: _nearest(a, b, most), schema)
    return top(best, ["proposal_id"], [F.desc("semantic"), F.col("concept_id")], most)


def embed(texts: DataFrame, load: Callable[[], Callable[[list[str]], list]], dimensions: int = DIMENSIONS, text_col: str = "text", batch: int = 64) -> DataFrame:
    """texts with their embedding (array<float> of unit length) by an injected model.

    load gives the model and is called once a task; the model maps a list of
    texts to as many vectors.  Another number of vectors, or of dimensions, is an
    error; a null text has no embedding, a zero vector is left as it is.
    """
    schema = T.StructType([*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            values, known = [None] * len(frame), [i for i, t in enumerate(frame[text_col]) if t is not None]
            for lo in range(0, len(known), batch):
                part = known[lo : lo + batch]
                vectors = model([frame[text_col].iloc[i] for i in part])
                if len(vectors) != len(part):
                    raise ValueError(f"the model gave {len(vectors)} vectors for {len(part)} texts")
                for i, v in zip(part, vectors, strict=True):
                    v = np.asarray(v, dtype=np.float64)
                    if v.shape != (dimensions,):
                        raise ValueError(f"a vector has shape {v.shape} instead of ({dimensions},)")
                    values[i] = (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)
            yield frame.assign(embedding=pd.Series(values, index=frame.index, dtype=object))

    return texts.mapInPandas(run, schema)


def top(scored: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group in an order."""
    return scored.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("at") <= most).drop("at")


def ranking_score(exact: Column, strength: Column, trigram: Column, semantic: Column) -> Column:
    weight = F.coalesce(vocab.map_column(vocab.STRENGTH_WEIGHT)[strength], F.lit(0.0))
    return (
        weight + F.when(exact, 1.25).otherwise(0.0) + 0.65 * F.coalesce(trigram, F.lit(0.0)) + 0.65 * F.greatest(F.coalesce(semantic, F.lit(0.0)), F.lit(0.0))
    )


def hybrid_topk(
    proposals: DataFrame, terms: DataFrame, identifiers: DataFrame, namespaces: DataFrame, embeddings: DataFrame | None = None, k: int = TOP_K, threshold: float = FUZZY
) -> DataFrame:
    """proposal_id, rank, concept_id and scores: the union of four signals, scored, the best k of each proposal."""
    if not 1 <= k <= 50:
        raise ValueError("k must be from 1 to 50")
    none = lambda t: F.lit(None).cast(t)
    row = lambda df, exact, strength, trigram, semantic: df.select("proposal_id", "concept_id", exact.alias("exact"), strength.alias("strength"), trigram.alias("trigram"), semantic.alias("semantic"))
    signals = row(exact_signal(proposals, terms), F.lit(True), none("string"), none("double"), none("double"))
    signals = signals.unionByName(row(identifier_signal(proposals, identifiers, namespaces), F.lit(False), F.col("strength"), none("double"), none("double")))
    signals = signals.unionByName(row(trigram_signal(proposals, terms, threshold, 2 * k), F.lit(False), none("string"), F.col("trigram"), none("double")))
    if embeddings is not None:
        signals = signals.unionByName(row(vector_signal(proposals, embeddings, 2 * k), F.lit(False), none("string"), none("double"), F.col("semantic")))
    merged = signals.groupBy("proposal_id", "concept_id").agg(
        F.max("exact").alias("exact_normalized"), F.max("strength").alias("identifier_strength"), F.max("trigram").alias("trigram"), F.max("semantic").alias("semantic")
    )
    scored = merged.withColumn("ranking_score", ranking_score(F.col("exact_normalized"), F.col("identifier_strength"), F.col("trigram"), F.col("semantic")))
    order = Window.partitionBy("proposal_id").orderBy(F.desc("ranking_score"), F.col("concept_id").cast("string"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def concept_cards(ids: DataFrame, concepts: DataFrame, terms: DataFrame, assignments: DataFrame, types: DataFrame, identifiers: DataFrame, namespaces: DataFrame) -> DataFrame:
    """concept_id, preferred term, aliases, type codes, identifiers and definition; concepts that don't exist are left out."""
    wanted = ids.select("concept_id").distinct()
    english = terms.where("language = 'en'").join(wanted, "concept_id", "left_semi").groupBy("concept_id").agg(
        F.array_sort(F.collect_list(F.struct("normalized_text", "text", "is_preferred"))).alias("t")
    )
    coded = assignments.join(wanted, "concept_id", "left_semi").join(types.select(F.col("id").alias("concept_type_id"), "code"), "concept_type_id")
    coded = coded.groupBy("concept_id").agg(F.array_sort(F.collect_list("code")).alias("type_codes"))
    named = identifiers.join(wanted, "concept_id", "left_semi").join(namespaces.select(F.col("id").alias("namespace_id"), F.col("code").alias("namespace"), "identity_strength"), "namespace_id")
    named = named.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("namespace", F.col("external_id").alias("value"), "identity_strength"))).alias("identifiers"))
    out = concepts.select(F.col("id").alias("concept_id"), "english_definition").join(wanted, "concept_id", "left_semi")
    out = out.join(english, "concept_id", "left").join(coded, "concept_id", "left").join(named, "concept_id", "left")
    preferred = F.coalesce(F.get(F.filter("t", lambda x: x["is_preferred"]), F.lit(0)), F.get("t", F.lit(0)))["text"]
    empty = lambda c, t: F.coalesce(c, F.array().cast(t))
    return out.select(
        "concept_id", preferred.alias("preferred_english_term"), empty(F.transform("t", lambda x: x["text"]), "array<string>").alias("aliases"),
        empty(F.col("type_codes"), "array<string>").alias("type_codes"),
        empty(F.col("identifiers"), "array<struct<namespace:string,value:string,identity_strength:string>>").alias("identifiers"), "english_definition",
    )


def vocabulary(types: DataFrame, namespaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active types with the code of an active parent, and active namespaces, both by code (tables of a few rows)."""
    active = types.where("active")
    parents = active.select(F.col("id").alias("parent_id"), F.col("code").alias("parent_code"))
    return active.join(parents, "parent_id", "left").select("code", "label", "description", "parent_code").orderBy("code"), namespaces.where("active").select(
        "code", "label", "description", "identity_strength"
    ).orderBy("code")


def resolver_payloads(proposals: DataFrame, cards: DataFrame, types: DataFrame, namespaces: DataFrame) -> DataFrame:
    """proposal_id and the JSON a resolver is asked with: the proposal, its candidate cards in rank order, vocabulary and non-merge rules.

    cards has proposal_id, rank and further columns; proposals without cards are
    not asked.  The vocabulary (tables of a few rows) is one value that all rows share.
    """
    t, n = vocabulary(types, namespaces)
    listed = lambda df, order: df.agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order]))).alias("v"))
    shared = listed(t, ["code"]).select(F.col("v").alias("types")).join(listed(n, ["code"]).select(F.col("v").alias("identifier_namespaces")))
    ranked = F.array_sort(F.collect_list(F.struct("rank", *[c for c in cards.columns if c not in ("proposal_id", "rank")])))
    asked = proposals.join(cards.groupBy("proposal_id").agg(ranked.alias("candidates")), "proposal_id").join(F.broadcast(shared))
    rules = F.array(*map(F.lit, vocab.NON_MERGE_RULES)).alias("non_merge_rules")
    body = F.struct(F.struct(*proposals.columns).alias("proposal"), "candidates", F.struct("types", "identifier_namespaces", rules).alias("vocabulary"))
    return asked.select("proposal_id", F.to_json(body).alias("payload"))


def resolve(proposals: DataFrame, ranked: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolutions, rejected decisions): a new concept where nothing was retrieved, else the recorded decision if it is coherent."""
    have = ranked.groupBy("proposal_id").agg(F.collect_set("concept_id").alias("candidates"))
    p = proposals.select("proposal_id").join(have, "proposal_id", "left")
    new = p.where("candidates is null").select(
        "proposal_id", F.lit("NEW_CONCEPT").alias("outcome"), F.lit(None).cast("string").alias("concept_id"), F.lit(1.0).alias("confidence"), F.lit("NO_CANDIDATE").alias("reason_code"), F.lit(False).alias("needs_review")
    )
    d = decisions.join(p.where("candidates is not null"), "proposal_id", "left").withColumn("error", decision_error())
    good = d.where("error is null").select("proposal_id", "outcome", F.col("concept_id").cast("string").alias("concept_id"), "confidence", "reason_code", "needs_review")
    return new.unionByName(good), d.where("error is not null").select("proposal_id", "outcome", "concept_id", "error")


def decision_error() -> Column:
    """What is wrong with a decision (outcome, concept_id, related_concept_id, needs_review, candidates); null if nothing."""
    known = lambda c: c.isNull() | F.array_contains("candidates", c)
    cid, rid = F.col("concept_id"), F.col("related_concept_id")
    return (
        F.when(F.col("candidates").isNull(), "unknown proposal or no candidates")
        .when(~F.col("outcome").isin(*vocab.RESOLUTION_OUTCOMES), "unknown outcome")
        .when((F.col("outcome") == "SAME_CONCEPT") & cid.isNull(), "the same concept needs its id")
        .when((F.col("outcome") == "RELATED_NOT_SAME") & rid.isNull(), "a related concept needs its id")
        .when((F.col("outcome") == "NEW_CONCEPT") & (cid.isNotNull() | rid.isNotNull()), "a new concept has no id")
        .when((F.col("outcome") == "AMBIGUOUS") & ~F.col("needs_review"), "ambiguity needs review")
        .when(~known(cid) | ~known(rid), "the id is not among the candidates")
    )
