"""Alignment, clustering, lineage, pairing, boundaries, boilerplate and pairwise F1 against plain versions."""

import random
import time
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlake.operators import align, boilerplate, boundaries, changes, cluster, evaluate, lineage, matching, resolve, vector_index
from termlake.staging import Rounds, rank_in_groups

# --- passage alignment ---------------------------------------------------------------------------


def test_alignments_of_short_passages_take_little_time():
    rng = random.Random(8)
    sides = [[" ".join(rng.choice(("gold", "NaCl", "17", "of", "alloy")) for _ in range(rng.randint(3, 12))) + "." for _ in range(6)] for _ in range(600)]
    began = time.process_time()
    for a, b in zip(sides, sides[1:], strict=False):
        align.Aligner(a, b).beads()
    assert time.process_time() - began < 3  # row by row it took five times as long


def plain_cost(aligner, left, right, i, j, bead):
    """Cost of one bead, from the texts and not from the table."""
    a, b, kind = bead
    if not (a and b):
        return kind
    n = sum(map(len, left[i - a : i])) * aligner.ratio
    m = sum(map(len, right[j - b : j]))
    shared = sum(len(align.anchors(x) & align.anchors(y)) for x in left[i - a : i] for y in right[j - b : j])
    penalty = min(round(50 * (m - n) ** 2 / (align.SPREAD * max((n + m) / 2, 1.0))), align.CAP)
    return kind + penalty - align.ANCHOR * min(shared, align.ANCHORS)


def plain_best(left, right, skip=None):
    """Least cost over all monotone alignments; skip forbids one bead."""
    aligner = align.Aligner(left, right)

    @lru_cache(None)
    def best(i, j):
        if not i and not j:
            return 0
        options = []
        for bead in align.BEADS:
            a, b, _ = bead
            if i >= a and j >= b and skip != (i - a, i, j - b, j):
                options.append(best(i - a, j - b) + plain_cost(aligner, left, right, i, j, bead))
        return min(options, default=10**9)

    return best(len(left), len(right))


def passages(rng, n, words=(1, 9)):
    return [" ".join(rng.choice(["alpha", "beta", "gamma", "NaCl", "7.5", "12", "H2SO4", "delta"]) for _ in range(rng.randint(*words))) + "." for _ in range(n)]


def test_alignment_equals_the_full_table():
    rng = random.Random(4)
    for _ in range(60):
        left = passages(rng, rng.randint(0, 9))
        right = [x for x in left if rng.random() < 0.7] + passages(rng, rng.randint(0, 3))
        beads = align.Aligner(left, right).beads()
        assert sum(b.cost for b in beads) == plain_best(left, right)
        assert [k for b in beads for k in range(*b.left)] == list(range(len(left)))
        assert [k for b in beads for k in range(*b.right)] == list(range(len(right)))


def test_alignment_is_bounded_by_its_band():
    rng = random.Random(5)
    left = passages(rng, 400, (20, 40))
    right = [x for i, x in enumerate(left) if i % 50 != 7]
    aligner = align.Aligner(left, right, band=12)
    assert aligner.forward().shape[1] < 40
    beads = aligner.beads()
    dropped = [b.left[0] for b in beads if b.right[0] == b.right[1]]
    assert len(dropped) >= 6 and sum(i % 50 == 7 for i in dropped) >= 5
    for n, m in ((300, 5), (5, 300), (0, 40), (40, 0)):
        beads = align.Aligner(passages(rng, n), passages(rng, m), band=4).beads()
        assert sum(b.left[1] - b.left[0] for b in beads) == n and sum(b.right[1] - b.right[0] for b in beads) == m


def test_alternative_places():
    left = passages(random.Random(2), 6, (15, 40))
    right = left[:3] + [left[2]] + left[3:]
    bead = next(b for b in align.Aligner(left, right).beads() if b.left == (2, 3))
    assert bead.right in ((2, 3), (3, 4)) and bead.other in ((2, 3), (3, 4)) and bead.other != bead.right and bead.extra == 0


def changed_pairs(rng, count):
    pairs = []
    for _ in range(count):
        left = [rng.choice(("", " ".join(passages(rng, rng.randint(1, 3))))) if rng.random() < 0.1 else passages(rng, 1)[0] for _ in range(rng.choice((0, 1, 1, 2, 3, 7, 12, 45)))]
        right = [y for x in left for y in ([] if rng.random() < 0.15 else [x, *passages(rng, 1)] if rng.random() < 0.15 else [x])]
        pairs.append((left, list(left) if rng.random() < 0.25 else passages(rng, rng.choice((0, 1, 2, 6, 30))) if rng.random() < 0.25 else right))
    return pairs


@pytest.mark.parametrize("band", [4, 12, align.BAND])
def test_pairs_of_all_sizes_share_tables_and_keep_their_beads(band):
    rng = random.Random(band)
    pairs = changed_pairs(rng, 250) + [(["a NaCl 5."] * n, ["a NaCl 5."] * m) for n, m in ((1, 1), (3, 3), (90, 90), (230, 40), (3, 4), (150, 148))]
    plain = lambda beads: [(b.left, b.right, b.cost, b.other, b.extra) for b in beads]
    for (left, right), beads in zip(pairs, align.align_many(pairs, band), strict=True):
        assert plain(beads) == plain(align.Aligner(left, right, band).beads()), (left, right)
    assert any(b.other for beads in align.align_many(pairs, band) for b in beads)
    assert align.align_rows(pairs, band) == [align.align_units(left, right, band) for left, right in pairs] and align.align_many([]) == align.align_rows([]) == []


def test_rows_are_aligned_together(monkeypatch):
    rng, tables = random.Random(12), []
    for known in {align.Aligner, getattr(align, "Tables", align.Aligner)}:
        monkeypatch.setattr(known, "forward", lambda self, forward=known.forward: tables.append(1) or forward(self))
    left = [passages(rng, 6) for _ in range(300)]
    rows = align.align_rows([(units, [x for i, x in enumerate(units) if i != k % 6]) for k, units in enumerate(left)])
    assert [sum(level == "paragraph" for level, *_ in beads) >= 5 for beads in rows] == [True] * 300
    assert 0 < len(tables) < 30  # a table for each pair of paragraphs and for each of its beads made 1,500 and more


def test_rows_beyond_what_is_aligned_together(spark, monkeypatch):
    rng = random.Random(3)
    given = [(k, left, None if k % 9 == 0 else right) for k, (left, right) in enumerate(changed_pairs(rng, 80))] + [(80, None, None), (81, [None, "x 5."], ["x 5."])]
    rows = spark.createDataFrame(given, "k int, left_units array<string>, right_units array<string>").coalesce(1)
    want = [(k, *bead) for k, left, right in given for bead in align.align_units([x or "" for x in left or []], [x or "" for x in right or []])]
    for size in (1, 2000):
        monkeypatch.setattr(align, "TOGETHER", size)
        got = [tuple(r) for r in align.align_sections(rows, ["k"]).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_sections_without_counterpart_and_odd_rows(spark):
    left = spark.createDataFrame([(1, "title", "A NaCl 5"), (1, "claims", "One. Two 7."), (2, "title", None)], "pair int, section string, text string")
    right = spark.createDataFrame([(1, "title", "Ein NaCl 5"), (3, "title", "x\n\ny")], "pair int, section string, text string")
    rows = align.align_sections(align.map_sections(left, right, ["pair"]), ["pair", "section"]).collect()
    got = {(r.pair, r.section, r.level, r.kind) for r in rows}
    assert got == {(1, "title", "paragraph", "1-1"), (1, "title", "sentence", "1-1"), (1, "claims", "paragraph", "1-0"), (3, "title", "paragraph", "0-1")}
    assert align.align_sections(align.map_sections(left.limit(0), right.limit(0), ["pair"]), ["pair", "section"]).count() == 0


# --- clusters ------------------------------------------------------------------------------------


def plain_clusters(nodes, links, forbidden, place):
    """The rounds of the module's docstring over plain sets."""
    cannot = {frozenset(p) for p in forbidden if None not in p}
    score = {}
    for a, b, s in links:
        if a is not None and b is not None and a != b and frozenset((a, b)) not in cannot:
            for p in ((a, b), (b, a)):
                score[p] = max(score.get(p, -1), s or 0.0)
    near = defaultdict(set)
    for a, b in score:
        near[a].add(b)
    free, pivot, members = set(near), {}, defaultdict(set)
    while True:
        asked = {}
        for v in free:
            options = [(-score[v, p], p) for p in near[v] if pivot.get(p) == p and not any(frozenset((v, m)) in cannot for m in members[p])]
            if options:
                asked[v] = min(options)
        taken = {v: p for v, (s, p) in asked.items() if not any(q == p and frozenset((v, w)) in cannot and (t, w) < (s, v) for w, (t, q) in asked.items())}
        live = {v for v in free if near[v] & free}
        new = [v for v in live if v not in asked and all(place[w] > place[v] for w in near[v] & free)]
        if not taken and not new:
            break
        for v, p in taken.items():
            pivot[v] = p
            members[p].add(v)
        for v in new:
            pivot[v] = v
        free -= taken.keys() | set(new)
    return {v: pivot.get(v, v) for v in set(nodes) | set(near) if v is not None}


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_the_plain_rounds(spark, seed):
    rng = random.Random(seed)
    nodes = [*range(40), None, 3]
    links = [(rng.randrange(40), rng.randrange(40), rng.choice([None, 0.1, 0.5, 0.9])) for _ in range(90)] + [(None, 1, 0.5), (5, 5, 0.9)]
    forbidden = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(None, 2)]
    forbidden = [p for p in forbidden if p[0] != p[1]]
    n = spark.createDataFrame([(x,) for x in nodes], "node long")
    ln, fb = spark.createDataFrame(links, "a long, b long, score double"), spark.createDataFrame(forbidden, "a long, b long")
    hashes = {r.node: (r.h, r.node) for r in spark.range(40).select(F.col("id").alias("node"), F.xxhash64("id").alias("h")).collect()}
    got = {r.node: r for r in cluster.pivot_clusters(n, ln, fb).collect()}
    assert {v: r.pivot for v, r in got.items()} == plain_clusters(nodes, links, forbidden, hashes)
    linked = {frozenset(p[:2]) for p in links}
    groups = defaultdict(set)
    for v, r in got.items():
        assert v == r.pivot or frozenset((v, r.pivot)) in linked
        groups[r.pivot].add(v)
    assert not any({a, b} <= g for g in groups.values() for a, b in forbidden)
    again = cluster.pivot_clusters(n.repartition(7), ln.repartition(5), fb.repartition(3)).collect()
    assert sorted(again) == sorted(got.values())


def test_clusters_of_nothing(spark):
    n = spark.createDataFrame([(1,)], "node long")
    links, forbidden = spark.createDataFrame([], "a long, b long, score double"), spark.createDataFrame([], "a long, b long")
    assert [tuple(r) for r in cluster.pivot_clusters(n, links, forbidden).collect()] == [(1, 1, None, 0)]
    assert cluster.pivot_clusters(n.limit(0), links, forbidden).count() == 0


# --- lineage -------------------------------------------------------------------------------------


def test_a_long_chain_takes_few_rounds_and_cycles_are_told(spark):
    n = 10_000
    rows = [(i, i + 1, 0) for i in range(n)] + [(-1, -2, 0), (-2, -3, 0), (-3, -1, 0), (-4, -1, 0), (-9, -9, 0), (None, 5, 0), (7, None, 9), (3, 99_999, -1)]
    rounds = Rounds(spark, "chain")
    got = {r.concept: (r.current, r.steps, r.on_cycle) for r in lineage.supersession(spark.createDataFrame(rows, "concept long, successor long, seq long"), rounds).collect()}
    assert rounds.count <= 2 * n.bit_length() + 12
    assert all(got[i] == (n, n - i, False) for i in range(n))
    assert {k: got[k] for k in (-1, -2, -3, -4, -9)} == {-1: (None, None, True), -2: (None, None, True), -3: (None, None, True), -4: (None, None, False), -9: (None, None, True)}


def test_terms_follow_splits_before_merges(spark):
    terms = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 9), ("e", 20), ("f", None)], "term string, concept long")
    merges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (20, 21, 1), (21, 20, 1)], "concept long, successor long, seq long")
    splits = spark.createDataFrame([(2, "a", 5, 1), (2, "a", 4, 0), (5, "a", 6, 1), (9, "d", 9, 1), (3, "b", 7, 1)], "concept long, term string, successor long, seq long")
    got = {r.term: (r.current, r.moves) for r in lineage.current_terms(terms, merges, splits).collect()}
    assert got == {"a": (6, 2), "b": (7, 1), "c": (3, 0), "d": (None, None), "e": (None, None), "f": (None, None)}


def plain_supersession(edges):
    out = {}
    for c in edges:
        at, seen = c, {}
        while at in edges and at not in seen:
            seen[at] = len(seen)
            at = edges[at]
        out[c] = (at, len(seen), False) if at not in edges else (None, None, at == c)
    return out


@pytest.mark.parametrize("stretch", [7, 1 << 18])
def test_chains_and_cycles_over_many_stretches(spark, stretch):
    rng = random.Random(4)
    names = rng.sample(range(10_000), 600)
    edges = {a: b for a, b in zip(names[:300], names[1:301], strict=True)}
    for lo, hi in ((301, 340), (340, 342), (342, 343), (343, 420)):  # cycles
        edges |= {names[k]: names[k + 1 if k + 1 < hi else lo] for k in range(lo, hi)}
    edges |= {names[k]: names[rng.choice([301 + k % 100, k - 1, k % 300])] for k in range(420, 600)}  # tails
    rows = [(a, b, 0) for a, b in edges.items()]
    rounds = Rounds(spark, "stretches")
    got = {r.concept: (r.current, r.steps, r.on_cycle) for r in lineage.supersession(spark.createDataFrame(rows, "concept long, successor long, seq long").repartition(5), rounds, stretch).collect()}
    assert got == plain_supersession(edges)
    strings = spark.createDataFrame([(f"c{a}", f"c{b}", c) for a, b, c in rows], "concept string, successor string, seq long")
    assert {int(r.concept[1:]): r.steps for r in lineage.supersession(strings, stretch=stretch).collect()} == {k: v[1] for k, v in got.items()}


def test_a_cycle_takes_no_more_rounds_than_the_longest_chain(spark):
    rows = [(-2, -1, 0), (-1, -2, 0)] + [(k * 10, k * 10 + 1, 0) for k in range(5000)]
    rounds = Rounds(spark, "cycle")
    got = lineage.supersession(spark.createDataFrame(rows, "concept long, successor long, seq long"), rounds).where("on_cycle").collect()
    assert sorted(r.concept for r in got) == [-2, -1] and rounds.count <= 6


def test_only_terms_that_a_split_names_are_taken_from_split_to_split(spark, monkeypatch):
    rng = random.Random(11)
    terms = [(f"t{k}", rng.randrange(30)) for k in range(200)] + [(None, 3), ("t1", None)]
    merges = {c: rng.randrange(30) for c in rng.sample(range(30), 20)}
    splits = {(rng.randrange(30), f"t{rng.randrange(40)}"): rng.randrange(30) for _ in range(60)}
    carried = []
    write = Rounds.write

    def spy(rounds, df):
        out = write(rounds, df)
        if "seen" in df.columns:
            carried.append({r.term for r in out.select("term").collect()})
        return out

    monkeypatch.setattr(Rounds, "write", spy)
    got = Counter(
        tuple(r)
        for r in lineage.current_terms(
            spark.createDataFrame(terms, "term string, concept long"),
            spark.createDataFrame([(a, b, 0) for a, b in merges.items()], "concept long, successor long, seq long"),
            spark.createDataFrame([(c, t, s, 0) for (c, t), s in splits.items()], "concept long, term string, successor long, seq long"),
        ).collect()
    )

    def plain(term, at):
        moves, seen = 0, set()
        while at not in seen and ((at, term) in splits or at in merges):
            seen.add(at)
            moves, at = (moves + 1, splits[at, term]) if (at, term) in splits else (moves, merges[at])
        return (None, None) if at in seen or at is None else (at, moves)

    assert got == Counter((t, c, *plain(t, c)) for t, c in terms)
    assert set().union(*carried) <= {t for _, t in splits}


# --- pairing -------------------------------------------------------------------------------------


def test_ranks_of_a_large_group(spark):
    rows = [("hot", i) for i in range(500)] + [("cold", 1), (None, 4), (None, 2)]
    df = spark.createDataFrame(rows, "key string, id int").repartition(9)
    got = {(r.key, r.id): r["at"] for r in rank_in_groups(df, ["key"], ["id"], Rounds(spark, "ranks")).collect()}
    assert got == {**{("hot", i): i for i in range(500)}, ("cold", 1): 0, (None, 2): 0, (None, 4): 1}


def test_pairing_is_one_to_one_and_maximal(spark):
    rng = random.Random(6)
    side = lambda k: [(i, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 3))] if i % 9 else None) for i in range(k)]
    left, right = side(40), side(30)
    schema = "id long, shared array<string>"
    a, b = spark.createDataFrame(left + left[:3] + [(None, ["a"])], schema), spark.createDataFrame(right, schema)
    got = matching.pair_publications(a, b, (("shared", 0.5, "comparable"),)).collect()
    keys_l, keys_r = {i: set(k or []) for i, k in left}, {i: set(k or []) for i, k in right}
    assert len({r.left_id for r in got}) == len({r.right_id for r in got}) == len(got) > 0
    assert all(keys_l[r.left_id] & keys_r[r.right_id] for r in got)
    free_l, free_r = keys_l.keys() - {r.left_id for r in got}, keys_r.keys() - {r.right_id for r in got}
    assert not any(keys_l[i] & keys_r[j] for i in free_l for j in free_r)
    again = matching.pair_publications(a.repartition(5), b.repartition(3), (("shared", 0.5, "comparable"),)).collect()
    assert sorted(again) == sorted(got)


def test_pairing_gives_the_strongest_reason(spark):
    schema = "id long, publication string, application string, family_priority array<string>, applicant_date string"
    a = spark.createDataFrame([(1, "p", "x", ["f"], None), (2, None, "x", ["f"], None), (3, None, None, ["g", "f"], None), (4, None, None, None, "d")], schema)
    b = spark.createDataFrame([(11, "p", "x", None, "d"), (12, None, "x", ["g"], "d"), (13, None, None, ["g"], "d")], schema)
    got = {(r.left_id, r.right_id, r.reason, r.label) for r in matching.pair_publications(a, b).collect()}
    assert got == {(1, 11, "publication", "parallel"), (2, 12, "application", "parallel"), (3, 13, "family_priority", "near_parallel")}


def test_tiers_of_one_key_a_row_take_no_rounds(spark, monkeypatch):
    rng = random.Random(3)
    side = lambda ids: [(i, rng.choice("abcd") if i % 5 else None) for i in ids]
    left, right = side(range(120)), side(range(200, 270))
    written, write = [], Rounds.write
    monkeypatch.setattr(Rounds, "write", lambda rounds, df: written.append(df.columns) or write(rounds, df))
    pair = lambda a, b: {(r.left_id, r.right_id) for r in matching.pair_publications(spark.createDataFrame(a, "id long, k string"), spark.createDataFrame(b, "id long, k string"), (("k", 0.5, "comparable"),)).collect()}
    ranked = lambda rows, key: sorted(i for i, k in rows if k == key)
    want = {p for key in "abcd" for p in zip(ranked(left, key), ranked(right, key), strict=False)}
    assert pair(left, right) == want and len(written) <= 5
    # a repeated id has several keys: it is in one pair only
    got = pair([(1, "a"), (1, "b"), (2, "b")], [(11, "a"), (12, "b"), (13, "b")])
    assert len(got) == 2 and {a for a, _ in got} == {1, 2} and len({b for _, b in got}) == 2


# --- boundaries, boilerplate, F1 -----------------------------------------------------------------


def test_boundary_pairs_equal_pairwise_comparison(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, "u", "v"]), s := rng.randrange(60), s + rng.randrange(-1, 25)) for _ in range(300)] + [("u", 0, 90), ("u", None, 4), ("w", 5, 5)]
    spans = spark.createDataFrame(rows, "unit string, start int, end int")
    known = {r for r in rows if None not in r[1:] and r[2] > r[1]}
    want = set()
    for u, s, e in known:
        for v, t, f in known:
            if u == v and t < e and s < f and (t < s or (t == s and f > e)):
                want.add((u, s, e, t, f, "nested" if f >= e else "crossing"))
    for window in (7, 1 << 16):
        assert {tuple(r) for r in boundaries.boundary_pairs(spans, ["unit"], window).collect()} == want
    assert boundaries.boundary_report(spans.limit(0), ["unit"]).count() == 0


def test_heavy_hitters_equal_exact_counts(spark):
    rng = random.Random(8)
    rows = [rng.choice(["one", "two", "three"]) if rng.random() < 0.3 else f"x{rng.randrange(3000)}" for _ in range(5000)] + [None, "", "  "]
    known = Counter(r for r in rows if r and r.strip())
    for share in (0.001, 0.05):
        got = {r.passage: r.n for r in boilerplate.heavy_hitters(spark.createDataFrame([(r,) for r in rows], "passage string").repartition(6), share).collect()}
        assert got == {p: n for p, n in known.items() if n >= share * sum(known.values())}
    assert boilerplate.heavy_hitters(spark.createDataFrame([], "passage string")).count() == 0


def test_boilerplate_lines_are_taken_out(spark):
    docs = spark.createDataFrame([(i, f"own {i}\n  footer \nlast {i}") for i in range(20)] + [(99, None)], "doc_id int, text string")
    found = boilerplate.heavy_hitters(docs.select(F.explode(boilerplate.lines(F.col("text"))).alias("passage")), 0.3)
    got = {r.doc_id: r.text for r in boilerplate.without_boilerplate(docs, found).collect()}
    assert got[3] == "own 3\nlast 3" and got[99] is None and len(got) == 21


def test_pairwise_f1_equals_pairs(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"])) for _ in range(200)]
    pairs = [(x, y) for i, x in enumerate(rows) for y in rows[:i]]
    same = lambda x, y, k: x[k] is not None and x[k] == y[k]
    tp, fp, gp = (sum(t(x, y) for x, y in pairs) for t in (lambda x, y: same(x, y, 0) and same(x, y, 1), lambda x, y: same(x, y, 1), lambda x, y: same(x, y, 0)))
    r = evaluate.pairwise_f1(spark.createDataFrame(rows, "gold int, found string")).first()
    assert (r.tp, r.found_pairs, r.gold_pairs) == (tp, fp, gp) and abs(r.f1 - 2 * tp / (fp + gp)) < 1e-9
    empty = evaluate.pairwise_f1(spark.createDataFrame([], "gold int, found string")).first()
    assert (empty.tp, empty.f1) == (0, None)


# --- snapshots and vectors -----------------------------------------------------------------------


def test_changes_read_only_differing_buckets(spark, tmp_path):
    rows = [(i, None if i % 10 == 0 else f"t{i}", i % 3) for i in range(400)] + [(None, "n", 1), (7, "t7", 1)]
    old = spark.createDataFrame(rows, "id long, text string, k int")
    new = old.where("id is null or id not in (3, 4)").withColumn("text", F.when(F.col("id") == 9, "other").otherwise(F.col("text")))
    new = new.unionByName(spark.createDataFrame([(1000, None, 2), (7, "t7", 1)], "id long, text string, k int")).select("k", "id", "text")
    paths = [str(tmp_path / n) for n in ("old", "new", "same")]
    for df, path in zip((old.repartition(5), new, old.repartition(3)), paths, strict=True):
        changes.write_snapshot(df, ["id"], path, 64)
    assert changes.differing_buckets(spark, paths[0], paths[2]) == []
    assert changes.changed_rows(spark, paths[0], paths[2], ["id"]).count() == 0
    buckets = changes.differing_buckets(spark, paths[0], paths[1])
    assert 0 < len(buckets) <= 5
    told = changes.changed_rows(spark, paths[0], paths[1], ["id"])
    assert {(r.id, r.status) for r in told.collect()} == {(3, "gone"), (4, "gone"), (9, "changed"), (1000, "added"), (7, "changed")}
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan or "_bucket#" in plan and "IN (" in plan
    with pytest.raises(ValueError, match="different columns"):
        changes.write_snapshot(old.drop("k"), ["id"], str(tmp_path / "other"), 64)
        changes.changed_rows(spark, paths[0], str(tmp_path / "other"), ["id"])


def test_duplicates_by_content(spark):
    rows = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None), (5, None), (None, "x"), (6, "")], "id long, text string")
    assert {tuple(r) for r in changes.duplicates(rows, "id", ["text"]).collect()} == {(3, 1), (1, 1), (4, 4), (5, 4)}


def test_vector_index_finds_most_of_the_exact_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.4 * rng.normal(size=16)).tolist()) for i in range(3000)]
    rows += [(90_000, None), (90_001, [0.0] * 16), (90_002, [1.0]), (None, [1.0] * 16), (90_003, [float("nan")] * 16)]
    stored = spark.createDataFrame(rows, "concept_id long, embedding array<float>")
    asked = spark.createDataFrame([(f"p{i}", v) for i, v in rows[:3000:50]] + [("none", None)], "proposal_id string, query_embedding array<float>")
    index = vector_index.build(stored, sample=1500)
    assert index.rows.count() == 3000
    exact = resolve.vector_signal(asked, stored.where("concept_id < 90000"))
    found = vector_index.search(index, asked, 16, index.probes(0.95))
    told = vector_index.recall(found, exact).first()
    assert told.asked == 60 and told.recall >= 0.9 and index.probes(0.95) < len(index.centres)
    whole = vector_index.search(index, asked, 16, len(index.centres))
    assert vector_index.recall(whole, exact).first().recall == 1.0
    assert vector_index.build(stored.where("concept_id >= 90000 and embedding is null")) is None


# --- terms and reviews ---------------------------------------------------------------------------


@pytest.mark.parametrize("penalty", [0.0, 0.2])
def test_review_queue_equals_sorting_everything(spark, penalty):
    rng = random.Random(11)
    rows = [(i, rng.choice("abc"), rng.choice([None, rng.random()]), rng.random() ** 3, rng.random()) for i in range(900)] + [(None, "a", 1.0, 1.0, 1.0)]
    items = spark.createDataFrame(rows, "item long, group string, uncertainty double, impact double, novelty double")
    weights = {"uncertainty": 0.5, "impact": 0.3, "novelty": 0.2}
    total = {r[0]: sum(w * (v or 0.0) for w, v in zip(weights.values(), r[2:], strict=True)) for r in rows if r[0] is not None}
    place = Counter()
    priority = {}
    for i in sorted(total, key=lambda i: (-total[i], i)):
        group = rows[i][1]
        priority[i] = total[i] - penalty * place[group]
        place[group] += 1
    want = sorted(priority, key=lambda i: (-round(priority[i], 12), i))[:12]
    for depth in (1, 8, 100):
        got = evaluate.review_queue(items, 12, weights, penalty, depth).orderBy("rank").collect()
        assert [r.item for r in got] == want and [r.priority for r in got] == pytest.approx([priority[i] for i in want])
    assert evaluate.review_queue(items.limit(0), 5, weights).count() == 0


def test_nc_value_and_log_likelihood(spark):
    rows = [("r1", "f1", "gold alloy", ["hard"]), ("r1", "f1", "gold alloy", ["hard", "new"]), ("r2", None, "alloy", ["new"]), ("r3", "f2", "blue sky", None)]
    mentions = spark.createDataFrame(rows, "source_record_id string, family_id string, text string, context array<string>")
    got = {r.text: (r.freq, r.families, round(r.c_value, 4), round(r.nc_value, 4)) for r in evaluate.nc_value(mentions, 1).collect()}
    c = round(2 * float(np.log2(3)), 4)
    # the best term is gold alloy: hard and new weigh 1
    assert got == {"gold alloy": (2, 1, c, round(0.8 * 2 * float(np.log2(3)) + 0.2 * 3, 4)), "alloy": (1, 0, -1.0, -0.6), "blue sky": (1, 1, round(float(np.log2(3)), 4), round(0.8 * float(np.log2(3)), 4))}
    ll = {r.text: r.log_likelihood for r in evaluate.log_likelihood(mentions, spark.createDataFrame([("alloy",)] * 5 + [("sky",)], "text string")).collect()}
    assert ll["gold alloy"] > 0 > ll["alloy"] and ll["sky"] < 0
    assert [r.log_likelihood for r in evaluate.log_likelihood(mentions.limit(0), mentions.select("text")).collect()] == [None] * 3
