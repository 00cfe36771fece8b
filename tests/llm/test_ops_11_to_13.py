"""Whitening, spelling variants and token files against plain versions, with odd rows in every table."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from llm import ngram_join, queries, spelling, token_coding, token_files, whitening
from llm.units import load, tokenizer_path

# --- whitening -----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, n long, vector string, part int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], VECTORS)


def plain_whitening(rows, k=8):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    y = ((n * x - s) / n).astype(float)
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:k]
    return n, [int(d) for d in ((n * x - s) ** 2).sum(axis=1)], y @ u[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)


def test_whitening_equals_the_plain_version(spark):
    rng = np.random.default_rng(3)
    scales = np.array([3.0, 2.5, 2.0, 1.7, 1.4, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3])
    good = [(i if i != 5 else None, (rng.normal(size=12) * scales).tolist()) for i in range(700)]
    good += [good[3], good[3]]
    bad = [(9000, None), (9001, [float("nan")] * 12), (9002, [None] + [0.0] * 11), (9003, [float("inf")] * 12), (9004, []), (9005, [1.0] * 5)]
    n, deviation, white, explained = plain_whitening(good)
    got = whitening.whiten(vectors_of(spark, good + bad).repartition(13)).collect()
    assert len(got) == 8 * len(good) and {r.n for r in got} == {n}
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    signs = [np.sign(by[0][0].whitened * white[0, 0])] * 8
    for i, (doc, _) in enumerate(good):
        if Counter(d for d, _ in good)[doc] > 1:
            assert len(by[doc]) == 24
            continue
        rows = sorted(by[doc], key=lambda r: r.component)
        assert [r.component for r in rows] == list(range(1, 9)) and {r.deviation for r in rows} == {deviation[i]}
        signs = [np.sign(r.whitened * w) for r, w in zip(rows, white[i], strict=True)] if i == 0 else signs
        assert np.allclose([r.whitened for r in rows], white[i] * signs, atol=1e-9)
        assert np.allclose([r.explained for r in rows], explained, rtol=1e-9)
    assert got[0].identity_error < 1e-9


def test_whitening_of_few_equal_and_no_rows(spark):
    one = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 2, 0, None, 0.0, None), (2, 2, 0, None, 0.0, None)] * 2
    line = whitening.whiten(vectors_of(spark, [(1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0])])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True), (3, True)} and line[0].identity_error < 1e-9
    assert whitening.whiten(vectors_of(spark, [(1, None), (2, [])])).count() == 0
    huge = whitening.whiten(vectors_of(spark, [(1, [3e38]), (2, [-3e38]), (3, [0.0])])).collect()
    assert [r.deviation for r in sorted(huge, key=lambda r: r.vec_id)] == [None, None, 0]


# --- spelling ------------------------------------------------------------------------------------

UPPER = {c: c + 32 for c in range(65, 91)}


def plain_forms(docs):
    total = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            total[low if h % 31 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    words = {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if a == b or len(b) - len(a) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near_of = {w: [v for v in words if near(w, v)] for w in words}
    form = {w: min(((-words[v], v) for v in near_of[w] if words[v] >= 10 * words[w]), default=(None, None))[1] for w in words}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (n, len(near_of[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


@pytest.fixture(scope="module")
def spelled(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdeÀé÷ÿ") for _ in range(rng.randint(7, 11))) for _ in range(25)] + ["x" * 3000, "y" * 40, "aaaaaaa", "aaaaaaaa", "aaaaaaaaa"]

    def edit(w):
        i, c = rng.randrange(len(w)), rng.choice("abcdeé")
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w.upper(), w])

    docs = [(i, " ".join(edit(w) if rng.random() < 0.3 else w for w in rng.choices(base, weights=[k % 5 + 1 for k in range(len(base))], k=40))) for i in range(150)]
    docs += [(None, "Nothing nothing NOTHING"), (7, None), (8, ""), (9, "kurz, 123 a_b"), docs[0], docs[0], (500, "chained1chainede " + "rechained " * 30 + "chained " * 300 + "chaine " * 3)]
    rows = spark.createDataFrame([(d, t, "en", 1, "w", 2) for d, t in docs], "doc_id long, text string, lang string, n long, word string, key long")
    return docs, rows


def test_forms_equal_brute_force(spelled):
    docs, rows = spelled
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_forms(rows).collect()}
    assert got == plain_forms(docs)
    assert sum(v[2] is not None for v in got.values()) > 3


def test_large_blocks_are_cut_into_parts(spelled, monkeypatch):
    docs, rows = spelled
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 3)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_forms(rows).collect()}
    assert got == plain_forms(docs)


def test_one_edit():
    cases = {("abcdefg", "abcdefg"): False, ("abcdefg", "abcdefgh"): True, ("abcdefg", "xabcdefg"): True, ("abcdefg", "abxdefg"): True, ("abcdefg", "axcxefg"): False, ("abcdefg", "abcdefghi"): False, ("aaaaaaa", "aaaaaaaa"): True}
    assert {k: spelling.one_edit(*k) for k in cases} == cases


def test_spelling_of_no_rows(spelled):
    assert spelling.spelling_forms(spelled[1].limit(0)).count() == 0
    assert spelling.spelling_forms(spelled[1].where("text like 'kurz%'")).count() == 0


# --- token files ---------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [64, 8192])
def test_coder_gives_back_every_id(monkeypatch, block):
    monkeypatch.setattr(token_coding, "BLOCK", block)
    rng = np.random.default_rng(1)
    zipf = np.minimum(rng.zipf(1.3, 5000), 50_000).astype(np.uint32)
    for ids in (zipf, zipf[:1], zipf[:0], np.zeros(300, np.uint32), rng.integers(0, 2**28, 700).astype(np.uint32), np.tile(zipf[:50], 40), np.full(129, 65_535, np.uint32)):
        pieces = [(None, 3, False), (-(2**63), 2**32 - 1, True)]
        raw = b"??" + token_coding.encode(ids, pieces)
        got, told, end = token_coding.decode(memoryview(raw + b"\nmore"), 2)
        assert (got == ids).all() and len(got) == len(ids) and told == pieces and end == len(raw)


def test_coder_is_smaller_where_ids_repeat_and_tells_damage():
    ids = np.tile(np.arange(500, dtype=np.uint32), 60)
    raw = bytearray(token_coding.encode(ids, [(1, len(ids), False)]))
    assert len(raw) < len(ids) // 4
    for at in (5, len(raw) // 2, len(raw) - 9):
        bad = bytearray(raw)
        bad[at] ^= 0x40
        with pytest.raises(Exception):
            token_coding.decode(memoryview(bytes(bad)), 0)


def test_coder_joins_phrases_inside_blocks_and_keeps_ids_without_a_symbol(monkeypatch):
    """F op13: a step for every id took twice the steps; neighbours that come often are one symbol."""
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 3000, k) for k in rng.integers(1, 5, 400)]
    ids = np.concatenate([words[min(k, 399)] for k in rng.zipf(1.2, 60_000)]).astype(np.uint32)
    ranks, lengths, names, _, _ = token_coding._phrases(ids)
    assert len(ranks) < 0.6 * len(ids) and lengths.sum() == len(ranks) and max(map(len, names)) > 2
    assert [sum(len(names[r]) for r in ranks[e - n : e]) for n, e in zip(lengths, np.cumsum(lengths), strict=True)][:-1] == [token_coding.BLOCK] * (len(lengths) - 1)
    monkeypatch.setattr(token_coding, "_PART", 3 * token_coding.BLOCK)
    for ranked in (token_coding.RANKED, 500, 1):
        monkeypatch.setattr(token_coding, "RANKED", ranked)
        for case in (ids, ids[:9000], np.concatenate([ids[:20_000], ids[:20_000] + np.uint32(1 << 24)])):
            got, _, _ = token_coding.decode(memoryview(token_coding.encode(case, [(1, len(case), False)])), 0)
            assert (got == case).all()


def test_ids_of_a_column_are_those_of_the_whole_texts():
    rng = random.Random(1)
    letters = [*"ab1,.'é漢😀", *"      ", "\n", "\t", "\u00a0", "\u3000", "\u2003", "\x1c", "\x85", "\r", "\x0b", "'s", "<|endoftext|>", "\u200b", "\u180e", "\u0301"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += [None, "", " ", "  ", " a", "a ", " a ", "a\n", "a\n b", "x" * 20_000 + " b", "a b " * 5000, "a b"]
    units = load(tokenizer_path(token_files.MODEL))
    want = [units.model.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, each = units.encode_column(pa.array(["left out", *texts], pa.string()).slice(1))
    assert each.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    ids, each = units.encode_column(pa.array([], pa.string()))
    assert not len(ids) and not len(each)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß漢 ") for _ in range(rng.randint(1, 9)))
    rows = [(rng.randrange(-50, 10**12), " ".join(word() for _ in range(rng.randint(0, 80)))) for _ in range(300)]
    return rows + [(None, "null id"), (None, None), (5, ""), (6, None), (7, "same"), (7, "same"), (7, "other"), (8, "<|endoftext|> x"), (2**62, "w " * 30_000)]


def test_token_files_round_trip(spark, texts, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 40_000)
    monkeypatch.setattr(token_files, "FRAME", 5_000)
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in texts], "doc_id long, text string, value string, start long").repartition(5)
    got = token_files.token_files_round_trip(rows).collect()
    model = load(tokenizer_path(token_files.MODEL)).model
    ids = {t: np.array(model.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4") for _, t in texts}
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(ids[t]), zlib.crc32(ids[t].tobytes())) for d, t in texts)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered]).tolist()[:-1]]
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in ordered]
    assert keys == sorted(keys)
    assert token_files.token_files_round_trip(rows.limit(0)).count() == 0


def test_token_files_give_ids_back(spark, texts, tmp_path):
    rows = spark.createDataFrame([t for t in texts if t[0] not in (None, 7)], "doc_id long, text string")
    token_files.write_token_files(rows, str(tmp_path / "ids"), end_id=9)
    model = load(tokenizer_path(token_files.MODEL)).model
    got = {r.doc_id: r.ids for r in token_files.read_token_files(spark, str(tmp_path / "ids"), with_ids=True).collect()}
    assert got == {d: model.encode(t or "", add_special_tokens=False).ids + [9] for d, t in texts if d not in (None, 7)}


def test_queries_read_their_whole_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = queries.QUERIES["op13_token_id_output"](spark, sf_dir)
    assert told.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and told.count() == docs.count()
    white = queries.QUERIES["op11_embedding_whitening"](spark, sf_dir)
    assert white.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert white.count() == 8 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    forms = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in queries.QUERIES["op12_spelling_variants"](spark, sf_dir).collect()}
    want = plain_forms_fast(rows)
    assert forms == want


def plain_forms_fast(docs):
    """plain_forms by neighbourhoods of deletions, for a whole table."""
    total = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(UPPER)
            h = zlib.crc32(f"{doc}:{low}".encode())
            total[low if h % 31 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    words = {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}
    near, same = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            d = w[:i] + w[i + 1 :]
            same[i, d].add(w)
            if d in words:
                near[w].add(d)
                near[d].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: min(((-words[v], v) for v in near[w] if words[v] >= 10 * words[w]), default=(None, None))[1] for w in words}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def test_long_words_that_a_polynomial_takes_for_equal_stay_apart(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, other), (3, word)], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.ngram_jaccard(docs).collect()}
    assert got == {1: (1, 1), 2: (2, 0), 3: (1, 1)}
