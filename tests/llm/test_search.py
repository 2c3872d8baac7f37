"""Hard negatives and lexical search against brute force, language identification against held-out rows."""

import random
import re
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from placelens.llm import hard_negatives as hard
from placelens.llm import language, lexical_search
from placelens.llm.common import ASCII_SPACE, span_hashes, spans, table, text_bytes
from pyspark.sql import functions as F
from tests.llm import cases

SF = "/root/testdata/sf0.01"


# ---- hashes ------------------------------------------------------------------------------------------------------

def test_span_hashes_tell_structured_words_apart():
    word = "a"
    for _ in range(10):                                            # Thue-Morse: defeats polynomials modulo 2^64
        word += word.translate(str.maketrans("ab", "ba"))
    rng = random.Random(1)
    base = "".join(rng.choice("abcdef") for _ in range(20_000))
    texts = [word, word.translate(str.maketrans("ab", "ba")), base, base[4096:8192] + base[:4096] + base[8192:], base[:-1],
             *(base[:i] + "x" + base[i + 1:] for i in (0, 15, 16, 4095, 4096, 8192, 19_999)), *(base[:n] for n in (1, 15, 16, 17, 4096, 4097))]
    column = pa.array([" ".join(texts), *texts])
    data, offsets = text_bytes(column)
    start, end = spans(data, offsets, ASCII_SPACE)
    h = span_hashes(data, start, end).tolist()
    assert h[:len(texts)] == h[len(texts):] and len(set(h)) == len(texts)


# ---- hard negatives ----------------------------------------------------------------------------------------------

TOP = 2 ** 63 - 1


def brute_negatives(rows, k=5):
    rows = sorted({(i, lab, tuple(v)) for i, v, lab in rows if i is not None and lab is not None and v is not None
                   and all(x is not None and np.isfinite(x) for x in v)})
    vectors = [(i, lab, [floor(256 * x) for x in v]) for i, lab, v in rows]
    out = []
    for n, (i, lab, v) in enumerate(vectors):
        if i % 100:
            continue
        scores = [(-max(-TOP, min(TOP, sum(a * b for a, b in zip(v, w)))), j, m != n, other == lab, len(w) == len(v)) for m, (j, other, w) in enumerate(vectors)]
        scores.sort(key=lambda s: s[:2])
        for p, j, other, _, _ in [s for s in scores if s[2] and s[3] and s[4]][:k]:
            found = [s for s in scores if not s[3] and s[4] and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(i, j, r + 1, s[1], -p, -s[0]) for r, s in enumerate(found)]
    return sorted(out)


def run_negatives(spark, rows, **options):
    data = spark.createDataFrame([(i, v, lab, "x", 1.0) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, side string, score double")
    return sorted(map(tuple, hard.hard_negatives(data, F.col("vec_id") % 100 == 0, **options).collect()))


@pytest.mark.parametrize("seed", range(2))
def test_hard_negatives(spark, monkeypatch, seed):
    monkeypatch.setattr(hard, "PACK", 7)
    monkeypatch.setattr(hard, "CELL_ROWS", 30)
    monkeypatch.setattr(hard, "ANCHOR_NUMBERS", 16)
    rng = np.random.default_rng(seed)
    rows = [(int(n) * (25 if n % 3 else 50), [float(x) for x in np.round(rng.normal(0.3, 1, 4), 1)], int(rng.integers(0, 3))) for n in range(240)]
    rows += [(100, None, 1), (200, [None, 1.0, 1.0, 1.0], 1), (300, [float("nan")] * 4, 0), (400, [1.0] * 4, None), (None, [1.0] * 4, 0),
             (500, [], 0), (501, [], 0), (502, [], 1), (600, [0.0] * 4, 1), (700, [1.0, 2.0], 0), (701, [1.0, 3.0], 0), (702, [1.0, 2.9], 1), (703, [1.0, 3.0], 2)]
    rows += rows[:20]                                                          # repeated rows
    got = run_negatives(spark, rows)
    assert got == brute_negatives(rows) and len(got) > 100


def test_hard_negatives_of_any_size(spark):
    rng = np.random.default_rng(5)
    rows = [(n * 50, [float(x * 10.0 ** int(rng.integers(0, 7))) for x in rng.normal(0.5, 1, 3)], n % 2) for n in range(40)]
    rows += [(5000 + n, [1e17 * n, 3.0, -1e9], n % 2) for n in range(4)] + [(100_000, [3e16, 1.0, 1.0], 0)]
    assert run_negatives(spark, rows) == brute_negatives(rows)
    assert run_negatives(spark, [(100, [1.0], 1)]) == [] == run_negatives(spark, [])
    assert run_negatives(spark, [(100, [float("inf")], 1), (200, [1e308], 1)]) == []


@pytest.mark.parametrize("top", [3, 2 ** 20, 2 ** 40])
def test_packed_products(top):
    rng = random.Random(top)
    x = np.array([[rng.randrange(-top, top) for _ in range(9)] for _ in range(50)])
    x = x if top < 2 ** 31 else x.astype(object)
    anchors = [[rng.randrange(-top, top) for _ in range(9)] for _ in range(5)]
    pack = hard.Pack(x, max(abs(a) for row in anchors for a in row))
    for a in anchors:
        assert pack.scores(a).tolist() == [max(-TOP, min(TOP, sum(int(p) * q for p, q in zip(row, a)))) for row in x.tolist()]


# ---- lexical search ----------------------------------------------------------------------------------------------

_TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return _TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(items, documents, k=50):
    docs = [(i, terms_of(t)) for i, t in documents]
    total, length = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df, asked, out = {}, {}, []
    for _, t in docs:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    for i, text in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms_of(text))
    for i, wanted in asked.items():
        found = []
        for d, t in docs:
            if d is None or not t:
                continue
            m = 50 + 50 * len(t) * total // length
            score = sum(floor(1000 * log((2 * total + 2) / (2 * df[term] + 1))) * (10 ** 9 * t.count(term) // (1000 * t.count(term) + 20 * m))
                        for term in wanted if term in df and term in t)
            if score > 0:
                found.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("vocabulary", [10 ** 6, 3])
@pytest.mark.parametrize("k", [1, 4])
def test_lexical_search(spark, monkeypatch, k, vocabulary):
    for name, value in {"VOCABULARY": vocabulary, "ITEM_TERMS": 150, "CELL_ROWS": 40, "LEAF_DOCS": 4, "LEAF_ITEMS": 2, "FAN": 2}.items():
        monkeypatch.setattr(lexical_search, name, value)
    docs = cases.documents()
    rng = random.Random(9)
    items = [(n, cases.text(rng, rng.randrange(1, 12))) for n in range(25)]
    items += [(100, None), (101, ""), (102, "!!"), (103, "nowhere at all"), (None, "one two"), (104, "ONE two, zwei-Wörter 漢字"), (5, "one"), (104, "ONE")]
    data = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id int, score string")
    got = sorted(map(tuple, lexical_search.ranked_search(data, cases.table(spark, docs), k).collect()))
    assert got == brute_search(items, docs, k) and len(got) >= 20


def test_lexical_search_edges(spark):
    docs, items = cases.table(spark, [(1, "one two"), (2, None)]), spark.createDataFrame([(1, "one")], "item_id long, text string")
    search = lexical_search.ranked_search
    assert search(items, docs.limit(0)).count() == 0 and search(items.limit(0), docs).count() == 0
    assert search(items, cases.table(spark, [(2, None), (3, "")])).count() == 0
    tied = cases.table(spark, [(n, "one two") for n in range(60, 0, -1)] + [(100 + n, "three four") for n in range(200)])
    assert [r.doc_id for r in search(items, tied).orderBy("rank").collect()] == list(range(1, 51))


def test_dual_trees_leave_pairs_out():
    rng = np.random.default_rng(2)
    n, docs, items = 4000, 3000, 60
    topic = rng.integers(0, 40, docs)
    bounds = np.arange(docs + 1) * 20
    terms = (topic[:, None] * 100 + np.sort(rng.permuted(np.tile(np.arange(100), (docs, 1)), axis=1)[:, :20], axis=1)).ravel().astype(np.int64)
    values = rng.integers(1, 100, len(terms))
    item_terms = (rng.integers(0, 40, items)[:, None] * 100 + np.sort(rng.permuted(np.tile(np.arange(100), (items, 1)), axis=1)[:, :8], axis=1)).ravel().astype(np.int64)
    weights = rng.integers(1, 50, len(item_terms))
    search = lexical_search.Search(np.arange(items), np.arange(items + 1) * 8, item_terms, weights, 5)
    search.add(np.arange(docs), terms, values, bounds)
    dense, asked = np.zeros((docs, n), np.int64), np.zeros((items, n), np.int64)
    dense[np.repeat(np.arange(docs), 20), terms] = values
    asked[np.repeat(np.arange(items), 8), item_terms] = weights
    scores = asked @ dense.T
    want = sorted((i, d, scores[i, d]) for i in range(items) for d in np.lexsort((np.arange(docs), -scores[i]))[:5].tolist() if scores[i, d] > 0)
    assert sorted(zip(*(c.tolist() for c in search.results()))) == want
    assert search.pairs < docs * items / 4


# ---- language ----------------------------------------------------------------------------------------------------

def test_language_on_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text", "lang")
    got = language.predict(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 2000 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    for name in ("de", "en", "es", "fr"):
        assert np.mean([r.lang_pred == name for r in held if r.lang == name]) > 0.95


def test_language_reads_no_held_out_row(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    wrong = docs.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    want, got = ({r.doc_id: r[2:] for r in language.predict(docs, language.fit(d)).collect()} for d in (docs, wrong))
    assert want == got


def test_language_edges(spark):
    rows = [(n, f"der die das und nicht {n} straße" if n % 2 else f"the and of that which {n} house", "de" if n % 2 else "en") for n in range(60)]
    rows += [(n, f"el la los que para {n} calle" if n % 2 else f"le la les que pour {n} rue", "es" if n % 2 else "fr") for n in range(60, 120)]
    rows += [(n, f"sumi kata rono {n} mezu", "qq") for n in range(120, 140)]
    odd = [(200, None, "en"), (201, "", "en"), (202, "123 !?", "de"), (203, "ж", None), (None, "the house", "en"), (204, "the house " * 50_000, None)]
    ddl = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows + odd + rows[:5], ddl).withColumn("score", F.lit("x"))
    model = language.fit(docs)
    assert model.names == ["de", "en", "es", "fr", "qq"] and len(model.members) == 3 and len(model.pairs) == 2
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and got[200].score == 0
    assert got[204].lang_pred == "en" and got[None].lang_pred == "en" and got[None].held_out is False
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows]) > 0.95
    one = language.predict(docs, language.fit(docs.where("lang = 'de'"))).where("doc_id = 3").first()
    assert (one.lang_pred, one.score) == ("de", 1.0)
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs.limit(0))).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_svm_finds_the_exact_margin():
    """Two points: the penalised squared hinge has a closed solution along their difference."""
    x, y = np.array([[1.0, 0.0], [-1.0, 0.0]]), np.array([1.0, -1.0])
    w = language.fit_svm(x, y, np.array([0.5, 0.5]))
    assert np.allclose(w, [2 / (2 + language.PENALTY), 0], atol=1e-3)
