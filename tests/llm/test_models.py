"""Toxicity, quality and personal data: models against held-out rows, gradients and brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from placelens.llm import pii, quality, toxicity
from placelens.llm.common import table
from tests.llm import cases

SF = "/root/testdata/sf0.1"


def test_toxicity_on_rows_the_fit_has_not_seen(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, labels.where("doc_id % 4 != 0"))
    got = toxicity.score(docs, model).join(labels.where("doc_id % 4 = 0").select("doc_id", "toxic").withColumnRenamed("toxic", "y"), "doc_id").collect()
    hit = sum(r.toxic and r.y for r in got) / sum(r.y for r in got)
    wrong = sum(r.toxic and not r.y for r in got) / sum(1 - r.y for r in got)
    assert hit > 0.85 and wrong < 0.02
    assert all(0 <= r.severity <= 3 for r in got) and (np.diff(model.thresholds) > 0).all()


def test_toxicity_edges(spark):
    rows = cases.documents() + [(6000 + k, f"calm words {k} idiot moron") for k in range(40)] + [(7000 + k, f"calm words {k}") for k in range(80)]
    docs = cases.table(spark, rows)
    labels = spark.createDataFrame([(6000 + k, 1, 1) for k in range(40)] + [(7000 + k, 1, 0) for k in range(80)] + [(None, 1, 1), (7000, 1, None), (6000, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[6000 + k].toxic for k in range(40)) and not any(got[7000 + k].toxic for k in range(80))
    kept = toxicity.clean_documents(docs, model)
    assert kept.schema == docs.schema and kept.count() == len(rows) - 40
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("toxic OR severity > 1e-9").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_ordinal_gradient_reaches_the_best_thresholds():
    """Without features the fitted thresholds are the log-odds of exceeding each grade."""
    grade = np.array([0] * 60 + [1] * 20 + [2] * 12 + [3] * 8)
    nothing = np.zeros(0, np.int64)
    _, t = toxicity.fit_ordinal(nothing, nothing, np.zeros(0), grade, 1, steps=3000, rate=0.02)
    want = [-np.log(p / (1 - p)) for p in (0.40, 0.20, 0.08)]
    assert np.allclose(t, want, atol=0.02)


def test_quality_on_held_out_rows(spark):
    labels = table(spark, SF, "labels").select("doc_id", "quality")
    got = quality.quality(table(spark, SF, "documents"), table(spark, SF, "labels")).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    auc = np.mean([[x > y for y in bad] for x in good])
    assert auc > 0.97 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_quality_reads_no_held_out_label(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) AS quality", "toxic")
    a, b = ({r.doc_id: r.score for r in quality.quality(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_quality_edges(spark):
    docs = cases.table(spark, cases.documents())
    labels = spark.createDataFrame([(k * 7 % 1009, 1) for k in range(20)] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_nonnegative_risk_separates_without_negatives():
    rng = np.random.default_rng(1)
    positive = np.c_[np.ones(3000), rng.normal(1.5, 1, 3000)]
    unlabelled = np.c_[np.ones(6000), np.r_[rng.normal(1.5, 1, 3000), rng.normal(-1.5, 1, 3000)]]
    w = quality.fit_nnpu(positive, unlabelled, 0.5)
    g = unlabelled @ w
    assert np.mean((g > 0) == (np.arange(6000) < 3000)) > 0.9
    assert quality.nonnegative_risk(positive @ w, g, 0.5) < quality.nonnegative_risk(positive @ (0 * w), 0 * g, 0.5)


PATTERNS = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in p.finditer(text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            total = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d)))
            if (kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == 2 and 16 <= len(d) <= 19 and total % 10 == 0 or kind == 3 and 8 <= len(d) <= 15):
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(2)
    for alphabet in ("ab@..1-_ é", "012...x", "0123456789- ", "+1(2) .-x3", "a@1.+ -0é\n"):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("card 4111 1111-1111 1111, 4111111111111112") == [(2, 5, 24)]


def test_tagger_gradient():
    p, rng = pii.new_parameters(), random.Random(3)
    x, y = pii.codes(["ab 12 @", "x"], 12), np.array([pii.tags_of([(3, 1, 4)], 12), pii.tags_of([], 12)])
    _, g = pii.loss_and_gradient(p, x, y)
    for k in p:
        for _ in range(3):
            at = tuple(rng.randrange(s) for s in p[k].shape)
            at = (int(x[0, rng.randrange(7)]), at[1]) if k[0] == "x" else at
            old, value = p[k][at], []
            for d in (1e-5, -1e-5):
                p[k][at] = old + d
                value.append(pii.loss_and_gradient(p, x, y)[0])
            p[k][at] = old
            slope = (value[0] - value[1]) / 2e-5
            assert abs(slope - g[k][at]) < 1e-4 * max(1, abs(slope)), k


def test_viterbi_and_marginals_by_enumeration():
    import itertools
    rng = np.random.default_rng(4)
    e, trans = rng.normal(size=(3, 1, pii.TAGS)), rng.normal(size=(pii.TAGS, pii.TAGS)) + pii._FORBIDDEN
    paths = {p: pii._START[p[0]] + sum(e[t, 0, p[t]] for t in range(3)) + trans[p[0], p[1]] + trans[p[1], p[2]]
             for p in itertools.product(range(pii.TAGS), repeat=3)}
    assert tuple(pii.viterbi(e, trans)[0]) == max(paths, key=paths.get)
    total, m, _, _ = pii.marginals(e, trans)
    assert np.isclose(total[0], np.log(sum(np.exp(v) for v in paths.values())))
    assert np.isclose(m[1, 0, 0], sum(np.exp(v - total[0]) for p, v in paths.items() if p[1] == 0))


def test_windows_cover_every_trigger_and_spans_are_reconciled():
    rng = random.Random(6)
    for _ in range(50):
        t = "".join(rng.choice("abc é" * 6 + "7@") for _ in range(rng.randrange(700)))
        starts = pii.windows_of(t)
        for m in re.finditer("[0-9@]", t):
            inside = [s for s in starts if s <= m.start() < s + pii.WINDOW]
            assert len(inside) >= (1 if len(t) <= pii.WINDOW or m.start() < pii.STRIDE else 2)
    t = "x" * 60 + " +1 (314) 555-6532 " + "y" * 60
    decoded = [[(3, 61, 79, 0.95)], [(3, 13, 31, 0.97)]]
    assert pii.reconciled(t, [0, 48], decoded, []) == [(3, 61, 78)]
    assert pii.reconciled(t, [0, 48], decoded, [(2, 70, 75)]) == []
    assert pii.reconciled(t, [0], [[(3, 61, 96, 0.99)]], []) == []


def test_personal_data(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = cases.documents() + [(8000, "call +1 (314) 555-6532 4663622617512349 now"), (8001, "é é a.b@c.de 1.2.3.4 x")]
    more = cases.table(spark, rows).select("doc_id", "text")
    parameters = pii.fit(docs)
    got = pii.find_personal_data(docs, parameters).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    import hashlib
    for r in got:
        base = plain_spans(texts[r.doc_id])
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in base) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) <= set(r.spans.split(",")) or not told
    extra = {r.doc_id: r for r in pii.find_personal_data(more, parameters).collect()}
    assert extra[8001].spans == "email:4:12,ip:13:20" and extra[8001].n_email == 1
    assert extra[8000].n_phone == extra[8000].n_card == 0
    empty = pii.find_personal_data(more.limit(0), None)
    assert empty.count() == 0 and pii.fit(cases.table(spark, [(1, "no such thing"), (2, None)])) is None


def test_tagger_adds_what_patterns_miss():
    """Matches that run into one another are no pattern match; the trained tagger finds most of them."""
    rng = random.Random(9)

    def phone():
        return f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"

    def card():
        while True:
            c = f"4{rng.randrange(10**14, 10**15)}{rng.randrange(10)}"
            if pii.luhn(pii.digits(c)):
                return c

    def around(x):
        words = ["".join(rng.choice("aehinorst") for _ in range(rng.randrange(2, 8))) for _ in range(14)]
        before = " ".join(words[:7]) + " "
        return before + x + " " + " ".join(words[7:]), len(before)

    examples = []
    for _ in range(120):
        for kind, make in ((3, phone), (2, card)):
            x = make()
            w, a = around(x)
            examples.append((w[:pii.WINDOW], [(kind, a, a + len(x))]))
    texts = [(k, w[a:b]) for w, s in examples for k, a, b in s]
    examples += [pii.joined(w, s, texts[(7 * i + 3) % len(texts)]) for i, (w, s) in enumerate(examples)]
    p = pii.train(examples, epochs=35)      # as many steps as a fit on the corpus takes
    found = 0
    for _ in range(40):
        t, a = around(f"{phone()} {card()}")
        assert pii.base_spans(t) == []
        starts = pii.windows_of(t)
        spans = pii.reconciled(t, starts, pii.window_spans(p, [t[s:s + pii.WINDOW] for s in starts]), [])
        found += len({k for k, _, _ in spans} & {2, 3})
    assert found >= 40


@pytest.mark.parametrize("texts", [[], [None, ""], ["a\nb", "É" * 3000, " \n "]])
def test_surface_features_of_odd_texts(texts):
    rows = quality.surface_features(pa.array(texts, pa.string()))
    assert len(rows) == len(quality.NAMES) and all(len(r) == len(texts) and np.isfinite(r).all() for r in rows)


@pytest.mark.parametrize("text, want", [("0" * 5000 + ".1.1.1", 1), ("1." + "0" * 5000 + "9.2.3", 1), ("9" * 5000 + ".1.1.1", 0), ("1.2.3." + "0" * 4301, 1),
                                        ("1.2.3.256", 0), ("000255.0.0.0", 1)])
def test_addresses_of_any_length(text, want):
    assert [(k, a, b) for k, a, b in pii.base_spans(text) if k == 1] == [(1, 0, len(text))] * want
    assert pii.plausible(1, text) == bool(want)
