"""N-gram join, line dedup and vector dedup against brute force over all pairs."""

import itertools
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from placelens.llm import groups, line_dedup, ngram_join, vectors
from placelens.llm.common import components
from tests.llm import cases


def roots(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def similar_pairs(sets, least):
    names = [k for k, s in sets.items() if s]
    for x, a in enumerate(names):
        for b in names[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and Fraction(both, len(sets[a] | sets[b])) >= least:
                yield a, b


def ascii_lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def shingles(t, n):
    w = re.findall("[^\x20\x09-\x0D]+", ascii_lower(t or ""))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000, k) for k in range(1001, 1400)]
    links += [(k, k + 1) for k in range(2000, 2080)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links + [(5, 5), (None, 3)], "a long, b long")).collect()}
    assert got == {k: v for k, v in roots({x for p in links for x in p}, links).items() if any(k in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [256, 3])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(groups, "BLOCK", block)
    rows = cases.documents()
    got = ngram_join.ngram_join(cases.table(spark, rows), n=4, num=85, den=100).collect()
    sets = {i: shingles(t, 4) for i, t in rows if i is not None}
    want = roots(sets, similar_pairs(sets, Fraction(85, 100)))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == \
        sorted((i, len(sets[i]), want[i]) for i, _ in rows if i is not None)
    assert len(set(want.values())) < len(want) - 20
    assert [r.component_id for r in got if r.doc_id is None] == [None] * 3


def test_ngram_join_of_nothing(spark):
    assert ngram_join.ngram_join(cases.table(spark, []).limit(0)).count() == 0
    got = ngram_join.ngram_join(cases.table(spark, [(1, None), (2, ""), (3, "")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


@pytest.mark.parametrize("num,den", [(85, 100), (80, 100), (1, 2)])
def test_linked_sets_share_a_signature(num, den):
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = rng.random(len(x)) > rng.random() * 0.3
        y = np.unique(np.concatenate([x[keep], rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64)]))
        if len(y) and not np.array_equal(x, y) and ngram_join.linked(x, y, num, den):
            assert set(ngram_join.signatures_of(x, num, den).tolist()) & set(ngram_join.signatures_of(y, num, den).tolist())


def test_tree_finds_all_components():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(20):
        base = rng.integers(0, 2**63, int(rng.integers(1, 120))).astype(np.uint64)
        sets += [np.unique(np.where(rng.random(len(base)) < 0.05, rng.integers(0, 2**63, len(base)).astype(np.uint64), base)) for _ in range(6)]
    links = ngram_join.tree_links((sets, list(range(len(sets)))), None, 85, 100)
    all_ = similar_pairs({i: set(s.tolist()) for i, s in enumerate(sets)}, Fraction(85, 100))
    assert roots(range(len(sets)), links) == roots(range(len(sets)), all_)
    half = len(sets) // 2
    across = ngram_join.tree_links((sets[:half], list(range(half))), (sets[half:], list(range(half, len(sets)))), 85, 100)
    want = [(a, b) for a, b in similar_pairs({i: set(s.tolist()) for i, s in enumerate(sets)}, Fraction(85, 100)) if a < half <= b]
    assert roots(range(len(sets)), across) == roots(range(len(sets)), want)


def test_line_dedup(spark):
    rows = cases.documents(seed=8) + [(5000, "Fuzzy " * 3 + "line that is long enough to be seen twice, with one letter changed"),
                                      (5001, "fuzzy " * 3 + "line that is long enough to be seen twice, with one letter chamged"), (5002, "x\n\n y \n")]
    got = line_dedup.dedup_lines(cases.table(spark, rows)).collect()
    where = defaultdict(list)
    strip = " \t\n\r\x0b\x0c"
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if i is not None and line.strip(strip):
                where[ascii_lower(line.strip(strip))].append((i, k))
    q = line_dedup.Q
    sets = {x: {x[i:i + q] for i in range(max(1, len(x) - q + 1))} for x in where}
    classes = defaultdict(list)
    for x, c in roots(sets, similar_pairs(sets, Fraction(8, 10))).items():
        classes[c] += where[x]
    first = {min(v) for v in classes.values()}
    want = []
    for i, t in rows:
        parts = (t or "").split("\n")
        full = [k for k, x in enumerate(parts) if x.strip(strip)]
        kept = full if i is None else [k for k in full if (i, k) in first]
        new = t if len(kept) == len(full) else "\n".join(x for k, x in enumerate(parts) if k in kept or k not in full) if kept else ""
        want.append((str(i), str(new), len(full), len(kept)))
    assert sorted((str(r.doc_id), str(r.text), r["__lines"], r["__kept"]) for r in got) == sorted(want)
    assert {r.item for r in got} == {"x"} and [c for c in got[0].asDict()][:3] == ["doc_id", "text", "lang"]
    assert {r.doc_id: r["__kept"] for r in got}[5001] == 0
    assert line_dedup.dedup_lines(cases.table(spark, []).limit(0)).count() == 0


def test_line_dedup_finds_one_changed_character(spark):
    """Lines of 45 to 75 characters with one character inside changed, at any place."""
    rng = random.Random(6)
    rows = []
    for k in range(186):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(45 + k // 6))
        line = "x" + line[1:-1] + "y"
        at = rng.randrange(4, len(line) - 4)
        rows += [(2 * k, line), (2 * k + 1, line[:at] + "#" + line[at + 1:])]
    got = {r.doc_id: r["__kept"] for r in line_dedup.dedup_lines(cases.table(spark, rows)).collect()}
    assert got == {i: 1 - i % 2 for i, _ in rows}


def test_line_dedup_of_two_texts_of_one_id(spark):
    rows = [(1, "the line that comes first of all"), (2, "the line that comes first of all\nalpha"), (2, "only in the other text of this id\nbeta"),
            (2, "the line that comes first of all"), (2, "only in the other text of this id\nbeta")]
    got = sorted((r.doc_id, r.text, r["__lines"], r["__kept"]) for r in line_dedup.dedup_lines(cases.table(spark, rows)).collect())
    assert got == [(1, rows[0][1], 1, 1), (2, "", 1, 0), (2, "alpha", 2, 1), (2, rows[2][1], 2, 2), (2, rows[2][1], 2, 2)]


def brute_vectors(rows):
    valid = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            valid[i] = (np.array(v, np.float64), label)
    links = []
    names = sorted(valid)
    for x, a in enumerate(names):
        for b in names[x + 1:]:
            (u, p), (v, q) = valid[a], valid[b]
            if p == q and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                links.append((a, b))
    return links


def test_vector_dedup(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PROBES", 7)
    monkeypatch.setattr(vectors, "MEMBERS", 11)
    rng = np.random.default_rng(7)
    rows, i = [], 0
    for group in range(30):
        centre = rng.normal(size=16)
        for k in range([1, 2, 5, 60][group % 4]):
            v = centre + rng.normal(size=16) * rng.choice([0, 0.02, 0.08, 0.12])
            rows.append(((i * 31) % 9973, [float(np.float32(x)) for x in v], int(group % 3)))
            i += 1
    rows += [(20001, None, 1), (20002, [0.0] * 16, 1), (20003, [float("nan")] + [1.0] * 15, 1), (20004, [None] + [1.0] * 15, 1),
             (20005, rows[0][1], None), (20006, [1.0, 2.0], 1), (20007, [2.0, 4.0], 1), (20008, [], 1), (20009, [float("inf")] * 16, 1),
             (None, rows[0][1], 0), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, item string, component int")
    got = vectors.near_duplicates(df).collect()
    links = brute_vectors(rows)
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    ids = [r[0] for r in rows if r[0] is not None]
    want = roots(set(ids), links)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None) == \
        sorted((i, count[i], want[i], want[i] == i) for i in ids)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert len(links) > 1000
    assert vectors.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("run", [vectors.RUN, 150])
def test_vector_dedup_of_dense_groups(spark, monkeypatch, run):
    """A hub whose members link with it only, and twins among vectors that are all near each other; also across blocks and passes."""
    monkeypatch.setattr(vectors, "RUN", run)
    monkeypatch.setattr(vectors, "NUMBERS", 64 * 256)
    rng = np.random.default_rng(5)

    def around(centre, cosine, n):
        d = rng.normal(size=(n, 64))
        d -= np.outer(d @ centre, centre)
        return cosine * centre + np.sqrt(1 - cosine ** 2) * d / np.linalg.norm(d, axis=1, keepdims=True)

    hub, middle = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    spokes = around(hub, 0.983, 1500)
    twins = around(middle, np.sqrt(0.9), 1000)
    other = np.array([around(v, 0.99, 1)[0] for v in twins])
    x = np.concatenate([[hub], spokes, twins, other])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.98
    np.fill_diagonal(links, False)
    want = roots(range(len(x)), zip(*(k.tolist() for k in np.nonzero(np.triu(links)))))
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = vectors.near_duplicates(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(k, int(links[k].sum()), want[k]) for k in range(len(x))]
    assert len(set(want.values())) > 900


def test_passes_grow_slowly():
    assert [vectors.passes_needed(n) for n in (1, 10**4, 10**9)] == sorted(vectors.passes_needed(n) for n in (1, 10**4, 10**9))
    assert vectors.passes_needed(10**9) < 150


def test_vectors_of_any_magnitude_and_width(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1.0, 1.0], 0), (3, [1e-200, 1.01e-200], 0), (4, [-1e300, 1e300], 0), (5, [5e-324, 5e-324], 0),
            (6, [1.0] * 4096, 0), (7, [2.0] * 4096, 0), (8, [3.0], 0), (9, [-3.0], 0)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [
        (1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4), (5, 3, 1), (6, 1, 6), (7, 1, 6), (8, 0, 8), (9, 0, 9)]


def test_windows_follow_the_order_of_the_hashes():
    """Without the exact join of runs: equal hashes lie side by side, and each vector sees the window before it, across batches."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[1::2] = x[::2] + rng.normal(size=(150, 8)) * 1e-4
    key = vectors.hashes(vectors.matrix(pa.array(x.tolist())), 0)
    order = np.argsort(key, kind="stable")
    columns = [pa.array(np.zeros(300, np.int32)), pa.array(np.zeros(300, np.int32)), pa.array(np.full(300, 8, np.int32)),
               pa.array(np.zeros(300, np.int64)), pa.array(order), pa.array(x[order].tolist())]
    table = pa.RecordBatch.from_arrays(columns, names=["pass", "label", "dim", "prefix", "item", "v"])
    edges = [pair for b in vectors._windows([table.slice(k, 50) for k in range(0, 300, 50)]) for pair in zip(*(c.to_pylist() for c in b.columns))]
    linked = {tuple(sorted(e)) for e in edges}
    assert {(k, k + 1) for k in range(0, 300, 2)} <= linked


def test_similar_lines_share_a_band_and_pass_the_sketches():
    """Planted edits that leave a similarity of 0.8 to 0.9, in lines of 45 to 1,500 characters: recall of both above 0.999."""
    rng = random.Random(17)
    letters = "abcdefghijklmnop     é"
    pairs = []
    while len(pairs) < 1200:
        line = "".join(rng.choice(letters) for _ in range(rng.choice([45, 60, 75, 150, 400, 1500]))).strip() or "a"
        other = list(line)
        for _ in range(rng.randrange(1, 2 + len(line) // 30)):
            at = rng.randrange(len(other))
            other[at:at + rng.randrange(2)] = rng.choice(letters) * rng.randrange(2)
        other = "".join(other).strip()
        x, y = ({s[i:i + line_dedup.Q] for i in range(len(s) - line_dedup.Q + 1)} for s in (line, other))
        if 0.8 <= len(x & y) / len(x | y) < 0.9:
            pairs.append((line, other))
    missed = 0
    for line, other in pairs:
        data, _, _, start, end, key = line_dedup.lines_of(pa.array([line + "\n" + other]))
        sig, item, names, sketch = line_dedup.signatures_of(data, start, end, key)
        bands = [set(sig[item == k].tolist()) for k in names]
        alike = line_dedup.may_be_similar(line_dedup._values(sketch), np.array([0]), np.array([1]))[0]
        missed += not (bands[0] & bands[1] and alike)
    assert missed <= 1


def test_sketches_keep_unrelated_lines_apart():
    rng = random.Random(18)
    lines = [" ".join(rng.choice(["the", "of", "rain", "stone", "river", "walk", "light"]) + rng.choice("abcdefgh") for _ in range(60)) for _ in range(60)]
    data, _, _, start, end, key = line_dedup.lines_of(pa.array(["\n".join(lines)]))
    _, _, names, sketch = line_dedup.signatures_of(data, start, end, key)
    left, right = np.triu_indices(len(names), 1)
    assert line_dedup.may_be_similar(line_dedup._values(sketch), left, right).mean() < 0.02


def test_large_candidate_groups_are_sifted_like_small_ones():
    rng = np.random.default_rng(19)
    base = rng.integers(1, 16, (3, line_dedup.BINS)).astype(np.uint8)
    rows = [base[n % 3] for n in range(70)]
    sketch = np.stack(rows)[:, :line_dedup.BINS // 2] | np.stack(rows)[:, line_dedup.BINS // 2:] << 4
    for size in (70, 9):
        gid, item = np.zeros(size, np.int64), np.arange(100, 100 + size)
        got = set(zip(*(c.to_pylist() for c in line_dedup._sift(gid, item, sketch[:size]).columns)))
        assert got == {(100 + n % 3, 100 + n) for n in range(3, size)}


def test_a_line_of_very_many_documents(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 3)
    rng = random.Random(23)
    shared = cases.text(rng, 14)
    rows = [(k, f"{cases.text(rng, 15)}\n{shared}") for k in range(40)]
    got = {r.doc_id: (r.text, r["__lines"], r["__kept"]) for r in line_dedup.dedup_lines(cases.table(spark, rows)).collect()}
    assert got == {k: (t, 2, 2) if k == 0 else (t.split("\n")[0], 2, 1) for k, t in rows}


def test_signed_entries_are_small_and_lose_no_pair():
    """An entry takes 9 bytes, a line is signed once for a task, and lines of one signature meet unless their sizes are too far apart."""
    rng = random.Random(29)
    lines = [cases.text(rng, 30) for _ in range(300)]
    column = pa.array(["\n".join(lines)] * 3)
    data, _, _, start, end, key = line_dedup.lines_of(column)
    sig, names, _, code = line_dedup.signed_lines(data, start, end, key)
    assert len(names) == len(set(lines)) and sig.shape == (line_dedup.BANDS, len(names))
    short = (names >> line_dedup.SHORT).astype(np.uint32)
    part = np.repeat(np.uint32(7), 3).tobytes() + np.arange(3, dtype=np.uint32).tobytes() + np.array([10, 14, 19], np.uint8).tobytes()
    got = line_dedup._candidates(*line_dedup._entries([part]))
    assert list(zip(got.column(0).to_pylist(), got.column(1).to_pylist())) == [(0, 1)]
    blob = b"".join(x.tobytes() for x in ((sig[0] >> np.uint64(32)).astype(np.uint32), short, code))
    assert len(blob) == 9 * len(names)
    near = line_dedup.size_codes(np.arange(1, 5000))
    size = np.arange(1, 5000)
    least = -(-size * 8 // 10)
    assert (near - line_dedup.size_codes(least)).max() <= line_dedup.NEAR


def test_chosen_rows_of_a_large_group_are_compared_at_once():
    rng = np.random.default_rng(31)
    sketch = rng.integers(0, 256, (90, line_dedup.BINS // 2)).astype(np.uint8)
    sketch[1::2] = sketch[::2]
    left, right = np.triu_indices(90, 1)
    bins = np.concatenate([sketch & 15, sketch >> 4], axis=1)
    same, either = ((bins[left] == bins[right]) & (bins[left] > 0)).sum(axis=1), ((bins[left] | bins[right]) > 0).sum(axis=1)
    got = line_dedup.may_be_similar(line_dedup._values(sketch), left, right)
    assert (got == line_dedup._enough(same, either)).all() and got.sum() >= 45


def _planted(rng, size, apart):
    """Two ascending sets of `size` hashes, of which `apart` are in one only."""
    x = rng.choice(1 << 32, size + apart, replace=False).astype(np.uint32)
    return np.sort(x[:size]), np.sort(x[apart:])


def test_long_lines_are_signed_so_that_few_unrelated_ones_meet():
    """Sets of 200 and 700 shingles: at 0.3 (unrelated lines of a language) they seldom share a signature, at 0.8 they always do."""
    rng = np.random.default_rng(37)
    for scheme, size, most in ((1, 200, 4), (2, 700, 2)):
        for alike in (False, True):
            sets = [x for _ in range(300) for x in _planted(rng, size, size // 9 if alike else size * 7 // 13)]
            sig = line_dedup._bin_minima(np.concatenate(sets), np.array([len(x) for x in sets]), scheme)
            shared = (sig[:, ::2] == sig[:, 1::2]).any(axis=0).sum()
            assert shared == 300 if alike else shared <= most          # before: 0.024 of such pairs, 7 of 300, at any size


def test_lines_on_both_sides_of_a_size_share_a_scheme():
    rng = random.Random(41)
    for least, *_ in line_dedup.SCHEMES:
        for _ in range(40):
            line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(least + 2 + rng.randrange(least // 12)))
            other = line[:least - 2 - rng.randrange(least // 20)]
            data, _, _, start, end, key = line_dedup.lines_of(pa.array([line + "\n" + other]))
            shared, sketches = 0, []
            for schemes in line_dedup.PASSES:
                found = line_dedup.scheme_signatures(data, start, end, key, schemes)
                if found:
                    sig, at, keys, code, here, sketch = found
                    shared += len(set(sig[at == 0].tolist()) & set(sig[at == 1].tolist()))
                    sketches += keys[here].tolist()
            assert shared and sorted(sketches) == sorted(key.tolist())     # each line is signed, its sketch sent once


def test_bitmaps_cut_groups_and_lose_no_link():
    """Texts that share a passage are one candidate group; what is connected by links stays so, the others are apart before texts move."""
    rng = np.random.default_rng(43)
    passage = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 1 << 63, int(k)).astype(np.uint64)])) for k in rng.integers(60, 140, 120)]
    sets += [np.unique(np.concatenate([s[k % 8:], rng.integers(0, 1 << 63, k % 7).astype(np.uint64)])) for k, s in enumerate(sets[:60])]
    item = rng.permutation(len(sets)).astype(np.int64)
    for num in (80, 85):
        found = ngram_join.sift(item, np.array([len(s) for s in sets]), [ngram_join.bitmap(s) for s in sets], num, 100)
        forest = ngram_join.Forest(len(sets))
        for a, b in zip(*(x.tolist() for x in found)):
            forest.join(a, b)
        root, links = forest.roots(), 0
        for i, j in itertools.combinations(range(len(sets)), 2):
            if ngram_join.linked(sets[i], sets[j], num, 100):
                links += 1
                assert root[item[i]] == root[item[j]]
        assert links >= 50 and len(found[0]) <= 60 and (found[0] < found[1]).all()
