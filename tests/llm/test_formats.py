"""SentencePiece, WARC, wavelet shards, decontamination and the pipeline: brute force, round trips and library results."""

import gzip
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest

import corpus_pipeline
from placelens.llm import decontamination, line_dedup, pieces, queries, warc, wavelet
from placelens.session import shared_dir
from tests.llm import cases

TEXTS = ["", None, " ", "  a  b\nc 漢字 😀\x00  ", "\n\n x", "the and of", "ab" * 3000, "Ünïcode ñandú ▁", "a\x1cb <|endoftext|> Σας ΣΑΣ it's é",
         "<|ENDOFTEXT|> a.b …. x.. It's. 'll. A,b;c d́. ", "I'LL \t x y 12345"]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.read_model())


def all_texts():
    return TEXTS + [t for _, t in cases.documents()]


# ---- SentencePiece -----------------------------------------------------------------------------------------------

def plain_viterbi(codec, model, text):
    """Best path over the whole text, character by character, with the same rule for ties."""
    if not text:
        return []
    s = pieces.MARK + text.replace(" ", pieces.MARK)
    score, back = [0.0] + [None] * len(s), [None] * (len(s) + 1)
    for end in range(1, len(s) + 1):
        for begin in range(max(0, end - 16), end):
            i = model.get(s[begin:end], -1)
            if i < 0 and (end - begin > 1):
                continue
            value = score[begin] + (codec.scores[i] if i >= 0 else codec.unknown_score)
            if score[end] is None or value > score[end]:
                score[end], back[end] = value, (begin, i)
    ids, at = [], len(s)
    while at:
        begin, i = back[at]
        ids = ([i] if i >= 0 else [int(codec.byte_ids[b]) for b in s[begin:at].encode()]) + ids
        at = begin
    return ids


def test_trie_holds_every_piece_and_nothing_else(codec):
    model = {p: i for i, (p, _, k) in enumerate(pieces.read_model()) if k == pieces.NORMAL}
    assert all(codec.trie.get(p.encode()) == i for p, i in model.items())
    rng = random.Random(1)
    for p in rng.sample(sorted(model), 500):
        for other in (p[:-1], p + "q", p[1:]):
            assert codec.trie.get(other.encode()) == model.get(other, -1)


def test_best_paths(codec):
    model = {p: i for i, (p, _, k) in enumerate(pieces.read_model()) if k == pieces.NORMAL}
    assert max(map(len, model)) <= 16
    texts = [t for t in all_texts() if len(t or "") < 3000]
    cache = codec.cache()
    for _ in range(2):                       # empty, then full cache
        ids, bounds = codec.encode_column(pa.array(texts, pa.string()), cache)
        for i, t in enumerate(texts):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == plain_viterbi(codec, model, t), t


def test_score_is_never_below_the_library(codec):
    import sentencepiece
    raw = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    at = raw.rindex(b"\x18\x02\x20\x80\xfa\x01")                # model type: the same pieces as a unigram model
    library = sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + b"\x18\x01" + raw[at + 2:])
    texts = [t for t in all_texts() if t and len(t) < 400]
    ids, bounds = codec.encode_column(pa.array(texts), codec.cache())
    for i, t in enumerate(texts):
        assert codec.scores[ids[bounds[i]:bounds[i + 1]]].sum() >= codec.scores[library.encode(t)].sum()
        assert library.decode(ids[bounds[i]:bounds[i + 1]].tolist()) == t.replace(pieces.MARK, " ")


def test_chunk_cache_stays_within_its_limit(codec):
    cache = codec.cache()
    cache.limit = 50
    texts = [t for t in all_texts() if t]
    for t in texts:
        a, _ = codec.encode_column(pa.array([t]), cache)
        b, _ = codec.encode_column(pa.array([t]), codec.cache())
        assert a.tolist() == b.tolist()


def test_encode_and_decode(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x y"), (3, TEXTS[3])]
    docs = cases.table(spark, rows)
    coded = pieces.encode(docs)
    got = coded.collect()
    for r in got:
        if r.doc_id is not None:
            t = TEXTS[r.doc_id] or ""
            assert r.round_trip == (pieces.MARK not in t) and r.n_tokens == len(r.ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes())
    back = {r.doc_id: r.text for r in pieces.decode(coded).collect()}
    assert all(back[i] == (t or "").replace(pieces.MARK, " ") for i, t in enumerate(TEXTS)) and back[None] == "x y"
    assert pieces.encode(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [230 + 3])], "doc_id long, ids array<int>")
    assert [r.text for r in pieces.decode(odd).orderBy("doc_id").collect()] == ["", "", "�"]


# ---- WARC --------------------------------------------------------------------------------------------------------

def page_rows():
    big, bigger = "<p>" + "é" * 700, "<p>" + "x" * 3_000_000
    return [(1, "http://a/", big), (2, "http://b/", big), (9, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""),
            (8, "http://c/ x\r\ny", bigger), (10, "z", "\r\n\r\nWARC/1.1\r\n\r\n" * 200), (11, "z", "y" * 999), (12, "z", "y" * 999),
            (13, "z", "y" * 1000), (14, "z", "y" * 1000), (None, "n", big), (3, "r", "q" * 2000), (3, "r", "q" * 2000)]


def test_archives(spark):
    pages = spark.createDataFrame([(*r, "x", 1) for r in page_rows()], "page_id long, url string, html string, digest string, first int")
    got = warc.archive_pages(pages, payload=True).collect()
    want = []
    for i, url, html in page_rows():
        raw = (html or "").encode()
        same = [j for j, _, h in page_rows() if (h or "").encode() == raw and j is not None]
        first = max(same, default=None) if len(raw) >= 1000 else None
        revisit = first is not None and first != i
        want.append((i, None if url is None else " ".join(url.split()), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None,
                     None if revisit else raw))
    key = lambda r: str(tuple(r)[:6])     # noqa: E731
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_normaliser_writes_members_that_the_index_finds(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    folder = shared_dir(spark, "test-warc")
    files = warc.write_monolithic(warc.mark_revisits(pages).coalesce(1), folder).collect()
    assert sum(f.records for f in files) == len(page_rows())
    index = warc.normalise(spark.createDataFrame(files), folder).collect()
    for path in {r.path for r in index}:
        rows = [r for r in index if r.path == path]
        assert [(r.record, r.start, r.size, r.record_type, r.record_id) for r in rows] == warc.read_index(path)
        fs, at = warc._open(path)
        raw = fs.open_input_stream(at, compression=None).read()
        whole = gzip.decompress(raw)
        assert whole.count(b"WARC-Record-ID") == len(rows) and len(raw) == rows[-1].start + rows[-1].size
        for r in rows:
            assert gzip.decompress(raw[r.start:r.start + r.size]).startswith(b"WARC/1.1\r\n")
            assert warc.read_member(path, r.start, r.size)[4] == r.record_type
    source = gzip.decompress(pafs.LocalFileSystem().open_input_stream(warc._open(files[0].path)[1], compression=None).read())
    assert source == whole or len(files) > 1


def test_records_in_any_pieces():
    raw = b"".join(warc.encode_record(i, u, (h or "").encode(), hashlib.sha1((h or "").encode()).hexdigest(), None) for i, u, h in page_rows()[:7])
    for size in (1, 7, 1000, len(raw)):
        records, found = warc.Records(), []
        for at in range(0, len(raw), size):
            found += [r for _, r in records.feed(raw[at:at + size])]
        records.close()
        assert b"".join(found) == raw
    broken = warc.Records()
    list(broken.feed(raw[:-10]))
    with pytest.raises(ValueError):
        broken.close()


# ---- wavelet -----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n,m", [(0, 1), (1, 3), (5000, 300), (20_000, 49_000), (9000, 2), (4096, 7)])
def test_wavelet_matrix(n, m):
    rng = np.random.default_rng(n)
    x = rng.integers(0, m, n)
    w, extra = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(x).to_bytes(b"more"))
    assert extra == b"more" and (w.tokens() == x).all() and w.count(1 << 20) == 0 and w.select(1 << 20, 0) == -1
    for i in rng.integers(0, max(n, 1), 40 if n else 0).tolist():
        s, where = int(x[i]), np.flatnonzero(x == x[i])
        k = int(rng.integers(len(where)))
        assert (w.access(i), w.count(s), w.rank(s, i)) == (s, len(where), int((x[:i] == s).sum()))
        assert w.select(s, k) == where[k] and w.select(s, len(where)) == -1


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 500)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = cases.documents() + [(9000 + i, t) for i, t in enumerate(TEXTS)]
    got = wavelet.token_files(cases.table(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for i, t in order:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [wavelet.END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert wavelet.token_files(cases.table(spark, []).limit(0)).count() == 0


# ---- decontamination ---------------------------------------------------------------------------------------------

def _enumerated(n, first, last):
    """All choices of as many differing places of n words, first <= place < last, as 80 % agreement allows."""
    from itertools import combinations
    return combinations(range(first, last), n // 5)


def test_masks_meet_every_stretch():
    """A longer stretch holds one of 13 to 25 words that agrees in 80 %, ends perhaps not."""
    for n in range(13, 26):
        at = [[sum(1 << (i + j) for j, c in enumerate(m) if c == "1") for i in range(n - len(m) + 1)] for m in decontamination.MASKS]
        at = [x for some in at for x in some]
        for differ in _enumerated(n, 0, n):
            bad = sum(1 << i for i in differ)
            assert any(not x & bad for x in at), (n, differ)


@pytest.mark.parametrize("n", [1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 20])
def test_every_substitution_is_found(n):
    item = [f"item{k}" for k in range(n)]
    docs = []
    for differ in _enumerated(n, 1, n - 1):
        docs.append(" ".join(["before"] * 5 + [f"other{k}" if k in differ else w for k, w in enumerate(item)] + ["after"] * 5))
    bench = decontamination.Benchmark([(1, "unrelated words of some other item " * 3), (2, " ".join(item))])
    got = decontamination.find_hits(pa.array(docs), bench)
    assert got == [(k, 1, n - n // 5, n, 5, 0) for k in range(len(docs))] and docs
    one_more = " ".join(f"other{k}" if k % 2 else w for k, w in enumerate(item))
    assert n == 1 or decontamination.find_hits(pa.array([one_more]), bench) == []


def plain_stretch(agree, least):
    on = [i for i, x in enumerate(agree) if x]
    return max((j - i + 1 for i in on for j in on if j - i + 1 >= least and Fraction(sum(agree[i:j + 1]), j - i + 1) >= Fraction(8, 10)), default=None)


def test_longest_stretch():
    rng = np.random.default_rng(1)
    for _ in range(1500):
        a = rng.random(rng.integers(1, 40)) < rng.choice([0.5, 0.8, 0.9])
        got = decontamination._best_stretch(a, 5)
        assert (got and got[1]) == plain_stretch(a.tolist(), 5)


def test_overlaps(spark):
    rng = random.Random(4)
    items = [(k, cases.text(rng, n, 5000)) for k, n in enumerate((40, 25, 60, 13, 4, 1))] + [(6, ""), (7, None), (8, None), (1, None)]
    docs = [(k, cases.text(rng, rng.randrange(5, 300), 5000)) for k in range(40)]
    planted = {}
    for k in range(20):
        words = items[k % 3][1].split()
        for p in range(3 + k % 5, len(words), 6):                  # a substitution in every sixth word
            words[p] = "other"
        at = rng.randrange(len(docs[k][1]))
        docs.append((100 + k, docs[k][1][:at].rsplit(" ", 1)[0] + ".\n" + " ".join(words).upper() + "! " + docs[k][1][at:]))
        planted[100 + k] = k % 3
    part = " ".join(items[2][1].split()[20:40])
    docs += [(200, part), (201, items[4][1]), (202, items[5][1]), (203, "x " + items[3][1] + " y"), (204, None), (205, ""), (None, items[0][1]),
             (206, " ".join(items[2][1].split()[:12])), (200, part)]
    benchmark = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    table = cases.table(spark, docs)
    got = decontamination.overlaps(table, benchmark).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    texts, by_id = {}, dict(docs)
    for i, t in docs:
        texts[i] = (t or "").lower().replace(".", " ").replace("!", " ").split()
    want = set(planted.items()) | {(200, 2), (201, 4), (203, 3), (None, 0)}
    want |= {(i, 5) for i, w in texts.items() if items[5][1] in w}
    want |= {(i, 4) for i, w in texts.items() if any(w[k:k + 4] == items[4][1].split() for k in range(len(w)))}
    assert pairs == want and len(got) == len(want) + 1             # the repeated row of document 200
    for r in got:
        if r.doc_id in planted:
            w, item = texts[r.doc_id], items[r.item_id][1].split()
            same = [a == b for a, b in zip(w[r.doc_word:r.doc_word + r.length], item[r.item_word:r.item_word + r.length])]
            assert sum(same) == r.matched and same[0] and same[-1] and r.matched >= 0.8 * r.length
    kept = decontamination.clean_documents(table, benchmark)
    assert kept.schema == table.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in docs if i not in {d for d, _ in want})
    assert decontamination.overlaps(table, benchmark.limit(0)).count() == 0 and decontamination.clean_documents(table, benchmark.limit(0)).count() == len(docs)
    assert decontamination.overlaps(table.limit(0), benchmark).count() == 0


def test_benchmark_in_slices_gives_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(tuple, decontamination.overlaps(docs, benchmark).collect()))
    monkeypatch.setattr(decontamination, "SLICE_WORDS", 300)
    assert sorted(map(tuple, decontamination.overlaps(docs, benchmark).collect())) == whole and whole


# ---- pipeline ----------------------------------------------------------------------------------------------------

def test_pipeline_stages_follow_their_operators(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding"]
    left = docs
    for name, stage in corpus_pipeline.STAGES:
        before = left
        left = stage(spark, before, sf)
        if name != "SentencePiece encoding":
            assert left.columns == docs.columns
            kept = {r.doc_id for r in left.collect()}
            assert kept <= ids
            ids = kept
        if name == "line dedup":
            lines = [x for r in left.collect() for x in {y.strip().lower() for y in r.text.split("\n")} if x]
            assert len(lines) == len(set(lines)) and all(r.n_chars == len(r.text) for r in left.collect())
    final = {r.doc_id for r in left.collect()}
    assert final == ids and {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == final
    assert left.where("NOT round_trip").count() == 0


def test_pipeline_takes_odd_rows(spark):
    docs = cases.table(spark, cases.documents())
    for name, stage in corpus_pipeline.STAGES:
        docs, before = stage(spark, docs, "/root/testdata/sf0.001"), docs
        assert 0 < docs.count() <= before.count(), name
    nothing = cases.table(spark, []).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, "/root/testdata/sf0.001")
        assert nothing.count() == 0


# ---- registered queries ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, name):
    from tests.oracle_check import ROOT, differences, duck
    got = queries.QUERIES[name](spark, f"{ROOT}/sf0.001").toPandas()
    assert len(got)
    if name in queries.SQL:
        assert differences(got, duck(f"{ROOT}/sf0.001").execute(queries.SQL[name]).df()) is None


def test_line_dedup_threshold_matches_its_docstring():
    assert (1 - 0.8 ** line_dedup.ROWS) ** line_dedup.BANDS < 1e-4


def test_paths_are_searched_a_bounded_number_of_bytes_at_once(monkeypatch):
    monkeypatch.setattr(pieces, "AT_ONCE", 64)
    codec, seen = pieces.Codec(pieces.read_model()), []
    search = codec.viterbi
    chunks = [f"▁word{k}".encode() for k in range(200)] + ["▁".encode() + b"x" * 300]
    want, size = search(chunks)
    monkeypatch.setattr(codec, "viterbi", lambda some: seen.append(sum(map(len, some))) or search(some))
    cache = codec.cache()
    keys = np.arange(len(chunks), dtype=np.uint64)[::-1] * np.uint64(977)
    for _ in range(2):
        ids, count = cache.ids_of(keys, lambda i: chunks[i])
        assert ids.tolist() == want.tolist() and count.tolist() == size.tolist()
    assert len(seen) > 10 and sorted(seen)[-2] <= 64
