"""Benchmark decontamination by spaced-seed hashing.

Each fixed mask looks at a window of words and ignores some places, so a substituted word under an ignored place leaves the
hash as it was. Hashes of all windows of the documents meet those of the benchmark; around every hit, along its alignment,
the documents' words are compared with the item's, and an overlap counts if some stretch of at least RUN words (or the whole
item, if it has fewer words) agrees in SHARE of its words or more, ends included.

The masks lose no such overlap. Between k differing words of a stretch lie at least 4 k agreeing ones in k + 1 runs, so one run
has 4 words, but for three differing words in 15 (runs of 3 3 3 3), where the second mask fits. Whole items of 5 to 12 words
have a run of 3, but for one differing word amid 5 words; items of up to 4 words must agree whole. So small masks meet much
by chance: before the comparison, a hit must have as many agreeing words near it on its alignment as any overlap has.

Words are runs of ASCII letters, digits and non-ASCII characters, ASCII letters in lower case, compared by 64-bit hash. The
benchmark side is cut into slices of at most SLICE_WORDS words; each slice is sent to the tasks and meets all documents, so
what is broadcast is bounded whatever the size of the benchmark. Nothing of the documents is shuffled.

Null and empty texts and items overlap with nothing; a null doc_id or item_id is carried along; repeated documents give
repeated rows, repeated items one row each.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from placelens.llm.common import PUNCTUATION, mix, randoms, record_batch, slices, table, text_bytes, words

#: Places that count, for items of RUN words and more; for shorter items, and for items of five words
MASKS = ("1111", "1110111")
SHORT_MASKS, FIVE_MASKS = ("111",), ("11011",)
RUN = 13
NEAR = 24             # words on either side of a hit that the first comparison reads: a stretch of 13 to 25 words holds the hit
AT_ONCE = 1 << 16     # hits compared at once
SHARE = 0.8
SLICE_WORDS = 2_000_000
FILTER_BITS = 22

HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched", pa.int64()), ("length", pa.int64()),
                  ("doc_word", pa.int64()), ("item_word", pa.int64())])
HITS_DDL = "doc_id long, item_id long, matched long, length long, doc_word long, item_word long"


def seed_hashes(hashes, mask, number):
    """Hash of every window of the mask's span over the word hashes, places marked 0 ignored."""
    factors = randoms(len(mask), 1000 + number) | np.uint64(1)
    n = len(hashes) - len(mask) + 1
    total = np.zeros(max(n, 0), np.uint64)
    for j, c in enumerate(mask):
        if c == "1" and n > 0:
            total += hashes[j:j + n] * factors[j]
    return mix(total)


def _rows_of(positions, bounds, span):
    """Row of each window start, -1 where the window leaves its row."""
    row = np.searchsorted(bounds, positions, "right") - 1
    return np.where(positions + span <= bounds[row + 1], row, -1)


class Benchmark:
    """Word hashes of the items and a table of their seed hashes."""

    def __init__(self, items):
        self.ids = [i for i, _ in items]
        self.words, _, _, self.bounds = words(*text_bytes(pa.array([t for _, t in items], pa.string())), separator=PUNCTUATION)
        self.length = np.diff(self.bounds)
        self.masks = [(mask, low, high) for masks, low, high in (
            (MASKS, RUN, np.inf), (SHORT_MASKS, 5, RUN - 1), (FIVE_MASKS, 5, 5), *((("1" * n,), n, n) for n in range(1, 5)))
            for mask in masks if ((self.length >= low) & (self.length <= high)).any()]
        self.tables, self.filter = [], np.zeros(1 << FILTER_BITS, bool)
        for k, (mask, low, high) in enumerate(self.masks):
            h = seed_hashes(self.words, mask, k)
            at = np.arange(len(h))
            row = _rows_of(at, self.bounds, len(mask)) if len(h) else at
            ok = row >= 0
            if len(h):
                n = self.length[np.maximum(row, 0)]
                ok &= (n >= low) & (n <= high)
            h, at = h[ok], at[ok]
            order = np.argsort(h, kind="stable")
            self.tables.append((h[order], at[order]))
            self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True


def _best_stretch(agree, least):
    """(matches, length, begin) of the longest stretch of at least `least` words, ends agreeing, with SHARE of them agreeing;
    None if there is none."""
    on = np.flatnonzero(agree)
    if not len(on):
        return None
    # stretch i..j qualifies if (j - i + 1) >= least and count >= SHARE * length: gain = count - SHARE * length
    rank = np.arange(len(on))
    left = rank - SHARE * on                         # before including word i
    right = (rank + 1) - SHARE * (on + 1)
    best = None
    lowest = np.minimum.accumulate(left)             # earliest start that any later end can reach
    starts = np.flatnonzero(np.r_[True, lowest[1:] < lowest[:-1]])
    for j in range(len(on) - 1, -1, -1):
        if best and on[j] + 1 <= best[1]:
            break
        k = np.searchsorted(-lowest[starts], -(right[j] + 1e-9), "left")
        if k < len(starts) and starts[k] <= j:
            i = starts[k]
            length = int(on[j] - on[i] + 1)
            if length >= least and (best is None or length > best[1]):
                best = (int(j - i + 1), length, int(on[i]))
    return best


def _promising(hashes, bounds, bench, at, row, w):
    """(row, item, shift) of the hits (word of the documents, its row, word of the benchmark) that may lie in an overlap."""
    item = np.searchsorted(bench.bounds, w, "right") - 1
    back = np.minimum(np.minimum(at - bounds[row], w - bench.bounds[item]), NEAR)
    ahead = np.minimum(np.minimum(bounds[row + 1] - at, bench.bounds[item + 1] - w), NEAR + 1)
    agree = np.zeros(len(at), np.int64)
    for j in range(-NEAR, NEAR + 1):
        ok = np.flatnonzero((j >= -back) & (j < ahead))
        agree[ok] += hashes[at[ok] + j] == bench.words[w[ok] + j]
    keep = agree >= SHARE * np.minimum(bench.length[item], RUN) - 1e-9
    at, row, w, item = at[keep], row[keep], w[keep], item[keep]
    return zip(row.tolist(), item.tolist(), (at - bounds[row] - w + bench.bounds[item]).tolist())


def find_hits(column, bench):
    """(row, item number, matched, length, document word, item word), one best overlap for each row and item."""
    hashes, _, _, bounds = words(*text_bytes(column), separator=PUNCTUATION)
    diagonals = set()
    for k, ((mask, _, _), (known, where)) in enumerate(zip(bench.masks, bench.tables)):
        h = seed_hashes(hashes, mask, k)
        maybe = np.flatnonzero(bench.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]) if len(h) else np.zeros(0, int)
        if not len(maybe) or not len(known):
            continue
        row = _rows_of(maybe, bounds, len(mask))
        maybe, row = maybe[row >= 0], row[row >= 0]
        low, high = np.searchsorted(known, h[maybe], "left"), np.searchsorted(known, h[maybe], "right")
        maybe, row, low, count = (x[high > low] for x in (maybe, row, low, high - low))
        total = np.concatenate([[0], np.cumsum(count)])
        for first in range(0, int(total[-1]), AT_ONCE):
            at = np.arange(first, min(first + AT_ONCE, int(total[-1])))
            hit = np.searchsorted(total, at, "right") - 1
            diagonals.update(_promising(hashes, bounds, bench, maybe[hit], row[hit], where[low[hit] + at - total[hit]]))
    best = {}
    for r, item, shift in diagonals:
        doc, text = hashes[bounds[r]:bounds[r + 1]], bench.words[bench.bounds[item]:bench.bounds[item + 1]]
        a, b = max(0, -shift), min(len(text), len(doc) - shift)
        got = _best_stretch(text[a:b] == doc[a + shift:b + shift], min(RUN, len(text)))
        if got and ((r, item) not in best or got[1] > best[r, item][1]):
            best[r, item] = (got[0], got[1], got[2] + a + shift, got[2] + a)
    return [(r, item, *v) for (r, item), v in sorted(best.items())]


def _benchmarks(benchmark):
    """Slices of the benchmark of bounded size, one after another."""
    items, total = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        items.append((row[0], row[1]))
        total += len(row[1] or "") // 2 + 1          # at least as many as its words
        if total >= SLICE_WORDS:
            yield Benchmark(items)
            items, total = [], 0
    if items:
        yield Benchmark(items)


def overlaps(documents, benchmark):
    """One row per document and item that overlap: doc_id, item_id, words matched, stretch length, where it begins."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long"), "text")

    def search(shared):
        def run(batches):
            bench = shared.value
            for batch in batches:
                for part in slices(batch):
                    ids, hits = part.column(0).to_pylist(), find_hits(part.column(1), bench)
                    if hits:
                        yield record_batch(HITS, *zip(*((ids[r], bench.ids[i], *rest) for r, i, *rest in hits)))
        return run

    found = [texts.mapInArrow(search(spark.sparkContext.broadcast(b)), HITS_DDL) for b in _benchmarks(benchmark)]
    out = found[0] if found else spark.createDataFrame([], HITS_DDL)
    for more in found[1:]:
        out = out.union(more)
    return out


def clean_documents(documents, benchmark):
    """The rows of `documents`, all columns as they are, that overlap with no item."""
    def keep(shared):
        def run(batches):
            for batch in batches:
                for part in slices(batch):
                    bad = np.zeros(part.num_rows, bool)
                    bad[[h[0] for h in find_hits(part.column(part.schema.get_field_index("text")), shared.value)]] = True
                    yield part.filter(pa.array(~bad))
        return run

    for bench in _benchmarks(benchmark):
        documents = documents.mapInArrow(keep(documents.sparkSession.sparkContext.broadcast(bench)), documents.schema)
    return documents


def op8_decontamination(spark, sf_dir):
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
