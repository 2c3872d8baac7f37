"""N-gram Jaccard self-join with signature trees.

Two documents link when the Jaccard similarity of their sets of distinct n-word shingles reaches a threshold. The join is
exact, in these steps:

1. Documents of equal sets are one node, named by the smallest id.
2. Every other node emits signatures, such that two linked nodes share at least one (no link is lost): sizes fall into
   overlapping ranges; for a range whose linked sets differ in at most d shingles, the shingles are dealt by hash to d + m
   parts, and each part's shingles give one signature. At least m parts of two linked sets agree; sets with fewer than m
   empty parts leave those out. A passage that many documents share fills a part alone only where it is most of the text.
3. A node and all that share a signature of which it is the smallest node form a candidate group. Texts that share a passage
   meet in large groups; so bitmaps of the sets, which bound every overlap from above, cut the groups before any text moves.
   Within what is left, blocks of bounded size build signature trees.
   A tree node holds the OR of its sets' token bitmaps, its range of sizes, and the largest number of shingles of a set that
   share a bit. Two trees (or one with itself) are traversed together; a pair of nodes is left when the sizes cannot reach the
   threshold, when the common bits bound the overlap below what is needed, or when all its sets are in one component already.
   Pairs of sets that remain are counted exactly.
4. Components of all links by distributed union-find.

Words are runs of bytes other than ASCII white space, A-Z in lower case; sets hold 64-bit hashes. A document with fewer words
than n has its whole sequence as one shingle; null and empty texts have no shingle and link with nothing. Rows with a null id
keep their size and get a null component. Rows of one id are one node: repeated rows get the same result. An empty table
gives an empty result.
"""

from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from placelens.llm.common import (PAIR, Forest, broadcast_if_small, components, drop, mix, record_batch, shingle_set, signed,
                                  slices, small_batches, stage, table, text_bytes, words)
from placelens.llm.groups import candidate_pairs, link_groups, runs

SIZES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])
BITMAPS = pa.schema([("item", pa.int64()), ("size", pa.int64()), ("bits", pa.binary())])
SIGNATURES = pa.schema([("sig", pa.int64()), ("item", pa.int64())])
GROWTH = 1.3        # ratio of the bounds of size classes
LEAF = 4            # sets of a tree's leaf
SIFTED = 1 << 15    # larger candidate groups are not sifted by bitmaps
AT_ONCE, BITS = 256, 1 << 21          # bitmaps of one block of the product that compares them, and their bits


def sets_of(column, n):
    """Shingle set of every row, ascending."""
    hashes, _, _, bounds = words(*text_bytes(column))
    return [shingle_set(hashes[a:b], n) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


@lru_cache(maxsize=None)
def size_range(i, num, den):
    """(low, high, parts, spare) of range i: smaller sets of size class i and all that they can link with.

    parts = 0 where only equal sets can link. spare is the least m for which m empty parts are rare.
    """
    low = 1
    for _ in range(i):
        low = max(low + 1, int(np.ceil(GROWTH * low)))
    top = max(low + 1, int(np.ceil(GROWTH * low))) - 1
    high = top * den // num
    differ = (den - num) * (top + high) // (den + num)
    if differ == 0:
        return low, high, 0, 0
    spare = 1
    while True:
        parts = differ + spare
        mean = parts * (1 - 1 / parts) ** low
        term, below = exp(-mean), 0.0
        for j in range(spare):
            below += term
            term *= mean / (j + 1)
        if 1 - below < 1e-4 or spare > 64 + differ:
            return low, high, parts, spare
        spare += 1


def ranges_of(size, num, den):
    """Numbers of the ranges that a set of this size belongs to."""
    out, i = [], 0
    while size_range(i, num, den)[0] <= size:
        if size <= size_range(i, num, den)[1] and size_range(i, num, den)[2]:
            out.append(i)
        i += 1
    return out


_ranges = lru_cache(maxsize=1 << 16)(ranges_of)


@lru_cache(maxsize=256)
def _edges(parts):
    return (np.ceil(np.arange(1, parts) * (2.0 ** 32 / parts)).astype(np.uint64)) << np.uint64(32)


def signatures_of(hashes, num, den):
    """Signatures of one ascending set of hashes."""
    out = []
    sums = None
    for i in _ranges(len(hashes), num, den):
        if sums is None:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes), dtype=np.uint64)])
        _, _, parts, spare = size_range(i, num, den)
        cuts = np.concatenate([[0], np.searchsorted(hashes, _edges(parts)), [len(hashes)]])
        full = cuts[1:] > cuts[:-1]
        sig = mix(sums[cuts[1:]] - sums[cuts[:-1]] + mix(np.arange(parts, dtype=np.uint64) + np.uint64((i + 1) << 32)))
        out.append(sig[full] if parts - np.count_nonzero(full) < spare else sig)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


# ---- bitmaps -----------------------------------------------------------------------------------------------------

def bitmap(hashes):
    """Bytes with a bit for each value of the hashes' last bits; four bits and more for a hash."""
    width = 64
    while width < 4 * len(hashes):
        width *= 2
    one = np.zeros(width, bool)
    one[(hashes & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(one).tobytes()


def sift(item, size, bits, num, den):
    """Of the sets of one group: pairs (smallest item, other) of those that a chain of possible links connects.

    A link is possible unless the sizes, or the common bits and the hashes that share one, leave too small an overlap: an exact bound.
    """
    names, at = np.unique(item, return_inverse=True)
    forest, root = Forest(len(names)), np.arange(len(names))
    length = np.array([len(b) for b in bits])
    rows = {n: (own := np.flatnonzero(length == n))[np.argsort(size[own], kind="stable")] for n in np.unique(length).tolist()}

    def matrix(rows, fold):
        flat = np.frombuffer(b"".join(bits[i] for i in rows.tolist()), np.uint8).reshape(len(rows), fold, -1)
        one = np.unpackbits(np.bitwise_or.reduce(flat, axis=1), axis=1).astype(np.float32)
        return one, size[rows] - one.sum(axis=1)

    for n, left in rows.items():
        step = max(1, min(AT_ONCE, BITS // (8 * n)))
        for fold in (1, 2):                              # sets of one link have at most twice as wide bitmaps
            right = rows.get(n * fold)
            for i in range(0, len(left) if right is not None else 0, step):
                own = left[i:i + step]
                high = int(np.searchsorted(size[right] * num, size[own[-1]] * den, "right"))
                (a, spare), known = matrix(own, 1), root[at[own]]
                for j in range(i if fold == 1 else 0, high, step):
                    other = right[j:min(j + step, high)]
                    if (known == known[0]).all() and (root[at[other]] == known[0]).all():
                        continue
                    b, more = matrix(other, fold)
                    both = np.minimum(a @ b.T + np.minimum.outer(spare, more), np.minimum.outer(size[own], size[other]))
                    x, y = np.nonzero(both * (den + num) >= num * np.add.outer(size[own], size[other]))
                    pairs = np.unique(known[x] * len(names) + root[at[other]][y])
                    pairs = pairs[pairs // len(names) != pairs % len(names)]
                    for u, v in zip((pairs // len(names)).tolist(), (pairs % len(names)).tolist()):
                        forest.join(u, v)
                    if len(pairs):
                        root = forest.roots()
                        known = root[at[own]]
    other = np.flatnonzero(root != np.arange(len(names)))
    return names[root[other]], names[other]


# ---- signature tree ----------------------------------------------------------------------------------------------

class Node:
    __slots__ = ("bits", "least", "most", "excess", "low", "high", "kids")

    def __init__(self, bits, least, most, excess, low, high, kids=()):
        self.bits, self.least, self.most, self.excess = bits, least, most, excess
        self.low, self.high, self.kids = low, high, kids


def build_tree(sets, width, low=0):
    """Tree over sets given by ascending size: leaves of LEAF sets, four children to a node."""
    level = []
    for a in range(0, len(sets), LEAF):
        bits, excess = np.zeros(width // 8, np.uint8), 0
        for s in sets[a:a + LEAF]:
            one = np.zeros(width, bool)
            one[(s & np.uint64(width - 1)).astype(np.int64)] = True
            excess = max(excess, len(s) - int(one.sum()))
            bits |= np.packbits(one)
        part = sets[a:a + LEAF]
        level.append(Node(bits.view(np.uint64), len(part[0]), len(part[-1]), excess, low + a, low + a + len(part)))
    while len(level) > 1:
        up = []
        for a in range(0, len(level), 4):
            kids = level[a:a + 4]
            bits = kids[0].bits.copy()
            for k in kids[1:]:
                bits |= k.bits
            up.append(Node(bits, kids[0].least, kids[-1].most, max(k.excess for k in kids), kids[0].low, kids[-1].high, kids))
        level = up
    return level[0]


def may_link(a, b, num, den):
    """False if no set of one node can link with a set of the other: by sizes, or by the largest possible overlap."""
    if a.most * den < num * b.least or b.most * den < num * a.least:
        return False
    common = int(np.bitwise_count(a.bits & b.bits).sum())
    overlap = min(common + min(a.excess, b.excess), a.most, b.most)
    return overlap * (den + num) >= num * (a.least + b.least)


def linked(x, y, num, den):
    if min(len(x), len(y)) * den < num * max(len(x), len(y)):
        return False
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int(np.count_nonzero(y[at] == x))
    return both * den >= num * (len(x) + len(y) - both)


def tree_links(left, right, num, den):
    """Links that connect whatever links inside `left` (right None) or between left and right: index pairs into left + right.

    Each side is (sets, component known so far).
    """
    sides = [left] if right is None else [left, right]
    sets = [s for side in sides for s in side[0]]
    known = [c for side in sides for c in side[1]]
    number = {}
    start = [number.setdefault(c, len(number)) for c in known]
    forest, links = Forest(len(number)), []
    width = 64
    while width < 4 * max(map(len, sets)):
        width *= 2

    def test(i, j):
        if forest.root(start[i]) != forest.root(start[j]) and linked(sets[i], sets[j], num, den):
            forest.join(start[i], start[j])
            links.append((i, j))

    order, trees, at = [], [], 0
    for side in sides:
        own = sorted((i for i in range(at, at + len(side[0])) if len(sets[i])), key=lambda i: len(sets[i]))
        if not own:
            return links
        trees.append(build_tree([sets[i] for i in own], width, len(order)))
        order += own
        at += len(side[0])
    if right is None:
        for i in order[1:]:
            test(order[0], i)
        lead = order[len(order) // 2]
        for i in order:
            test(lead, i)

    def one_component(a, b):
        if a.high - a.low + b.high - b.low > 64:
            return False
        root = forest.root(start[order[a.low]])
        return all(forest.root(start[order[i]]) == root for n in (a, b) for i in range(n.low, n.high))

    stack = [(trees[0], trees[-1])]
    while stack:
        a, b = stack.pop()
        if one_component(a, b) or not may_link(a, b, num, den):
            continue
        if not a.kids and not b.kids:
            for i in range(a.low, a.high):
                for j in range(max(b.low, i + 1) if a is b else b.low, b.high):
                    test(order[i], order[j])
        elif a is b:
            stack += [(x, y) for k, x in enumerate(a.kids) for y in a.kids[k:]]
        elif b.kids and (not a.kids or b.high - b.low >= a.high - a.low):
            stack += [(a, y) for y in b.kids]
        else:
            stack += [(x, b) for x in a.kids]
    return links


# ---- operator ----------------------------------------------------------------------------------------------------

def ngram_join(documents, n=5, num=80, den=100):
    """doc_id, n_shingles, component_id of every row; links at den * |intersection| >= num * |union|."""
    spark = documents.sparkSession
    small_batches(spark)
    texts = documents.select(F.col("doc_id").cast("long"), "text")

    def measure(batches):
        for batch in batches:
            for part in slices(batch):
                sets = sets_of(part.column(1), n)
                d1 = [np.sum(mix(s), dtype=np.uint64) for s in sets]
                d2 = [np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) for s in sets]
                yield record_batch(SIZES, part.column(0), [len(s) for s in sets], signed(d1), signed(d2))

    sizes, _ = stage(texts.mapInArrow(measure, "doc_id long, n_shingles long, d1 long, d2 long"), "sizes")
    key = ["n_shingles", "d1", "d2"]
    known = sizes.where("doc_id IS NOT NULL AND n_shingles > 0")
    first = known.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copies = known.join(first.where("first < last").drop("last"), key).where("doc_id != first").select("doc_id", "first")
    copies, _ = stage(copies.distinct(), "copies")

    def sign(batches):
        for batch in batches:
            for part in slices(batch):
                found = [signatures_of(s, num, den) for s in sets_of(part.column(1), n)]
                item = np.repeat(part.column(0).to_numpy(), [len(f) for f in found])
                if len(item):
                    yield record_batch(SIGNATURES, signed(np.concatenate(found)), item)

    single = texts.where("doc_id IS NOT NULL AND text IS NOT NULL")
    single = single.join(broadcast_if_small(copies.select("doc_id")), "doc_id", "left_anti")
    def texts_of(pairs):
        wanted = pairs.select("gid").union(pairs.select("item")).distinct()
        wanted = broadcast_if_small(wanted.toDF("doc_id"))
        return single.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("item"), F.col("text").alias("payload"))

    def measured(batches):
        for batch in batches:
            for part in slices(batch, "payload"):
                sets = sets_of(part.column(1), n)
                yield record_batch(BITMAPS, part.column(0), [len(s) for s in sets], [bitmap(s) for s in sets])

    def sifted(batches):
        for run in runs(batches, 1):
            found = sift(run.column("item").to_numpy(), run.column("size").to_numpy(), run.column("bits").to_pylist(), num, den)
            if len(found[0]):
                yield record_batch(PAIR, *found)

    pairs, path = stage(candidate_pairs(single.mapInArrow(sign, "sig long, item long")), "candidates")
    large = pairs.groupBy("gid").agg(F.count("*").alias("n")).where(F.col("n") > SIFTED).select("gid")
    large, _ = stage(large, "large")
    small = pairs.join(broadcast_if_small(large), "gid", "left_anti")
    small = small.union(small.select("gid", "gid").distinct()).join(
        texts_of(small).mapInArrow(measured, "item long, size long, bits binary"), "item").select("gid", "item", "size", "bits")
    kept = small.repartition("gid").sortWithinPartitions("gid").mapInArrow(sifted, "gid long, item long")
    if not large.isEmpty():
        kept = kept.union(pairs.join(broadcast_if_small(large), "gid", "left_semi"))
    pairs, _ = stage(kept.distinct(), "sifted")
    drop(spark, path)
    items = texts_of(pairs)
    found = link_groups(pairs, items, lambda texts: sets_of(texts, n), lambda left, right: tree_links(left, right, num, den))
    # a copy is linked with the first of its kind; ids that hold several texts connect what each of them links with
    links = found.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    found = components(links.union(copies.select("doc_id", "first")))
    return sizes.join(found, sizes.doc_id == found.node, "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op9_ngram_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"), n=4, num=85, den=100)
