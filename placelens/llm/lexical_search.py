"""Ranked lexical search by dual trees: the best documents of each item, all documents against all items.

A document is a sparse vector over terms, an item a set of weighted terms; the score is their product sum. A term that occurs
tf times in a document with n of the corpus's L terms counts (SCALE * tf) div (1000 * tf + 20 * m), where
m = 100 - B + (B * n * N) div L and N documents have terms; its weight is floor(1000 * ln((2N + 2) / (2 df + 1))). All is
64-bit integer but the logarithm.

A tree over documents and one over items hold the coordinate maxima of what lies below each node. The product sum of two
nodes' maxima bounds every score between them, so where it is less than the weakest kth score of the node's items so far, no
pair below can enter any list, and all of them are left together. What remains at two leaves is scored exactly. Equal bounds
are not pruned, as ties go by document id: the result is exact.

Items and documents meet in cells of bounded size, dealt by hash. Items of a cell are the items of one bounded block; each
task keeps the lists of its blocks from cell to cell, so later cells prune harder; a window over each item's few rows per task
merges. Only terms that some item holds are kept of a document, if these are few enough to be sent to the tasks
(`VOCABULARY`, counted first); otherwise all are kept, and the cells leave out what they do not need: the same results.

Terms are runs of ASCII letters and digits and all other characters, A-Z in lower case. Null and empty texts have none and
rank nowhere; they do not count in N. A document with a null id counts in N, L and df, but is not ranked. Rows of one document
id are documents of their own, also if equal. Items with a null id give no row, nor do items without terms or whose terms no
document holds; of rows of one item id the terms are united. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from placelens.llm.common import PUNCTUATION, record_batch, signed, slices, stage, table, text_bytes, words
from placelens.llm.groups import runs

B = 50
SCALE = 1_000_000_000
VOCABULARY = 1_000_000        # item terms sent to the tasks at most (8 MB)
ITEM_TERMS = 1 << 18          # terms of the items of a block, about
CELL_ROWS, CELL_TERMS = 8192, 1 << 20     # documents and their terms of a cell, about
LEAF_DOCS, LEAF_ITEMS, FAN = 16, 8, 8

VECTORS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int64())), ("tf", pa.list_(pa.int32()))])
FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


# ---- terms -------------------------------------------------------------------------------------------------------

def counted_terms(column, wanted=None):
    """(terms of each row, terms, counts, bounds): distinct terms of row i are bounds[i]:bounds[i + 1], ascending."""
    hashes, _, _, bounds = words(*text_bytes(column), separator=PUNCTUATION)
    hashes = signed(hashes)
    row = np.repeat(np.arange(len(column)), np.diff(bounds))
    if wanted is not None:
        at = np.searchsorted(wanted, hashes)
        at[at == len(wanted)] = 0
        used = wanted[at] == hashes if len(wanted) else np.zeros(len(hashes), bool)
        hashes, row = hashes[used], row[used]
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(hashes)))
    return np.diff(bounds), hashes[first], count, np.searchsorted(row[first], np.arange(len(column) + 1))


def term_vectors(texts, wanted=None):
    """doc_id, n (terms with repeats), terms and tf of every row of (id, text); only terms in `wanted`, if given."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                n, terms, count, bounds = counted_terms(part.column(1), shared.value)
                offsets = pa.array(bounds, pa.int32())
                yield record_batch(VECTORS, part.column(0), n, pa.ListArray.from_arrays(offsets, pa.array(terms)),
                                   pa.ListArray.from_arrays(offsets, pa.array(count, pa.int32())))

    return texts.mapInArrow(run, "doc_id long, n long, terms array<long>, tf array<int>")


# ---- trees -------------------------------------------------------------------------------------------------------

class Tree:
    """Sparse rows in a given order under nodes of `leaf` rows, then `fan` children, each node with its coordinate maxima.

    levels[0] are the leaves. A level holds (bounds, columns, maxima): node i has columns[bounds[i]:bounds[i + 1]], ascending.
    """

    def __init__(self, bounds, columns, values, leaf, fan):
        self.bounds, self.columns, self.values = bounds, columns, values
        self.leaf, self.fan, self.n = leaf, fan, len(bounds) - 1
        self.levels = []
        level, per = (bounds, columns, values), leaf
        while True:
            level = self._up(*level, per)
            self.levels.append(level)
            if len(level[0]) <= fan + 1:
                break
            per = fan

    @staticmethod
    def _up(bounds, columns, values, per):
        n = len(bounds) - 1
        node = np.repeat(np.arange(n) // per, np.diff(bounds))
        order = np.lexsort((columns, node))
        node, columns, values = node[order], columns[order], values[order]
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (columns[1:] != columns[:-1])
        first = np.flatnonzero(new)
        top = np.maximum.reduceat(values, first) if len(first) else values
        return np.searchsorted(node[first], np.arange(-(-n // per) + 1)), columns[first], top

    def children(self, level, node):
        """Nodes of the level below, or rows of a leaf, as a range."""
        per, n = (self.leaf, self.n) if level == 0 else (self.fan, len(self.levels[level - 1][0]) - 1)
        return node * per, min((node + 1) * per, n)


class Lists:
    """The k best (score, doc) of each item: score from high to low, then by doc id."""

    def __init__(self, n, k):
        self.k, self.score, self.doc = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        self.weakest = np.zeros(n, np.int64)          # kth score so far; 0 until there are k

    def offer(self, item, score, doc):
        score, doc = np.concatenate([self.score[item], score]), np.concatenate([self.doc[item], doc])
        at = np.lexsort((doc, -score))[:self.k]
        self.score[item], self.doc[item] = score[at], doc[at]
        if len(at) == self.k:
            self.weakest[item] = self.score[item][-1]


def product_sums(level, nodes, place, weight):
    """Product sums of the maxima of some nodes of a level with weights; place[column] is the weight's place, or -1."""
    bounds, columns, maxima = level
    size = bounds[nodes + 1] - bounds[nodes]
    at = np.arange(size.sum()) + np.repeat(bounds[nodes] - (np.cumsum(size) - size), size)
    used = place[columns[at]]
    values = np.where(used >= 0, maxima[at] * weight[used], 0)
    sums = np.concatenate([[0], np.cumsum(values)])
    stop = np.cumsum(size)
    return sums[stop] - sums[stop - size]


class Search:
    """One block of items against document trees, one after another."""

    def __init__(self, ids, bounds, terms, weights, k):
        self.vocabulary, columns = np.unique(terms, return_inverse=True)
        columns = columns.ravel()
        # items that share a rare term lie side by side: by the heaviest term that another item holds as well
        held = np.bincount(columns, minlength=len(self.vocabulary))
        key = np.full(len(ids), -1)
        for i in range(len(ids)):
            a, b = bounds[i], bounds[i + 1]
            several = a + np.flatnonzero(held[columns[a:b]] > 1)
            if len(several):
                key[i] = columns[several[np.argmax(weights[several])]]
        order = np.lexsort((ids, key))
        size = np.diff(bounds)[order]
        at = np.arange(size.sum()) + np.repeat(bounds[:-1][order] - (np.cumsum(size) - size), size)
        self.ids = ids[order]
        self.tree = Tree(np.concatenate([[0], np.cumsum(size)]), columns[at], weights[at], LEAF_ITEMS, FAN)
        self.lists = Lists(len(ids), k)
        self.place = np.full(len(self.vocabulary), -1)
        self.pairs = 0                                # pairs scored exactly

    def add(self, doc, terms, values, bounds):
        """Documents with terms (hashes) and what each counts; all are looked at once."""
        at = np.searchsorted(self.vocabulary, terms)
        at[at == len(self.vocabulary)] = 0
        used = self.vocabulary[at] == terms
        row = np.repeat(np.arange(len(doc)), np.diff(bounds))[used]
        columns, values = at[used], values[used]
        bounds = np.searchsorted(row, np.arange(len(doc) + 1))
        rows = np.flatnonzero(bounds[1:] > bounds[:-1])
        if not len(rows):
            return
        # documents that share their rarest term lie side by side
        rarest = np.bincount(columns, minlength=len(self.vocabulary))
        rank = np.argsort(np.argsort(rarest, kind="stable"), kind="stable")
        key = np.minimum.reduceat(rank[columns], bounds[:-1][rows])
        rows = rows[np.lexsort((doc[rows], key))]
        size = np.diff(bounds)[rows]
        at = np.arange(size.sum()) + np.repeat(bounds[:-1][rows] - (np.cumsum(size) - size), size)
        self.doc = doc[rows]
        self.docs = Tree(np.concatenate([[0], np.cumsum(size)]), columns[at], values[at], LEAF_DOCS, FAN)
        top, level = len(self.docs.levels) - 1, len(self.tree.levels) - 1
        nodes = np.arange(len(self.docs.levels[top][0]) - 1)
        for node in range(len(self.tree.levels[level][0]) - 1):
            self._visit(level, node, [(top, nodes)])

    def _weakest(self, level, node):
        per = LEAF_ITEMS * FAN ** level
        return self.lists.weakest[node * per:(node + 1) * per].min()

    def _bounds(self, level, node, doc_level, nodes):
        bounds, columns, weight = self.tree.levels[level]
        a, b = bounds[node], bounds[node + 1]
        self.place[columns[a:b]] = np.arange(b - a)
        out = product_sums(self.docs.levels[doc_level], nodes, self.place, weight[a:b])
        self.place[columns[a:b]] = -1
        return out

    def _visit(self, level, node, open_):
        """An item node against document nodes (level, nodes): what its bounds leave goes to its children, or is opened."""
        left, least = [], max(self._weakest(level, node), 1)
        for doc_level, nodes in open_:
            limit = self._bounds(level, node, doc_level, nodes)
            keep = limit >= least
            if not keep.any():
                continue
            nodes, limit = nodes[keep], limit[keep]
            if level and doc_level:                       # both go down: the larger tree keeps pace
                below = [np.arange(*self.docs.children(doc_level, d)) for d in nodes.tolist()]
                left.append((doc_level - 1, np.concatenate(below), None))
            else:
                left.append((doc_level, nodes, limit))
        if not left:
            return
        if level:
            for child in range(*self.tree.children(level, node)):
                self._visit(level - 1, child, [x[:2] for x in left])
        else:
            self._open(node, left)

    @staticmethod
    def _sorted(level, nodes, limit):
        order = np.argsort(-limit, kind="stable")
        return level, nodes[order], limit[order]

    def _open(self, node, left):
        """A leaf of items: document nodes from the best bound down, until the best left is below the weakest kth score."""
        first, last = self.tree.children(0, node)
        bounds, columns, _ = self.tree.levels[0]
        mine = columns[bounds[node]:bounds[node + 1]]
        weight = np.zeros((len(mine), last - first), np.int64)
        for i in range(first, last):
            a, b = self.tree.bounds[i], self.tree.bounds[i + 1]
            weight[np.searchsorted(mine, self.tree.columns[a:b]), i - first] = self.tree.values[a:b]
        heaviest = weight.max(axis=1)
        self.place[mine] = np.arange(len(mine))
        waiting = [self._sorted(*x) for x in left]
        while waiting:
            level, nodes, limit = waiting.pop()
            least = max(self.lists.weakest[first:last].min(), 1)
            if not len(nodes) or limit[0] < least:
                continue
            waiting.append((level, nodes[1:], limit[1:]))
            a, b = self.docs.children(level, int(nodes[0]))
            if level == 0:
                self._score(a, b, first, last, weight)
            else:
                below = np.arange(a, b)
                more = product_sums(self.docs.levels[level - 1], below, self.place, heaviest)
                waiting.append(self._sorted(level - 1, below, more))
        self.place[mine] = -1

    def _score(self, a, b, first, last, weight):
        x, y = self.docs.bounds[a], self.docs.bounds[b]
        used = self.place[self.docs.columns[x:y]]
        row = np.repeat(np.arange(b - a), np.diff(self.docs.bounds[a:b + 1]))
        at = np.flatnonzero(used >= 0)
        dense = np.zeros((b - a, len(weight)), np.int64)
        dense[row[at], used[at]] = self.docs.values[x:y][at]
        few = np.flatnonzero(dense.any(axis=0))
        dense, weight = dense[:, few], weight[few]
        if float(dense.sum(axis=1).max(initial=0)) * float(weight.max(initial=0)) < 2.0 ** 52:      # exact as doubles
            score = (dense.astype(np.float64) @ weight.astype(np.float64)).astype(np.int64)
        else:
            score = dense @ weight
        self.pairs += score.size
        weakest = self.lists.weakest[first:last]
        for i in np.flatnonzero((score >= np.maximum(weakest, 1)[None, :]).any(axis=0)).tolist():
            rows = np.flatnonzero(score[:, i] >= max(weakest[i], 1))
            self.lists.offer(first + i, score[rows, i], self.doc[a:b][rows])

    def results(self):
        size = [len(s) for s in self.lists.score]
        return np.repeat(self.ids, size), np.concatenate(self.lists.doc), np.concatenate(self.lists.score)


# ---- operator ----------------------------------------------------------------------------------------------------

def _flat(column):
    column = column.combine_chunks()
    return column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])


def _blocks(total, bound):
    return max(1, -(-int(total or 0) // bound))


def ranked_search(items, documents, k=50):
    """item_id, rank, doc_id, score: the k best documents of every item; items (item_id, text), documents (doc_id, text)."""
    spark = documents.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    asked = term_vectors(asked).select(F.col("doc_id").alias("item_id"), F.explode("terms").alias("term")).distinct()
    asked, _ = stage(asked, "item-terms")
    few = asked.select("term").distinct()
    wanted = None
    if few.limit(VOCABULARY + 1).count() <= VOCABULARY:
        wanted = np.sort(few.toArrow().column(0).to_numpy())
    vectors, _ = stage(term_vectors(documents.select(F.col("doc_id").cast("long"), "text"), wanted), "term-vectors")
    total, length, entries, rows = vectors.agg(
        F.count(F.when(F.col("n") > 0, 1)), F.sum("n"), F.sum(F.size("terms")), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * total + 2) / (2 * F.col("df") + 1)))
    weighted = asked.join(held, "term").withColumn("weight", weight).where("weight > 0")
    weighted = weighted.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("t"))
    weighted = weighted.select("item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    weighted, _ = stage(weighted, "items")
    groups = _blocks(weighted.agg(F.sum(F.size("terms"))).first()[0], ITEM_TERMS)
    blocks = max(_blocks(rows, CELL_ROWS), _blocks(entries, CELL_TERMS))

    share = F.expr(f"{100 - B} + ({B} * n * {total}L) div {length}L")
    left = weighted.select(
        F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int").alias("g"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(0).alias("side"), F.col("item_id").alias("id"),
        "terms", F.col("weights").alias("values"), F.lit(0).cast("long").alias("m"))
    right = vectors.where("doc_id IS NOT NULL AND size(terms) > 0").select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"),
        F.pmod(F.xxhash64("doc_id", "terms"), F.lit(blocks)).cast("int").alias("b"), F.lit(1).alias("side"),
        F.col("doc_id").alias("id"), "terms", F.col("tf").cast("array<long>").alias("values"), share.alias("m"))

    def search(batches):
        held = None
        for run in runs(batches, 2):
            side, ids, m = (run.column(c).combine_chunks().to_numpy() for c in ("side", "id", "m"))
            cut = int(np.searchsorted(side, 1))
            group = run.column("g")[0].as_py()
            if held is None or held[0] != group:
                if held is not None and held[1] is not None:
                    yield record_batch(FOUND, *held[1].results())
                terms, bounds = _flat(run.column("terms").slice(0, cut))
                weights, _ = _flat(run.column("values").slice(0, cut))
                held = group, Search(ids[:cut], bounds, terms, weights, k) if cut else None
            if held[1] is not None and cut < len(side):
                terms, bounds = _flat(run.column("terms").slice(cut))
                tf, _ = _flat(run.column("values").slice(cut))
                counts = SCALE * tf // (1000 * tf + 20 * np.repeat(m[cut:], np.diff(bounds)))
                held[1].add(ids[cut:], terms, counts, bounds)
        if held is not None and held[1] is not None:
            yield record_batch(FOUND, *held[1].results())

    order = ["g", "b", "side"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    cells = left.union(right).repartition(min(groups * blocks, tasks), "g", "b").sortWithinPartitions(*order)
    found = cells.mapInArrow(search, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
