"""Hard negatives of anchor vectors by Kronecker-packed products.

The components of a vector are integers (floor of scale * x). To score many candidates against an anchor at once, component j
of all of them, made non-negative by a bias, is laid into separate fields of one wide integer P_j. With the anchor's biased
components a_j, the sum of a_j * P_j holds in each field the product sum of one candidate: fields are wide enough that none
runs over, so one multiplication per anchor component scores the whole pack. Unpacked fields, less the bias terms, are the
exact inner products.

An anchor's positives are its first other rows of the same label, by score from high to low, ties by smaller id. For each of
them the hard negatives are the first rows of other labels whose score lies between `low` of the positive's and the positive's.

Anchors and candidates meet in cells of bounded size, dealt by hash of the id, so that no label is a hot key: a first pass
looks at rows of the anchor's label only, a second one at all others, and every pair is multiplied once. Each cell returns
the first few per anchor, which a window over the anchor's few rows per cell merges; pairs are never rows.

Rows with a null id, a null label or vector, or any component that is null, not finite or not finite after scaling take no
part. Vectors of different lengths have no inner product and never meet; empty vectors score 0 among each other. Equal rows
(id, label and vector) count once; different rows of one id are rows of their own, as anchors too. Components of any size
are exact; a score beyond 64 bits counts as the nearest of -(2^63 - 1) and 2^63 - 1. Anchors without positives, and
positives without negatives in range, give no row; an empty table gives an empty result. Other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from placelens.llm.common import record_batch, stage, table
from placelens.llm.groups import runs

ANCHOR_NUMBERS = 1 << 20      # components of the anchors of a cell
CELL_NUMBERS = 1 << 22        # components of the candidates of a cell
CELL_ROWS = 4096              # candidates of a cell, more where it has more anchors
PACK = 1024                   # candidates of one wide integer
_LONG = (1 << 63) - 1

POSITIVES = pa.schema([("anchor_id", pa.int64()), ("anchor_key", pa.int64()), ("positive_id", pa.int64()),
                       ("positive_key", pa.int64()), ("positive_score", pa.int64())])
NEGATIVES = pa.schema([("anchor_id", pa.int64()), ("anchor_key", pa.int64()), ("positive_id", pa.int64()),
                       ("positive_key", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()),
                       ("negative_key", pa.int64()), ("negative_score", pa.int64())])


# ---- packed products ---------------------------------------------------------------------------------------------

def integers(vectors, scale):
    """floor(scale * x) of equally long vectors as a matrix: int64 where that is exact, else Python integers."""
    x = np.floor(np.asarray(vectors, np.float64) * scale)
    if not x.size or np.abs(x).max() < 2.0 ** 52:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], object)


class Pack:
    """Up to PACK candidates as one wide integer per component."""

    def __init__(self, x, reach):
        """x: integer matrix (candidates, components); reach: largest magnitude of an anchor's component."""
        self.n, dim = x.shape
        self.bias = max(0, -int(x.min())) if x.size else 0
        self.reach = reach
        top = (int(x.max()) if x.size else 0) + self.bias
        self.width = 8 * max(4, (max(dim, 1) * top * max(2 * reach, 1)).bit_length() // 8 + 1)   # bits of a field, one to spare
        if self.width <= 64:
            self.width = 32 if self.width == 32 else 64
            kind = np.dtype(f"<u{self.width // 8}")
            fields = [np.ascontiguousarray(c).astype(kind).tobytes() for c in (x + self.bias).T]
        else:
            fields = [b"".join((int(v) + self.bias).to_bytes(self.width // 8, "little") for v in c) for c in x.T]
        self.wide = [int.from_bytes(f, "little") for f in fields]
        self.sums = x.sum(axis=1)

    def scores(self, anchor):
        """Inner products of an anchor (list of ints within reach) with all candidates: exact, or the nearest of -_LONG.._LONG."""
        # sum (a + reach)(c + bias) = score + reach * sum c + bias * sum (a + reach)
        shifted = [a + self.reach for a in anchor]
        total = sum(map(int.__mul__, self.wide, shifted))
        raw = total.to_bytes(self.n * self.width // 8, "little")
        less = self.bias * sum(shifted)
        if self.width <= 64 and self.sums.dtype != object:
            fields = np.frombuffer(raw, f"<u{self.width // 8}").astype(np.int64)
            return fields - self.reach * self.sums - less
        step = self.width // 8
        exact = (int.from_bytes(raw[k:k + step], "little") - self.reach * int(s) - less
                 for k, s in zip(range(0, len(raw), step), self.sums))
        return np.array([max(-_LONG, min(_LONG, s)) for s in exact], np.int64)


def first_of(score, ids, k):
    """Positions of the first k by score from high to low, then by id."""
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return at[np.lexsort((ids[at], -score[at]))[:k]]
    return np.lexsort((ids, -score))[:k]


class Best:
    """The first k of what has been offered, as (score, id, key)."""

    def __init__(self, k):
        self.k, self.rows = k, []

    def offer(self, score, ids, keys):
        if len(self.rows) == self.k and len(score):          # what cannot enter any more
            at = np.flatnonzero(score >= self.rows[-1][0])
            score, ids, keys = score[at], ids[at], keys[at]
        if len(score):
            at = first_of(score, ids, self.k)
            more = list(zip(score[at].tolist(), ids[at].tolist(), keys[at].tolist()))
            self.rows = sorted([*self.rows, *more], key=lambda r: (-r[0], *r[1:]))[:self.k]


# ---- cells -------------------------------------------------------------------------------------------------------

def _valid(embeddings, scale):
    finite = f"forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x * double({float(scale)})) < double('inf'))"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").alias("v"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(finite)
    return rows.withColumn("key", F.xxhash64("label", "v"))


def _cells(rows, anchors, extra, counts):
    """Rows of all cells (g, b): anchors (side 0) with the columns `extra`, candidates (side 1), sorted for `runs`."""
    n, m, dim = counts
    per = max(1, min(ANCHOR_NUMBERS // dim, m))
    groups = -(-m // per)
    blocks = max(1, -(-n // max(1, min(max(CELL_ROWS, 4 * per), CELL_NUMBERS // dim))))
    g = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(groups)).cast("int")
    b = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    left = anchors.withColumn("g", g).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(0))
    right = rows.withColumn("b", b).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("side", F.lit(1))
    right = right.withColumns({k: F.lit(None).cast(t) for k, t in extra.items()})
    order = ["g", "b", "side", "size", "label", "id", "key"]
    both = [x.withColumn("size", F.size("v")).select(*order, "v", *extra) for x in (left, right)]
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return both[0].union(both[1]).repartition(min(groups * blocks, tasks), "g", "b").sortWithinPartitions(*order)


def _packs(run, scale):
    """(anchors by vector length, packs of candidates of one length and label) of a cell: equal rows once."""
    side, size, ids, key = (run.column(k).to_numpy() for k in ("side", "size", "id", "key"))
    label = run.column("label").combine_chunks().dictionary_encode()
    label = label.indices.to_numpy()
    again = np.zeros(len(side), bool)
    again[1:] = (np.diff(side) == 0) & (np.diff(size) == 0) & (np.diff(label) == 0) & (np.diff(ids) == 0) & (key[1:] == key[:-1])
    vectors = run.column("v").combine_chunks()

    def rows_of(at):
        flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        return integers(flat.reshape(len(at), -1) if len(flat) else np.zeros((len(at), 0)), scale)

    for length in np.unique(size[side == 0]).tolist():
        mine = np.flatnonzero((side == 0) & (size == length) & ~again)
        x = rows_of(mine)
        anchors = [(i, label[i], row) for i, row in zip(mine.tolist(), x.tolist())]
        reach = max((abs(a) for _, _, row in anchors for a in row), default=0)
        yield anchors, None, None, None
        theirs = np.flatnonzero((side == 1) & (size == length) & ~again)
        for one in np.unique(label[theirs]).tolist():
            at = theirs[label[theirs] == one]
            for k in range(0, len(at), PACK):
                part = at[k:k + PACK]
                yield anchors, one, part, Pack(rows_of(part), reach)


def _positives_of(k, scale):
    def run_all(batches):
        for run in runs(batches, 2):
            ids, key = run.column("id").to_numpy(), run.column("key").to_numpy()
            best = {}
            for anchors, label, part, pack in _packs(run, scale):
                for i, own, row in anchors if pack else ():
                    if own == label:
                        score = pack.scores(row)
                        other = np.flatnonzero((ids[part] != ids[i]) | (key[part] != key[i]))
                        best.setdefault(i, Best(k)).offer(score[other], ids[part][other], key[part][other])
            rows = [(ids[i], key[i], d, h, s) for i, held in best.items() for s, d, h in held.rows]
            if rows:
                a, h, d, dh, s = zip(*rows)
                yield record_batch(POSITIVES, a, h, d, dh, s)
    return run_all


def _negatives_of(k, low, scale):
    num, den = low

    def run_all(batches):
        for run in runs(batches, 2):
            ids, key = run.column("id").to_numpy(), run.column("key").to_numpy()
            positives = run.column("positives")
            best, asked = {}, {}
            for anchors, label, part, pack in _packs(run, scale):
                if pack is None:
                    for i, _, _ in anchors:
                        asked[i] = sorted({p["score"] for p in positives[i].as_py()}, reverse=True)
                    continue
                for i, own, row in anchors:
                    if own != label and asked[i]:
                        score = pack.scores(row)
                        for p in asked[i]:
                            at = np.flatnonzero((score >= -(-num * p // den)) & (score <= p))
                            if len(at):
                                best.setdefault((i, p), Best(k)).offer(score[at], ids[part][at], key[part][at])
            rows = [(ids[i], key[i], q["id"], q["key"], q["score"], d, h, s) for i in asked for q in positives[i].as_py()
                    if (i, q["score"]) in best for s, d, h in best[i, q["score"]].rows]
            if rows:
                yield record_batch(NEGATIVES, *zip(*rows))
    return run_all


def _ddl(schema):
    return ", ".join(f"{f.name} long" for f in schema)


# ---- operator ----------------------------------------------------------------------------------------------------

def hard_negatives(embeddings, anchors, positives=5, negatives=5, low=(80, 100), scale=256):
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    embeddings: vec_id, embedding (array of float or double), label. anchors: a condition on vec_id. A negative's score s and
    the positive's score p meet low[0] * p <= low[1] * s <= low[1] * p.
    """
    rows = _valid(embeddings, scale)
    chosen = _valid(embeddings.where(anchors), scale)
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    counts = (n, max(chosen.count(), 1), max(dim or 1, 1))
    cells = _cells(rows, chosen, {}, counts)
    found = cells.mapInArrow(_positives_of(positives, scale), _ddl(POSITIVES))
    order = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("positive_score"), "positive_id", "positive_key")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives)
    found = found.groupBy("anchor_id", "anchor_key").agg(F.collect_list(F.struct(
        F.col("positive_id").alias("id"), F.col("positive_key").alias("key"), F.col("positive_score").alias("score"))).alias("positives"))
    found, _ = stage(found, "positives")
    asking = chosen.dropDuplicates(["id", "key"]).join(
        found, (F.col("id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key"))).drop("anchor_id", "anchor_key")
    extra = {"positives": found.schema["positives"].dataType}
    cells = _cells(rows, asking, extra, counts)
    hard = cells.mapInArrow(_negatives_of(negatives, low, scale), _ddl(NEGATIVES))
    order = Window.partitionBy("anchor_id", "anchor_key", "positive_id", "positive_key").orderBy(
        F.desc("negative_score"), "negative_id", "negative_key")
    return hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir):
    """Anchors are the rows whose vec_id is divisible by 100; every seventh row is relabelled first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
