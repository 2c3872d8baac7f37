"""Embedding near-dedup by sorted projection passes.

Vectors of one label link at a cosine (double precision) of 0.98 or more. Each pass orders the vectors of a label
lexicographically by concatenated random hashes, the signs of 63 projections. Every vector is compared with the WINDOW vectors
before it, hits are verified by the exact cosine, and pairs are united across passes by union-find.

What a window does not cover is joined exactly: the first `prefix_bits` signs make runs of equal prefixes, and in every run
longer than a window, unless it is one component already, each vector outside the run's largest component meets all of the run,
in blocks of bounded size. So all links of a run are found, whatever its length, and a pair at the threshold is missed only if no pass
gives it an equal prefix, whose probability is MISS or less for any data: density costs time, it loses no pair. Labels of up to RUN
vectors have no prefix and are one run: nothing is missed there.

Links are then counted exactly inside each component: members within half the threshold angle of the component's mean direction
link with each other by the triangle inequality and are counted, not compared; each remaining member meets all members of its
component in blocks, one matrix product each. Pairs are never rows.

Equal vectors of a label are compared once. Null, zero and non-finite vectors, null components and null labels link with
nothing, nor do vectors of different length. Rows of one id are one vector: repeated rows get the same result. A null id is
returned with a null component and is kept. An empty table gives an empty result.
"""

from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from placelens.llm.common import PAIR, broadcast_if_small, components, record_batch, stage, table
from placelens.llm.groups import runs

LINK = 0.98
SIGNS = 63            # projections of a pass's hash
WINDOW = 128          # neighbours before a vector that it is compared with
RUN = 2048            # vectors of equal prefix, if the signs were independent
NUMBERS = 1 << 18     # of the vectors of a block
BLOCK_ROWS = 4096     # vectors of a block at most
MISS = 1e-9
AT_ONCE = 4           # passes that share one job and its disk space
PROBES, MEMBERS = 256, 1024
MEANS = 1 << 22       # numbers of the mean vectors that are sent to the tasks; more are joined by a shuffle

_ANGLE = acos(LINK)


def prefix_bits(n):
    """Signs that make a run, for a label of n vectors."""
    return max(0, ceil(log2(max(n, 1) / RUN)))


def passes_needed(n):
    """Passes until a pair at the threshold shares a prefix with probability 1 - MISS, for a label of n vectors, of any density."""
    hit = (1 - _ANGLE / pi) ** prefix_bits(n)
    return 1 if hit == 1 else ceil(log(MISS) / log(1 - hit))


def matrix(column):
    """Rows of a list column of equal lengths as unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)      # so that no square runs over or under
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hashes(x, number):
    """The signs of SIGNS random projections of pass `number` as one long, the first sign in the highest place."""
    planes = np.random.default_rng([number, x.shape[1]]).standard_normal((x.shape[1], SIGNS))
    return ((x @ planes) > 0) @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))


def by_length(batch, column):
    """Slices of a batch in which all vectors have one length."""
    size = batch.column(batch.schema.get_field_index(column)).value_lengths().to_numpy()
    for n in np.unique(size):
        yield batch.filter(pa.array(size == n))


def local_components(links):
    """Smallest reachable row of every row of a symmetric boolean matrix."""
    n = len(links)
    root = np.arange(n)
    links = links | np.eye(n, dtype=bool)
    while True:
        low = np.where(links, root[None, :], n).min(axis=1)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def distinct_vectors(embeddings):
    """(vectors: item, label, v, copies; members: vec_id, item) of the valid rows; item is the smallest id of equal vectors."""
    valid = "size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) " \
            "AND exists(embedding, x -> x != 0)"
    rows = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(valid)
    rows = rows.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("v")).distinct()
    rows, _ = stage(rows.withColumn("h", F.xxhash64("label", "v")), "vectors")
    vectors = rows.groupBy("label", "h", "v").agg(F.min("vec_id").alias("item"), F.count("*").alias("copies"))
    vectors, _ = stage(vectors.select("item", "label", "v", "copies"), "distinct")
    few = vectors.where("copies > 1").select("label", F.col("v").alias("w"), "item", F.xxhash64("label", "v").alias("h"))
    members = rows.join(few, (rows.h == few.h) & (rows.label == few.label) & (rows.v == few.w), "left").select(
        "vec_id", F.coalesce("item", "vec_id").alias("item"))
    return vectors, members


def cell_edges(left, right):
    """Edges (two arrays of items) that connect whatever links between left and right, pairs of (items, unit vectors)."""
    (a, x), (b, y) = left, right
    links = np.zeros((len(a), len(b)), bool)
    for k in range(0, len(a), 256):
        links[k:k + 256] = x[k:k + 256] @ y.T >= LINK
        links[k:k + 256] |= a[k:k + 256, None] == b[None, :]
    rows = np.flatnonzero((links & (a[:, None] != b[None, :])).any(axis=1))
    links, a = links[rows], a[rows]
    columns = np.flatnonzero(links.any(axis=0))
    links, b = links[:, columns], b[columns]
    if not len(a):
        return a, a
    n = len(a)
    row = np.arange(n, dtype=np.int32)
    while True:                                        # smallest row that reaches each column, each row
        column = np.where(links, row[:, None], np.int32(n)).min(axis=0)
        low = np.where(links, column[None, :], np.int32(n)).min(axis=1)
        low = np.minimum(low, row)
        low = low[low]
        if (low == row).all():
            break
        row = low
    one, two = np.concatenate([a, b]), np.concatenate([a[row], a[column]])
    return one[one != two], two[one != two]


_KEY = ["pass", "label", "dim", "prefix"]


def _block_rows(dim):
    return max(1, min(BLOCK_ROWS, NUMBERS // max(dim, 1)))


def _rows_per_block():
    return F.greatest(F.least(F.floor(F.lit(NUMBERS) / F.col("dim")), F.lit(BLOCK_ROWS)), F.lit(1))


def _cells(rows, vectors):
    """Edges found in the cells of `rows`: run, i, j, side, item. Sides 0 and 1 meet; a cell without side 1 meets itself."""
    def meet(batches):
        for run in runs(batches, 6):
            side, item = (run.column(k).combine_chunks().to_numpy() for k in (6, 7))
            x = matrix(run.column(8))
            left, right = ((item[side == s], x[side == s]) for s in (0, 1))
            a, b = cell_edges(left, right if len(right[0]) else left)
            if len(a):
                yield record_batch(PAIR, a, b)

    cell = [*_KEY, "i", "j"]
    rows = rows.join(vectors.select("item", "v"), "item").select(*cell, "side", "item", "v")
    return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(meet, "a long, b long").distinct()


def dealt(vectors):
    """(table of pass, label, dim, prefix, key, item, one row of each pass of each vector; number of passes)."""
    size = vectors.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    largest = size.agg(F.max("n")).first()[0] or 0
    known = vectors.withColumn("dim", F.size("v")).join(broadcast_if_small(size), ["label", "dim"]).select("label", "dim", "item", "n", "v")

    def keys(batches):
        for batch in batches:
            for part in by_length(batch, "v"):
                n = part.column(3).to_numpy()
                for each in np.unique(n).tolist():
                    some = part.filter(pa.array(n == each))
                    x = matrix(some.column(4))
                    for k in range(passes_needed(each)):
                        key = hashes(x, k)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(x), k, np.int32)), some.column(0), some.column(1),
                             pa.array(key >> (SIGNS - prefix_bits(each))), pa.array(key), some.column(2)], names=[*_KEY, "key", "item"])

    label = vectors.schema["label"].dataType.simpleString()
    return stage(known.mapInArrow(keys, f"pass int, label {label}, dim int, prefix long, key long, item long"), "dealt")[0], passes_needed(largest)


def _windows(batches):
    """Edges between each vector and the WINDOW before it in a sorted partition; holds one window and one slice."""
    last, items, x = None, None, None
    for whole in batches:
        at = 0
        while at < whole.num_rows:
            batch = whole.slice(at, _block_rows(whole.column(2)[at].as_py()))
            at += batch.num_rows
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                run = tuple(c[a] for c in columns)
                more, y = batch.column(4).to_numpy()[a:b], matrix(batch.column(5).slice(a, b - a))
                keep = len(items) if last == run else 0
                if keep:
                    more, y = np.concatenate([items, more]), np.concatenate([x, y])
                for k in range(keep, len(more), WINDOW):
                    first = max(k - WINDOW, 0)
                    one, two = cell_edges((more[k:k + WINDOW], y[k:k + WINDOW]), (more[first:k + WINDOW], y[first:k + WINDOW]))
                    if len(one):
                        yield record_batch(PAIR, one, two)
                last, items, x = run, more[-WINDOW:], y[-WINDOW:]


def window_edges(rows, vectors):
    """Edges of neighbours in the order of some passes."""
    order = [*_KEY, "key", "item"]
    rows = rows.join(vectors.select("item", "v"), "item").repartition(*_KEY).sortWithinPartitions(*order)
    return rows.select(*_KEY, "item", "v").mapInArrow(_windows, "a long, b long").distinct()


def run_edges(vectors):
    """Edges that connect all that links inside the runs of all passes."""
    rows, total = dealt(vectors)
    edges = None
    for first in range(0, total, AT_ONCE):
        some, _ = stage(window_edges(rows.where((F.col("pass") >= first) & (F.col("pass") < first + AT_ONCE)), vectors), "window-links")
        edges = some if edges is None else edges.union(some)
    long_ = rows.groupBy(*_KEY).agg(F.count("*").alias("size")).where(F.col("size") > WINDOW).drop("size")
    found, _ = stage(components(edges), "components")
    found = broadcast_if_small(found.select(F.col("node").alias("item"), "component"))
    large = rows.drop("key").join(broadcast_if_small(stage(long_, "long-runs")[0]), _KEY)
    large, _ = stage(large.join(found, "item", "left").withColumn("component", F.coalesce("component", "item")), "large")
    most = large.groupBy(*_KEY, "component").agg(F.count("*").alias("n")).groupBy(*_KEY).agg(
        F.max_by("component", F.struct("n", "component")).alias("most"), F.max("n").alias("inner"), F.sum("n").alias("all"))
    per = _rows_per_block()
    most = most.where("inner < all").withColumns({
        "outer": F.ceil((F.col("all") - F.col("inner")) / per).cast("int"), "inner": F.ceil(F.col("inner") / per).cast("int")})
    most, _ = stage(most, "open-runs")
    if most.isEmpty():
        return edges
    open_ = large.join(broadcast_if_small(most), _KEY)
    # blocks 0 .. outer - 1 are of vectors outside the largest component, the others of it; two of these never meet
    outside = F.col("component") != F.col("most")
    b = F.when(outside, F.pmod(F.xxhash64("item"), F.col("outer"))).otherwise(
        F.col("outer") + F.pmod(F.xxhash64("item"), F.col("inner"))).cast("int")
    to = F.sequence(F.lit(0), F.when(outside, F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1)
    across = open_.withColumn("b", b).withColumn("to", F.explode(to)).withColumns({
        "i": F.least("b", "to"), "j": F.greatest("b", "to"), "side": (F.col("b") > F.col("to")).cast("int")})
    for first in range(0, total, AT_ONCE):
        some, _ = stage(_cells(across.where((F.col("pass") >= first) & (F.col("pass") < first + AT_ONCE)), vectors), "links")
        edges = edges.union(some)
    return edges


def count_links(vectors, found):
    """item, n: for every item of a component, how many vectors of other items (with copies) link with it. Exact."""
    rows = vectors.select("item", "v", "copies").join(
        broadcast_if_small(found.select(F.col("node").alias("item"), "component")), "item").select("component", "item", "copies", "v")
    rows, _ = stage(rows, "members")

    def sums(batches):
        for batch in batches:
            for part in by_length(batch, "v"):
                names, at = np.unique(part.column(0).to_numpy(), return_inverse=True)
                total = np.zeros((len(names), 0))
                x = matrix(part.column(part.num_columns - 1))
                total = np.zeros((len(names), x.shape[1]))
                np.add.at(total, at.ravel(), x)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total.tolist(), pa.list_(pa.float64()))],
                                                 names=["component", "mean"])

    def whole(batches):
        for run in runs(batches, 1):
            mean = np.array(run.column(1).combine_chunks().flatten()).reshape(run.num_rows, -1).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([run.column(0)[0].as_py()]), pa.array([mean.tolist()], pa.list_(pa.float64()))],
                                             names=["component", "mean"])

    widest = rows.agg(F.max(F.size("v"))).first()[0] or 1
    means = rows.mapInArrow(sums, "component long, mean array<double>").repartition("component").sortWithinPartitions("component")
    means = means.mapInArrow(whole, "component long, mean array<double>")

    def inside(batches):
        half = np.cos(_ANGLE / 2 - 1e-7)
        for batch in batches:
            for part in by_length(batch, "v"):
                x = matrix(part.column(3))
                m = np.asarray(part.column(4).flatten(), np.float64).reshape(x.shape)
                norm = np.linalg.norm(m, axis=1)
                core = (x * m).sum(axis=1) >= half * norm
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(core & (norm > 0))],
                                                 names=["component", "item", "copies", "v", "core"])

    ddl = "component long, item long, copies long, v array<double>, core boolean"
    rows = rows.join(broadcast_if_small(means, max(1, MEANS // max(widest, 1))), "component").select("component", "item", "copies", "v", "mean").mapInArrow(inside, ddl)
    rows, _ = stage(rows, "core")
    sizes = rows.groupBy("component").agg(
        F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("inner"),
        F.ceil(F.count(F.when(~F.col("core"), 1)) / PROBES).cast("int").alias("probes"),
        F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    sizes, _ = stage(sizes, "sizes")
    rows = rows.join(broadcast_if_small(sizes), "component")
    certain = rows.select("item", F.when(F.col("core"), F.col("inner") - F.col("copies")).otherwise(0).alias("n"))
    open_ = rows.where("probes > 0")
    columns = ["component", "p", "b", "side", "item", "copies", "core", "v"]
    probe = open_.where("NOT core").withColumn("p", F.pmod(F.xxhash64("item", F.lit(1)), "probes").cast("int")).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
    member = open_.withColumn("b", F.pmod(F.xxhash64("item"), "blocks").cast("int")).withColumn(
        "p", F.explode(F.sequence(F.lit(0), F.col("probes") - 1))).withColumn("side", F.lit(1))

    def meet(batches):
        for run in runs(batches, 3):
            side, item, copies, core = (run.column(k).to_numpy() for k in (3, 4, 5, 6))
            x = matrix(run.column(7))
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(a) and len(b):
                links = (x[a] @ x[b].T >= LINK) & (item[a][:, None] != item[b][None, :])
                inner = core[b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([item[a], item[b][inner]])),
                     pa.array(np.concatenate([links @ copies[b], (copies[a] @ links)[inner]]).astype(np.int64))], names=["item", "n"])

    cells = probe.select(*columns).union(member.select(*columns)).repartition("component", "p", "b").sortWithinPartitions("component", "p", "b")
    counted = cells.mapInArrow(meet, "item long, n long")
    return certain.union(counted).groupBy("item").agg(F.sum("n").alias("n"))


def near_duplicates(embeddings):
    """vec_id, n_links, component_id, kept of every row of `embeddings` (vec_id, embedding, label)."""
    vectors, members = distinct_vectors(embeddings)
    edges = run_edges(vectors)
    found, _ = stage(components(edges), "components")
    counts = count_links(vectors, found)
    info = vectors.select("item", "copies").join(found, F.col("item") == F.col("node"), "left").drop("node").join(counts, "item", "left")
    result = members.join(info, "item").select(
        F.col("vec_id").alias("id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("component", "item").alias("component"))
    result = result.groupBy("id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    ids = embeddings.select(F.col("vec_id").cast("long"))
    component = F.coalesce("component", "vec_id")
    return ids.join(result, ids.vec_id == result.id, "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))


def op1_vector_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
