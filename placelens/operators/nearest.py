"""Nearest object per category: branch and bound over two pyramids of cells, then trees inside bounded blocks."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from placelens.functions.geo import distance, geodesic_np, haversine_np, sphere_np
from placelens.operators.counting import _known
from placelens.operators.grid import MARGIN, SMALL_TABLE
from placelens.session import cut_lineage

MAX_DEPTH = 13
TINY = 1e-13      # rounding of the coordinates that distances are bounded with
CHUNK = 4_096     # probes that go down a tree at once
TREE_LEAF = 8     # objects in a leaf of a tree


def nearest(probes, objects, key="venue_id", by=None, method="degrees", label=None, leaf=1_024, probe_leaf=256, probe_block=20_000,
            object_block=200_000):
    """Rows (key, [by], dist, [label]): distance to the nearest object, per category if `by` is given.

    Works on any extent and without a search radius. The bounding boxes of objects and probes are cut into 4 x 4 parts, level by
    level, until no part holds more than `leaf` (`probe_leaf`) locations. A part knows its exact bounds, one of objects one member
    too. A part of probes goes down the objects' levels and keeps, per category, the parts whose least distance to it does not exceed
    the largest one to some member. Parts of probes are then put together to blocks of at most `probe_block`, which get the locations
    of the parts that they kept, `object_block` at a time, and search them by trees. So rows are copied by block, never by
    pair. Ties go to the smallest label.
    """
    cat = by or "_all"
    objs = objects if by else objects.withColumn("_all", F.lit(0))
    name = F.min(label) if label else F.lit(None).cast("string")
    # stored: every step below reads them again
    spots = cut_lineage(objs.filter(_known("o_lat", "o_long") & F.col(cat).isNotNull()).groupBy("o_lat", "o_long", cat).agg(name.alias("_label")))
    asks = cut_lineage(probes.select(F.col(key).alias("_key"), F.col("lat").cast("double"), F.col("long").cast("double")).filter(_known("lat", "long")))
    kinds = {f.name: f.dataType for f in [*probes.schema.fields, *objects.schema.fields]}
    out_cols = [key] + ([by] if by else []) + ["dist"] + ([label] if label else [])
    grids = _Grid(spots, "o_lat", "o_long", leaf, cat), _Grid(asks, "lat", "long", probe_leaf)
    if not grids[0].n or not grids[1].n:
        return probes.limit(0).select(key, *[F.lit(None).cast(kinds.get(c, "double")).alias(c) for c in out_cols[1:]])
    table, cells = grids[0].stored(method), _block_of_cells(grids[1], method, probe_block)

    wants = _kept_parts(cells, table, grids[0].depth, cat, method, [r[0] for r in spots.select(cat).distinct().collect()])   # a row per category
    sizes = wants.join(table.select(cat, "i", "j", "spots"), [cat, "i", "j"]).groupBy("_block").agg(
        F.ceil(F.sum("spots") / object_block).cast("int").alias("_ops"))
    cells = cells.join(sizes, "_block")
    blocks = cells.select("_block", "_sps", "_ops").distinct()
    held = wants.join(blocks, "_block").select(
        "_block", cat, "i", "j", F.pmod(F.xxhash64(cat, "i", "j"), "_ops").cast("int").alias("_op"),
        F.explode(F.sequence(F.lit(0), F.col("_sps") - 1)).alias("_sp"))
    held = grids[0].placed().join(held, [cat, "i", "j"]).select("_block", "_sp", "_op", F.col(cat).alias("_by"), "o_lat", "o_long", "_label")
    asks = grids[1].placed().join(cells.select("i", "j", "_block", "_sps", "_ops"), ["i", "j"]).select(
        "_block", F.pmod(F.xxhash64("_key", "lat", "long"), "_sps").cast("int").alias("_sp"),
        F.explode(F.sequence(F.lit(0), F.col("_ops") - 1)).alias("_op"), "_key", "lat", "long")

    def search(near, objects):
        return _search_block(near, objects, method)

    kind = {c: f"{held.schema[c].dataType.simpleString()}" for c in ("_by", "_label")}
    pairs = asks.groupBy("_block", "_sp", "_op").cogroup(held.groupBy("_block", "_sp", "_op")).applyInArrow(
        search, f"_key {asks.schema['_key'].dataType.simpleString()}, _by {kind['_by']}, lat double, long double, "
                f"o_lat double, o_long double, _label {kind['_label']}")
    pairs = pairs.withColumn("dist", distance(method, "lat", "long", "o_lat", "o_long"))
    found = pairs.groupBy(F.col("_key").alias(key), F.col("_by").alias(cat)).agg(F.min(F.struct("dist", "_label")).alias("m"))
    return found.select(key, *([by] if by else []), F.col("m.dist").alias("dist"),
                        *([F.col("m._label").alias(label)] if label else []))


def closest_city(points, cities, key="venue_id"):
    """Name of and great-circle distance to the nearest city of every point."""
    objects = cities.select("name", F.col("center_lat").alias("o_lat"), F.col("center_long").alias("o_long"))
    return nearest(points, objects, key=key, method="haversine", label="name")


# ---- coordinates in which distances are bounded ------------------------------------------------------------------

def _axes(method, lat, long):
    """Columns in which a point lies: degrees, or on the unit sphere, where chords rise with great-circle distances."""
    if method == "degrees":
        return [F.col(lat), F.col(long)]
    la, lo = F.radians(lat), F.radians(long)
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def _axes_np(method, lat, long):
    return np.column_stack([lat, long]) if method == "degrees" else sphere_np(lat, long)


def _slack(method):
    return MARGIN ** 2 if method == "geodesic" else 1.0 + 1e-9


# ---- parts -------------------------------------------------------------------------------------------------------

class _Grid:
    """4 x 4 parts of 4 x 4 parts over the bounding box of a table, so deep that a part of several locations holds at most `leaf` rows."""

    def __init__(self, df, lat, long, leaf, *cat):
        self.df, self.lat, self.long, self.cat = df, lat, long, cat
        self.ext = df.agg(F.min(lat).alias("a0"), F.max(lat).alias("a1"), F.min(long).alias("b0"), F.max(long).alias("b1"),
                          F.count("*").alias("n")).first()
        self.n = self.ext.n
        self.depth = min(MAX_DEPTH, max(1, math.ceil(math.log(max(self.n / leaf, 1), 16))))
        while self.n and self.depth < MAX_DEPTH and not self._counts().filter((F.col("spots") > leaf) & F.col("wide")).isEmpty():
            self.depth += 1

    def _side(self, x, lo, hi):
        parts = 4 ** self.depth
        return F.least(F.floor((F.col(x) - F.lit(lo)) / F.lit(max(hi - lo, 1e-12)) * parts), F.lit(parts - 1)).cast("bigint")

    def placed(self):
        e = self.ext
        return self.df.withColumn("i", self._side(self.lat, e.a0, e.a1)).withColumn("j", self._side(self.long, e.b0, e.b1))

    def _counts(self):
        return self.placed().groupBy(*self.cat, "i", "j").agg(
            F.count("*").alias("spots"), ((F.min(self.lat) < F.max(self.lat)) | (F.min(self.long) < F.max(self.long))).alias("wide"))

    def stored(self, method):
        """The finest parts: their number of rows, their bounds on each axis, and a member."""
        axes = _axes(method, self.lat, self.long)
        return cut_lineage(self.placed().withColumn("at", F.array(*axes)).groupBy(*self.cat, "i", "j").agg(
            F.count("*").alias("spots"), *_bounds(len(axes), lambda k: F.col("at")[k], lambda k: F.col("at")[k]), F.min("at").alias("member")))


def _bounds(axes, low, high):
    return [F.array(*[F.min(low(k)) for k in range(axes)]).alias("low"), F.array(*[F.max(high(k)) for k in range(axes)]).alias("high")]


def _block_of_cells(grid, method, limit):
    """The probes' finest parts with their block: the largest part around them that holds at most `limit` probes, or themselves.

    `_sps` is the number of pieces that a block of more probes is cut into.
    """
    cells = grid.stored(method).drop("member")
    top = min(grid.depth, max(0, math.ceil(math.log(max(grid.n / limit, 1), 16))))
    block, held = None, None
    for level in range(top, grid.depth + 1):
        up = 2 * (grid.depth - level)
        ids = F.struct(F.lit(level).alias("level"), F.shiftright("i", up).alias("i"), F.shiftright("j", up).alias("j"))
        n = F.sum("spots").over(Window.partitionBy(*[F.shiftright(c, up) for c in ("i", "j")]))   # over the few parts of a block
        cells = cells.withColumn(f"_id{level}", ids).withColumn(f"_n{level}", n)
        fits = F.lit(True) if level == grid.depth else F.col(f"_n{level}") <= limit
        block = F.when(fits, F.col(f"_id{level}")) if block is None else block.when(fits, F.col(f"_id{level}"))
        held = F.when(fits, F.col(f"_n{level}")) if held is None else held.when(fits, F.col(f"_n{level}"))
    return cut_lineage(cells.select("i", "j", "low", "high", block.alias("_block"), F.ceil(held / limit).cast("int").alias("_sps")))


def _kept_parts(cells, table, depth, cat, method, cats):
    """Rows (_block, cat, i, j): the objects' finest parts that can hold the nearest object of some probe of a block."""
    axes = 2 if method == "degrees" else 3

    def parts(level):   # coarser levels are rolled up from the finest one
        up = 2 * (depth - level)
        return table.drop("spots") if not up else table.groupBy(cat, F.shiftright("i", up).alias("i"), F.shiftright("j", up).alias("j")).agg(
            *_bounds(axes, lambda k: F.col("low")[k], lambda k: F.col("high")[k]), F.min("member").alias("member"))

    def gap(k):
        return F.greatest(F.col("low")[k] - F.col("p_high")[k], F.col("p_low")[k] - F.col("high")[k], F.lit(0.0))

    def reach(k):
        return F.greatest(F.abs(F.col("member")[k] - F.col("p_low")[k]), F.abs(F.col("member")[k] - F.col("p_high")[k]))

    def length(side):
        return F.sqrt(sum((F.pow(side(k), 2) for k in range(1, axes)), F.pow(side(0), 2)))

    place = F.struct(F.col("i"), F.col("j"))
    front = cells.select("_block", place.alias("_cell"), F.col("low").alias("p_low"), F.col("high").alias("p_high"))
    kept = [F.col(c) for c in front.columns]
    for level in range(1, depth + 1):
        nodes = parts(level)
        if level == 1:   # at most 16 parts per category: broadcast if that product is small
            if 16 * len(cats) <= SMALL_TABLE:
                nodes = F.broadcast(nodes)
            met = front.withColumn(cat, F.explode(F.array(*map(F.lit, cats)))).join(nodes, cat)
        else:
            up = [F.shiftright(c, 2).alias(f"up_{c}") for c in ("i", "j")]
            met = front.join(nodes.select("*", *up), [cat, "up_i", "up_j"])
        best = Window.partitionBy("_cell", cat)
        met = met.withColumn("_least", length(gap)).withColumn("_best", F.min(length(reach)).over(best))
        front = met.filter(F.col("_least") <= F.col("_best") * _slack(method) + TINY).select(
            *kept, cat, F.col("i").alias("up_i"), F.col("j").alias("up_j"))
    return cut_lineage(front.select("_block", cat, F.col("up_i").alias("i"), F.col("up_j").alias("j")).distinct())


# ---- blocks ------------------------------------------------------------------------------------------------------

class _Tree:
    """Points halved along the wider side, level by level: at level l, segment s holds the points edges[l][s]:edges[l][s + 1]."""

    def __init__(self, at):
        n = len(at)
        self.levels = max(0, math.ceil(math.log2(max(n / TREE_LEAF, 1))))
        order, self.edges = np.arange(n), [np.array([0, n])]
        for _ in range(self.levels):
            old = self.edges[-1]
            new = np.insert(old, np.arange(1, len(old)), (old[:-1] + old[1:]) // 2)
            low, high = self._box(at[order], old)
            segment = np.repeat(np.arange(len(old) - 1), np.diff(old))
            order = order[np.lexsort((at[order, (high - low).argmax(axis=1)[segment]], segment))]
            self.edges.append(new)
        self.order, self.at = order, at[order]
        self.boxes = [self._box(self.at, e) for e in self.edges]

    def _box(self, at, edges):
        return np.minimum.reduceat(at, edges[:-1]), np.maximum.reduceat(at, edges[:-1])

    def candidates(self, p, slack):
        """(probes, points): pairs among which are all nearest points of each probe, ordered by probe."""
        q, s = np.arange(len(p)), np.zeros(len(p), dtype=int)
        for level in range(1, self.levels + 1):
            q, s = np.repeat(q, 2), (2 * s[:, None] + [0, 1]).ravel()
            low, high = self.boxes[level]
            here = p[q]
            least = np.sqrt((np.maximum(np.maximum(low[s] - here, here - high[s]), 0) ** 2).sum(axis=1))
            member = np.sqrt(((self.at[self.edges[level][s]] - here) ** 2).sum(axis=1))
            q, s = self._keep(q, s, least, member, len(p), slack)
        first, size = self.edges[-1][s], np.diff(self.edges[-1])[s]
        point = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        q = np.repeat(q, size)
        dist = np.sqrt(((self.at[point] - p[q]) ** 2).sum(axis=1))
        q, point = self._keep(q, point, dist, dist, len(p), slack)
        return q, self.order[point]

    def _keep(self, q, s, least, reach, n, slack):
        best = np.minimum.reduceat(reach, np.searchsorted(q, np.arange(n)))
        some = least <= best[q] * slack + TINY
        return q[some], s[some]


def _search_block(near, held, method):
    """Nearest objects of each probe of a block, per category, as rows (_key, _by, lat, long, o_lat, o_long, _label).

    Objects whose distances agree up to rounding all stay if they have labels.
    """
    found = []
    if near.num_rows and held.num_rows:
        codes = held["_by"].combine_chunks().dictionary_encode()
        code = codes.indices.to_numpy()
        lat, long, o_lat, o_long = (t[c].to_numpy() for t, c in ((near, "lat"), (near, "long"), (held, "o_lat"), (held, "o_long")))
        named = held["_label"].null_count < held.num_rows
        p, o, order = _axes_np(method, lat, long), _axes_np(method, o_lat, o_long), np.argsort(code, kind="stable")
        exact = {"degrees": lambda a, b, c, d: np.hypot(a - c, b - d), "haversine": haversine_np, "geodesic": geodesic_np}[method]
        ends = np.flatnonzero(np.diff(code[order], prepend=-1, append=-1))
        for start, end in zip(ends[:-1], ends[1:]):
            own = order[start:end]
            tree = _Tree(o[own])
            for at in range(0, len(p), CHUNK):
                i, j = tree.candidates(p[at:at + CHUNK], _slack(method))
                i, j = i + at, own[j]
                dist = exact(lat[i], long[i], o_lat[j], o_long[j])
                first = np.searchsorted(i, np.arange(at, min(at + CHUNK, len(p))))
                if named:
                    best = np.minimum.reduceat(dist, first)
                    keep = np.flatnonzero(dist <= best[i - at] * (1 + 1e-12) + TINY)
                else:
                    by_dist = np.lexsort((dist, i))
                    keep = by_dist[first]
                found.append((i[keep], j[keep]))
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2
    i, j = pa.array(i), pa.array(j)
    return pa.table({**{c: near[c].take(i) for c in ("_key", "lat", "long")}, **{c: held[c].take(j) for c in ("o_lat", "o_long", "_by", "_label")}}
                    ).select(["_key", "_by", "lat", "long", "o_lat", "o_long", "_label"])
