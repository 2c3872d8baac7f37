"""Distance joins as equi-joins on the cells of a latitude-band grid.

A pure distance predicate would be planned as a nested loop over all pairs. Here every object sits
in exactly one cell, every probe is copied to the cells its circle can reach (about ten), the two
meet in an equi-join on the cell, and the exact predicate follows. Cells of a band have equal width
and wrap around evenly, so the antimeridian and the poles need no special case.
"""

import math

import numpy as np
from pyspark.sql import functions as F

from placelens.functions.geo import (R_SPHERE, distance, geodesic_np, geodesic_once, haversine_from_gaps, haversine_np, metre_box,
                                     sphere_np, weight_np)

MARGIN = 1.01          # covers the gap between spherical and ellipsoidal distances
SMALL_TABLE = 10_000   # rows up to which a measured helper table is broadcast
SLICE = 500_000        # pairs whose distances are held at once
LEAST_PAIRS = 1 << 21  # candidate pairs for which a task of its own pays
TASK_PAIRS = 1 << 26   # candidate pairs of a task of a pair list, about
CLOSE = 1e-6           # relative error that squared chords stay far below, their absolute error its square


def _reach(radius):
    """Band height in degrees for a radius in metres."""
    return math.degrees(radius / R_SPHERE) * MARGIN


def _widest(band, step, spread=0):
    """Largest |latitude| touched by the band and its `spread` neighbours."""
    return F.greatest(F.abs((band - spread) * step), F.abs((band + 1 + spread) * step))


def _cells_in_band(band, step):
    top = _widest(band, step)
    n = F.floor(F.cos(F.radians(top)) * 360 / step)
    return F.when(top >= 90, F.lit(1)).otherwise(F.greatest(n, F.lit(1))).cast("bigint")


def _key(band, cell):
    return F.shiftleft(band.cast("bigint"), 32) + cell


def object_cell(lat, long, radius):
    """The cell of an object."""
    step = _reach(radius)
    band = F.floor(F.col(lat) / step)
    n = _cells_in_band(band, step)
    return _key(band, F.pmod(F.floor((F.col(long) + 180) * n / 360), n))


def probe_cells(lat, long, radius):
    """Array of the cells that can hold objects within the radius of a probe."""
    step = _reach(radius)
    here = F.floor(F.col(lat) / step)
    top = _widest(here, step, 1)
    dlong = F.lit(step) / F.cos(F.radians(top))

    def cells(band):
        n = _cells_in_band(band, step)
        lo = F.floor((F.col(long) - dlong + 180) * n / 360)
        hi = F.floor((F.col(long) + dlong + 180) * n / 360)
        whole = (top >= 90) | (hi - lo >= n - 1)
        span = F.sequence(F.when(whole, F.lit(0)).otherwise(lo), F.when(whole, n - 1).otherwise(hi))
        return F.transform(span, lambda c: _key(band, F.pmod(c, n)))

    return F.flatten(F.transform(F.sequence(here - 1, here + 1), cells))


def hot_cells(objects, cell, limit):
    """Cells with more than `limit` objects and the number of pieces to cut them into.

    Returns None if there are none. A table of measured small size is broadcast; a larger one is
    left to a shuffle join.
    """
    counts = objects.groupBy(cell).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    hot = counts.select(cell, F.ceil(F.col("n") / limit).cast("int").alias("pieces"))
    some = hot.limit(SMALL_TABLE + 1).collect()   # bounded by the limit
    if not some:
        return None
    if len(some) <= SMALL_TABLE:
        return F.broadcast(objects.sparkSession.createDataFrame(some, hot.schema))
    return hot


def _cut(df, own, sides):
    """One of two sides that meet by `_cell`, its rows dealt to the pieces of its hot cells and copied to those of the other side.

    sides: (hot cells, columns that deal a row, name of the piece) of both; a side without hot cells gets no piece.
    """
    for i, (hot, cols, piece) in enumerate(sides):
        n = F.lit(1)
        if hot is not None:
            df = df.join(hot, "_cell", "left")
            n = F.coalesce("pieces", F.lit(1))
        which = F.pmod(F.xxhash64(*cols), n).cast("int") if i == own else F.explode(F.sequence(F.lit(0), n - 1))
        df = df.withColumn(piece, which).drop("pieces")
    return df


def candidate_pairs(probes, objects, radius, max_cell=4_000, lat="lat", long="long", o_lat="o_lat", o_long="o_long"):
    """All pairs that share a cell (a superset of the pairs within `radius`).

    Cells that more than `max_cell` objects or probes reach are cut into pieces of either side, and every two pieces meet once.
    The join has a task for about TASK_PAIRS pairs, not for so many bytes: the pairs are many more than the rows that meet.
    """
    objects = objects.withColumn("_cell", object_cell(o_lat, o_long, radius))
    probes = probes.withColumn("_cell", F.explode(probe_cells(lat, long, radius)))
    none, one = F.lit(0), F.lit(1)
    sizes = (probes.select("_cell", one.alias("p"), none.alias("o")).union(objects.select("_cell", none, one))
             .groupBy("_cell").agg(F.sum("p").cast("double").alias("p"), F.sum("o").cast("double").alias("o"))
             .filter("_cell IS NOT NULL AND p > 0 AND o > 0").agg(F.sum(F.col("p") * F.col("o")), F.max("p"), F.max("o")).first())
    pairs, most, keys, sides = sizes[0] or 0, sizes[1:], ["_cell"], []
    for df, n, piece in zip((probes, objects), most, ("_pp", "_op")):
        hot = hot_cells(df, "_cell", max_cell) if (n or 0) > max_cell else None
        if hot is not None:
            sides.append((hot, df.columns, piece))
            keys.append(piece)
        else:
            sides.append(None)
    for own, df in enumerate((probes, objects)):
        cut = [s for s in sides if s]
        df = _cut(df, cut.index(sides[own]) if sides[own] else -1, cut)
        probes, objects = (df, objects) if own == 0 else (probes, df)
    few = min(math.ceil(pairs / LEAST_PAIRS), 4 * probes.sparkSession.sparkContext.defaultParallelism)
    tasks = max(few, math.ceil(pairs / TASK_PAIRS), 1)
    return probes.repartition(tasks, *keys).join(objects.repartition(tasks, *keys).hint("merge"), keys).drop(*keys)


def _on_sphere(df, lat, long, prefix):
    """`df` with the points on the unit sphere and the cosine of the latitude."""
    la, lo = F.radians(F.col(lat)), F.radians(F.col(long))
    return df.withColumns({f"{prefix}x": F.cos(la) * F.cos(lo), f"{prefix}y": F.cos(la) * F.sin(lo), f"{prefix}z": F.sin(la),
                           f"{prefix}cos": F.cos(la)})


def _squared_chord(radius):
    """Square of the chord of a great-circle distance on the unit sphere."""
    return (2 * math.sin(min(radius / R_SPHERE, math.pi) / 2)) ** 2


def radius_join(probes, objects, radius, method="haversine", dist="dist", **names):
    """Pairs closer than `radius` metres, with their distance."""
    lat, long = names.get("lat", "lat"), names.get("long", "long")
    o_lat, o_long = names.get("o_lat", "o_lat"), names.get("o_long", "o_long")
    if method == "degrees":
        near = candidate_pairs(probes, objects, radius, **names)
        return near.withColumn(dist, distance(method, lat, long, o_lat, o_long)).filter(F.col(dist) < radius)
    # chords of points worked out once for each row tell what is in range; only pairs at the radius are told by their distance
    near = candidate_pairs(_on_sphere(probes, lat, long, "_p"), _on_sphere(objects, o_lat, o_long, "_o"), radius, **names)
    chord = sum(((F.col(f"_p{c}") - F.col(f"_o{c}")) * (F.col(f"_p{c}") - F.col(f"_o{c}")) for c in "yz"),
                (F.col("_px") - F.col("_ox")) * (F.col("_px") - F.col("_ox")))
    metres = haversine_from_gaps(F.col(o_lat) - F.col(lat), F.col(o_long) - F.col(long), F.col("_pcos") * F.col("_ocos"))
    helpers = [f"{side}{c}" for side in ("_p", "_o") for c in ("x", "y", "z", "cos")]
    if method == "geodesic":   # cheap test first: few candidates reach the Arrow function
        near = near.filter(chord < _squared_chord(radius * MARGIN) * (1 + CLOSE) + CLOSE ** 2).drop(*helpers)
        return near.withColumn(dist, geodesic_once(lat, long, o_lat, o_long)).filter(F.col(dist) < radius)
    edge = _squared_chord(radius)
    near = near.filter((chord < edge * (1 - CLOSE) - CLOSE ** 2) | ((chord < edge * (1 + CLOSE) + CLOSE ** 2) & (metres < radius)))
    return near.withColumn(dist, metres).drop(*helpers)


def rectangle_join(probes, objects, half_side, **names):
    """Pairs with the object strictly inside the square of `half_side` metres around the probe."""
    lat, long = names.get("lat", "lat"), names.get("long", "long")
    o_lat, o_long = F.col(names.get("o_lat", "o_lat")), F.col(names.get("o_long", "o_long"))
    box = dict(zip(("_lo1", "_hi1", "_lo2", "_hi2"), metre_box(lat, long, half_side)))
    near = candidate_pairs(probes.withColumns(box), objects, half_side, **names)   # cells reach as far along both axes
    return near.filter((F.col("_lo1") < o_lat) & (o_lat < F.col("_hi1")) & (F.col("_lo2") < o_long) & (o_long < F.col("_hi2"))).drop(*box)


def blocks(spots, objects, radius, spot_block=1_000, object_block=1_000, spot_columns=("lat", "long"),
           object_columns=("o_lat", "o_long")):
    """Both sides keyed for a cogrouped block computation: (spots, objects, keys, objects_cut).

    Here a spot sits in one cell and objects are copied to the cells they reach, so a spot's result
    is complete within one block unless its cell holds more than `object_block` objects. Fuller
    cells are cut into pieces on either side; every pair of pieces meets once, so no block ever
    holds more than about spot_block x object_block pairs. Rows equal in `spot_columns` (`object_columns`) stay together.
    """
    spots = spots.withColumn("_cell", object_cell("lat", "long", radius))
    objects = objects.withColumn("_cell", F.explode(probe_cells("o_lat", "o_long", radius)))
    sides = []
    for df, cols, limit, piece in ((spots, spot_columns, spot_block, "_sp"), (objects, object_columns, object_block, "_op")):
        sides.append((hot_cells(df, "_cell", limit), cols, piece))

    return _cut(spots, 0, sides), _cut(objects, 1, sides), ["_cell", "_sp", "_op"], sides[1][0] is not None


def block_distances(spots, objects, radius, method):
    """Distances of all pairs of one block, as a matrix spots x objects; geodesics only where they can be in range."""
    a, b = (np.asarray(spots[c], dtype=float)[:, None] for c in ("lat", "long"))
    c, d = (np.asarray(objects[x], dtype=float)[None, :] for x in ("o_lat", "o_long"))
    dist = haversine_np(a, b, c, d)
    if method == "geodesic":
        i, j = np.nonzero(dist < radius * MARGIN)
        exact = np.full(dist.shape, np.inf)
        exact[i, j] = geodesic_np(a[i, 0], b[i, 0], c[0, j], d[0, j])
        dist = exact
    return dist


def block_weights(spots, objects, radius, method, weight):
    """(weights, in-range mask) of all pairs of one block, as matrices spots x objects."""
    dist = block_distances(spots, objects, radius, method)
    return weight_np(dist, radius, weight), dist < radius


def chord_weights(spots, objects, radius, method, weight):
    """block_weights in a fraction of the time, equal up to rounding; the mask is the same."""
    if method != "haversine" or radius >= R_SPHERE:   # farther chords lose digits
        return block_weights(spots, objects, radius, method, weight)
    dist = _chord_distances(spots, objects, radius)
    return weight_np(dist, radius, weight, _products), dist < radius


def _products(base, power):
    """base ** 3 or base ** 6."""
    cube = base * base * base
    return cube if power == 3 else cube * cube


def _chord_distances(spots, objects, radius):
    """Great-circle distances within a nanometre or so, from chords; those at the radius by block_distances' own formula."""
    a, b = sphere_np(spots["lat"], spots["long"]), sphere_np(objects["o_lat"], objects["o_long"])
    dist = np.zeros((len(a), len(b)))
    for k in range(3):
        side = np.subtract.outer(a[:, k], b[:, k])
        dist += np.square(side, out=side)
    np.minimum(np.sqrt(dist, out=dist) / 2, 1, out=dist)
    dist = 2 * R_SPHERE * np.arcsin(dist, out=dist)
    i, j = np.nonzero(np.abs(dist - radius) < 1e-6)
    if len(i):
        (lat, long), (o_lat, o_long) = ([np.asarray(t[c], dtype=float) for c in names]
                                        for t, names in ((spots, ("lat", "long")), (objects, ("o_lat", "o_long"))))
        dist[i, j] = haversine_np(lat[i], long[i], o_lat[j], o_long[j])
    return dist


def compact_tiles(lat, long, size):
    """Row numbers of points with known coordinates in tiles of about `size` neighbours: strips by latitude, cut by longitude."""
    rows = np.flatnonzero(~np.isnan(lat + long))
    strip = max(size, math.isqrt(len(rows) * size))
    rows = rows[np.argsort(lat[rows], kind="stable")]
    for at in range(0, len(rows), strip):
        some = rows[at:at + strip]
        some = some[np.argsort(long[some], kind="stable")]
        yield from (some[k:k + size] for k in range(0, len(some), size))


def reached(tile, points, radius):
    """Which of some points on the unit sphere can be closer than `radius` metres to some point of a tile."""
    gap = np.maximum(np.maximum(tile.min(axis=0) - points, points - tile.max(axis=0)), 0)
    chord = 2 * math.sin(min(radius * MARGIN / R_SPHERE, math.pi) / 2)
    return np.flatnonzero(np.square(gap).sum(axis=1) <= chord * chord + 1e-12)


def first_k(dist, ids, k):
    """(row, column) of the k smallest finite entries of each row of a matrix, ties by id."""
    k = min(k, dist.shape[1])
    if not dist.size or not k:
        return np.zeros(0, int), np.zeros(0, int)
    limit = np.partition(dist, k - 1, axis=1)[:, k - 1]
    row, column = np.nonzero((dist <= limit[:, None]) & np.isfinite(dist))
    order = np.lexsort((np.argsort(np.argsort(ids, kind="stable"), kind="stable")[column], dist[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]
