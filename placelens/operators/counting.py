"""Counts of objects inside a box or circle around every probe, without listing the pairs.

Objects are first merged by location and category. Nearby probes and objects meet in bounded blocks. Inside a
block the objects of a category lie in strips of equal number by latitude, each sorted by longitude. A strip
that a probe's shape crosses over its whole height adds the objects between two longitudes by one subtraction;
only objects on the rim of the shape are compared one by one. So a block that holds a third of all objects
costs a probe about the root of their number, and the counts stay exact.
"""

import math
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from placelens.functions.geo import R_SPHERE, geodesic_np, haversine_from_gaps, haversine_np, metre_box
from placelens.operators.grid import MARGIN, blocks

CHUNK = 4_096        # probes compared at once
PAIRS = 2_000_000    # compared at once


class Box:
    """Square of half-side `metres` around the probe, bounds excluded, no wrap-around."""

    def __init__(self, metres):
        self.metres, self.reach = metres, metres * math.sqrt(2)

    def columns(self):
        """Columns that a probe needs besides lat and long."""
        return dict(zip(("_a", "_b", "_c", "_d"), metre_box("lat", "long", self.metres)))

    def block(self, probes, lat, long):
        return _BoxBlock(*(probes[c] for c in ("_a", "_b", "_c", "_d")), lat, long)


class Disc:
    """Circle of `metres` around the probe."""

    def __init__(self, metres, method="haversine"):
        self.reach, self.method = metres, method

    def columns(self):
        return {}

    def block(self, probes, lat, long):
        return _DiscBlock(self, probes["lat"], probes["long"], lat, long)


class _BoxBlock:
    """`x` places the objects of a strip in order."""

    def __init__(self, a, b, c, d, lat, long):
        self.a, self.b, self.c, self.d, self.lat, self.x = a, b, c, d, lat, long

    def holds(self, i, j):
        return (self.a[i] < self.lat[j]) & (self.lat[j] < self.b[i]) & (self.c[i] < self.x[j]) & (self.x[j] < self.d[i])

    def ranges(self, x, low, high):
        """[(probes, from, to, from, to)]: objects of the strip that can be inside, and between them those that surely are."""
        i = np.flatnonzero((self.a < high) & (low < self.b))
        left = np.searchsorted(x, self.c[i], "right")
        right = np.maximum(np.searchsorted(x, self.d[i], "left"), left)
        whole = (self.a[i] < low) & (high < self.b[i])
        return [(i, left, right, np.where(whole, left, right), right)]


class _DiscBlock:
    def __init__(self, disc, lat, long, o_lat, o_long):
        self.disc, self.o = disc, (lat, long, o_lat, o_long)
        middle = long[0] if len(long) else 0.0
        self.x, self.p = ((v - middle + 180) % 360 - 180 for v in (o_long, long))
        slack = MARGIN if disc.method == "geodesic" else 1 + 1e-6
        self.wide, self.narrow = disc.reach * slack / R_SPHERE + 1e-12, disc.reach / slack / R_SPHERE - 1e-12
        self.phi = np.radians(lat)

    def holds(self, i, j):
        lat, long, o_lat, o_long = self.o
        fn = geodesic_np if self.disc.method == "geodesic" else haversine_np
        return fn(lat[i], long[i], o_lat[j], o_long[j]) < self.disc.reach

    def _half(self, phi, at, reach):
        """Half the width of the circle at a latitude, in degrees; negative outside."""
        with np.errstate(all="ignore"):
            s = np.sin(reach / 2) ** 2 - np.sin((at - phi) / 2) ** 2
            w = np.degrees(2 * np.arcsin(np.sqrt(np.clip(s / (np.cos(phi) * np.cos(at)), 0, 1))))
        return np.where(s < 0, -1.0, w)

    def ranges(self, x, low, high):
        low, high = math.radians(low), math.radians(high)
        i = np.flatnonzero((self.phi - self.wide <= high) & (low <= self.phi + self.wide)) if self.wide < 1.5 else np.arange(len(self.phi))
        phi, p = self.phi[i], self.p[i]
        if self.wide < 1.5:   # the width rises to one latitude and falls beyond it
            outer = np.maximum(self._half(phi, low, self.wide), self._half(phi, high, self.wide))
            top = np.arcsin(np.clip(np.sin(phi) / math.cos(self.wide), -1, 1))
            across = (low <= top + 1e-9) & (top - 1e-9 <= high)
            with np.errstate(all="ignore"):
                most = math.sin(self.wide) / np.cos(phi)
            most = np.where(np.abs(phi) + self.wide >= math.pi / 2, 180.0, np.degrees(np.arcsin(np.clip(most, 0, 1))))
            outer = np.where(across, most, outer)
            inner = np.minimum(self._half(phi, low, self.narrow), self._half(phi, high, self.narrow)) if self.narrow > 0 else -np.ones(len(phi))
        else:
            outer, inner = np.full(len(phi), 180.0), -np.ones(len(phi))
        outer, inner = np.where(outer < 0, outer, outer + 1e-10), inner - 1e-10
        found = []
        full = outer >= 179.9   # all of the strip, once
        if full.any():
            k = i[full]
            sure = inner[full] >= 179.9
            n = np.full(len(k), len(x))
            found.append((k, 0 * n, n, np.where(sure, 0, n), n))
        for turn in (0, -360, 360):
            c = p + turn
            use = ~full & (outer >= 0) & (c + outer >= -180) & (c - outer < 180)
            if not use.any():
                continue
            c, o, n = c[use], outer[use], inner[use]
            left, right = np.searchsorted(x, c - o, "left"), np.searchsorted(x, c + o, "right")
            a, b = np.searchsorted(x, c - n, "left"), np.searchsorted(x, c + n, "right")
            found.append((i[use], left, right, np.where(n > 0, a, right), np.where(n > 0, b, right)))
        return found


def box_distance():
    """Lower bound of the great-circle distance from (lat, long) to the box lat_lo..long_hi."""
    def gap(x, lo, hi):
        return F.greatest(F.col(lo) - F.col(x), F.col(x) - F.col(hi), F.lit(0.0))
    dlong = F.least(*[F.greatest(F.col("long_lo") - (F.col("long") + k), F.col("long") + k - F.col("long_hi"), F.lit(0.0))
                      for k in (-360, 0, 360)])
    low_cos = F.least(F.cos(F.radians("lat_lo")), F.cos(F.radians("lat_hi")))
    return haversine_from_gaps(gap("lat", "lat_lo", "lat_hi"), dlong, F.cos(F.radians("lat")) * low_cos)


def merge_locations(objects, by):
    """One row per (location, category) with its number of objects in `n`."""
    return objects.groupBy("o_lat", "o_long", by).agg(F.count("*").alias("n"))


def count_within(probes, objects, shape, by="category", key="venue_id", leaf=200_000, probe_block=20_000):
    """Rows (key, by, n): objects per category inside the shape of each probe; absent if none.

    `probes` has key, lat, long; `objects` has o_lat, o_long and the category column. A block holds about
    `leaf` locations and `probe_block` probes at most; the counts of several blocks are added.
    """
    spots = merge_locations(objects, by).filter(_known("o_lat", "o_long"))
    asks = probes.select(F.col(key).alias("_key"), "lat", "long").filter(_known("lat", "long"))
    asks, spots, keys, _ = blocks(asks.withColumns(shape.columns()), spots.withColumnRenamed(by, "_by"), shape.reach, probe_block, leaf,
                                  spot_columns=("_key", "lat", "long"), object_columns=("o_lat", "o_long", "_by"))
    kinds = asks.schema["_key"].dataType.simpleString(), spots.schema["_by"].dataType.simpleString()

    def count(near, held):
        return _count_block(near, held, shape)

    parts = asks.groupBy(*keys).cogroup(spots.groupBy(*keys)).applyInArrow(count, f"_key {kinds[0]}, _by {kinds[1]}, n bigint")
    return parts.groupBy(F.col("_key").alias(key), F.col("_by").alias(by)).agg(F.sum("n").alias("n"))


def _known(*names):
    return reduce(and_, [F.col(c).isNotNull() & ~F.isnan(c) for c in names])


def _count_block(near, held, shape):
    """Counts of one block as a table (_key, _by, n)."""
    found = []
    if near.num_rows and held.num_rows:
        probes = {c: near[c].to_numpy() for c in near.column_names if pa.types.is_floating(near.schema.field(c).type)}
        codes = held["_by"].combine_chunks().dictionary_encode(null_encoding="encode")
        code = codes.indices.to_numpy()
        lat, long, n = (held[c].to_numpy() for c in ("o_lat", "o_long", "n"))
        order = np.lexsort((lat, code))
        by_lat = np.argsort(probes["lat"], kind="stable")
        bounds = np.flatnonzero(np.diff(code[order], prepend=-1, append=-1))
        for start, end in zip(bounds[:-1], bounds[1:]):
            o = order[start:end]   # one category, by latitude
            for at in range(0, len(by_lat), CHUNK):
                i = by_lat[at:at + CHUNK]
                total = _count_category({c: v[i] for c, v in probes.items()}, lat[o], long[o], n[o], shape)
                some = np.flatnonzero(total)
                found.append((i[some], np.full(len(some), code[o[0]]), total[some]))
    i, c, total = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
    kind = held.schema.field("_by").type
    names = codes.dictionary.take(pa.array(c)) if found else pa.array([], kind)
    return pa.table({"_key": near["_key"].take(pa.array(i)), "_by": names.cast(kind), "n": pa.array(total.astype("int64"))})


def _count_category(probes, lat, long, n, shape):
    """Number of objects, ordered by latitude, inside the shape of each probe."""
    m = len(probes["lat"])
    total = np.zeros(m, dtype="int64")
    if m * len(lat) <= 20_000:
        here = shape.block(probes, lat, long)
        i, j = np.divmod(np.arange(m * len(lat)), len(lat))
        _add(total, here, i, j, n)
        return total
    strip = np.arange(len(lat)) // max(1, math.isqrt(len(lat)))
    here = shape.block(probes, lat, long)
    order = np.lexsort((here.x, strip))
    here = shape.block(probes, lat[order], long[order])
    n = n[order]
    cum = np.concatenate(([0], np.cumsum(n)))
    edges = np.flatnonzero(np.diff(strip, prepend=-1, append=-1))
    for s, e in zip(edges[:-1], edges[1:]):
        for i, left, right, sure, until in here.ranges(here.x[s:e], lat[s], lat[e - 1]):
            until = np.maximum(sure, until)
            np.add.at(total, i, cum[s + until] - cum[s + sure])
            for a, b in ((left, sure), (until, right)):   # the rim on either side
                size = np.maximum(b - a, 0)
                ends = np.cumsum(size)
                cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, PAIRS), "right")
                for f, t in zip(cuts, [*cuts[1:], len(size)]):
                    k = size[f:t]
                    if k.sum():
                        which = np.repeat(np.arange(f, t), k)
                        inside = np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k)
                        _add(total, here, i[which], s + a[which] + inside, n)
    return total


def _add(total, here, i, j, n):
    """Add the objects j that the shapes of the probes i hold."""
    held = here.holds(i, j)
    np.add.at(total, i[held], n[j[held]])
