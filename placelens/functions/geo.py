"""Distances, boxes and distance weights as Columns."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

R_BOX = 6371000.0      # fixed value: radius behind the metre-to-degree box
R_SPHERE = 6371009.0   # fixed value: mean earth radius of great-circle distances
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563   # fixed values: WGS-84 ellipsoid


def _c(x):
    return F.col(x) if isinstance(x, str) else (x if hasattr(x, "_jc") or hasattr(x, "cast") else F.lit(float(x)))


def great_circle(lat1, long1, lat2, long2):
    """Haversine distance in metres."""
    lat1, long1, lat2, long2 = map(_c, (lat1, long1, lat2, long2))
    return haversine_from_gaps(lat2 - lat1, long2 - long1, F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)))


def haversine_from_gaps(dlat, dlong, cos_product):
    """Haversine distance from coordinate differences; with lower bounds in, a lower bound out."""
    a = F.pow(F.sin(F.radians(dlat) / 2), 2) + cos_product * F.pow(F.sin(F.radians(dlong) / 2), 2)
    return 2 * R_SPHERE * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def euclidean(lat1, long1, lat2, long2):
    """Planar distance in degrees."""
    lat1, long1, lat2, long2 = map(_c, (lat1, long1, lat2, long2))
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(long1 - long2, 2))


def metre_box(lat, long, metres):
    """(lat_lo, lat_hi, long_lo, long_hi) of the square of half-side `metres` around a point."""
    lat, long = _c(lat), _c(long)
    dlat = F.lit(float(np.degrees(metres / R_BOX)))
    dlong = dlat / F.cos(F.radians(lat))
    return lat - dlat, lat + dlat, long - dlong, long + dlong


def haversine_np(lat1, long1, lat2, long2):
    """great_circle for numpy arrays that broadcast against each other."""
    h = (np.sin(np.radians(lat2 - lat1) / 2) ** 2
         + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(long2 - long1) / 2) ** 2)
    return 2 * R_SPHERE * np.arcsin(np.sqrt(np.minimum(h, 1)))


def sphere_np(lat, long):
    """Points on the unit sphere, one row each; chords between them rise with great-circle distances."""
    la, lo = np.radians(np.asarray(lat, dtype=float)), np.radians(np.asarray(long, dtype=float))
    return np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])


def geodesic_np(lat1, long1, lat2, long2):
    """Ellipsoidal distance in metres: Vincenty's inverse formula (1975), vectorised.

    Near-antipodal pairs, for which that iteration does not settle, are solved for the azimuth instead.
    """
    p1, l1, p2, l2 = map(np.radians, (lat1, long1, lat2, long2))
    a, f = WGS84_A, WGS84_F
    b = a * (1 - f)
    u1, u2 = np.arctan((1 - f) * np.tan(p1)), np.arctan((1 - f) * np.tan(p2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    diff = (l2 - l1 + np.pi) % (2 * np.pi) - np.pi
    lam = diff
    with np.errstate(all="ignore"):
        for _ in range(60):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, cu1 * cu2 * sl / ss)
            c2a = 1 - sa ** 2
            c2m = np.where(c2a == 0, 0.0, cs - 2 * su1 * su2 / c2a)
            c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
            new = diff + (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m ** 2 - 1)))
            settled = np.abs(new - lam) < 1e-14
            lam = new
            if np.all(settled | np.isnan(new)):
                break
        k = c2a * (a * a - b * b) / (b * b)
        big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        corr = small * ss * (c2m + small / 4 * (cs * (2 * c2m ** 2 - 1)
                             - small / 6 * c2m * (4 * ss ** 2 - 3) * (4 * c2m ** 2 - 3)))
        out = b * big * (sigma - corr)
    missing = np.isnan(p1 + l1 + p2 + l2)
    out, missing = np.array(out, float), np.broadcast_to(missing, np.shape(out))
    rest = ~(settled & (np.abs(lam) <= np.pi) & ~np.isnan(out)) & ~missing
    if rest.any():
        out[rest] = _antipodal(*(np.broadcast_to(v, out.shape)[rest] for v in (u1, u2, diff)))
    return np.where(missing, np.nan, out)[()]


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(40)


def _antipodal(u1, u2, diff):
    """Shortest distances from reduced latitudes and the difference of longitude, by the azimuth at the first point.

    With the first point as the one farther from the equator, in the south, the longitude that a geodesic of azimuth alpha
    gains until it meets the second latitude rises with alpha, also at the antipode (Karney, 2013). So Newton's steps on
    alpha, halved into the bracket where they would leave it, end at the one solution. Integrals along the geodesic are taken by
    Gauss-Legendre quadrature, exact to rounding.
    """
    f, b = WGS84_F, WGS84_A * (1 - WGS84_F)
    e2 = f * (2 - f) / (1 - f) ** 2
    swap = np.abs(u1) < np.abs(u2)
    u1, u2 = np.where(swap, u2, u1), np.where(swap, u1, u2)
    south = np.where(u1 > 0, -1.0, 1.0)
    u1, u2, want = np.minimum(u1 * south, -1e-200), u2 * south, np.abs(diff)
    s1, c1, s2, c2 = np.sin(u1), np.maximum(np.cos(u1), 1e-200), np.sin(u2), np.maximum(np.cos(u2), 1e-200)

    def line(alpha):
        """(longitude gained, its rise with alpha, distance) up to the second latitude."""
        sa, ca = np.sin(alpha), np.cos(alpha)
        sin0, cos0 = sa * c1, np.hypot(ca, sa * s1)
        sa2 = sin0 / c2
        ca2 = np.sqrt(np.maximum((ca * c1) ** 2 + (c2 - c1) * (c2 + c1), 0)) / c2
        sigma1, sigma2 = np.arctan2(s1, ca * c1), np.arctan2(s2, ca2 * c2)
        omega = np.arctan2(sin0 * s2, ca2 * c2) - np.arctan2(sin0 * s1, ca * c1)
        half = (sigma2 - sigma1) / 2
        root = np.sqrt(1 + e2 * cos0[:, None] ** 2 * np.sin(sigma1[:, None] + half[:, None] * (1 + _NODES)) ** 2)
        along = half * (root @ _WEIGHTS)
        gained = omega - f * sin0 * half * (((2 - f) / (1 + (1 - f) * root)) @ _WEIGHTS)
        bend = half * ((root - 1 / root) @ _WEIGHTS)                         # the difference of the two integrals of the reduced length
        k1, k2 = (np.sqrt(1 + e2 * cos0 ** 2 * np.sin(s) ** 2) for s in (sigma1, sigma2))
        reduced = (k2 * np.cos(sigma1) * np.sin(sigma2) - k1 * np.sin(sigma1) * np.cos(sigma2)
                   - np.cos(sigma1) * np.cos(sigma2) * bend)
        with np.errstate(all="ignore"):
            rise = reduced * (1 - f) / (ca2 * c2)
        return gained, rise, b * along

    low, high = np.zeros(len(u1)), np.full(len(u1), np.pi)
    alpha = np.full(len(u1), np.pi / 2)
    for _ in range(200):
        gained, rise, _ = line(alpha)
        high, low = np.where(gained >= want, alpha, high), np.where(gained < want, alpha, low)
        with np.errstate(all="ignore"):
            step = alpha - (gained - want) / rise
        step = np.where((step > low) & (step < high), step, (low + high) / 2)
        if np.all((np.abs(step - alpha) <= 1e-16 * np.pi) | (high - low <= 4e-16)):
            break
        alpha = step
    return line(alpha)[2]


def _geodesic(lat1: pd.Series, long1: pd.Series, lat2: pd.Series, long2: pd.Series) -> pd.Series:
    """geodesic_np as a Column function (Arrow batches)."""
    return pd.Series(geodesic_np(*(x.to_numpy(dtype=float) for x in (lat1, long1, lat2, long2))))


geodesic = F.pandas_udf(_geodesic, T.DoubleType())
#: The same function, of which the optimizer makes no second copy where a filter and a result read one distance.
geodesic_once = F.pandas_udf(_geodesic, T.DoubleType()).asNondeterministic()


def distance(method, lat1, long1, lat2, long2):
    """`method` is haversine, geodesic (metres) or degrees (planar)."""
    pick = {"haversine": great_circle, "geodesic": geodesic, "degrees": euclidean}
    return pick[method](*map(_c, (lat1, long1, lat2, long2)))


def rounded(x, digits):
    """F.round of a double Column, the same number to the last bit, without decimal arithmetic but for numbers near a tie."""
    x = _c(x)
    scaled = x * F.lit(10.0 ** digits)
    clear = (F.abs(scaled) < 1e12) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(clear, F.floor(scaled + 0.5) / F.lit(10.0 ** digits)).otherwise(F.round(x, digits))


def distance_weight(dist, radius, kind="tanh"):
    """Weight of an object at `dist` within `radius`.

    `tanh` keeps the established name of the curve 1 - exp(-(w + 0.3)^6), w = 1 - dist/radius.
    """
    base = 1 - _c(dist) / F.lit(float(radius))
    if kind is None or kind == "None":
        return F.lit(1.0)
    if kind == "linear":
        return base
    if kind == "cubic":
        return F.pow(base, 3)
    if kind == "tanh":
        return 1 - F.exp(-F.pow(base + 0.3, 6))
    raise ValueError(f"unknown weight {kind!r}")


def weight_np(dist, radius, kind="tanh", power=np.power):
    """distance_weight for numpy arrays; objects at or beyond the radius weigh 0."""
    base = 1 - dist / radius
    if kind is None or kind == "None":
        w = np.ones_like(base)
    else:
        w = {"linear": lambda b: b, "cubic": lambda b: power(b, 3), "tanh": lambda b: 1 - np.exp(-power(b + 0.3, 6))}[kind](base)
    return np.where(dist < radius, w, 0.0)
