"""Neighbourhood features of venues: densities, entropy, competition, access, distance to centre."""

from pyspark.sql import functions as F

from placelens.functions.geo import euclidean
from placelens.operators.counting import Box, Disc, count_within
from placelens.operators.nearest import nearest

CENTRE = (40.730610, -73.935242)   # fixed value: city centre


def column_name(category, suffix="_count"):
    return category.lower().replace(" ", "_") + suffix


def _count_columns(categories):
    return [F.sum(F.when(F.col("category") == c, F.col("n")).otherwise(0)).alias(column_name(c)) for c in categories]


def category_counts(counts, probes, categories, key="venue_id"):
    """One column per category with the neighbour count, 0 if none. `counts` is long (key, category, n)."""
    wide = counts.groupBy(key).agg(*_count_columns(categories))
    return probes.select(key).join(wide, key, "left").na.fill(0)


def neighbourhood(counts, probes, categories=(), key="venue_id", category="category"):
    """Counts per listed category, area_density, area_entropy and competition per probe, from the long
    counts (key, category, n) in one aggregation.

    Competition compares the probe's unified category with the neighbours' own ones.
    """
    own = probes.select(key, F.col(category).alias("_own"))
    total = counts.groupBy(key).agg(
        *_count_columns(categories), F.sum("n").alias("_density"), F.sum(F.col("n") * F.log2("n")).alias("_nlogn"),
        F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("_by"))   # one entry per category
    d = F.col("_density")
    same = F.coalesce(F.col("_by")[F.col("_own")], F.lit(0))
    # -sum(f log2 f) with f = n/d equals log2 d - sum(n log2 n)/d
    return own.join(total, key, "left").select(
        key, *[F.coalesce(column_name(c), F.lit(0)).alias(column_name(c)) for c in categories],
        F.coalesce(d, F.lit(0)).alias("area_density"),
        F.coalesce(F.greatest(F.log2(d) - F.col("_nlogn") / d, F.lit(0.0)), F.lit(0.0)).alias("area_entropy"),
        (-same / d).alias("competition"))


def traffic_access(probes, places, key="venue_id", targets=("Bus", "Subway")):
    """Sum over targets of log2(N + 1) / log2(distance to the nearest in degrees), N counted over
    all places. NULL where a distance is 0 or 1, for which the term is undefined."""
    hubs = places.filter(F.col("category").isin(*targets))
    n = hubs.groupBy("category").agg(F.count("*").alias("n"))
    # at most one row per target
    near = nearest(probes, hubs, key=key, by="category").join(F.broadcast(n), "category")
    ok = (F.col("dist") > 0) & (F.col("dist") != 1)
    term = F.when(ok, F.log2(F.col("n") + 1) / F.log2("dist"))
    per = near.groupBy(key).agg(F.sum(term).alias("s"), F.count(term).alias("k"))
    return probes.select(key).join(per, key, "left").select(
        key, F.when(F.col("k") == len(targets), F.col("s")).alias("traffic_access"))


def with_dist_center(df, centre=CENTRE):
    return df.withColumn("dist_center", euclidean("lat", "long", F.lit(centre[0]), F.lit(centre[1])))


def geo_features(probes, places, categories, max_dist=200, centre=CENTRE, key="venue_id", leaf=200_000):
    """All geographic features. `places` has o_lat, o_long, category; the probe itself counts too.

    `categories` is the known list of place categories, so the schema does not depend on the data.
    """
    counts = count_within(probes, places, Box(max_dist), key=key, leaf=leaf)
    out = with_dist_center(probes, centre)
    for part in (neighbourhood(counts, probes, categories, key), traffic_access(probes, places, key)):
        out = out.join(part, key)
    order = [*probes.columns, *[column_name(c) for c in categories], "area_density", "area_entropy", "competition",
             "traffic_access", "dist_center"]
    return out.select(*order)


def count_and_nearest(probes, objects, max_dist, method="haversine", key="venue_id", leaf=200_000):
    """Rows (key, category, count, dist) for every probe and every category: objects closer than
    `max_dist` metres and distance to the nearest one at any range."""
    near = nearest(probes, objects, key=key, by="category", method=method)
    counts = count_within(probes, objects, Disc(max_dist, method), key=key, leaf=leaf)
    return near.join(counts, [key, "category"], "left").select(
        key, "category", F.coalesce("n", F.lit(0)).alias("count"), "dist")
