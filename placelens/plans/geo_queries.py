"""Queries over neighbourhoods, distances, regions and article vectors."""

from pyspark.sql import functions as F

from placelens.functions.geo import distance, distance_weight, rounded
from placelens.functions.hashing import uniform
from placelens.operators import geo_features as gf
from placelens.operators import relational as rel
from placelens.operators import text_features as tf
from placelens.operators import words
from placelens.operators.counting import Box, count_within
from placelens.operators.grid import radius_join, rectangle_join
from placelens.operators.nearest import closest_city, nearest
from placelens.plans import views as v
from placelens.plans.registry import query
from placelens.plans.venue_queries import bars_with_region, r6
from placelens.session import cut_lineage

PLACE_CATEGORIES = [c for c in v.CATEGORIES if c not in rel.BUS_CATEGORIES] + ["Bus"]


def probes(spark, sf, spread_rows=False):
    """Bar-like venues with the unified category."""
    bars = v.venues(spark, sf, spread_rows).filter(rel.matches_category())
    return rel.unify_category(bars.select("venue_id", "lat", "long", "category"))


def places(spark, sf, spread_rows=False):
    """All venues as neighbours, bus stops merged into one category."""
    all_places = rel.recode(v.venues(spark, sf, spread_rows), "category", {"Bus": rel.BUS_CATEGORIES})
    return all_places.select(F.col("venue_id").alias("place_id"), F.col("lat").alias("o_lat"),
                             F.col("long").alias("o_long"), "category")


def probe_points(spark, sf):
    return probes(spark, sf, spread_rows=True).select("venue_id", "lat", "long")


def counts(spark, sf):
    return count_within(probes(spark, sf), places(spark, sf), Box(200))


def hubs(spark, sf, category):
    return places(spark, sf).filter(F.col("category") == category)


def article_points(spark, sf):
    return v.articles(spark, sf).select("article_id", F.col("lat").alias("o_lat"), F.col("long").alias("o_long"))


def long_vectors(features, *keep):
    return features.select("venue_id", *keep, F.posexplode("embedding").alias("dim", "val")).select(
        "venue_id", *keep, "dim", r6("val").alias("val"))


@query()
def rect_neighbours(spark, sf):
    pairs = rectangle_join(probe_points(spark, sf), places(spark, sf, spread_rows=True).drop("category"), 200)
    return pairs.select("venue_id", "place_id")


@query("radius_join")
def radius_join_query(spark, sf):
    pairs = radius_join(probe_points(spark, sf), article_points(spark, sf), 500)
    return pairs.select("venue_id", "article_id", rounded("dist", 6).alias("dist"))


@query()
def dist_features(spark, sf):
    out = gf.count_and_nearest(probes(spark, sf), places(spark, sf), 500)
    return out.select("venue_id", "category", "count", r6("dist").alias("dist"))


@query("closest_city")
def closest_city_query(spark, sf):
    out = closest_city(v.venues(spark, sf), v.cities(spark, sf))
    return out.select("venue_id", "name", r6("dist").alias("dist"))


@query()
def nearest_bus(spark, sf):
    return nearest(probes(spark, sf), hubs(spark, sf, "Bus")).select("venue_id", F.round("dist", 9).alias("dist"))


@query()
def nearest_subway(spark, sf):
    return nearest(probes(spark, sf), hubs(spark, sf, "Subway")).select("venue_id", F.round("dist", 9).alias("dist"))


@query()
def category_counts(spark, sf):
    return gf.category_counts(counts(spark, sf), probes(spark, sf), PLACE_CATEGORIES)


@query()
def area_density(spark, sf):
    return gf.neighbourhood(counts(spark, sf), probes(spark, sf)).select("venue_id", "area_density")


@query()
def area_entropy(spark, sf):
    return gf.neighbourhood(counts(spark, sf), probes(spark, sf)).select("venue_id", r6("area_entropy").alias("area_entropy"))


@query()
def competition(spark, sf):
    return gf.neighbourhood(counts(spark, sf), probes(spark, sf)).select("venue_id", r6("competition").alias("competition"))


@query()
def traffic_access(spark, sf):
    out = gf.traffic_access(probes(spark, sf), places(spark, sf))
    return out.select("venue_id", r6("traffic_access").alias("traffic_access"))


@query()
def dist_center(spark, sf):
    return gf.with_dist_center(probes(spark, sf)).select("venue_id", r6("dist_center").alias("dist_center"))


@query()
def geo_features(spark, sf):
    out = gf.geo_features(probes(spark, sf), places(spark, sf), PLACE_CATEGORIES)
    real = ["area_entropy", "competition", "traffic_access", "dist_center"]
    return out.select("venue_id", "org_category", "area_density", *[r6(c).alias(c) for c in real])


@query()
def great_circle(spark, sf):
    """Great-circle distance between two points derived from every customer."""
    c = v.read(spark, sf, "customer").select("c_custkey")
    ends = {f"{k}{i}": uniform("c_custkey", f"{k}{i}") * (170.0 if k == "lat" else 360.0) - (85.0 if k == "lat" else 180.0)
            for k in ("lat", "long") for i in (1, 2)}
    out = c.withColumns(ends)
    return out.select("c_custkey", F.round(distance("haversine", "lat1", "long1", "lat2", "long2"), 3).alias("dist"))


@query()
def geodesic_far(spark, sf):
    """Ellipsoidal distance between two points anywhere, derived from every customer; near-antipodal ones are tested apart."""
    c = v.read(spark, sf, "customer").select("c_custkey")
    ends = {f"{k}{i}": uniform("c_custkey", f"{k}{i}") * (170.0 if k == "lat" else 360.0) - (85.0 if k == "lat" else 180.0)
            for k in ("lat", "long") for i in (1, 2)}
    out = c.withColumns(ends).where(distance("haversine", "lat1", "long1", "lat2", "long2") < 19_700_000)
    return out.select("c_custkey", F.round(distance("geodesic", "lat1", "long1", "lat2", "long2"), 2).alias("dist"))


@query("geodesic_distance")
def geodesic_query(spark, sf):
    pairs = radius_join(probe_points(spark, sf), article_points(spark, sf), 500, method="geodesic")
    return pairs.select("venue_id", "article_id", rounded("dist", 4).alias("dist"))   # tenths of a millimetre


@query()
def distance_weights(spark, sf):
    pairs = radius_join(probe_points(spark, sf), article_points(spark, sf), 500)
    kinds = {f"w_{k}": distance_weight("dist", 500, k) for k in ("linear", "cubic", "tanh")}
    weighed = pairs.select("venue_id", "article_id", *[c.alias(n) for n, c in kinds.items()])
    return weighed.select("venue_id", "article_id", *[rounded(n, 6).alias(n) for n in kinds])


@query()
def articles_with_vectors(spark, sf):
    docs = v.read(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), "lang")
    vecs = v.read(spark, sf, "embeddings").select(F.col("vec_id").alias("article_id"), "embedding")
    joined = tf.with_vectors(docs, vecs)
    return joined.select("article_id", "lang", F.posexplode("embedding").alias("dim", "val")).select(
        "article_id", "lang", "dim", r6(F.col("val").cast("double")).alias("val"))


@query()
def text_features_mean(spark, sf):
    return long_vectors(tf.text_features(probes(spark, sf), v.articles(spark, sf), 2000), "article_count")


@query()
def text_features_sum(spark, sf):
    return long_vectors(tf.text_features(probes(spark, sf), v.articles(spark, sf), 1000, weight="cubic", mean=False))


@query()
def k_closest_articles(spark, sf):
    venues = probes(spark, sf).select("venue_id", "lat", "long")
    return venues.join(tf.k_in_range(venues, article_points(spark, sf), 2000, 10), ["lat", "long"]).select(
        "venue_id", "article_id", r6("dist").alias("dist"))


@query()
def text_features_closest(spark, sf):
    return long_vectors(tf.text_features(probes(spark, sf), v.articles(spark, sf), 2000, k=5, weight="linear"), "article_count")


@query()
def article_count_stats(spark, sf):
    return tf.article_count_stats(tf.text_features(probes(spark, sf), v.articles(spark, sf), 500))


@query()
def out_of_region_features(spark, sf):
    outside = rel.null_rows(bars_with_region(spark, sf), ["region"]).select("venue_id", "lat", "long")
    return long_vectors(tf.text_features(outside, v.articles(spark, sf), 2000))


@query()
def combine_features(spark, sf):
    """Text and geographic features of the same venues side by side."""
    p = probes(spark, sf)
    geo = gf.with_dist_center(gf.neighbourhood(counts(spark, sf), p).join(p.select("venue_id", "lat", "long"), "venue_id"))
    text = tf.text_features(p, v.articles(spark, sf), 500).filter("article_count > 0").select("venue_id", "article_count")
    out = rel.combine_features(text, geo.select("venue_id", "area_density", r6("dist_center").alias("dist_center")))
    return out


@query()
def mean_token_length(spark, sf):
    return words.mean_token_length(v.read(spark, sf, "documents")).select(r6("mean_tokens").alias("mean_tokens"))


@query()
def tfidf_long(spark, sf):
    docs = v.articles(spark, sf).select("article_id", "text")
    return words.tfidf_long(docs).select("article_id", "word", "tf", r6("tfidf").alias("tfidf"))


def word_table(spark, sf):
    """Word values of all articles, stored as the stage that the venue features read."""
    return cut_lineage(words.tfidf_long(v.articles(spark, sf, spread_text=True).select("article_id", "text")))


@query()
def venue_tfidf(spark, sf):
    """Weighted word means per venue (3,400 m), reported per venue: words, total and largest value."""
    per_block, _ = words.venue_words(probes(spark, sf), v.articles(spark, sf), word_table(spark, sf), summary=True)
    return per_block.groupBy("venue_id").agg(F.sum("words").alias("words"), F.round(F.sum("total"), 4).alias("total"),
                                             F.round(F.max("largest"), 6).alias("largest"))


@query()
def venue_tfidf_words(spark, sf):
    """The long form: every venue and word within 400 m."""
    found = words.venue_words(probes(spark, sf), v.articles(spark, sf), word_table(spark, sf), max_dist=400, weight="linear", mean=False)
    return words.venue_words_long(*found).withColumn("value", r6("value"))
