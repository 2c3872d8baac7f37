"""Grid joins, counts, nearest and polygons against brute force in numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placelens.functions.geo import geodesic_np, haversine_np, rounded
from placelens.operators import grid, text_features as tf, words
from placelens.operators.counting import Box, Disc, count_within
from placelens.operators.nearest import nearest
from placelens.operators.regions import point_in_polygon, polygons_from_rings

# (lat range, long range, radius): a city, both sides of the antimeridian, both poles, a wide area
AREAS = [((40.68, 40.76), (-74.02, -73.92), 500), ((-1, 1), (178.5, 181.5), 30_000), ((88.5, 90), (-180, 180), 40_000),
         ((-90, -89), (-180, 180), 30_000), ((-60, 75), (-180, 180), 300_000)]


def points(n, lats, longs, seed, prefix=""):
    rng = np.random.default_rng(seed)
    lon = (rng.uniform(*longs, n) + 180) % 360 - 180
    return pd.DataFrame({"id": np.arange(n), f"{prefix}lat": rng.uniform(*lats, n), f"{prefix}long": lon})


@pytest.mark.parametrize("lats, longs, radius", AREAS)
@pytest.mark.parametrize("cut", [20_000, 5])
def test_radius_join_equals_brute_force(spark, lats, longs, radius, cut):
    a, b = points(250, lats, longs, 1), points(300, lats, longs, 2, "o_").rename(columns={"id": "oid"})
    dist = haversine_np(a.lat.values[:, None], a.long.values[:, None], b.o_lat.values[None], b.o_long.values[None])
    want = {(i, j) for i, j in zip(*np.nonzero(dist < radius))}
    got = grid.radius_join(spark.createDataFrame(a), spark.createDataFrame(b), radius, max_cell=cut).select("id", "oid").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("lats, longs, half", [((40.68, 40.76), (-74.02, -73.92), 200), ((-60, 75), (-170, 170), 300_000)])
@pytest.mark.parametrize("cut", [4_000, 5])
def test_rectangle_join_equals_brute_force(spark, lats, longs, half, cut):
    a, b = points(250, lats, longs, 1), points(300, lats, longs, 2, "o_").rename(columns={"id": "oid"})
    d, la, lo = np.degrees(half / 6371000.0), a.lat.values[:, None], a.long.values[:, None]
    inside = (np.abs(b.o_lat.values - la) < d) & (np.abs(b.o_long.values - lo) < d / np.cos(np.radians(la)))
    got = grid.rectangle_join(spark.createDataFrame(a), spark.createDataFrame(b), half, max_cell=cut).select("id", "oid").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == set(zip(*np.nonzero(inside)))


def test_pair_lists_have_tasks_by_pairs_and_distances_once(spark, monkeypatch):
    monkeypatch.setattr(grid, "LEAST_PAIRS", 1_000)
    monkeypatch.setattr(grid, "TASK_PAIRS", 1_000)
    a, b = points(250, (40.70, 40.701), (-74.0, -73.999), 1), points(300, (40.70, 40.701), (-74.0, -73.999), 2, "o_").rename(columns={"id": "oid"})
    for join in (lambda x, y: grid.radius_join(x, y, 500), lambda x, y: grid.radius_join(x, y, 500, "geodesic"), lambda x, y: grid.rectangle_join(x, y, 200)):
        pairs = join(spark.createDataFrame(a), spark.createDataFrame(b))
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert pairs.rdd.getNumPartitions() >= 250 * 300 // 1_000 and "SortMergeJoin" in plan
        assert plan.count("ArrowEvalPython") <= 1 and pairs.count() == 250 * 300


@pytest.mark.parametrize("digits", [4, 6])
def test_rounded_equals_round_to_the_last_bit(spark, digits):
    rng = np.random.default_rng(1)
    ties = np.round(rng.uniform(-500, 500, 2_000), digits + 1)
    ties = np.where(rng.random(2_000) < 0.5, np.floor(ties * 10.0 ** digits) / 10.0 ** digits + 0.5 / 10.0 ** digits, ties)
    x = [*rng.uniform(-500, 500, 2_000), *ties, *rng.uniform(-1, 1, 500) * 10.0 ** -digits, 0.0, -0.0, 1e15 + 0.3, -1e300, None,
         float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([(v if v is None else float(v),) for v in x], "x double")
    for got, want in df.select(rounded("x", digits), F.round("x", digits)).collect():
        assert repr(got) == repr(want)


@pytest.mark.parametrize("shape, leaf", [("box", 2_000), ("box", 3), ("disc", 2_000), ("disc", 3), ("geodesic", 3)])
def test_counts_equal_brute_force_also_in_hot_cells(spark, shape, leaf):
    rng = np.random.default_rng(3)
    a = points(120, (40.70, 40.72), (-74.0, -73.98), 4)
    b = points(900, (40.70, 40.72), (-74.0, -73.98), 5, "o_").drop(columns="id")
    b.loc[:299, ["o_lat", "o_long"]] = [40.71, -73.99]          # a third at one spot
    b.loc[300:599, "o_lat"] = 40.7105 + rng.normal(0, 1e-5, 300)  # a third within metres
    b.loc[300:599, "o_long"] = -73.9895 + rng.normal(0, 1e-5, 300)
    b["category"] = rng.choice(["x", "y"], len(b))
    r = 200
    la, lo = a.lat.values[:, None], a.long.values[:, None]
    if shape == "box":
        d = np.degrees(r / 6371000.0)
        inside = (np.abs(b.o_lat.values - la) < d) & (np.abs(b.o_long.values - lo) < d / np.cos(np.radians(la)))
    else:
        fn = geodesic_np if shape == "geodesic" else haversine_np
        inside = fn(*np.broadcast_arrays(la, lo, b.o_lat.values[None], b.o_long.values[None])) < r
    want = {(i, c): int(n) for i in range(len(a)) for c in "xy" if (n := (inside[i] & (b.category == c).values).sum())}
    kind = Box(r) if shape == "box" else Disc(r, "geodesic" if shape == "geodesic" else "haversine")
    got = count_within(spark.createDataFrame(a), spark.createDataFrame(b), kind, key="id", leaf=leaf).collect()
    assert {(x.id, x.category): x.n for x in got} == want and len(got) == len(want)


@pytest.mark.parametrize("lats, longs, radius", AREAS[1:])
@pytest.mark.parametrize("leaf", [1, 2_000])
def test_disc_counts_at_poles_and_antimeridian(spark, lats, longs, radius, leaf):
    a, b = points(40, lats, longs, 6), points(150, lats, longs, 7, "o_").drop(columns="id").assign(category="x")
    inside = haversine_np(a.lat.values[:, None], a.long.values[:, None], b.o_lat.values[None], b.o_long.values[None]) < radius
    got = count_within(spark.createDataFrame(a), spark.createDataFrame(b), Disc(radius), key="id", leaf=leaf).collect()
    assert {x.id: x.n for x in got} == {i: int(n) for i, n in enumerate(inside.sum(axis=1)) if n}


def test_disc_at_a_pole_is_not_covered_by_a_wide_part(spark):
    a = spark.createDataFrame([(1, 89.998, 180.0)], "id int, lat double, long double")
    b = spark.createDataFrame([(89.997, -179.9, "x"), (89.997, 179.9, "x"), (89.997, 0.0, "x")], "o_lat double, o_long double, category string")
    for leaf in (1, 2_000):
        assert [r.n for r in count_within(a, b, Disc(500), key="id", leaf=leaf).collect()] == [2]


@pytest.mark.parametrize("shape", [Box(200), Disc(200)])
def test_counts_of_a_dense_cell_need_no_stage_tables(spark, shape):
    from placelens import session
    a = points(300, (40.70, 40.7025), (-74.0, -73.9975), 4)
    b = points(12_000, (40.70, 40.7015), (-74.0, -73.9985), 5, "o_").drop(columns="id").assign(category=None).astype({"category": "object"})
    b.loc[:4_999, "category"] = "x"
    a, b = pd.concat([a, a.iloc[:1]]), pd.concat([b, b.iloc[:50]])        # a probe and 50 objects twice
    la, lo = a.lat.values[:, None], a.long.values[:, None]
    d = np.degrees(200 / 6371000.0)
    inside = (np.abs(b.o_lat.values - la) < d) & (np.abs(b.o_long.values - lo) < d / np.cos(np.radians(la))) if isinstance(shape, Box) else \
        haversine_np(la, lo, b.o_lat.values[None], b.o_long.values[None]) < 200
    want = pd.DataFrame({"id": a.id.values, "x": inside[:, (b.category == "x").values].sum(axis=1), "none": inside[:, b.category.isna().values].sum(axis=1)})
    want = want.groupby("id").sum()
    stages = len(session._STAGES)
    schema = "o_lat double, o_long double, category string"
    out = count_within(spark.createDataFrame(a), spark.createDataFrame(b.values.tolist(), schema), shape, key="id")
    got = {(r.id, r.category): r.n for r in out.collect()}
    assert len(session._STAGES) == stages
    assert got == {(i, c): int(r[k]) for i, r in want.iterrows() for c, k in (("x", "x"), (None, "none")) if r[k]}


@pytest.mark.parametrize("method", ["degrees", "haversine", "geodesic"])
@pytest.mark.parametrize("lats, longs", [((40.68, 40.76), (-74.02, -73.92)), ((-80, 85), (-180, 180)), ((-2, 2), (175, 185))])
def test_nearest_equals_brute_force(spark, method, lats, longs):
    a, b = points(80, lats, longs, 6), points(500, lats, longs, 7, "o_").rename(columns={"id": "oid"})
    b.loc[:150, ["o_lat", "o_long"]] = b.loc[0, ["o_lat", "o_long"]].values + np.random.default_rng(1).normal(0, 1e-4, (151, 2))
    la, lo = a.lat.values[:, None], a.long.values[:, None]
    args = np.broadcast_arrays(la, lo, b.o_lat.values[None], b.o_long.values[None])
    d = np.hypot(args[0] - args[2], args[1] - args[3]) if method == "degrees" else \
        {"haversine": haversine_np, "geodesic": geodesic_np}[method](*args)
    got = nearest(spark.createDataFrame(a), spark.createDataFrame(b), key="id", method=method, label="oid", leaf=8).toPandas().sort_values("id")
    assert len(got) == len(a)
    np.testing.assert_allclose(got.dist.values, d.min(axis=1), rtol=1e-8)
    assert (got.oid.values == d.argmin(axis=1)).all()


@pytest.mark.parametrize("method", ["degrees", "haversine"])
def test_nearest_per_category_in_cut_blocks_without_windows_over_probes(spark, method):
    rng = np.random.default_rng(8)
    a, b = points(400, (40.70, 40.72), (-74.0, -73.98), 4), points(1_500, (40.70, 40.72), (-74.0, -73.98), 5, "o_").drop(columns="id")
    a.loc[:99, ["lat", "long"]] = [40.71, -73.99]                # a quarter of the probes at one spot
    a.loc[100:199, "lat"] = 40.7105 + rng.normal(0, 1e-6, 100)   # a quarter within centimetres
    b.loc[:499, "o_lat"] = 40.7105 + rng.normal(0, 1e-6, 500)
    b["category"] = rng.choice(["x", "y", "far"], len(b), p=[0.6, 0.399, 0.001])
    b.loc[b.category == "far", "o_lat"] += 5
    b.loc[:20, "category"] = None
    d = np.hypot(a.lat.values[:, None] - b.o_lat.values, a.long.values[:, None] - b.o_long.values) if method == "degrees" else \
        haversine_np(a.lat.values[:, None], a.long.values[:, None], b.o_lat.values[None], b.o_long.values[None])
    want = {(i, c): d[i, (b.category == c).values].min() for i in range(len(a)) for c in ("x", "y", "far")}
    probes, objects = spark.createDataFrame(a), spark.createDataFrame(b.values.tolist(), "o_lat double, o_long double, category string")
    out = nearest(probes, objects, key="id", by="category", method=method)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    small = nearest(probes, objects, key="id", by="category", method=method, leaf=16, probe_leaf=8, probe_block=20, object_block=60)
    for found in (out.collect(), small.collect()):
        got = {(r.id, r.category): r.dist for r in found}
        assert len(found) == len(got) and got.keys() == want.keys()
        np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-7, atol=1e-9)


def test_geodesic_matches_published_pairs(spark):
    # one degree along the equator and along the meridian
    assert abs(float(geodesic_np(0.0, 0.0, 0.0, 1.0)) - 111319.4908) < 1e-3
    assert abs(float(geodesic_np(0.0, 0.0, 1.0, 0.0)) - 110574.3886) < 1e-3
    assert float(geodesic_np(10.0, 20.0, 10.0, 20.0)) == 0
    # near-antipodal (19,936,288.579 m): the documented fallback, a sphere, is within 0.1 %
    assert abs(float(geodesic_np(0.0, 0.0, 0.5, 179.7)) / 19936288.579 - 1) < 1e-3
    from placelens.functions.geo import geodesic
    row = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (None, 0.0, 0.0, 1.0)], "a double, b double, c double, d double").select(
        geodesic("a", "b", "c", "d").alias("m")).collect()
    assert abs(row[0].m - 111319.4908) < 1e-3 and row[1].m is None


def test_polygon_edges_vertices_holes_and_order(spark):
    rings = [(0, "outer", 0, 0, [(0., 0.), (10., 0.), (10., 10.), (0., 10.)]), (0, "outer", 0, 1, [(4., 4.), (6., 4.), (6., 6.), (4., 6.)]),
             (1, "later", 0, 0, [(8., 8.), (12., 8.), (12., 12.), (8., 12.)])]
    pts = [(1, 2., 2.), (2, 5., 5.), (3, 0., 5.), (4, 0., 0.), (5, 9., 9.), (6, 20., 20.), (7, 11., 11.), (8, 4., 5.)]
    df = spark.createDataFrame([(i, y, x) for i, x, y in pts], "venue_id int, lat double, long double")
    got = {r.venue_id: r.region for r in point_in_polygon(df, polygons_from_rings(spark, rings)).collect()}
    assert got == {1: "outer", 2: None, 3: None, 4: None, 5: "later", 6: None, 7: "later", 8: None}


def random_articles(spark, n=200, dims=5):
    a = points(n, (40.70, 40.74), (-74.0, -73.96), 8).rename(columns={"id": "article_id"})
    a.loc[:60, ["lat", "long"]] = [40.72, -73.98]
    a["embedding"] = list(np.random.default_rng(9).normal(size=(n, dims)).astype("float32"))
    v = points(60, (40.70, 40.74), (-74.0, -73.96), 10).rename(columns={"id": "venue_id"})
    v.loc[:20, ["lat", "long"]] = [40.7201, -73.98]
    v.loc[59, ["lat", "long"]] = [41.5, -73.0]     # nothing near
    return a, v


@pytest.mark.parametrize("method, weight, mean", [("haversine", "tanh", True), ("geodesic", "linear", False), ("haversine", None, True)])
@pytest.mark.parametrize("block", [1_000, 7])
def test_text_features_equal_brute_force(spark, method, weight, mean, block):
    a, v = random_articles(spark)
    d = {"haversine": haversine_np, "geodesic": geodesic_np}[method](*np.broadcast_arrays(
        v.lat.values[:, None], v.long.values[:, None], a.lat.values[None], a.long.values[None]))
    b = 1 - d / 1500
    w = np.where(d < 1500, {"tanh": 1 - np.exp(-(b + .3) ** 6), "linear": b, None: np.ones_like(b)}[weight], 0)
    count = (d < 1500).sum(axis=1)
    want = w @ np.stack(a.embedding)
    if mean:
        want = want / np.maximum(count, 1)[:, None]
    got = tf.text_features(spark.createDataFrame(v), spark.createDataFrame(a), 1500, weight, mean, method=method, spot_block=block,
                           article_block=block).toPandas().sort_values("venue_id")
    assert (got.article_count.values == count).all()
    for i, e in enumerate(got.embedding):
        assert (e is None) == (count[i] == 0)
        if e is not None:
            np.testing.assert_allclose(np.array(e), want[i], atol=1e-6)


def test_k_closest_keeps_nearest_or_farthest(spark):
    a, v = random_articles(spark)
    got = tf.text_features(spark.createDataFrame(v), spark.createDataFrame(a), 1500, "linear", k=3)
    assert got.agg(F.max("article_count")).first()[0] == 3
    pairs = spark.createDataFrame([(1, i, float(i)) for i in range(10)], "venue_id int, article_id int, dist double")
    assert {r.article_id for r in tf.k_closest(pairs, 3).collect()} == {0, 1, 2}
    assert {r.article_id for r in tf.k_closest(pairs, 3, keep="farthest").collect()} == {7, 8, 9}


@pytest.mark.parametrize("blocks", [(500, 5_000, 4_096), (7, 9, 10)])
def test_venue_words_equal_brute_force(spark, blocks):
    a, v = random_articles(spark)
    rng = np.random.default_rng(11)
    rows = [(int(i), f"w{w}", float(rng.uniform(.1, 2))) for i in a.article_id for w in rng.choice(60, 6, replace=False) if i % 7]
    table = spark.createDataFrame(rows, "article_id bigint, word string, tfidf double")
    d = haversine_np(v.lat.values[:, None], v.long.values[:, None], a.lat.values[None], a.long.values[None])
    w = np.where(d < 1500, (1 - d / 1500) ** 3, 0)
    want = {}
    for i, word, x in rows:
        for j in np.flatnonzero(w[:, i]):
            want[j, word] = want.get((j, word), 0) + w[j, i] * x / (d[j] < 1500).sum()
    found = words.venue_words(spark.createDataFrame(v), spark.createDataFrame(a), table, 1500, "cubic", spot_block=blocks[0],
                              article_block=blocks[1], width=blocks[2])
    got = {(r.venue_id, r.word): r.value for r in words.venue_words_long(*found).collect()}
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-9)


def test_no_cartesian_products(spark):
    a, v = random_articles(spark)
    venues, arts = spark.createDataFrame(v), spark.createDataFrame(a)
    points_ = arts.select("article_id", F.col("lat").alias("o_lat"), F.col("long").alias("o_long"), F.lit("c").alias("category"))
    for df in (grid.radius_join(venues, points_, 500), count_within(venues, points_, Disc(500)), nearest(venues, points_, by="category"),
               tf.text_features(venues, arts, 500)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_wide_word_rows_are_not_shuffled(spark):
    v = spark.createDataFrame([(1, 40.7, -74.0), (2, 40.7, -74.0), (2, 40.7, -74.0)], "venue_id int, lat double, long double")
    a = spark.createDataFrame([(1, 40.7, -74.0), (2, 40.7001, -74.0)], "article_id int, lat double, long double")
    w = spark.createDataFrame([(1, "a", 2.0), (2, "a", 1.0), (2, "b", 0.0)], "article_id int, word string, tfidf double")
    features, vocabulary = words.venue_words(v, a, w, 500, None, mean=False)
    long = words.venue_words_long(features, vocabulary)
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan[:plan.index("FlatMapCoGroups")].split("BroadcastExchange")[0]
    assert sorted(map(tuple, long.collect())) == [(1, "a", 3.0), (2, "a", 3.0), (2, "a", 3.0)]


def test_vector_blocks_hold_few_distances_at_once():
    import tracemalloc
    a, b = points(1_000, (40.70, 40.72), (-74.0, -73.98), 4), points(4_000, (40.70, 40.72), (-74.0, -73.98), 5, "o_")
    b["n"], b["v"] = 1, list(np.ones((4_000, 3)))
    tracemalloc.start()
    count, total = tf._weighted_sums(a, b, 5_000, "haversine", None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (count == 4_000).all() and (total == 4_000).all() and peak < 60e6


def test_weights_compare_few_distances_beyond_the_radius(monkeypatch):
    a, b = points(2_000, (40.68, 40.70), (-74.0, -73.98), 4), points(3_000, (40.64, 40.74), (-74.05, -73.93), 5, "o_")
    a.loc[:499, ["lat", "long"]] += np.random.default_rng(1).normal(0, 1e-5, (500, 2))
    a.loc[1_999, "lat"] = np.nan
    b["n"], b["v"] = 2, list(np.random.default_rng(2).normal(size=(3_000, 3)))
    compared, weigh = [], tf.chord_weights
    monkeypatch.setattr(tf, "chord_weights", lambda *args: compared.append(weigh(*args)) or compared[-1])
    count, total = tf._weighted_sums(a, b, 2_000, "haversine", "tanh")
    d = haversine_np(a.lat.values[:, None], a.long.values[:, None], b.o_lat.values, b.o_long.values)
    w = np.where(d < 2_000, 1 - np.exp(-(1.3 - d / 2_000) ** 6), 0)
    np.testing.assert_allclose(total, w @ np.stack(b.v), rtol=1e-9, atol=1e-9)
    assert (count == 2 * (d < 2_000).sum(axis=1)).all()
    assert sum(w.size for w, _ in compared) < 2 * (d < 2_000).sum()     # before: all pairs


def test_distances_at_the_radius_follow_the_plain_formula():
    a, b = points(30, (40.68, 40.70), (-74.0, -73.98), 4), points(40, (40.68, 40.70), (-74.0, -73.98), 5, "o_")
    d = haversine_np(a.lat.values[:, None], a.long.values[:, None], b.o_lat.values, b.o_long.values)
    for radius in d[::7, ::11].ravel():
        for r in (radius, np.nextafter(radius, np.inf)):
            assert (grid.chord_weights(a, b, r, "haversine", None)[1] == (d < r)).all()


def test_near_antipodal_geodesics():
    """Published distances (Karney, 2013, and the half meridian), in every order and mirrored; symmetric for random pairs."""
    for lat1, long1, lat2, long2, want in ((-30, 0, 29.9, 179.8, 19_989_832.827610), (0, 0, 0, 180, 20_003_931.4586), (90, 0, -90, 10, 20_003_931.4586),
                                           (40, 10, -40, -170, 20_003_931.4586), (0, 0, 0.5, 179.5, 19_936_288.579), (0, 0, 0.5, 179.7, 19_944_127.421)):
        for a, b, c, d in ((lat1, long1, lat2, long2), (lat2, long2, lat1, long1), (-lat1, long1, -lat2, long2), (lat1, -long1, lat2, -long2)):
            assert float(geodesic_np(*map(np.float64, (a, b, c, d)))) == pytest.approx(want, abs=1e-3)
    rng = np.random.default_rng(1)
    lat = rng.uniform(-89, 89, 2000)
    far = -lat + rng.normal(0, .3, 2000), 180 + rng.normal(0, .3, 2000)
    there, back = geodesic_np(lat, 0 * lat, *far), geodesic_np(*far, lat, 0 * lat)
    assert np.isfinite(there).all() and np.abs(there - back).max() < 1e-3 and there.max() < 20_003_931.5
    assert np.isnan(geodesic_np(np.array([np.nan, 0.0]), np.zeros(2), np.zeros(2), np.full(2, 180.0))).tolist() == [True, False]


@pytest.mark.parametrize("method, keep", [("haversine", "nearest"), ("haversine", "farthest"), ("geodesic", "nearest")])
@pytest.mark.parametrize("block", [4_000, 9])
def test_k_in_range_equals_brute_force(spark, method, keep, block):
    a = points(60, (40.70, 40.72), (-74.0, -73.98), 4)
    b = points(300, (40.70, 40.72), (-74.0, -73.98), 5, "o_").rename(columns={"id": "article_id"})
    b.loc[:99, ["o_lat", "o_long"]] = [40.71, -73.99]                    # a third at one spot: ties by id
    dist = (geodesic_np if method == "geodesic" else haversine_np)(*np.broadcast_arrays(a.lat.values[:, None], a.long.values[:, None], b.o_lat.values, b.o_long.values))
    want = set()
    for i in range(len(a)):
        inside = np.flatnonzero(dist[i] < 500)
        order = np.lexsort((b.article_id.values[inside], np.round(dist[i][inside], 7) * (1 if keep == "nearest" else -1)))[:7]
        want |= {(i, int(b.article_id[j])) for j in inside[order]}
    found = tf.k_in_range(spark.createDataFrame(a), spark.createDataFrame(b), 500, 7, method, keep, spot_block=block, article_block=block)
    got = spark.createDataFrame(a).join(found, ["lat", "long"]).collect()
    assert {(r.id, r.article_id) for r in got} == want and len(got) == len(want)


def test_the_k_nearest_are_found_among_few_candidates():
    """Tiles of spots meet few of the points in range, also where many points lie at one place; before: all pairs."""
    a, b = points(4_000, (40.68, 40.72), (-74.02, -73.98), 4), points(6_000, (40.68, 40.72), (-74.02, -73.98), 5, "o_").rename(columns={"id": "article_id"})
    b.loc[:1_999, ["o_lat", "o_long"]] = [40.70, -74.0]
    a.loc[0, "lat"] = np.nan
    b.loc[2_000, "o_long"] = np.nan
    for method, radius in (("haversine", 2_000), ("haversine", 40), ("geodesic", 300)):
        met, got = 0, {}
        for rows, some in tf._near_tiles(a, b, radius, 7, method, "article_id"):
            met += len(rows) * len(some)
            d = grid.block_distances(a.iloc[rows], b.iloc[some], radius, method)
            for i, j in zip(*grid.first_k(np.where(d < radius, d, np.inf), b.article_id.to_numpy()[some], 7)):
                got.setdefault(int(rows[i]), []).append(int(some[j]))
        assert met < 0.04 * len(a) * len(b)
        for i in range(1, len(a), 40):
            d = grid.block_distances(a.iloc[[i]], b, radius, method)
            assert got.get(i, []) == grid.first_k(np.where(d < radius, d, np.inf), b.article_id.to_numpy(), 7)[1].tolist()
        assert 0 not in got


def test_word_summaries_copy_articles_to_few_pieces_of_venues(spark, monkeypatch):
    """Summaries are those of the long form, and venues of a cell meet its articles in one task, tile by tile."""
    rng = np.random.default_rng(13)
    v = [(i, 40.70 + i % 20 * 1e-4, -74.0) for i in range(40)]
    a = [(i, 40.70 + i * 1e-4, -74.0) for i in range(30)]
    w = [(i, f"w{x}", float(rng.uniform(.1, 2))) for i in range(30) for x in rng.choice(20, 5, replace=False)]
    v, a, w = spark.createDataFrame(v, "venue_id int, lat double, long double"), spark.createDataFrame(a, "article_id int, lat double, long double"), \
        spark.createDataFrame(w, "article_id int, word string, tfidf double")
    long = words.venue_words_long(*words.venue_words(v, a, w, 1_000, "linear", mean=False))
    want = {r[0]: (r[1], pytest.approx(r[2]), pytest.approx(r[3])) for r in long.groupBy("venue_id").agg(F.count("*"), F.sum("value"), F.max("value")).collect()}
    made, plain = [], words.blocks
    monkeypatch.setattr(words, "blocks", lambda *args, **names: made.append(plain(*args, **names)) or made[-1])
    found, _ = words.venue_words(v, a, w, 1_000, "linear", mean=False, spot_block=5, summary=True)
    got = found.groupBy("venue_id").agg(F.sum("words"), F.sum("total"), F.max("largest")).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(want) == 40
    spots, points_, _, _ = made[-1]
    assert spots.select("_cell", "_sp").distinct().count() == spots.select("_cell").distinct().count()     # before: a piece for 5 venues
