"""Ranks, NDCG, splits, linear and kernel models against direct computations."""

import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placelens.operators import evaluation as ev
from placelens.operators import linear, svr
from placelens.operators import preparation as pr
from placelens.operators import ranking as rk


def ndcg_np(y, p, k):
    order = np.sort(y)[::-1]
    rel = np.array([(len(y) - np.searchsorted(-order, -v) ) / len(y) for v in y])
    disc = 1 / np.log2(np.arange(len(y)) + 2)
    disc[k:] = 0
    total, at = 0.0, 0
    for v in np.unique(p)[::-1]:
        g = rel[p == v]
        total += g.mean() * disc[at:at + len(g)].sum()
        at += len(g)
    return total / (np.sort(rel)[::-1] * disc).sum()


@pytest.mark.parametrize("k", [5, 300])
def test_ranks_and_ndcg(spark, k):
    rng = np.random.default_rng(0)
    df = pd.DataFrame({"g": rng.choice(["a", "b", "b", "b"], 800), "y": rng.integers(0, 60, 800).astype(float), "prediction": rng.integers(0, 40, 800) / 2})
    df.loc[:300, "y"] = 7.0   # one value holds a third of all rows
    s = spark.createDataFrame(df)
    got = {r.g: r.ndcg for r in rk.ndcg(s, group="g", k=k).collect()}
    for g, part in df.groupby("g"):
        assert got[g] == pytest.approx(ndcg_np(part.y.values, part.prediction.values, k))
        assert 0 < got[g] <= 1
    whole = rk.relevance(s, "y").toPandas()
    assert (whole["rank"] == whole.y.rank(method="min", ascending=False)).all()
    perfect = rk.ndcg(s.withColumn("prediction", F.col("y")), k=k).first().ndcg
    assert perfect == pytest.approx(1)


def data(n=400, d=4, seed=1, gaps=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 5, 0.1, 2] + [0, 3, 1, -2]
    y = 3 * x[:, 0] - x[:, 1] + rng.normal(size=n) + 10
    if gaps:
        x[rng.random(n) < 0.1, 1] = np.nan
    g = rng.choice(["a", "b", "c"], n, p=[.6, .2, .2])
    return x, y, g


def frame(spark, x, y, g):
    rows = [(i, [None if np.isnan(v) else float(v) for v in row], float(t), str(k)) for i, (row, t, k) in enumerate(zip(x, y, g))]
    return spark.createDataFrame(rows, "venue_id int, features array<double>, y double, g string")


def reference_fit(x, y, kind, alpha):
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    yc = y - y.mean()
    n, d = z.shape
    if kind == "ols":
        w = np.linalg.lstsq(z, yc, rcond=None)[0]
    elif kind == "ridge":
        w = np.linalg.solve(z.T @ z + alpha * np.eye(d), z.T @ yc)
    else:
        w = np.zeros(d)
        for _ in range(2000):
            for j in range(d):
                r = yc - z @ w + z[:, j] * w[j]
                c = z[:, j] @ r / n
                w[j] = np.sign(c) * max(abs(c) - alpha, 0) / (z[:, j] @ z[:, j] / n)
    return lambda q: (q - m) / s @ w + y.mean()


@pytest.mark.parametrize("kind", ["ols", "ridge", "lasso"])
def test_left_out_predictions_with_gaps(spark, kind):
    x, y, g = data()
    got = linear.predict_left_out(frame(spark, x, y, g), "g", kind=kind).toPandas().sort_values("venue_id")
    want = np.empty(len(y))
    for h in "abc":
        tr = g != h
        mu = np.nanmean(x[tr], axis=0)
        fill = np.where(np.isnan(x), mu, x)
        want[~tr] = reference_fit(fill[tr], y[tr], kind, 1.0)(fill[~tr])
    np.testing.assert_allclose(got.prediction.values, want, atol=1e-6)


@pytest.mark.parametrize("kind", ["ols", "ridge", "lasso"])
def test_mllib_pipeline_agrees(spark, kind):
    x, y, g = data(gaps=False)
    df = frame(spark, x, y, g).select("y", *[F.col("features")[i].alias(f"x{i}") for i in range(4)])
    model = linear.mllib_pipeline(df, [f"x{i}" for i in range(4)], "y", kind).fit(df)
    got = np.array([r.prediction for r in model.transform(df).select("prediction").collect()])
    np.testing.assert_allclose(got, reference_fit(x, y, kind, 1.0)(x), atol=1e-4)


def test_generic_and_moment_validation_agree(spark):
    x, y, g = data(gaps=False)
    df = frame(spark, x, y, g).withColumns({f"x{i}": F.col("features")[i] for i in range(4)})
    slow = ev.leave_groups_out(df, "g", lambda t: linear.mllib_pipeline(t, [f"x{i}" for i in range(4)], "y").fit(t))
    fast = linear.predict_left_out(df, "g", kind="ols")
    a, b = (d.select("venue_id", "prediction").toPandas().sort_values("venue_id").prediction.values for d in (slow, fast))
    np.testing.assert_allclose(a, b, atol=1e-6)


def test_svr_is_close_to_the_exact_kernel_solution(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 2))
    y = np.sin(x[:, 0]) * 3 + x[:, 1] + rng.normal(size=240) * .1
    g = np.where(np.arange(240) < 160, "a", "b")
    got = svr.predict_left_out(frame(spark, x, y, g), "g", dims=400, rounds=60, tol=1e-6).toPandas().sort_values("venue_id")
    # exact: the same objective with the full RBF kernel, dual variables by projected coordinate ascent
    tr, te = g == "a", g == "b"
    m, s = x[tr].mean(0), x[tr].std(0)
    z = (x - m) / s
    kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(-1) / 2)
    k, yt = kernel[np.ix_(tr, tr)] + 1e3, y[tr]   # a large constant stands for the free intercept
    b = np.zeros(tr.sum())
    for _ in range(3000):
        for i in range(len(b)):
            r = yt[i] - k[i] @ b + k[i, i] * b[i]
            b[i] = np.clip(np.sign(r) * max(abs(r) - 0.1, 0) / k[i, i], -1, 1)
    exact = (kernel[np.ix_(te, tr)] + 1e3) @ b
    pred = got.prediction.values[te]
    assert np.abs(pred - exact).mean() < 0.25 and np.abs(pred - y[te]).mean() < np.abs(exact - y[te]).mean() + 0.2


def test_preparation(spark):
    df = spark.createDataFrame([(i, float(i % 3), 0.0, float((-1) ** i), 5.0 if i % 2 else None) for i in range(200)],
                               "id int, a double, b double, c double, e double")
    assert set(pr.dead_levels(df, ["a", "b", "c", "e"])) == {"b", "c"}   # c: -1 and 1 cancel out
    assert pr.impute_mean(df, ["e"], F.lit(True)).filter("e is null or e != 5").count() == 0
    z = pr.zscore(df, ["a", "b"]).agg(F.avg("a"), F.stddev_pop("a"), F.max("b")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1) and z[2] == 0
    split = pr.train_test_split(df, "id").groupBy("split").count().collect()
    assert sum(r["count"] for r in split) == 200 and 25 < {r.split: r["count"] for r in split}["test"] < 75
    folds = ev.assign_folds(df, "id").groupBy("fold").count().collect()
    assert len(folds) == 5 and sum(r["count"] for r in folds) == 200


def test_elimination_keeps_the_informative_features(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 12))
    y = 4 * x[:, 3] - 2 * x[:, 7] + rng.normal(size=600) * .1
    df = frame(spark, x, y, rng.choice(["a", "b"], 600))
    names = [f"f{i}" for i in range(12)]
    rank = linear.feature_ranking(df, names, step=5).orderBy("removal_order").collect()
    assert len(rank) == 12 and {r.feature for r in rank[-2:]} == {"f3", "f7"}
    sweep = linear.feature_sweep(df, names, [r.feature for r in rank], group="g", step=5)
    got = {r.dropped: r.mae for r in sweep.collect()}
    assert sorted(got) == [0, 5, 10] and got[10] < 0.2
    assert linear.best_feature_count(sweep).first().dropped in got


def test_a_large_offset_is_no_constant(spark):
    rows = [(k, [1.6e9 + k], 3.0 * k - 7, "ab"[k % 2]) for k in range(400)]
    df = spark.createDataFrame(rows, "venue_id int, features array<double>, y double, g string")
    for kind in ("ols", "lasso"):
        got = linear.predict_left_out(df, "g", kind=kind, alpha=1e-9).agg(F.max(F.abs(F.col("prediction") - F.col("y"))).alias("e")).first().e
        assert got < 1e-6


def test_rows_without_a_group_train_every_model(spark):
    x, y, g = data(gaps=False)
    lost = np.where(np.arange(len(y)) % 5 == 0, None, g)
    got = linear.predict_left_out(frame(spark, x, y, g).drop("g").join(
        spark.createDataFrame([(i, v) for i, v in enumerate(lost.tolist())], "venue_id int, g string"), "venue_id"), "g", kind="ols")
    got = got.toPandas().sort_values("venue_id")
    lost = np.array(lost, dtype=object)
    for h in "abc":
        te = lost == h
        want = reference_fit(x[~te], y[~te], "ols", 1.0)(x[te])
        np.testing.assert_allclose(got.prediction.values[te], want, atol=1e-6)
    assert got.prediction[[v is None for v in lost]].isna().all()


def test_named_features_can_be_dropped(spark):
    x, y, g = data(gaps=False)
    names = [f"f{i}" for i in range(x.shape[1])]
    got = linear.predict_left_out(frame(spark, x, y, g), "g", kind="ols", names=names, drops=["f1", "f2"]).toPandas().sort_values("venue_id")
    keep = [i for i in range(x.shape[1]) if i not in (1, 2)]
    te = g == "a"
    np.testing.assert_allclose(got.prediction.values[te], reference_fit(x[~te][:, keep], y[~te], "ols", 1.0)(x[te][:, keep]), atol=1e-6)
    a = ev.cross_validate(frame(spark, x, y, g), linear.predict_left_out, names=names, drops=["f1"]).first()
    assert a.mae is not None


@pytest.mark.parametrize("kind", ["ols", "ridge", "lasso"])
def test_wide_features_in_tiles(spark, monkeypatch, kind):
    """Several tiles, rows with gaps, without a group, and collinear features: as in one tile."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(260, 23)) * 10.0 ** rng.integers(-2, 3, 23) + rng.normal(size=23) * 50
    y = x[:, 3] - x[:, 20] + rng.normal(size=260)
    x[:, 22] = x[:, 3] * 2                                                    # collinear
    x[rng.random(260) < 0.05, 7] = np.nan
    g = np.array(["a", "b", "c", None], object)[rng.integers(0, 4, 260)]
    rows = [(i, [None if np.isnan(v) else float(v) for v in row], float(t), k) for i, (row, t, k) in enumerate(zip(x, y, g))]
    df = spark.createDataFrame(rows, "venue_id int, features array<double>, y double, g string")
    want = linear.predict_left_out(df, "g", kind=kind, alpha=0.1).toPandas().sort_values("venue_id").prediction
    monkeypatch.setattr(linear, "TILE", 6)
    got = linear.predict_left_out(df, "g", kind=kind, alpha=0.1).toPandas().sort_values("venue_id").prediction
    np.testing.assert_allclose(got, want, atol=1e-6 * np.abs(want).max())
    assert got.isna().sum() == sum(k is None for k in g)


def test_tiled_cholesky_and_least_squares():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 150))
    a, b = x.T @ x / 400, rng.normal(size=150)
    low = np.tril(linear.cholesky(a.copy(), block=40))
    np.testing.assert_allclose(low @ low.T, a, atol=1e-12)
    np.testing.assert_allclose(linear._least_squares(a.copy(), b), np.linalg.solve(a, b), atol=1e-9)
    x[:, 149] = x[:, 0]                                                       # singular: the shortest solution
    a, b = x.T @ x / 400, x.T @ rng.normal(size=400) / 400
    np.testing.assert_allclose(linear._least_squares(a.copy(), b), np.linalg.lstsq(a, b, rcond=1e-10)[0], atol=1e-5)


@pytest.mark.parametrize("case", ["plain", "collinear", "wide", "correlated"])
def test_lasso_certifies_itself(case):
    rng = np.random.default_rng(13)
    n, d = (60, 200) if case == "wide" else (300, 60)
    x = rng.normal(size=(n, d))
    if case == "collinear":
        x[:, 1::2] = x[:, ::2]
    if case == "correlated":
        x = np.cumsum(x, axis=1)
    x = (x - x.mean(0)) / x.std(0)
    y = x[:, 0] * 3 - x[:, 10] + rng.normal(size=n)
    y -= y.mean()
    a, b, yy = x.T @ x / n, x.T @ y / n, y @ y / n
    for alpha in (5.0, 0.5, 0.05, 0.005):
        w, gap = linear.lasso(a, b, alpha, yy)
        assert gap <= 1e-10 * yy
        v = np.zeros(d)                                                       # long coordinate descent never does better
        for _ in range(300):
            for j in range(d):
                z = b[j] - a[j] @ v + a[j, j] * v[j]
                v[j] = np.sign(z) * max(abs(z) - alpha, 0) / a[j, j]
        value = lambda u: ((y - x @ u) ** 2).mean() / 2 + alpha * np.abs(u).sum()
        assert value(w) <= value(v) + 1e-10


def test_lasso_gaps_of_held_out_groups(spark):
    x, y, g = data()
    got = linear.lasso_gaps(frame(spark, x, y, g), "g", alpha=0.1).collect()
    assert sorted(r.g for r in got) == ["a", "b", "c"] and max(r.gap for r in got) < 1e-12


def test_svr_defaults_converge(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 2))
    y = np.sin(x[:, 0]) * 3 + x[:, 1]
    df = frame(spark, x, y, np.where(np.arange(200) < 120, "a", "b"))
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = svr.predict_left_out(df, "g").toPandas()
    assert (got.prediction - got.y).abs().mean() < 1.0
    with pytest.warns(UserWarning, match="before it converged"):
        svr.predict_left_out(df, "g", rounds=1)


def test_errors_in_per_cent_and_global_scores_take_gaps(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 5.0)], "y double, prediction double")
    assert ev.mape(df).first().mape == pytest.approx(37.5)
    z = pr.zscore_global(spark.createDataFrame([(1.0, None), (3.0, 5.0)], "a double, b double"), ["a", "b"]).collect()
    assert z[0].a == pytest.approx(-1.2247, abs=1e-4) and z[0].b is None
