"""Elimination by a linear machine, the kernel sweep and the selection chain against exact small solutions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelens.operators import selection
from tests.test_models import frame


def exact_svr(kernel, y, c=1.0, eps=0.1, rounds=4000, constant=1e3):
    """Dual coefficients of the epsilon-insensitive machine by coordinate ascent; a large constant stands for the free intercept."""
    k = kernel + constant
    b = np.zeros(len(y))
    for _ in range(rounds):
        before = b.copy()
        for i in range(len(b)):
            r = y[i] - k[i] @ b + k[i, i] * b[i]
            b[i] = np.clip(np.sign(r) * max(abs(r) - eps, 0) / k[i, i], -c, c)
        if np.abs(b - before).max() < 1e-9:
            break
    return b


def located(spark, x, y, g):
    return frame(spark, x, y, g).withColumns({"lat": F.col("venue_id") * 0.001, "long": F.col("venue_id") * -0.001}).withColumnRenamed("g", "region")


def test_linear_machines_meet_the_exact_solution(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 3)) * [1, 5, 0.2] + [0, 100, 3]
    y = 2 * x[:, 0] - 0.3 * (x[:, 1] - 100) + rng.normal(size=90) * 0.5
    g = np.array(["a", "b", "c"])[np.arange(90) % 3]
    df = frame(spark, x, y, g)
    sums, shift = selection.known_sums(df.withColumn("all", F.lit("x")), "all")
    scale = selection.Scale(sums["x"], shift, sample=True)
    np.testing.assert_allclose(scale.std, x.std(0, ddof=1))
    uses = {m: np.arange(3) for m in ("a", "b", "c", None)}
    data = selection._stored(df, "g", "features", "y")
    got = selection.fit_together(data, selection.LinearDesign(scale, uses), {m: np.zeros(4) for m in uses}, tol=1e-7)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    for m, w in got.items():
        rows = g != m if m else np.ones(90, bool)
        b = exact_svr(z[rows] @ z[rows].T, y[rows], constant=10.0, rounds=20_000)   # the intercept is near 0
        want = np.concatenate([[10 * b.sum()], z[rows].T @ b])
        both = [v[1:] @ v[1:] / 2 + np.maximum(np.abs(y[rows] - v[0] - z[rows] @ v[1:]) - 0.1, 0).sum() for v in (w, want)]
        dual = b @ y[rows] - 0.1 * np.abs(b).sum() - b @ (z[rows] @ z[rows].T + 10) @ b / 2
        assert both[0] <= 1.002 * both[1] and both[0] <= 1.002 * dual and np.abs(w - want).max() < 0.05


def test_ranking_by_a_linear_machine(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 9)) * 10 ** rng.uniform(-2, 2, 9)
    y = 4 * x[:, 3] / x[:, 3].std() - 2 * x[:, 7] / x[:, 7].std() + rng.normal(size=300) * .1
    x[::7, 5] = np.nan
    x[:, 0] = 3.0                                                             # constant: counts as 0
    df = frame(spark, x, y, np.full(300, "a"))
    rows = selection.svr_ranking(df, [f"f{i}" for i in range(9)], step=4).orderBy("removal_order").collect()
    assert [r.removal_order for r in rows] == list(range(1, 10)) and [r.feature for r in rows[-2:]] == ["f7", "f3"]
    assert rows[0].feature == "f0" and [r.kept for r in rows] == sorted(r.kept for r in rows) and rows[-2].kept
    assert selection.svr_ranking(df.limit(0), ["a"]).count() == 0
    names = ["dummy_x", *[f"f{i}" for i in range(1, 9)]]
    assert "dummy_x" not in selection.worst_features(selection.svr_ranking(df, names, step=4))


def test_kernel_sweep_is_close_to_the_exact_machines(spark):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=(210, 2)), rng.normal(size=(210, 2)) * 30 + 7])
    y = np.sin(x[:, 0]) * 3 + x[:, 1] + rng.normal(size=210) * .1
    g = np.where(np.arange(210) < 140, "a", "b")
    got = selection.kernel_predictions(frame(spark, x, y, g).withColumnRenamed("g", "region"), list("pqrs"), ["r", "s"], [0, 2],
                                       dims=400, tol=1e-5).toPandas().sort_values(["dropped", "venue_id"])
    tr, te = g == "a", g == "b"
    errors = {}
    for dropped, use in ((0, [0, 1, 2, 3]), (2, [0, 1])):
        z = (x[:, use] - x[tr][:, use].mean(0)) / x[tr][:, use].std(0)
        kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(-1) / len(use))
        b = exact_svr(kernel[np.ix_(tr, tr)], y[tr], rounds=1500)
        exact = (kernel[np.ix_(te, tr)] + 1e3) @ b
        pred = got.prediction[got.dropped == dropped].values[te]
        errors[dropped] = np.abs(pred - y[te]).mean()
        assert np.abs(pred - exact).mean() < 0.45 and errors[dropped] < np.abs(exact - y[te]).mean() + 0.25
    assert errors[2] < errors[0]


def test_many_models_in_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, g = rng.normal(size=(120, 4)), np.array(["a", "b", "c"])[np.arange(120) % 3]
    df = frame(spark, x, x[:, 0] * 2, g).withColumnRenamed("g", "region")
    args = (df, list("pqrs"), ["s", "r"], [0, 1, 2])
    want = selection.kernel_predictions(*args, dims=16).toPandas().sort_values(["dropped", "venue_id"])
    monkeypatch.setattr(selection, "PASS_NUMBERS", 400)                       # a pass holds one model
    got = selection.kernel_predictions(*args, dims=16).toPandas().sort_values(["dropped", "venue_id"])
    np.testing.assert_allclose(got.prediction, want.prediction, atol=1e-8)


@pytest.mark.parametrize("kind", ["ols", "svr"])
def test_chain_from_ranking_to_errors(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(420, 5))
    y = 5 * x[:, 0] - 3 * x[:, 2] + rng.normal(size=420) * .2
    g = np.array(["a", "b", "out"])[np.arange(420) % 3]
    x[(g != "out") & (np.arange(420) % 2 == 0), 4] = 40.0                     # a feature that only misleads inside
    table = located(spark, x, y, g)
    names = ["f0", "f1", "f2", "f3", "dummy_q"]
    out = selection.selection_chain(table.where("region = 'out'"), table.where("region != 'out'"), names, step=1, kind=kind)
    assert set(out) == {"ranking", "sweep", "best", "folds", "regions", "spatial", "errors"}
    assert out["ranking"].count() == 5 and out["sweep"].count() == 4
    sweep = {r.dropped: r.mae for r in out["sweep"].collect()}
    best = out["best"].first()
    assert best.mae == min(sweep.values()) and sweep[2] < sweep[3]
    errors = out["errors"].toPandas()
    assert sorted(errors.columns) == ["error", "id", "lat", "long", "prediction", "region"] and len(errors) == 280
    assert np.abs(errors.error).mean() == pytest.approx(best.mae, rel=1e-6)
    assert out["spatial"].first().mae == pytest.approx(best.mae, rel=1e-6)
    assert {r.region for r in out["regions"].collect()} == {"a", "b"} and out["folds"].first().mae > 0
