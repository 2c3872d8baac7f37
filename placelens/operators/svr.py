"""RBF support-vector regression by random Fourier features (Rahimi and Recht, 2007).

An approximation: the kernel is replaced by `dims` random cosines, and the epsilon-insensitive loss is
minimised by majorisation (each round a weighted ridge problem; the objective never rises). One round
is one distributed pass that sums dims x dims numbers; the models of all held-out groups share it.
"""

import itertools
import warnings

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from placelens.operators.scales import Scale, known_sums


class _Maps:
    """Scaling and random features of the model of one held-out group."""

    def __init__(self, scale, dims, gamma, seed):
        d = len(scale.fill)
        self.scale = scale
        rng = np.random.default_rng(seed)
        live = max(int(scale.live.sum()), 1)
        self.omega = rng.normal(size=(d, dims)) * np.sqrt(2 * (gamma or 1 / live))
        self.phase = rng.uniform(0, 2 * np.pi, dims)
        self.ybar = scale.ybar

    def __call__(self, x):
        z = np.sqrt(2 / len(self.phase)) * np.cos(self.scale(x) @ self.omega + self.phase)
        return np.column_stack([np.ones(len(x)), z])


def _normal_equations(z, y, w, eps, tiny):
    """Weighted Gram matrix, right-hand side and loss of the majoriser at w."""
    r = y - z @ w
    up, down = np.maximum(np.abs(r - eps), tiny), np.maximum(np.abs(-r - eps), tiny)
    a, b = 1 / (4 * up), 1 / (4 * down)
    weight, pull = a + b, a * (y - eps + up) + b * (y + eps - down)
    return z.T @ (z * weight[:, None]), z.T @ pull, np.maximum(np.abs(r) - eps, 0).sum()


def predict_left_out(df, group, features="features", target="y", c=1.0, eps=0.1, dims=128, gamma=None, rounds=None,
                     tol=1e-3, seed=7, name="prediction"):
    """Out-of-group SVR predictions of all rows. The input is cached while the rounds run.

    Rounds run until no objective falls by more than `tol` of its value, which happens because it never rises and is
    bounded below. `rounds` sets a limit; if it is met earlier, a warning says so.
    """
    spark = df.sparkSession
    data = df.select(F.col(group).cast("string").alias("g"), features, F.col(target).cast("double").alias("t")).persist()
    try:
        sums, shift = known_sums(data, "g", features, "t")
        total = sum(sums.values())
        maps = {g: _Maps(Scale(total - s, shift), dims, gamma, seed) for g, s in sorted((g, s) for g, s in sums.items() if g is not None)}
        shared = spark.sparkContext.broadcast(maps)   # groups x features x dims numbers, independent of the rows
        weights = {g: np.concatenate([[m.ybar], np.zeros(dims)]) for g, m in maps.items()}
        best = {g: np.inf for g in maps}
        for done in itertools.count():
            if done == rounds:
                warnings.warn(f"support-vector regression stopped after {rounds} rounds, before it converged", stacklevel=2)
                break
            sums = _pass(data, features, shared, weights, eps)
            active = False
            for g, total in sums.items():
                gram, rhs, loss = total[:, :-2], total[:, -2], total[0, -1]
                objective = weights[g][1:] @ weights[g][1:] / 2 + c * loss
                if best[g] - objective <= tol * objective:
                    continue
                active, best[g] = True, objective
                ridge = np.eye(dims + 1)
                ridge[0, 0] = 1e-9
                weights[g] = np.linalg.solve(ridge + 2 * c * gram, 2 * c * rhs)
            if not active:
                break
    finally:
        data.unpersist()
    return _apply(df, group, features, shared, weights, name)


def _pass(data, features, shared, weights, eps):
    w = data.sparkSession.sparkContext.broadcast(weights)

    def partial(batches):
        acc = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x, y, own = np.stack(pdf[features].to_numpy()), pdf["t"].to_numpy(), pdf["g"].to_numpy()
            for g, fmap in shared.value.items():
                rows = own != g
                if rows.any():
                    gram, rhs, loss = _normal_equations(fmap(x[rows]), y[rows], w.value[g], eps, 1e-3)
                    m = np.column_stack([gram, rhs, np.full(len(rhs), loss)])
                    acc[g] = acc.get(g, 0) + m
        for g, m in acc.items():
            yield pd.DataFrame({"g": g, "i": np.arange(len(m)), "row": list(m)})

    parts = data.coalesce(data.sparkSession.sparkContext.defaultParallelism).mapInPandas(partial, "g string, i int, row array<double>")
    out = {}
    for r in parts.groupBy("g", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).collect():
        out.setdefault(r.g, {})[r.i] = r.row   # groups x (dims + 1) rows
    return {g: np.array([m[i] for i in range(len(m))]) for g, m in out.items()}


def _apply(df, group, features, shared, weights, name):
    w = df.sparkSession.sparkContext.broadcast(weights)
    small = df.drop(name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.drop(features).schema) + f", `{name}` double"

    def apply(batches):
        for pdf in batches:
            out = np.zeros(len(pdf))
            for g, rows in pdf.groupby(pdf[group].astype(str)).indices.items():
                out[rows] = shared.value[g](np.stack(pdf[features].to_numpy()[rows])) @ w.value[g]
            yield pdf.drop(columns=[features]).assign(**{name: out})

    return small.mapInPandas(apply, schema)
