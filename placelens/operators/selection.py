"""Feature selection with epsilon-insensitive regression: elimination by a linear machine, the sweep over kernel machines, and
the chain from ranking to error table.

Many models are fitted together. Each minimises |w|^2 / 2 + c * sum max(0, |y - w.z - b| - eps) by majorisation: a round is one
weighted ridge problem per model, and the normal equations of all models come from one shared pass over the rows. Matrices are
summed by row and solved in a task per model; the driver holds one weight vector per model. Models stop one by one, when their
objective, which never rises, falls by no more than `tol` of its value.
"""

import itertools

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from placelens.operators import linear, svr
from placelens.operators.evaluation import assign_folds, cross_validate, error_table, regression_metrics, weighted_summary
from placelens.operators.scales import Scale, known_sums
from placelens.session import cut_lineage

PASS_NUMBERS = 1 << 23       # numbers of the normal equations that a task sums in one pass; more models take more passes
TINY = 1e-3                  # least distance from the kinks of the loss in a majoriser


# ---- models that share a pass ------------------------------------------------------------------------------------

class LinearDesign:
    """One scale for all rows; a model is (held group or None, places of its features)."""

    def __init__(self, scale, uses):
        self.scale, self.uses = scale, uses

    def held(self, model):
        return model

    def width(self, model):
        return len(self.uses[model]) + 1

    def matrices(self, x, own, models):
        """(model, rows it is trained on, design matrix of these) of each model."""
        z = self.scale(x)
        for m in models:
            rows = np.flatnonzero(own != m) if m is not None else np.arange(len(x))
            yield m, rows, np.column_stack([np.ones(len(rows)), z[rows][:, self.uses[m]]])


class CosineDesign:
    """Random Fourier features of an RBF kernel for models (held group, number of dropped features).

    All models of a group share one projection: it is summed feature block by feature block, from the best to the worst, and
    each drop count takes the sum so far; the kernel's width follows from the number of live features that are left.
    """

    def __init__(self, scales, order, counts, dims, seed):
        self.scales, self.counts, self.dims = scales, sorted(counts), dims
        self.order = np.asarray(order, int)                      # places, worst first
        rng = np.random.default_rng(seed)
        self.omega = rng.normal(size=(len(self.order), dims))
        self.phase = rng.uniform(0, 2 * np.pi, dims)

    def held(self, model):
        return model[0]

    def width(self, model):
        return self.dims + 1

    def projections(self, x, g, counts):
        """(count, design matrix) for some drop counts of group g, from the largest count down."""
        scale = self.scales[g]
        z = scale(x)
        total, done = np.zeros((len(x), self.dims)), len(self.order)
        for c in sorted(counts, reverse=True):
            use = self.order[c:done]
            total, done = total + z[:, use] @ self.omega[use], c
            live = max(int(scale.live[self.order[c:]].sum()), 1)
            yield c, np.column_stack([np.ones(len(x)), np.sqrt(2 / self.dims) * np.cos(total * np.sqrt(2 / live) + self.phase)])

    def matrices(self, x, own, models):
        by_group = {}
        for g, c in models:
            by_group.setdefault(g, []).append(c)
        for g, counts in by_group.items():
            rows = np.flatnonzero(own != g)
            for c, z in self.projections(x[rows], g, counts):
                yield (g, c), rows, z


def _groups_of(column):
    return np.array([None if pd.isna(v) else v for v in column], object)


def _chunks(design, models):
    """Models in chunks whose normal equations fit in one pass."""
    chunk, size = [], 0
    for m in models:
        n = design.width(m) * (design.width(m) + 2)
        if chunk and size + n > PASS_NUMBERS:
            yield chunk
            chunk, size = [], 0
        chunk.append(m)
        size += n
    if chunk:
        yield chunk


def _round(data, design, weights, models, c, eps):
    """One round of some models: {model: (new weights, objective of the old ones)}."""
    spark = data.sparkSession
    names = {str(i): m for i, m in enumerate(models)}
    number = {m: k for k, m in names.items()}
    sent = spark.sparkContext.broadcast((design, [(m, weights[m]) for m in models]))

    def partial(batches):
        design, pairs = sent.value
        w, acc = dict(pairs), {}
        for pdf in batches:
            if not len(pdf):
                continue
            x, y, own = np.stack(pdf["x"].to_numpy()).astype(float), pdf["t"].to_numpy(), _groups_of(pdf["g"])
            for m, rows, z in design.matrices(x, own, list(w)):
                if len(rows):
                    gram, rhs, loss = svr._normal_equations(z, y[rows], w[m], eps, TINY)
                    both = np.column_stack([gram, rhs, np.full(len(rhs), loss)])
                    acc[m] = acc[m] + both if m in acc else both
        for m, both in acc.items():
            yield pd.DataFrame({"m": number[m], "i": np.arange(len(both)), "row": list(both)})

    def solve(pdf):
        total = np.stack(pdf.sort_values("i")["row"].to_numpy())
        old = dict(sent.value[1])[names[pdf["m"].iloc[0]]]
        ridge = np.eye(len(total))
        ridge[0, 0] = 1e-9
        new = np.linalg.solve(ridge + 2 * c * total[:, :-2], 2 * c * total[:, -2])
        return pd.DataFrame({"m": [pdf["m"].iloc[0]], "w": [new], "objective": [old[1:] @ old[1:] / 2 + c * total[0, -1]]})

    parts = data.coalesce(spark.sparkContext.defaultParallelism).mapInPandas(partial, "m string, i int, row array<double>")
    sums = parts.groupBy("m", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
    out = {names[r.m]: (np.array(r.w), r.objective)
           for r in sums.groupBy("m").applyInPandas(solve, "m string, w array<double>, objective double").collect()}   # one per model
    sent.unpersist()
    return out


def fit_together(data, design, weights, c=1.0, eps=0.1, tol=1e-3):
    """Weights of all models at convergence; `weights` holds their starts. data: g, x, t, a stored table.

    Rounds start from points extrapolated along the last step; where that raises a model's objective, it goes back to its best
    round's result and extrapolates anew. A plain round never raises it, so every model ends.
    """
    at, last, speed = dict(weights), dict(weights), dict.fromkeys(weights, 1.0)
    result, best = dict(weights), dict.fromkeys(weights, np.inf)
    active = list(weights)
    while active:
        going = []
        for chunk in _chunks(design, active):
            for m, (new, objective) in _round(data, design, at, chunk, c, eps).items():
                if objective > best[m] and speed[m] > 1:
                    at[m], last[m], speed[m] = result[m], result[m], 1.0
                    going.append(m)
                elif best[m] - objective > tol * objective:
                    faster = (1 + np.sqrt(1 + 4 * speed[m] ** 2)) / 2
                    at[m] = new + (speed[m] - 1) / faster * (new - last[m])
                    best[m], result[m], last[m], speed[m] = objective, new, new, faster
                    going.append(m)
                elif objective < best[m]:
                    result[m] = new
        active = going
    return result


def _stored(df, group, features, target):
    return cut_lineage(df.select(F.col(group).cast("string").alias("g"), F.col(features).alias("x"), F.col(target).cast("double").alias("t")))


# ---- elimination -------------------------------------------------------------------------------------------------

def svr_ranking(df, names, features="features", target="y", step=25, k=5, key="venue_id", c=1.0, eps=0.1, tol=1e-3):
    """(removal_order, feature, kept), worst first: recursive elimination by a linear support-vector regression.

    Features are z-scored over all rows (sample std), NULLs count as the mean, constant features as 0. Each round removes the
    `step` features of smallest weight, in every training fold and on all rows; all these models share their passes and start
    from the weights of the round before. `kept` are the features left at the least mean absolute error over the k folds, fewest on ties.
    """
    folded = assign_folds(df, key, k)
    sums, shift = known_sums(folded.withColumn("_all", F.lit("all")), "_all", features, target)
    if not sums:
        return df.sparkSession.createDataFrame([], "removal_order int, feature string, kept boolean")
    scale = Scale(sums["all"], shift, sample=True)
    data = _stored(folded, "fold", features, target)
    folds = [str(i) for i in range(k)]
    uses = {m: np.arange(len(names)) for m in [*folds, None]}
    weights = {m: np.concatenate([[scale.ybar], np.zeros(len(names))]) for m in uses}
    removed, levels = {m: [] for m in uses}, []
    while True:
        weights = fit_together(data, LinearDesign(scale, uses), weights, c, eps, tol)
        levels.append({m: (uses[m], weights[m]) for m in folds})
        if len(uses[None]) <= 1:
            break
        for m, use in uses.items():
            size = np.abs(weights[m][1:])
            drop = sorted(range(len(use)), key=lambda i: (size[i], names[use[i]]))[:min(step, len(use) - 1)]
            removed[m] += [names[i] for i in use[drop]]
            left = np.setdiff1d(np.arange(len(use)), drop)
            uses[m], weights[m] = use[left], weights[m][np.concatenate([[0], left + 1])]
    errors = _fold_errors(data, scale, levels)
    counts = [min(i * step, len(names) - 1) for i in range(len(levels))]
    best = min((e, -d) for e, d in zip(errors, counts))
    order = removed[None] + [names[i] for i in uses[None]]
    rows = [(i + 1, n, bool(i >= -best[1])) for i, n in enumerate(order)]
    return df.sparkSession.createDataFrame(rows, "removal_order int, feature string, kept boolean")


def _fold_errors(data, scale, levels):
    """Mean over the folds of the mean absolute error at each level, from one pass."""
    sent = data.sparkSession.sparkContext.broadcast(levels)

    def partial(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            z, y, own = scale(np.stack(pdf["x"].to_numpy()).astype(float)), pdf["t"].to_numpy(), _groups_of(pdf["g"])
            for g in set(own.tolist()):
                rows = np.flatnonzero(own == g)
                error = [float(np.abs(y[rows] - w[0] - z[rows][:, use] @ w[1:]).sum()) for use, w in (level[g] for level in sent.value)]
                yield pd.DataFrame({"g": [g], "n": [len(rows)], "error": [error]})

    parts = data.mapInPandas(partial, "g string, n long, error array<double>")
    total = parts.groupBy("g").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("error"))).alias("error")).collect()
    return np.mean([np.array(r.error) / r.n for r in total], axis=0).tolist()        # one row per fold


def worst_features(ranking, hidden="dummy_"):
    """Names worst first, without those that hold `hidden`: these compete in the elimination, but are never dropped by it."""
    return [r.feature for r in ranking.orderBy("removal_order").collect() if hidden not in r.feature]   # one row per feature


# ---- sweep -------------------------------------------------------------------------------------------------------

def kernel_predictions(df, names, worst, counts, group="region", features="features", target="y", c=1.0, eps=0.1, dims=128, tol=1e-3, seed=7):
    """Rows with `dropped` and the out-of-group `prediction` of an RBF support-vector regression without the worst features.

    One model per group and number of dropped features; all are fitted in the same passes.
    """
    at = {n: i for i, n in enumerate(names)}
    order = [at[n] for n in worst] + [i for i, n in enumerate(names) if n not in set(worst)]
    counts = sorted({min(n, len(worst)) for n in counts})
    sums, shift = known_sums(df, group, features, target)
    groups = sorted(g for g in sums if g is not None)
    total = sum(sums.values())
    scales = {g: Scale(total - sums[g], shift) for g in groups}
    design = CosineDesign(scales, order, counts, dims, seed)
    models = list(itertools.product(groups, counts))
    weights = {m: np.concatenate([[scales[m[0]].ybar], np.zeros(dims)]) for m in models}
    weights = fit_together(_stored(df, group, features, target), design, weights, c, eps, tol)
    sent = df.sparkSession.sparkContext.broadcast((design, list(weights.items())))
    small = df.drop("prediction").withColumn(group, F.col(group).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.drop(features).schema) + ", predictions array<double>"

    def apply(batches):
        design, pairs = sent.value
        w = dict(pairs)
        for pdf in batches:
            x, own = [np.asarray(v, float) for v in pdf[features]], _groups_of(pdf[group])
            out = [None] * len(pdf)
            for g in {g for g in own.tolist() if g is not None}:
                rows = np.flatnonzero(own == g)
                found = dict((n, z @ w[g, n]) for n, z in design.projections(np.stack([x[i] for i in rows]), g, counts))
                for i, p in zip(rows.tolist(), np.column_stack([found[n] for n in counts])):
                    out[i] = p
            yield pdf.drop(columns=[features]).assign(predictions=out)

    steps = F.array(*[F.lit(int(n)) for n in counts])
    return small.mapInPandas(apply, schema).select("*", F.posexplode("predictions").alias("_i", "prediction")).withColumn(
        "dropped", F.get(steps, F.col("_i"))).drop("predictions", "_i")


def sweep(df, names, worst, counts, group="region", features="features", target="y", kind="svr", **options):
    """(dropped, mae, rmse, ndcg), weighted by the groups' rows, for each number of dropped worst features."""
    if kind != "svr":
        return linear.feature_sweep(df, names, worst, group, counts, features=features, target=target, kind=kind)
    rows = kernel_predictions(df, names, worst, counts, group, features, target, **options)
    per = regression_metrics(rows.select("dropped", group, target, "prediction"), ["dropped", group], y=target)
    w = F.sum("n")
    return per.groupBy("dropped").agg(*[(F.sum(F.col(c) * F.col("n")) / w).alias(c) for c in ("mae", "rmse", "ndcg")])


# ---- the whole chain ---------------------------------------------------------------------------------------------

def selection_chain(outside, inside, names, step=25, counts=None, group="region", features="features", target="y", key="venue_id",
                    kind="svr", k=5, hidden="dummy_", **options):
    """From rows outside of the regions to the chosen model's errors inside; a dict of tables:

    ranking  features worst first, by elimination on `outside`
    sweep    spatial metrics of models on `inside` for each number of dropped worst features
    best     the number with the least mean absolute error, fewest on ties
    folds    k-fold metrics of the model without them
    regions  its metrics in each region, trained on the others
    spatial  these, weighted by rows
    errors   its error at every row: id, lat, long, group, prediction, error

    kind: `svr` (RBF), or ols, ridge, lasso for the models of the sweep and after it. inside has key, lat, long, group, target and
    features, outside the same without group.
    """
    inside, outside = cut_lineage(inside), cut_lineage(outside)
    ranking = cut_lineage(svr_ranking(outside, names, features, target, step, k, key))
    worst = worst_features(ranking, hidden)
    counts = sorted({c for c in (counts if counts is not None else range(0, len(worst), step)) if c < len(names)})
    swept = cut_lineage(sweep(inside, names, worst, counts, group, features, target, kind, **options))
    best = cut_lineage(linear.best_feature_count(swept))
    dropped = best.first().dropped

    def predict(df, by, **_):
        if kind == "svr":
            return kernel_predictions(df, names, worst, [dropped], by, features, target, **options).drop("dropped")
        return linear.predict_left_out(df, by, features, target, kind, names=names, drops=worst[:dropped])

    rows = cut_lineage(predict(inside, group))
    regions = cut_lineage(regression_metrics(rows.where(F.col(group).isNotNull()), group, target))
    return {"ranking": ranking, "sweep": swept, "best": best,
            "folds": cross_validate(inside.drop("prediction"), predict, key, k, y=target),
            "regions": regions, "spatial": weighted_summary(regions), "errors": error_table(rows, group, key, target)}
