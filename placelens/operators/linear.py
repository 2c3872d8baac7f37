"""Linear models for all folds at once, from moments summed in one distributed pass and solved in a task for each fold."""

import pickle
import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from placelens.operators.preparation import dead_levels
from placelens.session import cut_lineage

TILE = 2048           # columns of a tile of the moment matrix; a task sums one tile of each group
SLICE_NUMBERS = 1 << 22   # of the rows that a task multiplies at once
ALL = "\0all"
GAP = 1e-9            # duality gap of a lasso, relative to the variance of the target, above which a warning is given


class Moment:
    """Sum of (1, x - shift, y)(1, x - shift, y)^T over some rows; the shift keeps large offsets from cancelling.

    The matrix `m` is overwritten: its inner part becomes the covariance of the features.
    """

    def __init__(self, m, shift, block=512):
        self.shift, self.n = shift, m[0, 0]
        self.near = m[0, 1:-1] / self.n            # mean of x - shift
        self.mean, self.ybar = self.near + shift, m[0, -1] / self.n
        self.cxy = m[1:-1, -1] / self.n - self.near * self.ybar
        self.yvar = max(m[-1, -1] / self.n - self.ybar ** 2, 0.0)
        self.cov = m[1:-1, 1:-1]
        self.cov /= self.n
        for k in range(0, len(self.cov), block):
            self.cov[k:k + block] -= np.outer(self.near[k:k + block], self.near)
        self.var = np.maximum(np.diag(self.cov), 0)


def mllib_pipeline(train, features, target, kind="ols", alpha=1.0, max_iter=1000, tol=1e-12):
    """Standardised OLS, lasso or ridge as a Spark ML pipeline with the usual penalties: lasso minimises
    |y - Xw|^2 / 2n + alpha |w|_1, ridge |y - Xw|^2 + alpha |w|^2, on features of population std 1.

    Two facts of the library are corrected for: its scaler uses the sample std, and its ridge penalty
    is relative to the std of the target.
    """
    s = train.agg(F.count(target).alias("n"), F.stddev_pop(target).alias("std")).first()
    shrink = (s.n - 1) / s.n if s.n else 1.0   # (population std / sample std)^2
    reg = {"ols": dict(regParam=0.0), "lasso": dict(regParam=alpha * shrink ** 0.5, elasticNetParam=1.0),
           "ridge": dict(regParam=alpha / max(s.n, 1) * (s.std or 1.0) * shrink, elasticNetParam=0.0)}[kind]
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        LinearRegression(featuresCol="_scaled", labelCol=target, standardization=False, maxIter=max_iter, tol=tol, **reg)])


def as_array(df, columns, name="features", widths=None):
    """Put numeric and array columns into one array column, in the given order.

    `widths` gives the length of array columns that can be NULL; their places become NULL elements.
    """
    kinds, parts = dict(df.dtypes), []
    for c in columns:
        if not kinds[c].startswith("array"):
            parts.append(F.array(F.col(c).cast("double")))
            continue
        part = F.col(c).cast("array<double>")
        if widths and c in widths:
            part = F.coalesce(part, F.array_repeat(F.lit(None).cast("double"), widths[c]))
        parts.append(part)
    return df.withColumn(name, F.concat(*parts))


def _has_null(c):
    return F.exists(c, lambda x: x.isNull())


def train_means(df, group, features="features"):
    """{g: feature means over all rows outside group g}, NULLs skipped, and the means over all rows.

    Rows without a group are outside every group.
    """
    cols = df.select(F.col(group).cast("string").alias("g"), features)

    def partial(batches):
        acc = {}
        for pdf in batches:
            for g, part in pdf.groupby("g", dropna=False)[features]:
                g = None if pd.isna(g) else g
                x = np.stack(part.to_numpy())
                known = ~np.isnan(x)
                acc[g] = acc.get(g, 0) + np.stack([np.where(known, x, 0).sum(axis=0), known.sum(axis=0)])
        for g, (s, c) in acc.items():
            yield pd.DataFrame({"g": [g], "row": [np.concatenate([s, c])]})

    parts = cols.mapInPandas(partial, "g string, row array<double>")
    rows = parts.groupBy("g").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).collect()   # one per group
    sums = {r.g: np.array(r.row).reshape(2, -1) for r in rows}
    total = sum(sums.values())
    return ({g: (total - x)[0] / np.maximum((total - x)[1], 1) for g, x in sorted((k, v) for k, v in sums.items() if k is not None)},
            total[0] / np.maximum(total[1], 1))


def moment_rows(df, group, shift, features="features", target="y"):
    """Rows (g, a, b, i, row): the sums of (1, x - shift, y)(1, x - shift, y)^T over the rows of each group, as tiles.

    Row i of the tile (a, b), b <= a, of TILE x TILE numbers. One tile covers narrow features, and each task adds up its rows
    where they lie. Wide features are dealt as pairs of column ranges, so that a task holds one tile of each group.
    """
    spark = df.sparkSession
    ends = np.concatenate([[0.0], shift, [0.0]])
    width = len(ends)
    tiles = [(a, b) for a in range(-(-width // TILE)) for b in range(a + 1)]
    z = F.concat(F.array(F.lit(1.0)), F.col(features).cast("array<double>"), F.array(F.col(target).cast("double")))
    rows = df.select(F.col(group).cast("string").alias("g"), z.alias("z"))
    cores = spark.sparkContext.defaultParallelism
    if len(tiles) == 1:
        rows = rows.select("g", F.lit(0).alias("s"), F.col("z").alias("u"), F.lit(None).cast("array<double>").alias("v")).coalesce(cores)
    else:
        def cut(k):
            first = F.get(F.array(*[F.lit(pair[k] * TILE + 1) for pair in tiles]), F.col("s"))
            return F.slice("z", first, F.lit(TILE))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("z"), F.lit(max(1, cores // len(tiles)))))
        rows = rows.withColumn("s", F.explode(F.array(*map(F.lit, range(len(tiles))))))
        rows = rows.select("g", "s", cut(0).alias("u"), F.when(F.lit(True), cut(1)).alias("v"), "part").repartition("s", "part").drop("part")

    def partial(batches):
        acc = {}
        for batch in batches:
            step = max(1, SLICE_NUMBERS // min(width, TILE))
            for at in range(0, batch.num_rows, step):
                pdf = batch.slice(at, step).to_pandas()
                for (g, s), part in pdf.groupby(["g", "s"], dropna=False):
                    a, b = tiles[int(s)]
                    u = np.stack(part["u"].to_numpy()) - ends[a * TILE:(a + 1) * TILE]
                    v = u if a == b else np.stack(part["v"].to_numpy()) - ends[b * TILE:(b + 1) * TILE]
                    k = (None if pd.isna(g) else g, a, b)
                    acc[k] = acc[k] + u.T @ v if k in acc else u.T @ v
        for (g, a, b), m in acc.items():
            for first in range(0, len(m), 256):
                some = m[first:first + 256]
                n = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * n, pa.string()), *(pa.array(np.full(n, k, np.int32)) for k in (a, b)),
                     pa.array(np.arange(first, first + n, dtype=np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * some.shape[1]), pa.array(some.ravel()))],
                    names=["g", "a", "b", "i", "row"])

    parts = rows.mapInArrow(partial, "g string, a int, b int, i int, row array<double>")
    return _row_sums(parts, "g", "a", "b", "i")


def _row_sums(rows, *keys):
    return rows.groupBy(*keys).agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))


def for_each_held_out(df, group, work, features="features", target="y", everything=False):
    """(means, {g: work(Moment of all rows outside g, means of g)}); `work` runs in a task of its own for each group.

    With `everything`, there is one more group, None, which holds no row out.

    NULL features are filled with the training means. A row without NULLs enters the sums once, whichever group is held out. A
    row with NULLs is filled with the means of each training set it belongs to, so it is copied once per other group. A row
    without a group belongs to every training set and is never held out. A task holds one matrix of (d + 2)^2 numbers and what `work`
    needs, the driver what `work` returns.
    """
    spark = df.sparkSession
    means, shift = train_means(df, group, features)
    if everything:
        means = {**means, ALL: shift}
    names, size = list(means), len(shift) + 2
    whole = cut_lineage(moment_rows(df.filter(~_has_null(features)), group, shift, features, target))
    gaps = df.filter(_has_null(features))
    table = spark.createDataFrame([(str(g), list(map(float, mu))) for g, mu in means.items()], "held string, mu array<double>")
    copies = (gaps.withColumn("held", F.explode(F.array(*[F.lit(str(g)) for g in names])))   # one row per group is sent
              .filter(~F.col("held").eqNullSafe(F.col(group).cast("string"))).join(F.broadcast(table), "held")
              .withColumn(features, F.zip_with(features, "mu", lambda x, m: F.coalesce(x, m))))
    partial = moment_rows(copies, "held", shift, features, target)
    total = _row_sums(whole, "a", "b", "i").select(F.explode(F.array(*map(F.lit, names))).alias("h"), F.lit(1).alias("sign"), "a", "b", "i", "row")
    own = whole.where("g IS NOT NULL").select(F.col("g").alias("h"), F.lit(-1).alias("sign"), "a", "b", "i", "row")
    rows = total.union(own).union(partial.select(F.col("g").alias("h"), F.lit(1).alias("sign"), "a", "b", "i", "row"))

    def run(batches):
        name, m = None, None

        def result():
            for k in range(0, size, 512):                 # the lower tiles hold the sums
                m[:k, k:k + 512] = m[k:k + 512, :k].T
                m[k:k + 512, k:k + 512] = np.tril(t := m[k:k + 512, k:k + 512]) + np.tril(t, -1).T
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pickle.dumps(work(Moment(m, shift), means[name]))])], names=["h", "out"])

        for batch in batches:
            h, sign, a, b, i = (batch.column(k).to_pylist() for k in range(5))
            column = batch.column(5)
            flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            for k in range(batch.num_rows):
                if h[k] != name:
                    if name is not None:
                        yield result()
                    name, m = h[k], np.zeros((size, size))
                row = flat[offsets[k]:offsets[k + 1]]
                m[a[k] * TILE + i[k], b[k] * TILE:b[k] * TILE + len(row)] += sign[k] * row
        if name is not None:
            yield result()

    found = rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h string, out binary").collect()   # one per group
    out = {r.h: pickle.loads(r.out) for r in sorted(found, key=lambda r: names.index(r.h))}
    if everything:
        means[None], out[None] = means.pop(ALL), out.pop(ALL, None)
    return means, out


def solve(moment, kind="lasso", alpha=1.0, scale="feature", use=None, centre=0.0):
    """(intercept, coefficients) in the original units; the intercept is the model's value at x = centre.

    scale: per feature (population std), `global` (one mean and std for all) or None. `use` selects
    features; others get 0. Features without spread get 0.
    """
    n, cov, cxy, var, mean = moment.n, moment.cov, moment.cxy, moment.var, moment.mean
    d = len(mean)
    alive = var > 1e-12 * np.maximum(moment.near ** 2, 1e-300)
    if use is not None:
        alive &= np.isin(np.arange(d), use)
    idx = np.flatnonzero(alive)
    coef = np.zeros(d)
    if len(idx):
        if scale == "feature":
            s = np.sqrt(var[idx])
        elif scale == "global":
            s = np.full(len(idx), np.sqrt(max(var[idx].mean() + mean[idx].var(), 1e-300)))
        else:
            s = np.ones(len(idx))
        a, b = cov[np.ix_(idx, idx)], cxy[idx] / s
        a /= s[:, None]
        a /= s
        if kind == "ols":
            w = _least_squares(a, b)
        elif kind == "ridge":
            w = _least_squares(a, b, alpha / n)
        else:
            w, _ = lasso(a, b, alpha, moment.yvar)
        coef[idx] = w / s
    return moment.ybar - (mean - centre) @ coef, coef


def cholesky(a, block=512):
    """Lower Cholesky factor of a symmetric matrix in place, tile by tile; the upper half is left as it is."""
    n = len(a)
    for k in range(0, n, block):
        e = min(k + block, n)
        a[k:e, k:e] = np.linalg.cholesky(a[k:e, k:e])
        if e < n:
            inverse = np.linalg.inv(np.tril(a[k:e, k:e]))
            for i in range(e, n, block):
                a[i:i + block, k:e] = a[i:i + block, k:e] @ inverse.T
            for i in range(e, n, block):
                for j in range(e, i + 1, block):
                    a[i:i + block, j:j + block] -= a[i:i + block, k:e] @ a[j:j + block, k:e].T
    return a


def _triangular(factor, b, transposed, block=512):
    """Solve L x = b, or L^T x = b, tile by tile."""
    x, n = b.copy(), len(b)
    starts = list(range(0, n, block))
    for k in reversed(starts) if transposed else starts:
        e = min(k + block, n)
        t = np.tril(factor[k:e, k:e])
        x[k:e] = np.linalg.solve(t.T if transposed else t, x[k:e])
        if transposed:
            x[:k] -= factor[k:e, :k].T @ x[k:e]
        else:
            x[e:] -= factor[e:, k:e] @ x[k:e]
    return x


def _times(factor, x, transposed, block=512):
    """L x, or L^T x, tile by tile."""
    out = np.zeros(len(x))
    for k in range(0, len(x), block):
        t = np.tril(factor[k:k + block, k:k + block])
        if transposed:
            out[k:k + block] += t.T @ x[k:k + block]
            out[:k] += factor[k:k + block, :k].T @ x[k:k + block]
        else:
            out[k:k + block] += t @ x[k:k + block] + factor[k:k + block, :k] @ x[:k]
    return out


def _least_squares(a, b, penalty=0.0, jitter=1e-10):
    """min w'aw/2 - b'w + penalty |w|^2/2 for a correlation matrix `a`, which is overwritten; of many solutions the shortest.

    A small multiple of the identity makes the factor exist; repeated correction takes its effect out again.
    """
    at = np.arange(len(a))
    right = a.copy() if len(a) <= 64 else None            # small systems may be near singular: checked below
    a[at, at] += penalty + jitter
    factor = cholesky(a)

    def product(w):                                        # (a + (penalty + jitter) I) w, from the factor
        return _times(factor, _times(factor, w, True), False)

    w = np.zeros(len(b))
    for _ in range(6):
        rest = b - (product(w) - jitter * w) if w.any() else b
        step = _triangular(factor, _triangular(factor, rest, False), True)
        w = w + step
        if np.abs(step).max(initial=0) <= 1e-13 * max(np.abs(w).max(initial=0), 1e-300):
            break
    return w if right is None or penalty else np.linalg.lstsq(right, b, rcond=1e-10)[0]


def lasso(a, b, alpha, yy):
    """(w, gap): min w'aw/2 - b'w + alpha |w|_1 by an active set, and the duality gap that certifies it.

    Coefficients enter where the gradient exceeds alpha. On the active set, with given signs, the minimum is a linear system; on
    the way to it the best point where a sign changes is taken. The objective falls in every step, so the search ends by itself.
    yy is the mean square of the centred target.
    """
    w = np.zeros(len(b))
    live = np.diag(a) > 0
    many = 32                                              # that enter at once; one, where several stop each other

    def move(sign):
        use = np.flatnonzero(sign)
        reached = _towards(a[np.ix_(use, use)], b[use], w[use], sign[use], alpha) if len(use) else None
        if reached is not None:
            w[use] = reached
        return reached is not None

    while True:
        while move(np.sign(w)):                            # the active set is at its minimum before others enter
            pass
        grad = a @ w - b
        out = np.flatnonzero((w == 0) & live & (np.abs(grad) > alpha * (1 + 1e-12) + 1e-15))
        out = out[np.argsort(-np.abs(grad[out]), kind="stable")]
        sign = np.sign(w)
        sign[out[:many]] = -np.sign(grad[out[:many]])
        if len(out) and move(sign):
            many = 32
        elif many > 1 and len(out) > 1:
            many = 1
        else:
            break
    slope = b - a @ w
    fit, rest = yy - b @ w, max(yy - 2 * (b @ w) + w @ (a @ w), 0.0)
    scale = min(1.0, alpha / max(np.abs(slope).max(initial=0), 1e-300))
    gap = rest / 2 + alpha * np.abs(w).sum() - (2 * scale * fit - scale * scale * rest) / 2
    return w, max(float(gap), 0.0)


def _towards(q, b, start, sign, alpha):
    """The best point on the way from `start` to the minimum for some signs, where a sign changes or at its end; None if none is better.

    Where the system is singular and the minimum for these signs lies at infinity, the null direction that leads there is tried first.
    """
    down = b - alpha * sign - q @ start
    value, vector = np.linalg.eigh(q)
    sure = value > 1e-11 * value[-1]
    part = vector.T @ down
    ways = [(vector @ np.where(sure, part / np.where(sure, value, 1), 0), 1.0)]
    if not sure.all() and np.abs(part[~sure]).max() > 1e-9 * max(np.abs(part).max(), alpha * 1e-3):
        ways.insert(0, (vector @ np.where(sure, 0.0, part), np.inf))
    for step, end in ways:
        with np.errstate(all="ignore"):
            turns = -start / step
        t = np.unique(np.concatenate([[0.0], turns[(turns > 0) & (turns < end)], [end] if end == 1 else []]))
        curve = step @ q @ step if end == 1 else 0.0
        value = (start @ q @ start / 2 - b @ start + t * (start @ q @ step - b @ step) + t * t * curve / 2
                 + alpha * np.abs(start[:, None] + step[:, None] * t).sum(axis=0))
        k = int(value.argmin())
        if len(t) > 1 and value[k] >= value[0] - 1e-15 * np.abs(value[0]) and value[1] <= value[0] + 1e-15 * np.abs(value[0]) and t[1] < end:
            k = 1                                          # a coefficient of no weight leaves the active set
        if k and value[k] <= value[0] + 1e-15 * np.abs(value[0]):
            reached = start + t[k] * step
            reached[turns == t[k]] = 0.0
            return reached
    return None


def lasso_certificate(moment, alpha=1.0):
    """Duality gap of the standardised lasso on a moment, relative to the variance of the target."""
    live = moment.var > 1e-12 * np.maximum(moment.near ** 2, 1e-300)
    s = np.sqrt(moment.var[live])
    _, gap = lasso(moment.cov[np.ix_(live, live)] / np.outer(s, s), moment.cxy[live] / s, alpha, moment.yvar)
    return float(gap / max(moment.yvar, 1e-300))


def apply_models(df, group, models, means, features="features", name="prediction"):
    """Predict every row with its group's model; `models` maps group to (value at the group's means, coefficients).

    A row without a group gets NULL.
    """
    rows = [(str(g), float(b), list(map(float, w)), list(map(float, means[g]))) for g, (b, w) in models.items()]
    table = df.sparkSession.createDataFrame(rows, "_g string, _b double, _w array<double>, _mu array<double>")
    gap = F.zip_with(features, "_mu", lambda x, m: F.coalesce(x - m, F.lit(0.0)))
    value = F.aggregate(F.zip_with(gap, "_w", lambda x, w: x * w), F.col("_b"), lambda acc, x: acc + x)
    out = df.drop(name).join(F.broadcast(table), F.col(group).cast("string") == F.col("_g"), "left")   # one row per group
    return out.withColumn(name, value).drop("_g", "_b", "_w", "_mu")


def predict_left_out(df, group, features="features", target="y", kind="lasso", alpha=1.0, scale="feature", names=None, drops=()):
    """Out-of-group predictions of all rows: two passes for the moments, one task per group to solve, one pass to predict.

    `drops` leaves out features by name; `names` are then the names of the feature array's places.
    """
    use = None if not drops else np.array([i for i, n in enumerate(names) if n not in set(drops)], dtype=int)
    def work(moment, mean):
        return solve(moment, kind, alpha, scale, use, mean)

    means, models = for_each_held_out(df, group, work, features, target)
    return apply_models(df, group, models, means, features)


def lasso_gaps(df, group, features="features", target="y", alpha=1.0):
    """(group, gap): the duality gap of each held-out group's lasso, relative to the variance of its target."""
    _, gaps = for_each_held_out(df, group, lambda moment, _: lasso_certificate(moment, alpha), features, target)
    worst = max(gaps.values(), default=0.0)
    if worst > GAP:
        warnings.warn(f"a lasso ended at a duality gap of {worst:.1e} of the variance", stacklevel=2)
    return df.sparkSession.createDataFrame([(g, v) for g, v in gaps.items()], f"`{group}` string, gap double")


def eliminate(m, names, step=25, keep=1, protect=()):
    """Backward elimination on a moment matrix: names in order of removal, worst first.

    Each round fits ridge on the standardised features and removes the `step` smallest coefficients.
    """
    std = np.sqrt(m.var)
    left = [i for i, n in enumerate(names) if n not in protect]
    fixed = [i for i, n in enumerate(names) if n in protect]
    removed = []
    while len(left) > keep:
        _, coef = solve(m, "ridge", 1.0, use=np.array(left + fixed))
        order = sorted(left, key=lambda i: (abs(coef[i] * std[i]), names[i]))[:min(step, len(left) - keep)]
        removed += order
        left = [i for i in left if i not in set(order)]
    return [names[i] for i in removed] + [names[i] for i in sorted(left)]


def feature_ranking(df, names, features="features", target="y", step=25, k=5, key="venue_id", protect=()):
    """Worst-first feature names with the number kept at the best 5-fold MAE; df are out-of-region rows.

    Elimination runs on the moments of each training fold; the fold errors of every step come from
    one pass over the rows.
    """
    from placelens.operators.evaluation import assign_folds
    folded = assign_folds(df, key, k)
    counts = list(range(0, len(names) - len(protect), step))

    def work(moment, mean):
        order = eliminate(moment, names, step, protect=protect)
        return order, _sweep_models(moment, names, order, counts, mean)

    means, out = for_each_held_out(folded, "fold", work, features, target, everything=True)
    order, _ = out.pop(None)
    models = {g: models for g, (_, models) in out.items()}
    errors = sweep_predictions(folded, "fold", models, means, counts, features)
    mae = errors.groupBy("dropped").agg(F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("mae"))
    best = mae.orderBy("mae", "dropped").first()
    rows = [(i + 1, n, bool(i >= best.dropped)) for i, n in enumerate(order)]
    return df.sparkSession.createDataFrame(rows, "removal_order int, feature string, kept boolean")


def _sweep_models(m, names, worst, counts, centre, kind="ridge"):
    at = {n: i for i, n in enumerate(names)}
    return [solve(m, kind, 1.0, use=np.array([at[n] for n in names if n not in set(worst[:c])], dtype=int), centre=centre) for c in counts]


def sweep_predictions(df, group, models, means, counts, features="features"):
    """Rows with a prediction for each number of dropped features: all models of a group applied in one pass."""
    spark = df.sparkSession
    packed = spark.sparkContext.broadcast({str(g): (np.array([b for b, _ in ms]), np.array([w for _, w in ms]).T, means[g])
                                           for g, ms in models.items()})   # within GROUP_LIMIT numbers
    small = df.drop("prediction")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.drop(features).schema) + ", predictions array<double>"

    def apply(batches):
        for pdf in batches:
            x = np.stack([np.asarray(v, dtype=float) for v in pdf[features]]) if len(pdf) else np.empty((0, 0))
            out = [None] * len(pdf)
            for g, rows in pdf.groupby(pdf[group].astype(str)).indices.items():
                b, w, mu = packed.value[g]
                part = np.where(np.isnan(x[rows]), 0, x[rows] - mu) @ w + b
                for r, p in zip(rows, part):
                    out[r] = p
            yield pdf.drop(columns=[features]).assign(predictions=out)

    made = small.mapInPandas(apply, schema)
    steps = F.array(*[F.lit(int(c)) for c in counts])
    return made.select("*", F.posexplode("predictions").alias("_i", "prediction")).withColumn(
        "dropped", F.get(steps, F.col("_i"))).drop("predictions", "_i")


def feature_sweep(df, names, worst, group="region", counts=None, step=25, features="features", target="y", kind="ridge"):
    """Region-weighted metrics for each number of dropped worst features, plus the per-region table."""
    from placelens.operators.evaluation import regression_metrics
    counts = counts or list(range(0, len(worst), step))
    means, models = for_each_held_out(df, group, lambda m, mean: _sweep_models(m, names, worst, counts, mean, kind), features, target)
    rows = sweep_predictions(df, group, models, means, counts, features)
    per = regression_metrics(rows.select("dropped", group, target, "prediction"), ["dropped", group], y=target)
    w = F.sum("n")
    return per.groupBy("dropped").agg(*[(F.sum(F.col(c) * F.col("n")) / w).alias(c) for c in ("mae", "rmse", "ndcg")])


def best_feature_count(sweep):
    """The number of dropped features with the lowest MAE, fewest on ties."""
    return sweep.agg(F.min(F.struct("mae", "dropped")).alias("b")).select("b.dropped", "b.mae")
