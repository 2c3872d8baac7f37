"""Metrics, fold assignment, cross-validation and leave-one-region-out validation."""

from functools import reduce

from pyspark.sql import functions as F

from placelens.functions.hashing import hash32
from placelens.operators.ranking import _list, ndcg, score_counts


def mape(df, y="y", pred="prediction"):
    """Mean absolute error in per cent of the target; rows with a zero target have no such error and are left out."""
    return df.agg((F.avg(F.abs(F.try_divide(F.col(y) - F.col(pred), F.col(y)))) * 100).alias("mape"))


def regression_metrics(df, group=None, y="y", pred="prediction", k=300):
    """Rows (group, n, mae, rmse, ndcg)."""
    keys = _list(group)
    cells = score_counts(df, y, pred, group)
    err, c, n = F.col(y) - F.col(pred), F.col("c"), F.sum("c")
    basic = cells.groupBy(*keys).agg(n.alias("n"), (F.sum(F.abs(err) * c) / n).alias("mae"), F.sqrt(F.sum(err * err * c) / n).alias("rmse"))
    rank = ndcg(df, y, pred, group, k, cells)
    if keys:
        return basic.join(rank, keys)
    return basic.withColumn("_one", F.lit(0)).join(rank.withColumn("_one", F.lit(0)), "_one").drop("_one")


def assign_folds(df, key, k=5, seed=42):
    return df.withColumn("fold", (hash32(key, f"fold{seed}") % k).cast("int"))


def fold_summary(metrics):
    """Mean and population std over the folds, rounded as reported (2, 2 and 3 digits)."""
    digits = {"mae": 2, "rmse": 2, "ndcg": 3}
    return metrics.agg(*[F.round(F.avg(c), d).alias(c) for c, d in digits.items()],
                       *[F.round(F.stddev_pop(c), d).alias(f"{c}_std") for c, d in digits.items()])


def weighted_summary(metrics):
    """Mean and std over the regions, weighted by their number of rows."""
    w = F.col("n") / F.sum("n").over(_whole())
    rows = metrics.withColumn("w", w)   # one row per region
    names = ("mae", "rmse", "ndcg")
    rows = rows.withColumns({f"_{c}": F.sum(F.col(c) * F.col("w")).over(_whole()) for c in names})
    return rows.agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in names],
                    *[F.sqrt(F.sum(F.pow(F.col(c) - F.col(f"_{c}"), 2) * F.col("w"))).alias(f"{c}_std") for c in names])


def _whole():
    from pyspark.sql import Window
    return Window.partitionBy(F.lit(0))


def group_mean_predictions(df, group, y="y"):
    """Each row predicted by the mean of all other groups' targets."""
    sums = df.groupBy(group).agg(F.sum(y).alias("s"), F.count(y).alias("c"))   # one row per group
    all_rows = sums.select(group, ((F.sum("s").over(_whole()) - F.col("s")) / (F.sum("c").over(_whole()) - F.col("c"))).alias("prediction"))
    return df.drop("prediction").join(all_rows, group)


def error_table(predictions, group, key="venue_id", y="y"):
    """(id, lat, long, group, prediction, error) keyed by id, error = target - prediction."""
    return predictions.select(F.col(key).alias("id"), "lat", "long", group, "prediction", (F.col(y) - F.col("prediction")).alias("error"))


def leave_groups_out(df, group, fit):
    """Predictions for every row by a model that never saw the row's group.

    `fit(train)` returns something with transform(test) that adds `prediction`, such as a fitted
    Spark ML pipeline. For linear and kernel models see linear.py and svr.py, which fit all groups'
    models in the same passes.
    """
    names = [r[0] for r in df.select(group).distinct().orderBy(group).collect()]   # regions or folds: few
    parts = [fit(df.filter(F.col(group) != g)).transform(df.filter(F.col(group) == g)).select(*df.columns, "prediction") for g in names]
    return reduce(lambda a, b: a.unionByName(b), parts)


def cross_validate(df, predict, key="venue_id", k=5, seed=42, y="y", **options):
    """k-fold summary; `predict(df, "fold", **options)` returns df with out-of-fold predictions."""
    return fold_summary(regression_metrics(predict(assign_folds(df, key, k, seed), "fold", **options), "fold", y))


def soos_validate(df, predict, group="region", y="y", per_region=False, **options):
    """Spatial out-of-sample validation: size-weighted summary, or the metrics of every region.

    Rows without a region help to train every model and are not part of the metrics.
    """
    metrics = regression_metrics(predict(df, group, **options).filter(F.col(group).isNotNull()), group, y)
    return metrics if per_region else weighted_summary(metrics)
