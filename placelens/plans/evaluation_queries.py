"""Queries over model tables: splits, scaling, metrics, validation and feature selection."""

from pyspark.sql import functions as F

from placelens.functions.hashing import uniform
from placelens.operators import evaluation as ev
from placelens.operators import linear, selection, svr
from placelens.operators import geo_features as gf
from placelens.operators import preparation as pr
from placelens.operators import ranking as rk
from placelens.operators import relational as rel
from placelens.operators import text_features as tf
from placelens.operators.encoding import encode_text as encode
from placelens.plans import views as v
from placelens.plans.geo_queries import PLACE_CATEGORIES, places, probes
from placelens.plans.registry import query
from placelens.plans.venue_queries import r6
from placelens.session import cut_lineage, spread

BAR_CATEGORIES = ["Bar", "Cocktail Bar", "Gastropub", "Pub", "Sports Bar", "Wine Bar"]
GEO = ["area_density", "area_entropy", "competition", "traffic_access", "dist_center"]


def scores(spark, sf):
    """The scored venues with a gappy feature, a shifted one, and 0/1 columns (one of them never set in training)."""
    s = v.scores(spark, sf)
    gap = uniform("venue_id", "gap")
    return (s.withColumn("f1", F.when(gap >= 0.1, F.col("lat") * 100))
            .withColumn("f2", F.col("long") + F.col("y"))
            .withColumn("dummy_rare", (pr.in_test("venue_id") & (gap < 0.5)).cast("int"))
            .withColumn("dummy_common", (gap < 0.5).cast("int")))


def geo_model_table(spark, sf):
    """Bars with geographic features, one-hot categories, target and region (the geographic model's input)."""
    geo = gf.geo_features(probes(spark, sf), places(spark, sf), PLACE_CATEGORIES)
    table = pr.dummy_category(geo.select("venue_id", "org_category", "category", *GEO), BAR_CATEGORIES)
    y = v.scores(spark, sf).select("venue_id", "lat", "long", "region", "y")
    # models read the table many times: write it once, as the stage boundary it is
    return cut_lineage(table.join(y, "venue_id"))


DUMMIES = ["dummy_" + c.replace(" ", "_") for c in BAR_CATEGORIES]


def geo_arrays(spark, sf):
    return linear.as_array(geo_model_table(spark, sf), GEO + DUMMIES).select("venue_id", "lat", "long", "region", "y", "features")


def text_arrays(spark, sf):
    """Bars with the 64 aggregated embedding values as features."""
    text = tf.text_features(probes(spark, sf), v.articles(spark, sf), 2000).select("venue_id", "embedding")
    y = v.scores(spark, sf).select("venue_id", "region", "y")
    table = linear.as_array(text.join(y, "venue_id"), ["embedding"], widths={"embedding": 64})
    return cut_lineage(table.drop("embedding"))


NAMES = [f"embedding_{i}" for i in range(64)]


@query()
def relevance(spark, sf):
    out = rk.relevance(scores(spark, sf), "y", "region")
    return out.select("venue_id", "rank", r6("relevance").alias("relevance"))


@query()
def relevance_all(spark, sf):
    """One global group: the rank is computed without gathering it in one task."""
    out = rk.relevance(scores(spark, sf), "y")
    return out.select("venue_id", "rank", r6("relevance").alias("relevance"))


@query()
def ndcg_at_k(spark, sf):
    return rk.ndcg(scores(spark, sf), group="region").select("region", r6("ndcg").alias("ndcg"))


@query()
def regression_metrics(spark, sf):
    m = ev.regression_metrics(scores(spark, sf), "region")
    return m.select("region", "n", *[r6(c).alias(c) for c in ("mae", "rmse", "ndcg")])


@query()
def mape(spark, sf):
    return ev.mape(scores(spark, sf)).select(r6("mape").alias("mape"))


@query()
def error_coords(spark, sf):
    """Prediction errors of the test rows with the coordinates looked up by id."""
    errors = (pr.train_test_split(scores(spark, sf), "venue_id").filter("split = 'test'")
              .select("venue_id", (F.col("y") - F.col("prediction")).alias("error")))
    out = rel.attach_coordinates(errors, v.venues(spark, sf))
    return out.select("venue_id", "error", r6("lat").alias("lat"), r6("long").alias("long"))


@query()
def dummy_category(spark, sf):
    return pr.dummy_category(probes(spark, sf).select("venue_id", "category", "org_category"), BAR_CATEGORIES)


@query()
def train_test_split(spark, sf):
    return pr.train_test_split(scores(spark, sf), "venue_id").select("venue_id", "split")


@query()
def nested_split(spark, sf):
    table, names = pr.make_train_test(scores(spark, sf).select("venue_id", "y", "region", "f2", "dummy_rare", "dummy_common", "lat"),
                                      "venue_id", "y", dummies=["region"], drop=["lat"], levels={"region": ["East", "North", "South", "West"]})
    return table.select("venue_id", "split", *[c for c in names if c != "f2"], r6("f2").alias("f2"))


@query()
def dead_levels(spark, sf):
    train = scores(spark, sf).filter(~pr.in_test("venue_id"))
    prof = pr.level_profile(train, ["dummy_rare", "dummy_common", "y"])
    dead = pr.dead_levels(train, ["dummy_rare", "dummy_common", "y"])
    return prof.select("column_name", "total", F.col("column_name").isin(*dead).cast("int").alias("dropped"))


@query()
def impute_mean(spark, sf):
    out = pr.impute_mean(scores(spark, sf), ["f1"], ~pr.in_test("venue_id"))
    return out.select("venue_id", r6("f1").alias("f1"))


@query()
def zscore(spark, sf):
    out = pr.zscore(scores(spark, sf), ["f1", "f2"], ~pr.in_test("venue_id"))
    return out.select("venue_id", r6("f1").alias("f1"), r6("f2").alias("f2"))


@query()
def zscore_sample(spark, sf):
    out = pr.zscore(scores(spark, sf), ["f1", "f2"], std="sample")
    return out.select("venue_id", r6("f1").alias("f1"), r6("f2").alias("f2"))


@query()
def zscore_global(spark, sf):
    out = pr.zscore_global(scores(spark, sf), ["f2", "y", "lat"], ~pr.in_test("venue_id"))
    return out.select("venue_id", *[r6(c).alias(c) for c in ("f2", "y", "lat")])


@query()
def kfold_assign(spark, sf):
    return ev.assign_folds(v.scores(spark, sf), "venue_id").select("venue_id", "fold")


@query()
def soos_metrics(spark, sf):
    """Leave-one-region-out with the mean of the other regions as the prediction."""
    p = ev.group_mean_predictions(scores(spark, sf), "region")
    m = ev.regression_metrics(p, "region")
    return m.select("region", "n", *[r6(c).alias(c) for c in ("mae", "rmse", "ndcg")])


@query()
def soos_summary(spark, sf):
    out = ev.soos_validate(scores(spark, sf), ev.group_mean_predictions)
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query()
def fold_summary(spark, sf):
    return ev.cross_validate(scores(spark, sf), ev.group_mean_predictions)


@query()
def error_table(spark, sf):
    """Errors of a one-feature least-squares model fitted without the row's own region."""
    t = linear.as_array(scores(spark, sf), ["f1"])
    p = linear.predict_left_out(t, "region", kind="ols")
    out = ev.error_table(p, "region")
    return out.select("id", r6("lat").alias("lat"), r6("long").alias("long"), "region", F.round("prediction", 4).alias("prediction"),
                      F.round("error", 4).alias("error"))


def _place_arrays(spark, sf, columns=("lat", "long")):
    return linear.as_array(scores(spark, sf), list(columns)).select("venue_id", "region", "y", "features")


def _left_out(spark, sf, kind, alpha, columns=("lat", "long")):
    """Predictions of each region by a model of few features fitted on the others, small enough to solve by hand."""
    p = linear.predict_left_out(_place_arrays(spark, sf, columns), "region", kind=kind, alpha=alpha)
    return p.select("venue_id", F.round("prediction", 5).alias("prediction"))


@query()
def ols_left_out(spark, sf):
    return _left_out(spark, sf, "ols", 0.0)


@query()
def ridge_left_out(spark, sf):
    return _left_out(spark, sf, "ridge", 50.0)


@query()
def lasso_left_out(spark, sf):
    return _left_out(spark, sf, "lasso", 0.02, ("lat",))


@query()
def dropped_features(spark, sf):
    """Least squares on three named features of which two are dropped by name."""
    p = linear.predict_left_out(_place_arrays(spark, sf, ("lat", "f2", "long")), "region", kind="ols",
                                names=["lat", "f2", "long"], drops=["f2", "long"])
    return p.select("venue_id", F.round("prediction", 5).alias("prediction"))


def _ols(df, group):
    return linear.predict_left_out(df, group, kind="ols")


@query()
def lasso_certificates(spark, sf):
    """Held-out lasso models on text and geographic features: whether the duality gap certifies each."""
    table = text_geo_arrays(spark, sf)
    return linear.lasso_gaps(table, "region", alpha=0.5).select("region", (F.col("gap") < linear.GAP).alias("certified"))


@query()
def model_agreement(spark, sf):
    """Test rows predicted by the pipeline models and by the models solved from moments: whether the two agree."""
    table = pr.impute_mean(geo_model_table(spark, sf), GEO, ~pr.in_test("venue_id"))
    train, test = table.filter(~pr.in_test("venue_id")), table.filter(pr.in_test("venue_id"))
    arrays = linear.as_array(table.withColumn("held", F.when(pr.in_test("venue_id"), "test")), GEO + DUMMIES).select("venue_id", "held", "y", "features")
    parts = []
    for kind in ("lasso", "ridge"):                       # the dummies add up to 1, so least squares has many solutions
        one = linear.mllib_pipeline(train, GEO + DUMMIES, "y", kind).fit(train).transform(test).select("venue_id", F.col("prediction").alias("p"))
        other = linear.predict_left_out(arrays, "held", kind=kind).select("venue_id", "prediction")
        parts.append(one.join(other, "venue_id").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("p") - F.col("prediction"))) < 1e-3).alias("agree"))
                     .select(F.lit(kind).alias("kind"), "n", "agree"))
    return parts[0].union(parts[1])


@query()
def cross_validation_ols(spark, sf):
    return ev.cross_validate(_place_arrays(spark, sf), _ols)


@query()
def soos_validation_ols(spark, sf):
    m = ev.soos_validate(_place_arrays(spark, sf), _ols, per_region=True)
    return m.select("region", "n", *[r6(c).alias(c) for c in ("mae", "rmse", "ndcg")])


def _single_fit(spark, sf, kind):
    """Standardised model on the training rows; metrics of the test rows."""
    table = pr.impute_mean(geo_model_table(spark, sf), GEO, ~pr.in_test("venue_id"))
    train = table.filter(~pr.in_test("venue_id"))
    model = linear.mllib_pipeline(train, GEO + DUMMIES, "y", kind).fit(train)
    m = ev.regression_metrics(model.transform(table.filter(pr.in_test("venue_id"))).select("y", "prediction"))
    return m.select("n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "ndcg")])


@query()
def fit_ols(spark, sf):
    return _single_fit(spark, sf, "ols")


@query()
def fit_lasso(spark, sf):
    return _single_fit(spark, sf, "lasso")


@query()
def fit_ridge(spark, sf):
    return _single_fit(spark, sf, "ridge")


@query()
def fit_svr_rff(spark, sf):
    return ev.soos_validate(geo_arrays(spark, sf), svr.predict_left_out, per_region=True)


@query()
def cross_validation(spark, sf):
    return ev.cross_validate(geo_arrays(spark, sf), linear.predict_left_out)


@query()
def soos_validation(spark, sf):
    return ev.soos_validate(geo_arrays(spark, sf), linear.predict_left_out, per_region=True)


@query()
def feature_ranking(spark, sf):
    """Worst-first text features, ranked on the venues of one region kept out of the later evaluation."""
    outside = text_arrays(spark, sf).filter(F.col("region") == "West")
    return selection.svr_ranking(outside, NAMES, step=8)


@query()
def feature_sweep(spark, sf):
    table = text_arrays(spark, sf)
    ranking = linear.feature_ranking(table.filter(F.col("region") == "West"), NAMES, step=8)
    worst = [r.feature for r in ranking.orderBy("removal_order").collect()]   # one row per feature
    return linear.feature_sweep(table.filter(F.col("region") != "West"), NAMES, worst, step=8)


def text_geo_arrays(spark, sf):
    """Bars with text and geographic features and one-hot categories side by side."""
    text = tf.text_features(probes(spark, sf), v.articles(spark, sf), 2000).select("venue_id", "embedding")
    table = linear.as_array(geo_model_table(spark, sf).join(text, "venue_id", "left"), ["embedding", *GEO, *DUMMIES], widths={"embedding": 64})
    return cut_lineage(table.select("venue_id", "lat", "long", "region", "y", "features"))


@query()
def selection_chain(spark, sf):
    """Errors of the kernel model on text and geographic features, without the worst of them: ranked outside, chosen inside."""
    table = text_geo_arrays(spark, sf)
    west = F.col("region") == "West"
    out = selection.selection_chain(table.filter(west), table.filter(~west), [*NAMES, *GEO, *DUMMIES], step=16)["errors"]
    return out.select("id", r6("lat").alias("lat"), r6("long").alias("long"), "region", "prediction", "error")


def _chain_of_two(spark, sf):
    s = scores(spark, sf).withColumn("y", F.col("lat") * 100 + F.col("long") * 60 + F.col("y") / 100)
    table = linear.as_array(s, ["lat", "long"]).select("venue_id", "lat", "long", "region", "y", "features")
    west = F.col("region") == "West"
    return selection.selection_chain(table.filter(west), table.filter(~west), ["lat", "long"], step=1, kind="ols")


@query()
def selection_chain_ols(spark, sf):
    """The chain on two features with least squares after the elimination, small enough for closed formulas."""
    out = _chain_of_two(spark, sf)["errors"]
    return out.select("id", "region", F.round("prediction", 4).alias("prediction"), F.round("error", 4).alias("error"))


@query()
def selection_chain_ranking(spark, sf):
    out = _chain_of_two(spark, sf)
    return out["ranking"].crossJoin(F.broadcast(out["best"])).select(   # one row per feature, one row
        "removal_order", "feature", "kept", "dropped", r6("mae").alias("mae"))


@query()
def best_feature_count(spark, sf):
    """The best entry of a table of sweep results (made from the scored venues)."""
    rows = scores(spark, sf).withColumn("dropped", (F.col("venue_id") % 20).cast("int") * 25)
    sweep = rows.groupBy("dropped").agg(F.round(F.avg(F.abs(F.col("y") - F.col("prediction"))), 6).alias("mae"))
    return linear.best_feature_count(sweep)


@query()
def encode_text(spark, sf):
    docs = spread(v.read(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), "text"))
    out = encode(docs)
    return out.select("article_id", F.posexplode("embedding").alias("dim", "val")).filter("val > 0").select(
        "article_id", "dim", F.col("val").cast("double").alias("val"))
