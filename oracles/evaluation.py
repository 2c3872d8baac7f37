"""DuckDB SQL for splits, scaling, metrics and validation: plain windows over whole groups."""

import re

from oracles.views import hash32, uniform, with_views as w

_test = f"({hash32('venue_id', '42')} % 100 < 25)"
_inner = f"({hash32('venue_id', '42:inner')} % 100 < 25)"
_fold = f"({hash32('venue_id', 'fold42')} % 5)"
_gap = uniform("venue_id", "gap")
_s = f"""s AS MATERIALIZED (SELECT *, CASE WHEN {_gap} >= 0.1::DOUBLE THEN lat * 100 END AS f1, long + y AS f2,
   ({_test} AND {_gap} < 0.5::DOUBLE)::INT AS dummy_rare, ({_gap} < 0.5::DOUBLE)::INT AS dummy_common, {_test} AS test,
   {_fold} AS fold FROM v_scores)"""


def chain(*ctes_and_body):
    *ctes, body = ctes_and_body
    return w("", "v_scores").rstrip() + ", " + ", ".join([_s, *ctes]) + " " + body


def ndcg(src, group, k=300):
    """CTEs ending in nd(group, ndcg): every row ranked by a window, ties averaged."""
    return f"""r AS (SELECT *, rank() OVER (PARTITION BY {group} ORDER BY y DESC) AS rk, count(*) OVER (PARTITION BY {group}) AS n FROM {src}),
      rel AS (SELECT *, (n - rk + 1) / n::DOUBLE AS rel FROM r),
      pos AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY prediction DESC) AS p,
                     row_number() OVER (PARTITION BY {group} ORDER BY rel DESC) AS q FROM rel),
      tied AS (SELECT {group}, avg(rel) * sum(CASE WHEN p <= {k} THEN 1 / log2(p + 1) ELSE 0 END) AS g FROM pos GROUP BY {group}, prediction),
      dcg AS (SELECT {group}, sum(g) AS dcg FROM tied GROUP BY 1),
      best AS (SELECT {group}, sum(CASE WHEN q <= {k} THEN rel / log2(q + 1) ELSE 0 END) AS best FROM pos GROUP BY 1),
      nd AS (SELECT {group}, dcg / best AS ndcg FROM dcg JOIN best USING ({group})),
      met AS (SELECT {group}, count(*) AS n, avg(abs(y - prediction)) AS mae, sqrt(avg(pow(y - prediction, 2))) AS rmse
              FROM {src} GROUP BY 1),
      allm AS (SELECT * FROM met JOIN nd USING ({group}))"""


def _mean_pred(group):
    return f"""g AS (SELECT {group}, sum(y) AS sy, count(*) AS c FROM s GROUP BY 1),
      t AS (SELECT sum(y) AS sy, count(*) AS c FROM s),
      p AS (SELECT venue_id, s.{group}, s.y, (t.sy - g.sy) / (t.c - g.c) AS prediction FROM s JOIN g USING ({group}), t)"""


def _closed(group, w1, w2="0.0", src="s", p="p"):
    """CTEs ending in p(venue_id, group, y, prediction): a model of lat and long fitted without the row's group, by formula."""
    return f"""gr AS (SELECT DISTINCT {group} FROM {src} s),
      tr AS (SELECT gr.{group}, avg(lat) AS m1, avg(long) AS m2, avg(y) AS my, count(*) AS n FROM gr JOIN {src} s ON s.{group} <> gr.{group} GROUP BY 1),
      mo AS (SELECT tr.{group}, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my, any_value(n) AS n,
               avg((lat - m1) * (lat - m1)) AS v11, avg((lat - m1) * (long - m2)) AS v12, avg((long - m2) * (long - m2)) AS v22,
               avg((lat - m1) * (y - my)) AS c1, avg((long - m2) * (y - my)) AS c2 FROM tr JOIN {src} s ON s.{group} <> tr.{group} GROUP BY 1),
      st AS (SELECT *, v12 / sqrt(v11 * v22) AS a, c1 / sqrt(v11) AS b1, c2 / sqrt(v22) AS b2 FROM mo),
      wt AS (SELECT *, {w1} AS w1, {w2} AS w2 FROM st),
      {p} AS (SELECT venue_id, s.{group}, s.y, my + w1 * (lat - m1) + w2 * (long - m2) AS prediction FROM {src} s JOIN wt USING ({group}))"""


_ols = ("(c1 * v22 - c2 * v12) / (v11 * v22 - v12 * v12)", "(c2 * v11 - c1 * v12) / (v11 * v22 - v12 * v12)")
_d = "(1 + 50.0::DOUBLE / n)"
_ridge = (f"(b1 * {_d} - b2 * a) / ({_d} * {_d} - a * a) / sqrt(v11)", f"(b2 * {_d} - b1 * a) / ({_d} * {_d} - a * a) / sqrt(v22)")
_lasso = ("sign(b1) * greatest(abs(b1) - 0.02::DOUBLE, 0) / sqrt(v11)",)
_left = "SELECT venue_id, round(prediction, 5) AS prediction FROM p"
_round3 = "round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(ndcg, 6) AS ndcg"
_dummy = ", ".join(f"(category = '{c}')::INT AS \"dummy_{c.replace(' ', '_')}\"" for c in
                   ["Bar", "Cocktail Bar", "Gastropub", "Pub", "Sports Bar", "Wine Bar"])


def _two():
    """CTEs of the chain on lat and long: the smaller standardised slope of the outside rows goes first; errors with and without."""
    slopes = _closed("one", *_ols, src="(SELECT *, 0 AS one FROM t0 WHERE region = 'West' UNION ALL SELECT *, 1 AS one FROM t0 WHERE region = 'West')", p="p0")
    both = _closed("region", *_ols, src="inside", p="pb")
    first = _closed("region", "c1 / v11", src="inside", p="pl")
    second = _closed("region", "0.0", "c2 / v22", src="inside", p="pr")
    folds = [_closed("fold", *w, src="outside", p=p) for w, p in ((_ols, "pc"), (("c1 / v11",), "pd"), (("0.0", "c2 / v22"), "pe"))]
    out = ["t0 AS (SELECT * EXCLUDE y, lat * 100 + long * 60 + y / 100 AS y FROM s)", "inside AS (SELECT * FROM t0 WHERE region <> 'West')",
           "outside AS (SELECT * FROM t0 WHERE region = 'West')"]
    for i, part in enumerate((slopes, both, first, second, *folds)):
        for name in ("gr", "tr", "mo", "st", "wt"):
            part = re.sub(rf"\b{name}\b", f"{name}{i}", part)
        out.append(part)
    out.append("""rk AS (SELECT abs(any_value(w1 * sqrt(v11))) < abs(any_value(w2 * sqrt(v22))) AS lat_first FROM wt0)""")
    out.append("""one AS (SELECT * FROM pl WHERE NOT (SELECT lat_first FROM rk) UNION ALL SELECT * FROM pr WHERE (SELECT lat_first FROM rk))""")
    out.append("""sw AS (SELECT 0 AS dropped, avg(abs(y - prediction)) AS mae FROM pb UNION ALL SELECT 1, avg(abs(y - prediction)) FROM one)""")
    out.append("best AS (SELECT dropped, mae FROM sw ORDER BY mae, dropped LIMIT 1)")
    return out


def _z(col, src, std):
    return f"round(({col} - (SELECT avg({col}) FROM {src})) / (SELECT {std}({col}) FROM {src}), 6)"


SQL = {
    "dropped_features": chain(_closed("region", "c1 / v11"), _left),
    "ols_left_out": chain(_closed("region", *_ols), _left),
    "ridge_left_out": chain(_closed("region", *_ridge), _left),
    "lasso_left_out": chain(_closed("region", *_lasso), _left),
    "cross_validation_ols": chain(_closed("fold", *_ols), ndcg("p", "fold"), """SELECT round(avg(mae), 2) AS mae, round(avg(rmse), 2) AS rmse,
        round(avg(ndcg), 3) AS ndcg, round(stddev_pop(mae), 2) AS mae_std, round(stddev_pop(rmse), 2) AS rmse_std,
        round(stddev_pop(ndcg), 3) AS ndcg_std FROM allm"""),
    "soos_validation_ols": chain(_closed("region", *_ols), ndcg("p", "region"), f"SELECT region, n, {_round3} FROM allm"),
    "lasso_certificates": w("SELECT DISTINCT region, true AS certified FROM probes JOIN v_scores USING (venue_id)", "probes", "v_scores"),
    "model_agreement": w(f"""SELECT kind, count(*) AS n, true AS agree FROM probes JOIN v_scores USING (venue_id), (SELECT unnest(['lasso', 'ridge']) AS kind)
        WHERE {_test} GROUP BY kind""", "probes", "v_scores"),
    "selection_chain_ols": chain(*_two(), """SELECT venue_id AS id, region, round(prediction, 4) AS prediction, round(y - prediction, 4) AS error
        FROM (SELECT *, 0 AS d FROM pb UNION ALL SELECT *, 1 AS d FROM one) WHERE d = (SELECT dropped FROM best)"""),
    "selection_chain_ranking": chain(*_two(), """ft AS (SELECT 'lat' AS feature, CASE WHEN lat_first THEN 1 ELSE 2 END AS removal_order FROM rk
        UNION ALL SELECT 'long', CASE WHEN lat_first THEN 2 ELSE 1 END FROM rk)""",
        """fe AS (SELECT avg(e) AS e2, avg(e1) AS e1 FROM (SELECT avg(abs(y - prediction)) AS e FROM pc GROUP BY fold),
              (SELECT avg(abs(y - prediction)) AS e1 FROM (SELECT * FROM pd WHERE NOT (SELECT lat_first FROM rk)
               UNION ALL SELECT * FROM pe WHERE (SELECT lat_first FROM rk)) GROUP BY fold))""",
        """SELECT removal_order, feature, removal_order > 1 OR (SELECT e2 <= e1 FROM fe) AS kept, dropped, round(mae, 6) AS mae FROM ft, best"""),
    "relevance": chain("""SELECT venue_id, rank() OVER (PARTITION BY region ORDER BY y DESC) AS rank,
        round((count(*) OVER (PARTITION BY region) - rank() OVER (PARTITION BY region ORDER BY y DESC) + 1)
          / (count(*) OVER (PARTITION BY region))::DOUBLE, 6) AS relevance FROM s"""),
    "relevance_all": chain("""SELECT venue_id, rank() OVER (ORDER BY y DESC) AS rank,
        round((count(*) OVER () - rank() OVER (ORDER BY y DESC) + 1) / (count(*) OVER ())::DOUBLE, 6) AS relevance FROM s"""),
    "ndcg_at_k": chain(ndcg("s", "region"), "SELECT region, round(ndcg, 6) AS ndcg FROM nd"),
    "regression_metrics": chain(ndcg("s", "region"), f"SELECT region, n, {_round3} FROM allm"),
    "mape": chain("SELECT round(avg(abs((y - prediction) / y)) * 100, 6) AS mape FROM s"),
    "error_coords": chain("SELECT venue_id, y - prediction AS error, round(lat, 6) AS lat, round(long, 6) AS long FROM s WHERE test"),
    "dummy_category": w(f"SELECT venue_id, 'Bar' AS _category, {_dummy.replace('category =', 'org_category =')} FROM probes", "probes"),
    "train_test_split": chain("SELECT venue_id, CASE WHEN test THEN 'test' ELSE 'train' END AS split FROM s"),
    "nested_split": chain(f"""SELECT venue_id, CASE WHEN test THEN 'test' WHEN {_inner} THEN 'validation' ELSE 'train' END AS split,
        dummy_common, (region = 'East')::INT AS "region_East", (region = 'North')::INT AS "region_North", (region = 'South')::INT AS "region_South",
        (region = 'West')::INT AS "region_West", round(f2, 6) AS f2 FROM s"""),
    "dead_levels": chain("""SELECT 'dummy_rare' AS column_name, sum(dummy_rare)::DOUBLE AS total, 1 AS dropped FROM s WHERE NOT test
        UNION ALL SELECT 'dummy_common', sum(dummy_common)::DOUBLE, 0 FROM s WHERE NOT test
        UNION ALL SELECT 'y', sum(y), 0 FROM s WHERE NOT test"""),
    "impute_mean": chain("SELECT venue_id, round(coalesce(f1, (SELECT avg(f1) FROM s WHERE NOT test)), 6) AS f1 FROM s"),
    "zscore": chain("tr AS (SELECT * FROM s WHERE NOT test)",
                    f"SELECT venue_id, {_z('f1', 'tr', 'stddev_pop')} AS f1, {_z('f2', 'tr', 'stddev_pop')} AS f2 FROM s"),
    "zscore_sample": chain(f"SELECT venue_id, coalesce({_z('f1', 's', 'stddev_samp')}, 0) AS f1, {_z('f2', 's', 'stddev_samp')} AS f2 FROM s"),
    "zscore_global": chain("u AS (SELECT unnest([f2, y, lat]) AS x FROM s WHERE NOT test)", "ms AS (SELECT avg(x) AS m, stddev_pop(x) AS d FROM u)",
                           "SELECT venue_id, round((f2 - m) / d, 6) AS f2, round((y - m) / d, 6) AS y, round((lat - m) / d, 6) AS lat FROM s, ms"),
    "kfold_assign": chain("SELECT venue_id, fold::INT AS fold FROM s"),
    "soos_metrics": chain(_mean_pred("region"), ndcg("p", "region"), f"SELECT region, n, {_round3} FROM allm"),
    "soos_summary": chain(_mean_pred("region"), ndcg("p", "region"),
        "wt AS (SELECT *, n / sum(n) OVER () AS wgt FROM allm)",
        "av AS (SELECT sum(mae * wgt) AS a, sum(rmse * wgt) AS b, sum(ndcg * wgt) AS c FROM wt)",
        """SELECT round(any_value(a), 6) AS mae, round(any_value(b), 6) AS rmse, round(any_value(c), 6) AS ndcg,
           round(sqrt(sum(pow(mae - a, 2) * wgt)), 6) AS mae_std, round(sqrt(sum(pow(rmse - b, 2) * wgt)), 6) AS rmse_std,
           round(sqrt(sum(pow(ndcg - c, 2) * wgt)), 6) AS ndcg_std FROM wt, av"""),
    "fold_summary": chain(_mean_pred("fold"), ndcg("p", "fold"), """SELECT round(avg(mae), 2) AS mae, round(avg(rmse), 2) AS rmse,
        round(avg(ndcg), 3) AS ndcg, round(stddev_pop(mae), 2) AS mae_std, round(stddev_pop(rmse), 2) AS rmse_std,
        round(stddev_pop(ndcg), 3) AS ndcg_std FROM allm"""),
    "error_table": chain("rg AS (SELECT DISTINCT region AS held FROM s)",
        "mu AS (SELECT held, avg(f1) AS m FROM rg JOIN s ON region <> held GROUP BY 1)",
        """fit AS (SELECT held, any_value(m) AS m, regr_slope(y, coalesce(f1, m)) AS b, regr_intercept(y, coalesce(f1, m)) AS a
           FROM mu JOIN s ON region <> held GROUP BY 1)""",
        """SELECT venue_id AS id, round(lat, 6) AS lat, round(long, 6) AS long, region, round(a + b * coalesce(f1, m), 4) AS prediction,
           round(y - (a + b * coalesce(f1, m)), 4) AS error FROM s JOIN fit ON region = held"""),
    "best_feature_count": chain("sw AS (SELECT (venue_id % 20 * 25)::INT AS dropped, round(avg(abs(y - prediction)), 6) AS mae FROM s GROUP BY 1)",
                                "SELECT dropped, mae FROM sw ORDER BY mae, dropped LIMIT 1"),
    "encode_text": """SELECT doc_id AS article_id, (('0x' || substr(md5(word), 1, 8))::BIGINT % 64)::INT AS dim, count(*)::DOUBLE AS val
        FROM (SELECT doc_id, unnest(list_slice(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 1, 510)) AS word FROM documents)
        GROUP BY 1, 2""",
}
