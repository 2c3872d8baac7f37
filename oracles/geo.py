"""Brute-force DuckDB SQL for the neighbourhood queries: every pair is tested."""

from oracles.views import haversine, uniform, with_views as w
from placelens.plans.geo_queries import PLACE_CATEGORIES

_art = haversine("p.lat", "p.long", "a.lat", "a.long")
_place = haversine("lat", "long", "p_lat", "p_long")
_near = """near AS (SELECT venue_id, place_id, category FROM probes CROSS JOIN places
  WHERE abs(p_lat - lat) < degrees(200 / 6371000::DOUBLE)
    AND abs(p_long - long) < degrees(200 / 6371000::DOUBLE) / cos(radians(lat)))"""
_counts = "cnt AS (SELECT venue_id, category, count(*) AS n FROM near GROUP BY 1, 2)"


def _in_range(metres, extra=""):
    return f"""inr AS (SELECT p.venue_id, a.article_id, {extra} {_art} AS dist FROM probes p CROSS JOIN v_articles a
        WHERE {_art} < {metres})"""


def chain(base, *ctes_and_body):
    """Append more CTEs to a with_views prefix; the last element is the body."""
    *ctes, body = ctes_and_body
    return base.rstrip() + ", " + ", ".join(ctes) + " " + body


def _wide():
    return ", ".join(f"""count(*) FILTER (near.category = '{c}') AS "{c.lower().replace(' ', '_')}_count\"""" for c in PLACE_CATEGORIES)


def _vectors(metres, weight, divide, extra_where="", src="probes"):
    base = w("", src, "v_articles")
    pairs = f"""inr AS (SELECT *, {weight} AS wt FROM (SELECT p.venue_id, a.article_id, a.embedding, 1 - {_art} / {metres}::DOUBLE AS b,
        {_art} AS dist FROM {src} p CROSS JOIN v_articles a WHERE {_art} < {metres}))"""
    flat = f"""flat AS (SELECT venue_id, article_id, wt, unnest(embedding) AS val, unnest(range(0, 64)) AS dim FROM inr {extra_where})"""
    return chain(base, pairs, flat, f"""SELECT venue_id, {'count(*) AS article_count,' if divide == 'c' else ''} dim::INT AS dim,
        0::DOUBLE + round(sum(wt * val) {'/ count(*)' if divide else ''}, 6) AS val FROM flat GROUP BY venue_id, dim""")


_tanh = "1 - exp(-pow(b + 0.3::DOUBLE, 6))"
_stop = "('the', 'of', 'and', 'is', 'to', 'in', 'a', 'for', 'der', 'die', 'und', 'la', 'le', 'de')"
_tf = f"""tok AS (SELECT article_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{2,}}')) AS word FROM v_articles),
  tf AS (SELECT article_id, word, count(*) AS tf FROM tok WHERE word NOT IN {_stop} GROUP BY 1, 2),
  df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
  tfidf AS (SELECT article_id, word, tf, tf * ln(((SELECT count(*) FROM v_articles) + 1)::DOUBLE / (df + 1)) AS tfidf
            FROM tf JOIN df USING (word))"""

_NEAR_PAIRS = """SELECT p.venue_id, a.article_id, p.lat AS lat1, a.lat AS lat2, a.long - p.long AS turn
        FROM probes p CROSS JOIN v_articles a WHERE abs(p.lat - a.lat) < 0.1::DOUBLE AND abs(p.long - a.long) < 0.1::DOUBLE"""


def _geodesic(metres, rounds=8, pairs=_NEAR_PAIRS):
    """CTEs ending in geo(venue_id, article_id, dist): the inverse formula on the ellipsoid with a fixed number of rounds."""
    f = "(1 / 298.257223563::DOUBLE)"
    a, b = "6378137.0::DOUBLE", f"(6378137.0::DOUBLE * (1 - {f}))"
    u = lambda x: f"atan((1 - {f}) * tan(radians({x})))"
    ctes = [f"""g0 AS (SELECT venue_id, article_id, sin(u1) AS su1, cos(u1) AS cu1, sin(u2) AS su2, cos(u2) AS cu2, diff, diff AS lam FROM (
        SELECT venue_id, article_id, {u('lat1')} AS u1, {u('lat2')} AS u2, radians(turn) AS diff FROM ({pairs}))
        WHERE abs(u1 - u2) + abs(diff) > 0)"""]
    for k in range(rounds):
        ctes += [f"""a{k} AS (SELECT *, sqrt(pow(cu2 * sin(lam), 2) + pow(cu1 * su2 - su1 * cu2 * cos(lam), 2)) AS ss,
                   su1 * su2 + cu1 * cu2 * cos(lam) AS cs FROM g{k})""",
                 f"b{k} AS (SELECT *, atan2(ss, cs) AS sigma, cu1 * cu2 * sin(lam) / ss AS sa FROM a{k})",
                 f"c{k} AS (SELECT *, 1 - sa * sa AS c2a, cs - 2 * su1 * su2 / (1 - sa * sa) AS c2m FROM b{k})",
                 f"d{k} AS (SELECT *, {f} / 16 * c2a * (4 + {f} * (4 - 3 * c2a)) AS c FROM c{k})"]
        if k < rounds - 1:
            ctes.append(f"""g{k + 1} AS (SELECT venue_id, article_id, su1, cu1, su2, cu2, diff, diff + (1 - c) * {f} * sa * (sigma + c * ss *
                (c2m + c * cs * (2 * c2m * c2m - 1))) AS lam FROM d{k})""")
    ctes += [f"e AS (SELECT *, c2a * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS k FROM d{rounds - 1})",
             """h AS (SELECT *, 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))) AS big,
                k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) AS small FROM e)""",
             f"""geo AS (SELECT * FROM (SELECT venue_id, article_id, {b} * big * (sigma - small * ss * (c2m + small / 4 * (cs * (2 * c2m * c2m - 1)
                - small / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))) AS dist FROM h) WHERE dist < {metres})"""]
    return ctes


SQL = {
    "rect_neighbours": chain(w("", "probes", "places"), _near, "SELECT venue_id, place_id FROM near"),
    "radius_join": chain(w("", "probes", "v_articles"), _in_range(500),
                         "SELECT venue_id, article_id, round(dist, 6) AS dist FROM inr"),
    "dist_features": w(f"""SELECT venue_id, category, count(*) FILTER ({_place} < 500) AS count,
        round(min({_place}), 6) AS dist FROM probes CROSS JOIN places GROUP BY 1, 2""", "probes", "places"),
    "closest_city": w(f"""SELECT venue_id, arg_min(name, (d, name)) AS name, round(min(d), 6) AS dist FROM (
        SELECT venue_id, name, {haversine('lat', 'long', 'center_lat', 'center_long')} AS d FROM v_venues CROSS JOIN v_cities)
        GROUP BY 1""", "v_venues", "v_cities"),
    "nearest_bus": w("""SELECT venue_id, round(min(sqrt(pow(lat - p_lat, 2) + pow(long - p_long, 2))), 9) AS dist
        FROM probes CROSS JOIN places WHERE category = 'Bus' GROUP BY 1""", "probes", "places"),
    "nearest_subway": w("""SELECT venue_id, round(min(sqrt(pow(lat - p_lat, 2) + pow(long - p_long, 2))), 9) AS dist
        FROM probes CROSS JOIN places WHERE category = 'Subway' GROUP BY 1""", "probes", "places"),
    "category_counts": chain(w("", "probes", "places"), _near, f"SELECT venue_id, {_wide()} FROM near GROUP BY 1"),
    "area_density": chain(w("", "probes", "places"), _near,
                          "SELECT venue_id, count(*) AS area_density FROM near GROUP BY 1"),
    "area_entropy": chain(w("", "probes", "places"), _near, _counts, """SELECT venue_id, greatest(0, round(-sum(f * log2(f)), 6)) AS area_entropy
        FROM (SELECT venue_id, n / sum(n) OVER (PARTITION BY venue_id) AS f FROM cnt) GROUP BY 1"""),
    "competition": chain(w("", "probes", "places"), _near, """SELECT venue_id,
        round(0 - count(*) FILTER (category = 'Bar') / count(*)::DOUBLE, 6) AS competition FROM near GROUP BY 1"""),
    "traffic_access": w("""SELECT venue_id, round(sum(CASE WHEN d > 0 AND d <> 1 THEN log2(n + 1) / log2(d) END), 6) AS traffic_access
        FROM (SELECT venue_id, category, min(sqrt(pow(lat - p_lat, 2) + pow(long - p_long, 2))) AS d, count(*) AS n
              FROM probes CROSS JOIN places WHERE category IN ('Bus', 'Subway') GROUP BY 1, 2) GROUP BY 1
        HAVING count(CASE WHEN d > 0 AND d <> 1 THEN 1 END) = 2
        """, "probes", "places"),
    "dist_center": w("""SELECT venue_id, round(sqrt(pow(lat - 40.730610::DOUBLE, 2) + pow(long + 73.935242::DOUBLE, 2)), 6) AS dist_center
        FROM probes""", "probes"),
    "geo_features": chain(w("", "probes", "places"), _near, _counts,
        """ent AS (SELECT venue_id, sum(n)::BIGINT AS area_density, greatest(0, round(-sum(f * log2(f)), 6)) AS area_entropy,
            round(0 - coalesce(sum(n) FILTER (category = 'Bar'), 0) / sum(n)::DOUBLE, 6) AS competition
          FROM (SELECT *, n / sum(n) OVER (PARTITION BY venue_id) AS f FROM cnt) GROUP BY 1)""",
        """acc AS (SELECT venue_id, round(sum(log2(n + 1) / log2(d)), 6) AS traffic_access
          FROM (SELECT venue_id, category, min(sqrt(pow(lat - p_lat, 2) + pow(long - p_long, 2))) AS d, count(*) AS n
              FROM probes CROSS JOIN places WHERE category IN ('Bus', 'Subway') GROUP BY 1, 2) GROUP BY 1)""",
        """SELECT venue_id, org_category, area_density, area_entropy, competition, traffic_access,
          round(sqrt(pow(lat - 40.730610::DOUBLE, 2) + pow(long + 73.935242::DOUBLE, 2)), 6) AS dist_center
        FROM probes JOIN ent USING (venue_id) JOIN acc USING (venue_id)"""),
    "great_circle": f"""SELECT c_custkey, round({haversine('a', 'b', 'c', 'd')}, 3) AS dist FROM (SELECT c_custkey,
        {uniform('c_custkey', 'lat1')} * 170::DOUBLE - 85::DOUBLE AS a, {uniform('c_custkey', 'long1')} * 360::DOUBLE - 180::DOUBLE AS b,
        {uniform('c_custkey', 'lat2')} * 170::DOUBLE - 85::DOUBLE AS c, {uniform('c_custkey', 'long2')} * 360::DOUBLE - 180::DOUBLE AS d
        FROM customer)""",
    "geodesic_far": "WITH " + ", ".join(_geodesic(1e9, 25, f"""SELECT c_custkey AS venue_id, 0 AS article_id, a AS lat1, c AS lat2,
        CASE WHEN d - b > 180 THEN d - b - 360 WHEN d - b < -180 THEN d - b + 360 ELSE d - b END AS turn FROM (SELECT c_custkey,
        {uniform('c_custkey', 'lat1')} * 170::DOUBLE - 85::DOUBLE AS a, {uniform('c_custkey', 'long1')} * 360::DOUBLE - 180::DOUBLE AS b,
        {uniform('c_custkey', 'lat2')} * 170::DOUBLE - 85::DOUBLE AS c, {uniform('c_custkey', 'long2')} * 360::DOUBLE - 180::DOUBLE AS d
        FROM customer) WHERE {haversine('a', 'b', 'c', 'd')} < 19700000"""))
        + " SELECT venue_id AS c_custkey, round(dist, 2) AS dist FROM geo",
    "geodesic_distance": chain(w("", "probes", "v_articles"), *_geodesic(500), "SELECT venue_id, article_id, round(dist, 4) AS dist FROM geo"),
    "distance_weights": chain(w("", "probes", "v_articles"), _in_range(500), """SELECT venue_id, article_id, round(b, 6) AS w_linear,
        round(b * b * b, 6) AS w_cubic, round(1 - exp(-pow(b + 0.3::DOUBLE, 6)), 6) AS w_tanh
        FROM (SELECT *, 1 - dist / 500::DOUBLE AS b FROM inr)"""),
    "articles_with_vectors": """SELECT article_id, lang, dim - 1 AS dim, round(embedding[dim]::DOUBLE, 6) AS val FROM (
        SELECT doc_id AS article_id, lang, embedding, unnest(range(1, len(embedding) + 1))::INT AS dim FROM documents JOIN embeddings ON doc_id = vec_id)""",
    "text_features_mean": _vectors(2000, _tanh, "c"),
    "text_features_sum": _vectors(1000, "b * b * b", ""),
    "k_closest_articles": chain(w("", "probes", "v_articles"), _in_range(2000), """SELECT venue_id, article_id, round(dist, 6) AS dist
        FROM inr QUALIFY row_number() OVER (PARTITION BY venue_id ORDER BY dist, article_id) <= 10"""),
    "text_features_closest": _vectors(2000, "b", "c",
        "QUALIFY row_number() OVER (PARTITION BY venue_id ORDER BY dist, article_id) <= 5"),
    "article_count_stats": chain(w("", "probes", "v_articles"), _in_range(500),
        "c AS (SELECT p.venue_id, count(article_id) AS n FROM probes p LEFT JOIN inr USING (venue_id) GROUP BY 1)",
        """SELECT quantile_cont(n, 0.0) AS lowest, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS q2,
           quantile_cont(n, 0.75) AS q3, quantile_cont(n, 1.0) AS highest, count(*) AS venues,
           count(*) FILTER (n = 0) AS without_articles FROM c"""),
    "combine_features": chain(w("", "probes", "places", "v_articles"), _near, _in_range(500),
        "t AS (SELECT venue_id, count(*) AS article_count FROM inr GROUP BY 1)",
        "g AS (SELECT venue_id, count(*) AS area_density FROM near GROUP BY 1)",
        """SELECT venue_id, article_count, area_density,
        round(sqrt(pow(lat - 40.730610::DOUBLE, 2) + pow(long + 73.935242::DOUBLE, 2)), 6) AS dist_center
        FROM probes JOIN g USING (venue_id) LEFT JOIN t USING (venue_id)"""),
    "mean_token_length": """SELECT round(avg(least(len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+|[^\\p{L}\\p{N}\\p{M}_\\s]')) + 2, 512)), 6) AS mean_tokens
        FROM documents""",
    "tfidf_long": chain(w("", "v_articles"), _tf, "SELECT article_id, word, tf, round(tfidf, 6) AS tfidf FROM tfidf"),
    "venue_tfidf": chain(w("", "probes", "v_articles"), _tf, _in_range(3400),
        f"pw AS (SELECT venue_id, article_id, {_tanh.replace('b +', '1 - dist / 3400::DOUBLE +')} AS wt FROM inr)",
        "pc AS (SELECT venue_id, count(*) AS c FROM pw GROUP BY 1)",
        "pv AS (SELECT venue_id, word, sum(wt * tfidf) / any_value(c) AS value FROM pw JOIN pc USING (venue_id) JOIN tfidf USING (article_id) GROUP BY 1, 2)",
        "SELECT venue_id, count(*) FILTER (value <> 0) AS words, round(sum(value), 4) AS total, round(max(value), 6) AS largest FROM pv GROUP BY 1"),
    "venue_tfidf_words": chain(w("", "probes", "v_articles"), _tf, _in_range(400),
        """SELECT venue_id, word, round(sum((1 - dist / 400::DOUBLE) * tfidf), 6) AS value FROM inr JOIN tfidf USING (article_id)
        GROUP BY 1, 2 HAVING sum(tfidf) <> 0"""),
}
SQL["out_of_region_features"] = chain(
    w("", "bars", "in_region", "v_articles"),
    "outside AS (SELECT venue_id, lat, long FROM bars WHERE venue_id NOT IN (SELECT venue_id FROM in_region))",
    f"""inr AS (SELECT *, {_tanh} AS wt FROM (SELECT p.venue_id, a.article_id, a.embedding, 1 - {_art} / 2000::DOUBLE AS b
        FROM outside p CROSS JOIN v_articles a WHERE {_art} < 2000))""",
    "flat AS (SELECT venue_id, article_id, wt, unnest(embedding) AS val, unnest(range(0, 64)) AS dim FROM inr)",
    "SELECT venue_id, dim::INT AS dim, 0::DOUBLE + round(sum(wt * val) / count(*), 6) AS val FROM flat GROUP BY venue_id, dim")
