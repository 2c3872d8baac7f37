"""Independent DuckDB SQL for the check-in, venue, region and source queries."""

from oracles.views import uniform, with_views as w

_weekday = "strftime(utc_time, '%a %b %d %H:%M:%S +0000 %Y')"
_files = """(SELECT doc_id, n_chars, text, 'enwiki-' || CASE WHEN doc_id % 7 = 0 THEN 'pages-articles-multistream'
   WHEN doc_id % 11 = 0 THEN 'pages-meta' ELSE 'pages-articles' END || (doc_id + 1) || '.xml-p' || (doc_id * 100 + 1)
   || 'p' || (doc_id * 100 + 90 + doc_id % 10) || '.bz2' AS file_name FROM documents)"""
_flat = """SELECT 'Place ' || article_id AS title, round(lat, 6) AS lat, round(long, 6) AS long,
   CASE WHEN article_id % 3 > 0 THEN article_id::VARCHAR END AS prop_name, md5(text) AS text_md5,
   'Town;' || article_id AS links, 'https://example.org/' AS urls, length(text)::INT AS text_length FROM v_articles"""
_merge = """CASE WHEN region IN ('Staten Island', 'Jersey City') THEN 'JC + SI'
   WHEN region IN ('Bronx', 'Queens') THEN 'Bronx + Queens' ELSE region END"""
_bar_names = "Bar"

SQL = {
    "read_tsv_checkins": w(f"""SELECT user_id::VARCHAR AS user_id, venue_id::VARCHAR AS venue_id,
        {_weekday} AS utc_time, timezone_offset_mins::VARCHAR AS timezone_offset_mins FROM v_checkins""", "v_checkins"),
    "typed_checkins": w("""SELECT user_id::VARCHAR AS user_id, venue_id::VARCHAR AS venue_id,
        epoch(utc_time)::BIGINT AS utc_seconds, timezone_offset_mins FROM v_checkins""", "v_checkins"),
    "filter_country": w("""SELECT name, round(center_lat, 6) AS center_lat, round(center_long, 6) AS center_long
        FROM v_cities WHERE country_code = 'US'""", "v_cities"),
    "bbox_filter": w("""SELECT venue_id, category FROM v_venues
        WHERE lat > 40.69::DOUBLE AND lat < 40.75::DOUBLE AND long > -74.01::DOUBLE AND long < -73.93::DOUBLE
        AND NOT (lat > 40.71::DOUBLE AND lat < 40.72::DOUBLE AND long > -73.97::DOUBLE AND long < -73.96::DOUBLE)""",
                     "v_venues"),
    "category_match": w("""SELECT venue_id, category FROM v_venues WHERE regexp_matches(lower(category), 'bar|pub')
        AND category NOT IN ('Salon / Barbershop', 'Public Art')""", "v_venues"),
    "distinct_matching": w("""SELECT category, min(venue_id) AS first_seen FROM v_venues
        WHERE lower(category) LIKE '%bus%' GROUP BY 1""", "v_venues"),
    "recode_bus": w("""SELECT venue_id, CASE category WHEN 'Bus Station' THEN 'Bus' WHEN 'Bus Line' THEN 'Bus'
        ELSE category END AS category FROM v_venues""", "v_venues"),
    "merge_regions": w(f"SELECT venue_id, {_merge} AS region FROM bars LEFT JOIN in_region USING (venue_id)",
                       "bars", "in_region"),
    "unify_category": w("""SELECT venue_id, 'Bar' AS category, category AS org_category, total_visits FROM bars""",
                        "bars"),
    "drop_null_rows": w("SELECT venue_id, region FROM in_region", "in_region"),
    "null_rows": w("SELECT venue_id, category FROM bars WHERE venue_id NOT IN (SELECT venue_id FROM in_region)",
                   "bars", "in_region"),
    "null_profile": w("""SELECT count(*) AS row_count, 6::BIGINT AS column_count,
        count(*) - count(region) AS null_count FROM bars LEFT JOIN in_region USING (venue_id)""", "bars", "in_region"),
    "column_range": w("SELECT venue_id, round(long, 6) AS long, category, total_visits FROM visits_us", "visits_us"),
    "checkins_venues": w("""SELECT user_id, venue_id, timezone_offset_mins, category, country_code
        FROM v_checkins JOIN v_venues USING (venue_id)""", "v_checkins", "v_venues"),
    "point_in_polygon": w("SELECT venue_id, region FROM bars LEFT JOIN in_region USING (venue_id)", "bars", "in_region"),
    "venue_visits": w("""SELECT venue_id, category, count(user_id) AS total_visits FROM v_checkins
        JOIN v_venues USING (venue_id) GROUP BY 1, 2""", "v_checkins", "v_venues"),
    "top_countries": w("""SELECT country_code, count(*) AS checkins FROM v_checkins JOIN v_venues USING (venue_id)
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", "v_checkins", "v_venues"),
    "top_categories": w("SELECT category, count(*) AS n FROM visits_us GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
                        "visits_us"),
    "median_visits": w("""SELECT category, median(total_visits) AS median_visits, count(*) AS n FROM visits_us
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""", "visits_us"),
    "bar_category_summary": w("""SELECT category, median(total_visits) AS median_visits, count(*) AS n FROM bars
        GROUP BY 1""", "bars"),
    "box_stats": w("""SELECT category, q1, q2, q3,
          min(total_visits) FILTER (total_visits BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_lo,
          max(total_visits) FILTER (total_visits BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_hi,
          count(*) FILTER (NOT total_visits BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
        FROM bars JOIN (SELECT category, quantile_cont(total_visits, 0.25) AS q1, quantile_cont(total_visits, 0.5) AS q2,
          quantile_cont(total_visits, 0.75) AS q3 FROM bars GROUP BY 1) USING (category) GROUP BY ALL""", "bars"),
    "region_counts": w(f"SELECT {_merge} AS region, count(*) AS n FROM in_region GROUP BY 1", "in_region"),
    "seeded_order": "SELECT p_partkey AS venue_id, md5(p_partkey::VARCHAR || ':42') AS order_key FROM part",
    "union_categories": w("""SELECT venue_id, category FROM v_venues WHERE category = 'Bar' UNION ALL
        SELECT venue_id, category FROM v_venues WHERE category = 'Pub' UNION ALL
        SELECT venue_id, category FROM v_venues WHERE category = 'Wine Bar'""", "v_venues"),
    "first_articles": w("""SELECT article_id, md5(text) AS text_md5 FROM v_articles ORDER BY article_id LIMIT 500""",
                        "v_articles"),
    "decode_article_records": w(_flat, "v_articles"),
    "write_read_articles": w(_flat, "v_articles"),
    "stage_roundtrip": w(f"""SELECT venue_id, round(lat, 6) AS lat, round(long, 6) AS long, {_merge} AS region,
        'Bar' AS category, category AS org_category, total_visits FROM bars JOIN in_region USING (venue_id)""",
                         "bars", "in_region"),
    "boundary_edges": f"""WITH s AS (SELECT s_suppkey, s_name AS name, floor({uniform('s_suppkey', 'bx')} * 1000::DOUBLE) AS x,
          floor({uniform('s_suppkey', 'by')} * 1000::DOUBLE) AS y FROM supplier),
        t AS (SELECT * FROM (VALUES (0, 0, 0, 0.0, 0.0, 0.5, 0.0), (0, 0, 0, 0.5, 0.0, 0.5, 0.5), (0, 0, 0, 0.5, 0.5, 0.0, 0.0),
          (1, 0, 0, 0.0, 0.0, 0.2, 0.0), (1, 0, 0, 0.2, 0.0, 0.2, 0.2), (1, 0, 0, 0.2, 0.2, 0.0, 0.2), (1, 0, 0, 0.0, 0.2, 0.0, 0.0),
          (1, 1, 0, 0.6, 0.6, 0.8, 0.6), (1, 1, 0, 0.8, 0.6, 0.8, 0.8), (1, 1, 0, 0.8, 0.8, 0.6, 0.8), (1, 1, 0, 0.6, 0.8, 0.6, 0.6))
          v(kind, polygon_id, ring_id, a, b, c, d))
        SELECT s_suppkey, name, polygon_id, ring_id, round(x + a::DOUBLE, 6) AS x1, round(y + b::DOUBLE, 6) AS y1,
          round(x + c::DOUBLE, 6) AS x2, round(y + d::DOUBLE, 6) AS y2
        FROM s JOIN t ON kind = CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END""",
    "embedding_vectors": """SELECT vec_id AS article_id, (i - 1)::INT AS dim, round(embedding[i]::DOUBLE, 6) AS val
        FROM embeddings, generate_series(1, 64) t(i)""",
    "dump_inventory": f"""SELECT file_name, round(strlen(text) / 1e6, 6) AS size_mb,
        (89 + doc_id % 10)::BIGINT AS article_span FROM {_files}""",
    "inventory_totals": f"""SELECT count(*) AS files, round(sum(strlen(text)) / 1e9, 6) AS size_gb,
        sum(89 + doc_id % 10)::BIGINT AS articles FROM {_files}""",
    "verify_checksums": f"""SELECT file_name, CASE WHEN listed AND doc_id % 13 = 0 THEN 'missing' WHEN NOT listed THEN 'unlisted'
          WHEN doc_id % 5 = 0 THEN 'bad' ELSE 'ok' END AS status
        FROM (SELECT *, doc_id % 7 <> 0 AND doc_id % 11 <> 0 AS listed FROM {_files})
        WHERE listed OR doc_id % 13 <> 0""",
    "read_pages_xml": """SELECT 'Doc ' || doc_id AS title, '2021-01-01T00:00:00Z' AS timestamp, md5(text) AS text_md5
        FROM documents""",
    "html_links": """SELECT page_id, (i - 1)::INT AS position, hrefs[i] AS href FROM (SELECT page_id, i, hrefs FROM (
        SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS hrefs FROM pages),
        generate_series(1, 1000) t(i) WHERE i <= len(hrefs))""",
    "html_classified_items": """SELECT page_id, position, item, array_to_string(string_split_regex(item, '\\s+')[2:], ' ') AS size, 'x file' AS css_class
        FROM (SELECT page_id, (2 * i - 2)::INT AS position, replace(items[i], '&amp;', '&') || ' 12.5 MB' AS item FROM (
          SELECT page_id, regexp_extract_all(html, '<li>[^<]*<[^>]*>([^<]*)</a></li>', 1) AS items FROM pages),
          generate_series(1, 1000) t(i) WHERE i <= len(items)) WHERE contains(string_split_regex(item, '\\s+')[1], 'e')""",
    "html_list_items": """SELECT page_id, (i - 1)::INT AS position, item, array_to_string(string_split_regex(item, '\\s+')[2:], ' ') AS size FROM (SELECT page_id, i,
          trim(regexp_replace(items[i], '<[^>]*>', '', 'g')) AS item FROM (
          SELECT page_id, regexp_extract_all(html, '(?s)<li(?:\\s[^>]*)?>(.*?)</li>', 1) AS items FROM pages),
          generate_series(1, 1000) t(i) WHERE i <= len(items))
        WHERE contains(item, 'th') AND contains(split_part(item, ' ', 1), 'e') AND NOT contains(split_part(item, ' ', 1), 'q')""",
}
