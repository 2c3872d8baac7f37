"""The derived location tables again, written in DuckDB SQL."""

from placelens.plans.views import CATEGORIES, REGION_RINGS


def _u(key, tag):
    return f"(('0x'||substr(md5({key}::VARCHAR||':{tag}'),1,8))::BIGINT::DOUBLE / 4294967296::DOUBLE)"


def _h(key, tag):
    return f"(('0x'||substr(md5({key}::VARCHAR||':{tag}'),1,8))::BIGINT)"


_names = ", ".join("'" + c + "'" for c in CATEGORIES)


def _edges():
    rows = []
    for idx, name, part, ring, pts in REGION_RINGS:
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
            rows.append(f"({idx}, '{name}', {part}, {ring}, {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) +
            ") t(feature_idx, name, part, ring, x1, y1, x2, y2)")


_minutes = {t: f"floor({_u('doc_id', t)} * 60::DOUBLE)::BIGINT" for t in ("m1", "s1", "m2", "s2")}
_fracs = {t: f"floor({_u('doc_id', t)} * 10000::DOUBLE)::BIGINT" for t in ("wlat", "wlong")}

# name -> (definition, names it needs)
VIEWS = {
    "v_venues": (f"""
        SELECT p_partkey AS venue_id,
               40.68::DOUBLE + {_u('p_partkey', 'lat')} * 0.08::DOUBLE AS lat,
               -74.02::DOUBLE + {_u('p_partkey', 'long')} * 0.10::DOUBLE AS long,
               ([{_names}])[split_part(p_brand, '#', 2)::INT] AS category,
               CASE WHEN p_size % 5 < 3 THEN 'US' WHEN p_size % 5 = 3 THEN 'JP' ELSE 'BR' END AS country_code
        FROM part""", []),
    "v_checkins": ("""
        SELECT o_custkey AS user_id, l_partkey AS venue_id, l_shipdate AS utc_time,
               (l_linenumber - 4) * 60 AS timezone_offset_mins
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""", []),
    "v_cities": (f"""
        SELECT s_name AS name, {_u('s_suppkey', 'clat')} * 170::DOUBLE - 85::DOUBLE AS center_lat,
               {_u('s_suppkey', 'clong')} * 360::DOUBLE - 180::DOUBLE AS center_long,
               CASE WHEN s_nationkey % 5 < 2 THEN 'US' ELSE 'JP' END AS country_code
        FROM supplier""", []),
    "v_articles": (f"""
        SELECT doc_id AS article_id,
               40.68::DOUBLE + {_u('doc_id', 'alat')} * 0.08::DOUBLE AS lat,
               -74.02::DOUBLE + {_u('doc_id', 'along')} * 0.10::DOUBLE AS long, text, embedding
        FROM documents JOIN embeddings ON doc_id = vec_id""", []),
    "v_edges": (_edges(), []),
    "v_wikitext": (f"""
        SELECT doc_id, title,
          CASE WHEN doc_id % 5 = 0 THEN '' ELSE '{{{{Infobox place' || chr(10) || '| name = ' || title || chr(10) ||
            '| built = ' || (doc_id % 200 + 1800) || chr(10) || '| owner = ' || chr(10) || '}}}}' || chr(10) END
          || CASE doc_id % 8
            WHEN 0 THEN '{{{{coord|' || la || '|N|' || lo || '|W|display=title}}}}'
            WHEN 1 THEN '{{{{coord|40|' || m1 || '|N|74|' || m2 || '|W}}}}'
            WHEN 2 THEN '{{{{Coord|40|' || m1 || '|' || s1 || '|S|74|' || m2 || '|' || s2 || '|E|type:city}}}}'
            WHEN 3 THEN '{{{{coord|' || la || '|-' || lo || '|display=inline}}}}'
            WHEN 4 THEN '{{{{coord|' || la || '|-' || lo || '}}}}'
            WHEN 5 THEN '{{{{coord|| 40 | ' || m1 || ' |' || chr(10) || ' N ||74|' || m2 || '|W|region:US}}}}'
            WHEN 6 THEN '{{{{coord|display=title}}}}' ELSE '' END
          || chr(10) || '''''''' || title || ''''''' lies in [[Town ' || t || '|the town]] by [[Park ' || t ||
          ']] &amp; [[Town ' || t || ']] &quot;x&quot; &amp;lt; [https://example.org/' || doc_id ||
          ' site].<ref>note</ref>' || chr(10) || text || chr(10) || '[[File:a.jpg|thumb|View of [[Park ' || t || ']]]]' || chr(10) || '== History ==' || chr(10) ||
          '{{{{cite web|url=https://example.com/' || doc_id || '|note={{{{small|n}}}}}}}}Built long ago, see [[Park ' || t
          || ']].' || chr(10) AS text
        FROM (SELECT doc_id, text, 'Place ' || doc_id AS title, (doc_id % 17)::VARCHAR AS t,
                     '40.' || lpad(({_fracs['wlat']})::VARCHAR, 4, '0') AS la,
                     '74.' || lpad(({_fracs['wlong']})::VARCHAR, 4, '0') AS lo,
                     {', '.join(f'{v} AS {k}' for k, v in _minutes.items())} FROM documents)""", []),
    "v_truth": (f"""
        SELECT doc_id, CASE WHEN f IN (0, 3, 4) THEN 40 + la / 10000::DOUBLE
                            WHEN f IN (1, 5) THEN 40 + m1 / 60::DOUBLE
                            WHEN f = 2 THEN -(40 + m1 / 60::DOUBLE + s1 / 3600::DOUBLE) END AS lat,
               CASE WHEN f IN (0, 3, 4) THEN -(74 + lo / 10000::DOUBLE)
                    WHEN f IN (1, 5) THEN -(74 + m2 / 60::DOUBLE)
                    WHEN f = 2 THEN 74 + m2 / 60::DOUBLE + s2 / 3600::DOUBLE END AS long
        FROM (SELECT doc_id, doc_id % 8 AS f, {_fracs['wlat']} AS la, {_fracs['wlong']} AS lo,
                     {', '.join(f'{v} AS {k}' for k, v in _minutes.items())} FROM documents)""", []),
    "v_scores": (f"""
        SELECT v.venue_id, lat, long, category,
               CASE WHEN s < 0.4::DOUBLE THEN 'North' WHEN s < 0.7::DOUBLE THEN 'East'
                    WHEN s < 0.9::DOUBLE THEN 'South' ELSE 'West' END AS region,
               y::DOUBLE AS y, (y % 17)::DOUBLE AS prediction
        FROM (SELECT *, {_u('venue_id', 'region')} AS s FROM v_venues) v
        JOIN (SELECT l_partkey AS venue_id, count(*) AS y FROM lineitem GROUP BY 1) c USING (venue_id)""",
                 ["v_venues"]),
    # venues with visits, the box and exclusion filters, and the category match
    "visits_us": ("""
        SELECT venue_id, lat, long, category, count(user_id) AS total_visits
        FROM v_checkins JOIN v_venues USING (venue_id) WHERE country_code = 'US' GROUP BY ALL""",
                  ["v_checkins", "v_venues"]),
    "visits_city": ("""
        SELECT * FROM visits_us WHERE 40.69::DOUBLE < lat AND lat < 40.75::DOUBLE
          AND -74.01::DOUBLE < long AND long < -73.93::DOUBLE
          AND NOT (40.71::DOUBLE < lat AND lat < 40.72::DOUBLE AND -73.97::DOUBLE < long AND long < -73.96::DOUBLE)""",
                    ["visits_us"]),
    "bars": ("""
        SELECT * FROM visits_city WHERE (contains(lower(category), 'bar') OR contains(lower(category), 'pub'))
          AND category NOT IN ('Salon / Barbershop', 'Public Art')""", ["visits_city"]),
    # every bar-like venue, used as the probes of neighbourhood features
    "probes": ("""
        SELECT venue_id, lat, long, category AS org_category FROM v_venues
        WHERE (contains(lower(category), 'bar') OR contains(lower(category), 'pub'))
          AND category NOT IN ('Salon / Barbershop', 'Public Art')""", ["v_venues"]),
    "places": ("""
        SELECT venue_id AS place_id, lat AS p_lat, long AS p_long,
               CASE WHEN category IN ('Bus Station', 'Bus Line') THEN 'Bus' ELSE category END AS category
        FROM v_venues""", ["v_venues"]),
    "in_region": ("""
        SELECT venue_id, arg_max(name, feature_idx) AS region FROM (
          SELECT venue_id, feature_idx, name,
                 sum(CASE WHEN (y1 > lat) <> (y2 > lat)
                           AND long < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 AS odd
          FROM bars CROSS JOIN v_edges GROUP BY 1, 2, 3) WHERE odd = 1 GROUP BY 1""", ["bars", "v_edges"]),
}


def haversine(lat1, long1, lat2, long2):
    return (f"2 * 6371009::DOUBLE * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin(radians({long2} - {long1}) / 2), 2)))")


def with_views(body, *names):
    """Prefix a query with the definitions it uses, dependencies first."""
    order = []

    def visit(name):
        if name not in order:
            for need in VIEWS[name][1]:
                visit(need)
            order.append(name)

    for name in names:
        visit(name)
    # every derived table is used more than once or is heavy, so compute each one once
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n][0]})" for n in order) + " " + body


uniform, hash32 = _u, _h
