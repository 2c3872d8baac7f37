"""Location tables derived from the star-schema test tables (inputs only, no operator logic)."""

from pyspark.sql import functions as F

from placelens.functions.hashing import uniform
from placelens.operators.regions import polygons_from_rings
from placelens.session import spread

# Category names of the derived venues, in the order of the brand number.
CATEGORIES = [
    "Bar", "Wine Bar", "Pub", "Sports Bar", "Salon / Barbershop", "Public Art", "Bus Station",
    "Bus Line", "Subway", "Jazz Club", "Café", "Park", "Museum", "Hotel", "Gym", "Bakery",
    "Library", "Theater", "Bookstore", "Diner", "Beer Garden", "Gastropub", "Cocktail Bar",
    "Bridge", "Office",
]

# Region outlines: (feature index, name, part, ring, [(long, lat), ...]); ring 0 is the outline
# of a part, later rings are holes. Some space stays uncovered and two features overlap.
REGION_RINGS = [
    (0, "Staten Island", 0, 0, [(-74.02, 40.68), (-73.99, 40.68), (-73.98, 40.71), (-74.02, 40.72)]),
    (1, "Queens", 0, 0, [(-73.98, 40.69), (-73.93, 40.69), (-73.93, 40.73), (-73.955, 40.70),
                         (-73.98, 40.73)]),
    (2, "Manhattan", 0, 0, [(-74.015, 40.715), (-73.985, 40.715), (-73.985, 40.757), (-74.015, 40.757)]),
    (2, "Manhattan", 0, 1, [(-74.005, 40.73), (-73.995, 40.73), (-73.995, 40.74), (-74.005, 40.74)]),
    (3, "Bronx", 0, 0, [(-73.975, 40.73), (-73.945, 40.735), (-73.95, 40.758), (-73.97, 40.755)]),
    (3, "Bronx", 1, 0, [(-73.945, 40.72), (-73.925, 40.72), (-73.925, 40.745), (-73.945, 40.745)]),
]


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def venues(spark, sf_dir, spread_rows=False):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    part = spread(part) if spread_rows else part
    brand = F.substring_index("p_brand", "#", -1).cast("int")
    size = F.col("p_size") % 5
    return part.select(
        F.col("p_partkey").alias("venue_id"),
        (F.lit(40.68) + uniform("p_partkey", "lat") * F.lit(0.08)).alias("lat"),
        (F.lit(-74.02) + uniform("p_partkey", "long") * F.lit(0.10)).alias("long"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), brand).alias("category"),
        F.when(size < 3, "US").when(size == 3, "JP").otherwise("BR").alias("country_code"),
    )


def checkins(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("venue_id"),
        F.col("l_shipdate").alias("utc_time"),
        ((F.col("l_linenumber") - 4) * 60).alias("timezone_offset_mins"),
    )


def cities(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"),
        (uniform("s_suppkey", "clat") * F.lit(170.0) - F.lit(85.0)).alias("center_lat"),
        (uniform("s_suppkey", "clong") * F.lit(360.0) - F.lit(180.0)).alias("center_long"),
        F.when(F.col("s_nationkey") % 5 < 2, "US").otherwise("JP").alias("country_code"),
    )


def articles(spark, sf_dir, spread_text=False):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = spread(docs) if spread_text else docs
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return docs.join(vectors, docs.doc_id == vectors.vec_id).select(
        F.col("doc_id").alias("article_id"),
        (F.lit(40.68) + uniform("doc_id", "alat") * F.lit(0.08)).alias("lat"),
        (F.lit(-74.02) + uniform("doc_id", "along") * F.lit(0.10)).alias("long"),
        "text",
        "embedding",
    )


def regions(spark):
    return polygons_from_rings(spark, REGION_RINGS)


def wikitext(spark, sf_dir):
    """Article source around every document: coordinate template (form by doc_id % 8), infobox,
    links, entities, a heading. Numbers in the templates come from the key's hash."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    key = F.col("doc_id").cast("string")
    frac = {t: F.lpad(F.floor(uniform("doc_id", t) * 10000).cast("string"), 4, "0")
            for t in ("wlat", "wlong")}
    sixty = {t: F.floor(uniform("doc_id", t) * 60).cast("string")
             for t in ("m1", "s1", "m2", "s2")}
    lat, long = F.concat(F.lit("40."), frac["wlat"]), F.concat(F.lit("74."), frac["wlong"])
    m1, s1, m2, s2 = (sixty[t] for t in ("m1", "s1", "m2", "s2"))
    form = F.col("doc_id") % 8

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    template = (
        F.when(form == 0, text("{{coord|", lat, "|N|", long, "|W|display=title}}"))
        .when(form == 1, text("{{coord|40|", m1, "|N|74|", m2, "|W}}"))
        .when(form == 2, text("{{Coord|40|", m1, "|", s1, "|S|74|", m2, "|", s2, "|E|type:city}}"))
        .when(form == 3, text("{{coord|", lat, "|-", long, "|display=inline}}"))
        .when(form == 4, text("{{coord|", lat, "|-", long, "}}"))
        .when(form == 5, text("{{coord|| 40 | ", m1, " |\n N ||74|", m2, "|W|region:US}}"))
        .when(form == 6, "{{coord|display=title}}")
        .otherwise("")
    )
    infobox = F.when(F.col("doc_id") % 5 == 0, "").otherwise(text(
        "{{Infobox place\n| name = Place ", key, "\n| built = ", F.col("doc_id") % 200 + 1800,
        "\n| owner = \n}}\n"))
    town = (F.col("doc_id") % 17).cast("string")
    return docs.select(
        "doc_id",
        text("Place ", key).alias("title"),
        text(infobox, template, "\n'''Place ", key, "''' lies in [[Town ", town, "|the town]] by [[Park ",
             town, "]] &amp; [[Town ", town, "]] &quot;x&quot; &amp;lt; [https://example.org/", key,
             " site].<ref>note</ref>\n", F.col("text"),
             "\n[[File:a.jpg|thumb|View of [[Park ", town, "]]]]\n== History ==\n{{cite web|url=https://example.com/", key,
             "|note={{small|n}}}}Built long ago, see [[Park ", town, "]].\n").alias("text"),
    )


def scores(spark, sf_dir):
    """One row per visited venue with a target, a prediction with many ties, a fold and a region."""
    visits = (read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("venue_id"))
              .agg(F.count("*").alias("y")))
    spread = uniform("venue_id", "region")
    return venues(spark, sf_dir).join(visits, "venue_id").select(
        "venue_id", "lat", "long", "category",
        F.when(spread < 0.4, "North").when(spread < 0.7, "East").when(spread < 0.9, "South")
        .otherwise("West").alias("region"),
        F.col("y").cast("double").alias("y"),
        (F.col("y") % 17).cast("double").alias("prediction"),
    )
