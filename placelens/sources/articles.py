"""Article records, embedding tables, region files and page listings."""

from pyspark.sql import functions as F

from placelens.functions import markup
from placelens.operators.regions import EDGE


def decode_articles(lines, column="value"):
    """Each line is a JSON array [title, coords, properties, text, wikilinks, exlinks, text_length]."""
    a = F.from_json(column, "array<string>")
    coords = F.from_json(a[1], "array<double>")
    return lines.select(
        a[0].alias("title"),
        F.when(a[1].isNotNull(), F.struct(coords[0].alias("lat"), coords[1].alias("long"))).alias("coords"),
        F.from_json(a[2], "map<string,string>").alias("properties"),
        a[3].alias("text"),
        F.from_json(a[4], "array<string>").alias("wikilinks"),
        F.from_json(a[5], "array<string>").alias("exlinks"),
        a[6].cast("int").alias("text_length"),
    )


def read_articles(spark, path):
    return decode_articles(spark.read.text(path))


def encode_articles(articles):
    """The inverse of decode_articles, one JSON array per row."""
    def js(*cols):
        return F.concat_ws(", ", *[F.coalesce(F.to_json(c), F.lit("null")) for c in cols])

    def text(c):
        wrapped = F.to_json(F.array(c))   # to_json takes no scalars: wrap, then cut the brackets
        return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)

    coords = F.when(F.col("coords").isNotNull(), F.array("coords.lat", "coords.long"))
    length = F.coalesce(F.col("text_length").cast("string"), F.lit("null"))
    body = F.concat_ws(", ", text("title"), js(coords, F.col("properties")), text("text"),
                       js(F.col("wikilinks"), F.col("exlinks")), length)
    return articles.select(F.concat(F.lit("["), body, F.lit("]")).alias("value"))


def embedding_vectors(table, key="article_id", prefix="embedding_"):
    """Wide embedding columns (prefix_0, prefix_1, ...) to one array column, keyed by id."""
    cols = sorted((c for c in table.columns if c.startswith(prefix)), key=lambda c: int(c[len(prefix):]))
    return table.select(key, F.array(*[F.col(c).cast("float") for c in cols]).alias("embedding"))


def read_embeddings(spark, path, schema, key="article_id"):
    return embedding_vectors(spark.read.schema(schema).option("header", True).csv(path), key)


_GEOJSON = ("struct<features:array<struct<properties:struct<name:string>,"
            "geometry:struct<type:string,coordinates:string>>>>")


def parse_boundaries(docs, column="value", keep=()):
    """Polygons of GeoJSON FeatureCollection texts, one row per ring with its edges."""
    doc = docs.select(*keep, F.posexplode(F.from_json(column, _GEOJSON)["features"]).alias("feature_idx", "f"))
    single = F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    multi = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    parts = doc.select(*keep, F.col("feature_idx").cast("bigint").alias("feature_idx"),
                       F.col("f.properties.name").alias("name"),
                       F.posexplode(F.when(F.col("f.geometry.type") == "MultiPolygon", multi).otherwise(single))
                       .alias("polygon_id", "rings"))
    rings = parts.select(*keep, "feature_idx", "name", "polygon_id", F.posexplode("rings").alias("ring_id", "ring"))
    # an open ring is closed by joining its last point to its first
    edges = F.transform("ring", lambda p, i: F.struct(
        p[0].alias("x1"), p[1].alias("y1"),
        F.get(F.get(F.col("ring"), (i + 1) % F.size("ring")), F.lit(0)).alias("x2"),
        F.get(F.get(F.col("ring"), (i + 1) % F.size("ring")), F.lit(1)).alias("y2")))
    proper = F.filter(edges, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
    return rings.select(*keep, "feature_idx", "name", "polygon_id", "ring_id",
                        proper.cast(f"array<{EDGE}>").alias("edges"))


def read_boundaries(spark, path):
    return parse_boundaries(spark.read.text(path, wholetext=True))


def html_links(pages, html="html", keep=("page_id",)):
    """Every href of an <a>, with its position in the page."""
    return pages.select(*keep, F.posexplode(markup.hrefs(F.col(html))).alias("position", "href"))


def html_list_items(pages, wanted="", contains=(), excludes=(), html="html", keep=("page_id",), css_class=None):
    """position, item, size, css_class of the <li> items whose text contains `wanted` and that have the class, if one is given.

    The first word, a file's name, must contain / not contain the rest; `size` is the text after it.
    """
    out = pages.select(*keep, F.posexplode(markup.list_items(F.col(html))).alias("position", "_li")).select(
        *keep, "position", "_li.item", "_li.css_class").filter(F.col("item").contains(wanted))
    if css_class:
        out = out.filter(F.array_contains(F.split("css_class", r"\s+"), css_class))
    words = F.split(F.trim("item"), r"\s+")
    for s in contains:
        out = out.filter(words[0].contains(s))
    for s in excludes:
        out = out.filter(~words[0].contains(s))
    return out.select(*keep, "position", "item", F.concat_ws(" ", F.slice(words, 2, F.size(words))).alias("size"), "css_class")
