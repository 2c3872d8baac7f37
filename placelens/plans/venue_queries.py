"""Queries over check-ins, venues, regions and raw sources."""

from pyspark.sql import functions as F

from placelens.functions.hashing import hash32, uniform
from placelens.operators import relational as rel
from placelens.operators.regions import point_in_polygon
from placelens.plans import views as v
from placelens.plans.registry import query
from placelens.session import cut_lineage, shared_dir
from placelens.sources import articles as art
from placelens.sources import files

CITY_BOX = ((40.69, 40.75), (-74.01, -73.93))
CITY_HOLE = ((40.71, 40.72), (-73.97, -73.96))


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def visits_us(spark, sf):
    us = v.venues(spark, sf).filter(F.col("country_code") == "US")
    return rel.venue_visits(v.checkins(spark, sf), us)


def visits_city(spark, sf):
    # visits per venue are a stored stage of the pipeline: later filters run on the small table
    return rel.box_filter(cut_lineage(visits_us(spark, sf)), *CITY_BOX, exclude=CITY_HOLE)


def bars(spark, sf):
    return visits_city(spark, sf).filter(rel.matches_category())


def bars_with_region(spark, sf):
    return point_in_polygon(bars(spark, sf), v.regions(spark))


def structured(spark, sf):
    """The venue table of the pipeline: bars in a (merged) region with a unified category."""
    found = rel.recode(bars_with_region(spark, sf), "region", rel.REGION_MERGES)
    return rel.unify_category(found).na.drop(subset=["region"])


def raw_checkin_lines(spark, sf):
    c = v.checkins(spark, sf)
    when = F.date_format("utc_time", "EEE MMM dd HH:mm:ss '+0000' yyyy")
    return c.select(F.concat_ws("\t", F.col("user_id").cast("string"), F.col("venue_id").cast("string"), when,
                                F.col("timezone_offset_mins").cast("string")).alias("value"))


@query()
def read_tsv_checkins(spark, sf):
    # through a real text file, so that the scan itself is what runs
    path = shared_dir(spark, "tsv")
    raw_checkin_lines(spark, sf).write.text(path)
    return files.read_tsv(spark, path, files.CHECKINS_RAW)


@query()
def typed_checkins(spark, sf):
    raw = files.split_tsv(raw_checkin_lines(spark, sf), files.CHECKINS_RAW)
    return rel.typed_checkins(raw).select("user_id", "venue_id", F.unix_timestamp("utc_time").alias("utc_seconds"),
                                          "timezone_offset_mins")


@query()
def filter_country(spark, sf):
    return v.cities(spark, sf).filter(F.col("country_code") == "US").select(
        "name", r6("center_lat").alias("center_lat"), r6("center_long").alias("center_long"))


@query()
def bbox_filter(spark, sf):
    return rel.box_filter(v.venues(spark, sf), *CITY_BOX, exclude=CITY_HOLE).select("venue_id", "category")


@query()
def category_match(spark, sf):
    return v.venues(spark, sf).filter(rel.matches_category()).select("venue_id", "category")


@query()
def distinct_matching(spark, sf):
    return rel.distinct_matching(v.venues(spark, sf), "category", "bus", "venue_id")


@query()
def recode_bus(spark, sf):
    out = rel.recode(v.venues(spark, sf), "category", {"Bus": rel.BUS_CATEGORIES})
    return out.select("venue_id", "category")


@query()
def merge_regions(spark, sf):
    return rel.recode(bars_with_region(spark, sf), "region", rel.REGION_MERGES).select("venue_id", "region")


@query()
def unify_category(spark, sf):
    return rel.unify_category(bars(spark, sf)).select("venue_id", "category", "org_category", "total_visits")


@query()
def drop_null_rows(spark, sf):
    return bars_with_region(spark, sf).na.drop(subset=["region"]).select("venue_id", "region")


@query()
def null_rows(spark, sf):
    return rel.null_rows(bars_with_region(spark, sf)).select("venue_id", "category")


@query()
def null_profile(spark, sf):
    return rel.null_profile(bars_with_region(spark, sf))


@query()
def column_range(spark, sf):
    out = rel.column_range(visits_us(spark, sf), "long", "total_visits", keep=["venue_id"])
    return out.withColumn("long", r6("long"))


@query()
def checkins_venues(spark, sf):
    joined = rel.checkins_with_venues(v.checkins(spark, sf), v.venues(spark, sf))
    return joined.select("user_id", "venue_id", "timezone_offset_mins", "category", "country_code")


@query("point_in_polygon")
def point_in_polygon_query(spark, sf):
    return bars_with_region(spark, sf).select("venue_id", "region")


@query()
def venue_visits(spark, sf):
    return rel.venue_visits(v.checkins(spark, sf), v.venues(spark, sf)).select("venue_id", "category", "total_visits")


@query()
def top_countries(spark, sf):
    return rel.top_countries(v.checkins(spark, sf), v.venues(spark, sf))


@query()
def top_categories(spark, sf):
    return rel.value_counts(visits_us(spark, sf), "category", 15)


@query()
def median_visits(spark, sf):
    return rel.median_by(visits_us(spark, sf), n=30)


@query()
def bar_category_summary(spark, sf):
    return rel.median_by(bars(spark, sf))


@query()
def box_stats(spark, sf):
    return rel.box_stats(bars(spark, sf))


@query()
def region_counts(spark, sf):
    return rel.value_counts(structured(spark, sf), "region")


@query()
def seeded_order(spark, sf):
    return rel.seeded_order(v.venues(spark, sf).select("venue_id"), "venue_id")


@query()
def union_categories(spark, sf):
    return rel.union_categories(v.venues(spark, sf), ["Bar", "Pub", "Wine Bar"]).select("venue_id", "category")


@query()
def first_articles(spark, sf):
    """The first 500 articles with coordinates, by id (the early stop of the extraction): a bounded list per task, no full sort."""
    return v.articles(spark, sf).orderBy("article_id").limit(500).select("article_id", F.md5("text").alias("text_md5"))


@query()
def decode_article_records(spark, sf):
    path = shared_dir(spark, "ndjson")
    art.encode_articles(_article_records(spark, sf)).write.text(path)
    return _flat_articles(art.read_articles(spark, path))


@query()
def write_read_articles(spark, sf):
    path = shared_dir(spark, "articles")
    records = _article_records(spark, sf)
    files.write_stage(records, path)
    files.write_stage(records.limit(0), path)   # already there: must not replace it
    return _flat_articles(files.read_stage(spark, path, records.schema))


def _article_records(spark, sf):
    a = v.articles(spark, sf)
    key = F.col("article_id").cast("string")
    return a.select(
        F.concat(F.lit("Place "), key).alias("title"),
        F.struct(F.round("lat", 6).alias("lat"), F.round("long", 6).alias("long")).alias("coords"),
        F.when(F.col("article_id") % 3 > 0, F.create_map(F.lit("name"), key)).alias("properties"),
        "text", F.array(F.lit("Town"), key).alias("wikilinks"), F.array(F.lit("https://example.org/")).alias("exlinks"),
        F.length("text").alias("text_length"))


def _flat_articles(a):
    return a.select("title", "coords.lat", "coords.long", F.col("properties")["name"].alias("prop_name"),
                    F.md5("text").alias("text_md5"), F.concat_ws(";", "wikilinks").alias("links"),
                    F.concat_ws(";", "exlinks").alias("urls"), "text_length")


@query()
def stage_roundtrip(spark, sf):
    path = shared_dir(spark, "stage")
    table = structured(spark, sf).select("venue_id", "lat", "long", "region", "category", "org_category", "total_visits")
    files.write_stage(table, path, form="csv")
    back = files.read_stage(spark, path, table.schema, form="csv")
    return back.select("venue_id", r6("lat").alias("lat"), r6("long").alias("long"), "region", "category",
                       "org_category", "total_visits")


@query()
def boundary_edges(spark, sf):
    """GeoJSON texts, one per supplier: a triangle, or two squares for every third one."""
    s = v.read(spark, sf, "supplier")
    x, y = (F.floor(uniform("s_suppkey", t) * 1000).cast("string") for t in ("bx", "by"))

    def ring(*pts):
        return F.concat(F.lit("["), F.concat_ws(",", *[
            F.concat(F.lit("["), x, F.lit(f".{a},"), y, F.lit(f".{b}]")) for a, b in pts]), F.lit("]"))

    triangle = F.concat(F.lit('{"type":"Polygon","coordinates":['), ring((0, 0), (5, 0), (5, 5), (0, 0)), F.lit("]}"))
    squares = F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), ring((0, 0), (2, 0), (2, 2), (0, 2)),
                       F.lit("],["), ring((6, 6), (8, 6), (8, 8), (6, 8), (6, 6)), F.lit("]]}"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"'),
                    F.col("s_name"), F.lit('"},"geometry":'),
                    F.when(F.col("s_suppkey") % 3 == 0, squares).otherwise(triangle), F.lit("}]}"))
    rings = art.parse_boundaries(s.select("s_suppkey", text.alias("value")), keep=["s_suppkey"])
    return rings.select("s_suppkey", "name", "polygon_id", "ring_id", F.explode("edges").alias("e")).select(
        "s_suppkey", "name", "polygon_id", "ring_id", *[r6(f"e.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query()
def embedding_vectors(spark, sf):
    e = v.read(spark, sf, "embeddings")
    n = 64
    wide = e.select(F.col("vec_id").alias("article_id"), *[F.col("embedding")[i].alias(f"embedding_{i}") for i in range(n)])
    path = shared_dir(spark, "vectors")
    files.write_stage(wide, path, form="csv")
    back = art.read_embeddings(spark, path, wide.schema)
    return back.select("article_id", F.posexplode("embedding").alias("dim", "val")).select(
        "article_id", "dim", r6(F.col("val").cast("double")).alias("val"))


def _dump_files(spark, sf):
    d = v.read(spark, sf, "documents").select("doc_id", "n_chars", "text")
    n = F.col("doc_id")
    kind = F.when(n % 7 == 0, "pages-articles-multistream").when(n % 11 == 0, "pages-meta").otherwise("pages-articles")
    name = F.concat(F.lit("enwiki-"), kind, (n + 1).cast("string"), F.lit(".xml-p"), (n * 100 + 1).cast("string"),
                    F.lit("p"), (n * 100 + 90 + n % 10).cast("string"), F.lit(".bz2"))
    return d.withColumn("file_name", name)


def _written(spark, sf, files_of=None):
    """A folder that holds the dump files, each with its text as content."""
    folder = shared_dir(spark, "dumps")
    d = _dump_files(spark, sf)
    files.write_files(d if files_of is None else d.filter(files_of), folder, content="text").agg(F.sum("length")).first()
    return folder


@query()
def dump_inventory(spark, sf):
    found = files.list_files(spark, _written(spark, sf))
    return files.dump_inventory(found).withColumn("size_mb", r6("size_mb"))


@query()
def inventory_totals(spark, sf):
    found = files.list_files(spark, _written(spark, sf))
    return files.inventory_totals(files.dump_inventory(found)).withColumn("size_gb", r6("size_gb"))


@query()
def verify_checksums(spark, sf):
    """A manifest of all files against those in a folder: every 5th hash is wrong, every 13th file missing."""
    n = F.col("doc_id")
    wrong = F.when(n % 5 == 0, F.md5(F.lit("x"))).otherwise(F.md5("text"))
    manifest = shared_dir(spark, "manifest")
    _dump_files(spark, sf).select(F.concat(wrong, F.lit("  "), F.col("file_name")).alias("value")).write.text(manifest)
    return files.verify_checksums(spark, _written(spark, sf, n % 13 != 0), manifest)


@query()
def read_pages_xml(spark, sf):
    path = shared_dir(spark, "xml")
    pages = v.read(spark, sf, "documents").select(
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"),
        F.lit("2021-01-01T00:00:00Z").alias("timestamp"), "text")
    files.write_pages_xml(pages, path)
    return files.read_pages_xml(spark, path).select("title", "timestamp", F.md5("text").alias("text_md5"))


@query()
def html_links(spark, sf):
    return art.html_links(v.read(spark, sf, "pages"))


@query()
def html_list_items(spark, sf):
    out = art.html_list_items(v.read(spark, sf, "pages"), wanted="th", contains=("e",), excludes=("q",))
    return out.drop("css_class")


@query()
def html_classified_items(spark, sf):
    """Items of the class `file` with name and size, as dump listings have them; the pages' items get classes and sizes first."""
    pages = v.read(spark, sf, "pages").withColumn("html", F.regexp_replace(
        "html", "<li>([^<]*<[^>]*>)([^<]*)(</a>)</li>", "<li title='a > b' class=\"x file\">$1$2$3 12.5 MB</li><li class=files>$2"))
    return art.html_list_items(pages, contains=("e",), css_class="file")
