"""Queries over article source text."""

from pyspark.sql import functions as F

from placelens.functions import coordinates as co
from placelens.functions import text as tx
from placelens.plans import views as v
from placelens.plans.registry import query
from placelens.plans.venue_queries import r6


def _text_out(df, column):
    return df.select("doc_id", F.md5(column).alias("text_md5"), F.length(column).alias("chars"))


@query()
def clean_text(spark, sf):
    return _text_out(v.wikitext(spark, sf).withColumn("t", tx.clean_text("text")), "t")


@query()
def clean_summary(spark, sf):
    raw = v.wikitext(spark, sf).unionByName(v.read(spark, sf, "documents").select(
        (-F.col("doc_id") - 1).alias("doc_id"), F.lit("").alias("title"), "text"))   # plain texts too: some are short
    return _text_out(raw.withColumn("t", tx.clean_text("text", only_summary=True)), "t")


@query()
def article_sections(spark, sf):
    parts = v.wikitext(spark, sf).select("doc_id", F.posexplode(tx.sections("text")).alias("position", "section"))
    return parts.select("doc_id", "position", F.md5("section").alias("section_md5"))


@query()
def decode_body(spark, sf):
    raw = F.concat(F.lit('<page><text xml:space="preserve">'), F.col("text"), F.lit("</text></page>"))
    return _text_out(v.wikitext(spark, sf).withColumn("t", tx.decode_body(raw)), "t")


@query()
def wikilinks(spark, sf):
    return v.wikitext(spark, sf).select("doc_id", F.posexplode(tx.wikilinks("text")).alias("position", "target"))


@query()
def valid_coordinates(spark, sf):
    tokens = v.wikitext(spark, sf).select("doc_id", F.posexplode(F.split(F.regexp_extract("text", r"\{\{[cC]oord\|([^}]*)", 1), r"\|"))
                                          .alias("position", "token"))
    return tokens.select("doc_id", "position", co.is_coordinate("token").cast("int").alias("valid"),
                         r6(co.to_number("token")).alias("number"))


@query()
def extract_coordinates(spark, sf):
    point = v.wikitext(spark, sf).select("doc_id", co.extract_coordinates("text").alias("p"))
    return point.select("doc_id", r6("p.lat").alias("lat"), r6("p.long").alias("long"))


@query()
def region_articles(spark, sf):
    out = tx.region_articles(v.wikitext(spark, sf), (40.1, 40.9), (-74.9, -74.1))
    return out.select("doc_id", "title", r6("coords.lat").alias("lat"), r6("coords.long").alias("long"),
                      F.col("properties")["name"].alias("prop_name"), F.md5("text").alias("text_md5"),
                      F.concat_ws(";", "wikilinks").alias("links"), F.concat_ws(";", "exlinks").alias("urls"), "text_length")


@query()
def infobox_map(spark, sf):
    out = v.wikitext(spark, sf).select("doc_id", tx.infobox_map("text").alias("m"))
    return out.select("doc_id", F.explode("m").alias("name", "value"))


@query()
def strip_markup(spark, sf):
    return _text_out(v.wikitext(spark, sf).withColumn("t", tx.strip_markup("text")), "t")


@query()
def article_links(spark, sf):
    out = v.wikitext(spark, sf).select("doc_id", tx.internal_links("text").alias("a"), tx.external_links("text").alias("b"))
    return out.select("doc_id", F.concat_ws(";", "a").alias("links"), F.concat_ws(";", "b").alias("urls"))


@query()
def template_usage(spark, sf):
    return tx.template_usage(v.wikitext(spark, sf))
