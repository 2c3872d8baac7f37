"""Hand-written cases for text, coordinates and sources."""

import bz2
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from placelens.functions import text as tx
from placelens.functions.coordinates import extract_coordinates, is_coordinate
from placelens.operators import relational as rel
from placelens.operators.encoding import encode_text
from placelens.operators.words import tfidf_long
from placelens.sources import articles as art
from placelens.sources import files

COORDS = [
    ("{{coord|40.5|N|74.25|W}}", (40.5, -74.25)),
    ("{{Coord|40|30|S|74|15|E|type:city}}", (-40.5, 74.25)),
    ("{{coord|40|30|36|N|74|15|36|W|display=title}}", (40.51, -74.26)),
    ("{{coord|40.5|-74.25|display=title}}", (40.5, -74.25)),
    ("{{coord|40.5|-74.25}}", (40.5, -74.25)),                       # no closing pipe
    ("{{coord|40.5|-74.25|name=North}}", (40.5, -74.25)),            # a parameter that starts with a direction letter
    ("{{coord|40.5|-74.25|source:x}}", (40.5, -74.25)),
    ("{{coord|| 40 |30\n| n ||| 74 | 15 |w}}", (40.5, -74.25)),      # blanks, doubled and tripled pipes, lower case
    ("{{coord|display=inline|40.5|N|74.25|W}}", (40.5, -74.25)),     # label first
    ("{{coord|40.5|N|74|15|W}}", (40.5, -74.25)),                    # mixed forms
    ("{{coord|display=title}}", None), ("{{coord|4..0|1}}", None), ("{{coord|40|N}}", None), ("no template", None), ("{{coord|}}", None),
    ("{{coord|x}} {{coord|1|2}}", (1.0, 2.0)),                       # the first that parses
]


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first().x


@pytest.mark.parametrize("text, want", COORDS)
def test_coordinates(spark, text, want):
    got = one(spark, text, extract_coordinates("t"))
    assert (got is None) if want is None else tuple(got) == pytest.approx(want)


def test_first_only_stops_at_the_first_template(spark):
    assert one(spark, "{{coord|x}} {{coord|1|2}}", extract_coordinates("t", first_only=True)) is None


def test_validity(spark):
    cases = {"40": True, "-7.5": True, "": False, ".": False, "-": False, "1..2": False, "1--2": False, "4a": False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.v for r in df.select("t", is_coordinate("t").alias("v")).collect()} == cases


def test_clean_and_sections(spark):
    text = "a <b>bold</b> end\nnext thumb|line here\n== H ==\nmore"
    assert one(spark, text, tx.clean_text("t")) == "a  end\nnext |line here\n== H ==\nmore"
    assert one(spark, text, tx.clean_text("t", only_summary=True)) == "a  end\nnext |line here\n"
    assert one(spark, "0123456789", tx.clean_text("t")) is None and one(spark, "0123456789a", tx.clean_text("t")) is not None
    assert one(spark, text, tx.sections("t"))[1] == " H "


def test_body_and_links(spark):
    page = 'x<text xml:space="preserve">a &amp;lt; &quot;b&quot;&nbsp;c</text>y'
    assert one(spark, page, tx.decode_body("t")) == 'a < "b" c' and one(spark, "nothing", tx.decode_body("t")) is None
    assert one(spark, "[[B|x]] [[A]] [[B]]", tx.wikilinks("t")) == ["A", "B"]
    assert one(spark, "[[Town 1 |x]] [[Town 10]] [[Town 1]]", tx.internal_links("t")) == ["Town 1", "Town 10", "Town 1"]
    assert one(spark, "[http://a.b/c d] https://e.f/?q=1|x", tx.external_links("t")) == ["http://a.b/c", "https://e.f/?q=1"]


def test_infobox_and_markup(spark):
    text = ("{{Other|a=b}}{{Infobox x\n| name = The [[Big|big]] '''one'''\n| note = {{small|{{x}}}} kept\n| none =\n| map = [[File:a|b]]\n| pos\n}}"
            "Hello <ref>r</ref> [[A|label]] [[B]] [http://x.y site] [[File:c.jpg|thumb|see [[D]]]] {{t|{{u}}}}done\n\n\n\n== H ==\n")
    assert one(spark, text, tx.infobox_map("t")) == {"name": "The big one", "note": "kept", "map": "b", "1": "pos"}
    assert one(spark, text, tx.strip_markup("t")) == "Hello  label B site thumb|see D done\n\n== H =="
    assert one(spark, "plain", tx.infobox_map("t")) is None and one(spark, None, tx.strip_markup("t")) is None
    assert one(spark, "{{a|b {{c}} }} {{open", tx.strip_markup("t")) == "{{open"


def test_region_articles(spark):
    rows = [("In", "{{Coord|40.5|-74.5}}{{Infobox a|k=v}}See [[X]]"), ("Out", "{{coord|10|10}}"), ("None", "text"), ("Edge", "{{coord|41|-74.5}}")]
    got = tx.region_articles(spark.createDataFrame(rows, "title string, text string"), (40, 41), (-75, -74)).collect()
    assert [r.title for r in got] == ["In"]
    assert got[0].properties == {"k": "v"} and got[0].text == "See X" and got[0].text_length == 5 and got[0].wikilinks == ["X"]


def test_tsv_keeps_quotes_blank_and_short_lines(spark, tmp_path):
    (tmp_path / "v.txt").write_text('1\t40.5\t-74\t"Caf\té"\n\n2\t41\n')
    got = files.read_tsv(spark, str(tmp_path / "v.txt"), files.VENUES_RAW).collect()
    assert [tuple(r) for r in got] == [("1", "40.5", "-74", '"Caf', 'é"'), ("", None, None, None, None), ("2", "41", None, None, None)]


def test_typed_checkins(spark):
    raw = spark.createDataFrame([("1", "v", "Tue Apr 03 18:00:06 +0000 2012", "-240"), ("2", "w", "bad", "x")], files.CHECKINS_RAW)
    got = rel.typed_checkins(raw).select(F.unix_timestamp("utc_time").alias("s"), "timezone_offset_mins").collect()
    assert [tuple(r) for r in got] == [(1333476006, -240), (None, None)]


def test_xml_pages_with_and_without_attributes(spark, tmp_path):
    xml = ('<mediawiki><page><title>A &amp; B</title><revision><timestamp>2020</timestamp><text xml:space="preserve">x {{y}}\nz</text></revision></page>'
           "<page><title>C</title><revision><text>plain</text></revision></page></mediawiki>")
    (tmp_path / "d.xml-p1p9.bz2").write_bytes(bz2.compress(xml.encode()))
    got = {r.title: (r.timestamp, r.text) for r in files.read_pages_xml(spark, str(tmp_path)).collect()}
    assert got == {"A & B": ("2020", "x {{y}}\nz"), "C": (None, "plain")}


def test_article_records_of_mixed_arrays(spark, tmp_path):
    rows = [["T", [40.5, -74.0], {"a": "1"}, "te\"xt", ["L"], [], 5], ["U", [1.0, 2.0], None, "x", [], ["http://a"], 1]]
    (tmp_path / "a.ndjson").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    df = art.read_articles(spark, str(tmp_path))
    got = sorted(df.collect(), key=lambda r: r.title)
    assert got[0].coords.lat == 40.5 and got[0].properties == {"a": "1"} and got[0].text == 'te"xt' and got[1].properties is None
    back = sorted(art.decode_articles(art.encode_articles(df)).collect(), key=lambda r: r.title)
    assert back == got


def test_boundaries_and_checksums(spark, tmp_path):
    geo = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "P"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
        {"type": "Feature", "properties": {"name": "M"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}]}
    (tmp_path / "b.geojson").write_text(json.dumps(geo, indent=1))
    got = art.read_boundaries(spark, str(tmp_path / "b.geojson")).collect()
    assert [(r.feature_idx, r.name, r.polygon_id, len(r.edges)) for r in got] == [(0, "P", 0, 3), (1, "M", 0, 3), (1, "M", 1, 3)]
    dump = tmp_path / "dump"
    dump.mkdir()
    names = ["a-pages-articles1.xml-p1p10.bz2", "a-pages-articles2.xml-p11p20.bz2", "a-pages-articles3.xml-p21p25.bz2"]
    for n in names[:2]:
        (dump / n).write_bytes(n.encode())
    lines = [f"{hashlib.md5(names[0].encode()).hexdigest()}  {names[0]}", f"bad  {names[1]}", f"x  {names[2]}", "y  a-multistream1.xml-p1p2.bz2"]
    (tmp_path / "md5").write_text("\n".join(lines) + "\n")
    status = {r.file_name: r.status for r in files.verify_checksums(spark, str(dump), str(tmp_path / "md5")).collect()}
    assert status == {names[0]: "ok", names[1]: "bad", names[2]: "missing"}
    inv = {r.file_name: r.article_span for r in files.dump_inventory(files.list_files(spark, str(dump))).collect()}
    assert inv == {names[0]: 9, names[1]: 9}


def test_html(spark):
    page = spark.createDataFrame([(1, '<li class="file">pages-articles1.xml-p1 <b>x</b></li><li>other</li><li>pages-articles-multistream.xml-p2</li><a href="/d">t</a>')],
                                 "page_id int, html string")
    got = art.html_list_items(page, "pages-articles", contains=(".xml-p",), excludes=("multistream",)).collect()
    assert [r.item for r in got] == ["pages-articles1.xml-p1 x"]
    assert [r.href for r in art.html_links(page).collect()] == ["/d"]


def test_tfidf_of_known_counts(spark):
    docs = spark.createDataFrame([(1, "apple pear apple"), (2, "apple plum"), (3, "pear fig the")], "article_id int, text string")
    got = {(r.article_id, r.word): (r.tf, r.tfidf) for r in tfidf_long(docs).collect()}
    idf = math.log(4 / 3)
    assert got == {(1, "apple"): (2, 2 * idf), (1, "pear"): (1, idf), (2, "apple"): (1, idf), (3, "pear"): (1, idf)}


def test_a_bz2_dump_is_read_in_several_splits(spark, tmp_path):
    rows = [(f"T{k}", "2020-01-01", f"{hashlib.sha256(str(k).encode()).hexdigest() * 20} & <{k}>") for k in range(3000)]
    files.write_pages_xml(spark.createDataFrame(rows, "title string, timestamp string, text string").coalesce(1), str(tmp_path / "d"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        pages = files.read_pages_xml(spark, str(tmp_path / "d"))
        parts = [r.p for r in pages.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(parts) > 1 and sorted(map(tuple, pages.collect())) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_markup_that_readers_do_not_see(spark):
    deep = "core"
    for c in "fedcba":
        deep = f"[[{c}|{deep}]]"
    cases = {"A town.<ref>Smith 1999</ref> End <math>x^2</math>!<ref name=a/> z": "A town. End ! z", deep: "core",
             "x [[A|b [[c]] d]] y": "x b c d y", "[[[x]]] [ftp://h/a name] [//h/b more] [mailto:x@y z]": "[x] name more z",
             "a<!-- [[no]] -->b <gallery>\nF.jpg|t\n</gallery>c": "ab c", "]] [[ x": "]] [[ x"}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, text string")
    got = {r.text: r.t for r in df.select("text", tx.strip_markup("text").alias("t")).collect()}
    assert got == cases
    links = spark.createDataFrame([("<!-- [[no]] http://no -->[[a]] <nowiki>[[no]]</nowiki> ftp://f/x [//h/p t] mailto:q@w.e http://k",)], "text string")
    r = links.select(tx.internal_links("text").alias("i"), tx.external_links("text").alias("e")).first()
    assert r.i == ["a"] and r.e == ["ftp://f/x", "//h/p", "mailto:q@w.e", "http://k"]


def test_anchors_in_every_quoting(spark):
    page = """<a href='one'>1</a><A HREF="two?a=1&amp;b=2">2</A><a href=three>3</a><a data-href="no">-</a><a
        class="x" href = "four">4</a><a title="href='no'" href="five">5</a>"""
    got = art.html_links(spark.createDataFrame([(1, page)], "page_id int, html string"))
    assert [r.href for r in got.orderBy("position").collect()] == ["one", "two?a=1&b=2", "three", "four", "five"]


def test_encoder_is_pluggable(spark):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(1, 300)], "article_id int, text string")
    got = encode_text(docs, lambda: (lambda texts: [[float(len(t)), 1.0] for t in texts]), batch=16).collect()
    assert {r.article_id: r.embedding[0] for r in got} == {i: float(i) for i in range(1, 300)}


def test_tags_of_any_kind_in_linear_time(spark):
    import time
    from placelens.functions import markup
    page = ("""<!-- <a href="no"> --><UL><li class="file x" title='a > b'>n1.xml-p1 <b>1.5</b> MB<li class=other>two<ul><li>in&amp;ner</ul> more</ul>"""
            """<script>"<li>no</li>"</script><a name="k" HREF='q?a=1&amp;b=2'>t</a><a hrefx=no data-href="no">u</a><a href>v</a><li>last""")
    assert markup.items_of(page) == [("n1.xml-p1 1.5 MB", "file x"), ("twoin&ner more", "other"), ("in&ner", None), ("last", None)]
    assert markup.hrefs_of(page) == ["q?a=1&b=2", ""]
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")
    got = art.html_list_items(df, css_class="file").collect()
    assert [(r.page_id, r.position, r.item, r.size, r.css_class) for r in got] == [(1, 0, "n1.xml-p1 1.5 MB", "1.5 MB", "file x")]
    start = time.time()
    for part, n in (("<a ", 1), ("<li ", 1), ("<!-- ", 1), ("<a x=\"", 1), ("<a x='", 1), ("<script>", 1), ("< ", 1), ("<li>", 1), ("</", 1), ("<ul><li>", 0)):
        text = part * (1_000_000 // len(part)) if n else part * 2000
        markup.hrefs_of(text), markup.items_of(text)
    big = "<a " + "x=1 " * 250_000 + "href=here>t</a>"
    assert markup.hrefs_of(big) == ["here"] and time.time() - start < 60
    assert [r.href for r in art.html_links(spark.createDataFrame([(1, big)], "page_id int, html string")).collect()] == ["here"]


def test_unclosed_notes_take_linear_time():
    import time
    from placelens.functions.text import _without_tags
    start = time.time()
    for part in ("<ref>", "<!--", "<ref name=a>x", "</ref >", "<math><ref>", "<ref"):
        _without_tags(part * 200_000)
    assert time.time() - start < 20
    assert _without_tags("a<ref>b<math>c</ref>d</math>e<REF x=1>f</ref >g<ref>h<!-- i --><gallery>j") == "adeghj"


def test_digests_of_files_of_any_size(spark, tmp_path):
    import os
    folder = str(tmp_path / "dump")
    rows = [("a.xml-p1p9.bz2", b"one"), ("b.xml-p10p29.bz2", b""), ("c c%20.xml-p30p31.bz2", b"x" * 3_000_000)]
    made = files.write_files(spark.createDataFrame(rows, "file_name string, content binary"), folder).collect()
    assert sorted(r.length for r in made) == [0, 3, 3_000_000]
    with open(f"{folder}/large.xml-p40p50.bz2", "wb") as f:
        f.truncate(2_200_000_000)                                              # more than a value can hold; sparse on disk
    want = {name: hashlib.md5(data).hexdigest() for name, data in rows}
    h = hashlib.md5()
    for _ in range(220):
        h.update(bytes(10_000_000))
    want["large.xml-p40p50.bz2"] = h.hexdigest()
    listed = files.list_files(spark, folder)
    got = {r.file_name: r.actual for r in files.file_digests(listed).collect()}
    assert got == want and {r.length for r in listed.collect()} == {0, 3, 3_000_000, 2_200_000_000}
    os.truncate(f"{folder}/large.xml-p40p50.bz2", 0)


def test_first_articles_keeps_five_hundred(spark, tmp_path):
    from placelens.plans import all_queries
    spark.range(600).selectExpr("600 - id AS doc_id", "concat('t', id) AS text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(600).selectExpr("id + 1 AS vec_id", "array(1.0f) AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = all_queries()["first_articles"](spark, str(tmp_path)).collect()
    assert sorted(r.article_id for r in got) == list(range(1, 501))
