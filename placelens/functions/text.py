"""Article text: cleaning, links, templates and markup, as Column expressions.

Only matching nested braces needs Python: two small Arrow functions scan the text once.
"""

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placelens.functions.coordinates import extract_coordinates

# Entities and their characters, replaced in this order (so `&amp;lt;` ends as `<`).
ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")]
# Tags whose content is no part of the text that a reader sees.
INVISIBLE = ["ref", "math", "ce", "chem", "gallery", "graph", "imagemap", "inputbox", "score", "section", "templatedata",
             "timeline", "categorytree"]


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def clean_text(text, only_summary=False):
    """Delete `<...>` (greedy within a line) and `thumb`, optionally keep the part before the first
    `==`; NULL if at most ten characters are left."""
    out = F.replace(F.regexp_replace(_c(text), r"<[^\n]*>", ""), F.lit("thumb"), F.lit(""))
    if only_summary:
        out = F.substring_index(out, "==", 1)
    return F.when(F.length(out) > 10, out)


def sections(text):
    return F.split(_c(text), "==")


def decode_entities(text):
    out = _c(text)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def decode_body(page):
    """Text between the text tags of a raw page with its entities decoded; NULL without the tag."""
    body = F.regexp_extract(_c(page), r'(?s)<text xml:space="preserve">(.*?)(?:</text>|\z)', 1)
    return F.when(_c(page).contains('<text xml:space="preserve">'), decode_entities(body))


def wikilinks(text):
    """Distinct link targets in sorted order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"\[\[([^\]|]*)"), F.lit(1))))


def _live(text):
    """The text without comments and without what nowiki tags switch off."""
    return F.regexp_replace(_c(text), r"(?is)<!--.*?-->|<nowiki\s*/>|<nowiki>.*?</nowiki\s*>", "")


def internal_links(text):
    """All link targets in order, repeats kept."""
    return F.transform(F.regexp_extract_all(_live(text), F.lit(r"\[\[([^\[\]|]*)"), F.lit(1)), lambda t: F.trim(t))


def external_links(text):
    """URLs of http(s), ftp(s) and mailto, and those in brackets that leave out the scheme."""
    url = r"((?:\b(?:https?|ftps?)://|\bmailto:|(?<=\[)//)[^\s\[\]|{}<>\"]+)"
    return F.regexp_extract_all(_live(text), F.lit(url), F.lit(1))


def template_names(text):
    """Lower-case names of all templates, in order."""
    found = F.regexp_extract_all(_c(text), F.lit(r"\{\{([^|{}]+)"), F.lit(1))
    return F.transform(found, lambda n: F.lower(F.regexp_replace(n, r"^\s+|\s+$", "")))


_BRACES = re.compile(r"\{\{|\}\}")


def _template_spans(text):
    """(start, end, depth) of every balanced template, in order of their start."""
    open_at, spans = [], []
    for m in _BRACES.finditer(text):
        if m.group() == "{{":
            open_at.append(m.start())
        elif open_at:
            start = open_at.pop()
            spans.append((start, m.end(), len(open_at)))
    return sorted(spans)


def _without_templates(text):
    out, at = [], 0
    for start, end, _ in _template_spans(text):
        if start >= at:
            out.append(text[at:start])
            at = end
    return "".join(out) + text[at:]


def _split_parameters(body):
    """Split a template body on the pipes outside nested templates and links."""
    parts, depth, at = [], 0, 0
    for m in re.finditer(r"\{\{|\[\[|\}\}|\]\]|\|", body):
        if m.group() in ("{{", "[["):
            depth += 1
        elif m.group() in ("}}", "]]"):
            depth = max(depth - 1, 0)
        elif depth == 0:
            parts.append(body[at:m.start()])
            at = m.end()
    return parts + [body[at:]]


_TAGS = "|".join(INVISIBLE)
_EMPTY_TAG = re.compile(rf"<(?:{_TAGS})\b[^<>]*/>", re.I)
_UNSEEN_OPEN = re.compile(rf"<({_TAGS})\b[^<>]*>", re.I)
_UNSEEN_END = re.compile(rf"</({_TAGS})\s*+>", re.I)
_TAG = re.compile(r"<[^<>]*>")
_BRACKET = re.compile(r"[\[\]]")


def _without_comments(text):
    out, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (stop := text.find("-->", start + 4)) >= 0:
        out.append(text[at:start])
        at = stop + 3
    return "".join(out) + text[at:]


def _without_unseen(text):
    """The text without the invisible tags that are closed and what they hold: each to the next end tag of its name."""
    ends = {}
    for m in _UNSEEN_END.finditer(text):
        ends.setdefault(m.group(1).lower(), []).append(m.span())
    out, at = [], 0
    next_end = dict.fromkeys(ends, 0)
    for m in _UNSEEN_OPEN.finditer(text) if ends else ():
        name = m.group(1).lower()
        if m.start() < at or name not in ends:
            continue
        k = next_end[name]
        while k < len(ends[name]) and ends[name][k][0] < m.end():
            k += 1
        next_end[name] = k
        if k < len(ends[name]):
            out.append(text[at:m.start()])
            at = ends[name][k][1]
    return "".join(out) + text[at:]


def _without_tags(text):
    """No comments, no tags; what invisible tags hold goes with them. Linear in the text."""
    return _TAG.sub("", _without_unseen(_EMPTY_TAG.sub("", _without_comments(text))))


def _resolve_links(text):
    """[[target|caption]] becomes caption and [[target]] target, nested to any depth, in one scan."""
    out, marks, at = [], [], 0          # pieces so far; places in `out` of brackets that are still open or left over
    end = len(text)
    while True:
        m = _BRACKET.search(text, at)
        if not m:
            break
        out.append(text[at:m.start()])
        at = m.end()
        if (m.group() == "]" and at < end and text[at] == "]" and len(marks) > 1
                and out[marks[-1]] == out[marks[-2]] == "[" and not any(out[marks[-2] + 1:marks[-1]])):
            caption = "".join(out[marks[-1] + 1:])
            del out[marks[-2]:], marks[-2:]
            out.append(caption.split("|", 1)[-1])
            at += 1
        else:
            marks.append(len(out))
            out.append(m.group())
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def drop_tags_and_links(text: pd.Series) -> pd.Series:
    """The text without comments and tags, links replaced by their captions."""
    return text.map(lambda t: _resolve_links(_without_tags(t)), na_action="ignore")


@F.pandas_udf(T.StringType())
def drop_templates(text: pd.Series) -> pd.Series:
    """The text without its templates, nested ones included."""
    return text.map(_without_templates, na_action="ignore")


def _infobox(text):
    for start, end, _ in _template_spans(text):
        name, *params = _split_parameters(text[start + 2:end - 2])
        if "infobox" not in name.strip().lower():
            continue
        pairs, unnamed = [], 0
        for p in params:
            key, eq, value = p.partition("=")
            if not eq:
                unnamed += 1
                key, value = str(unnamed), p
            pairs.append((key.strip(), _resolve_links(_without_tags(_without_templates(value)))))
        return dict(pairs)   # a repeated name keeps its last value
    return None


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _infobox_raw(text: pd.Series) -> pd.Series:
    return text.map(_infobox, na_action="ignore")


def _plain(text):
    """External links, quotes and entities to plain text, after tags and links; headings keep their `==`."""
    out = F.regexp_replace(_c(text), r"\[(?:(?:https?|ftps?):|mailto:(?=[^\s\[\]])|(?=//))(?://)?[^\s\[\]]+\s*([^\[\]]*)\]", "$1")
    out = decode_entities(F.regexp_replace(out, r"'{2,}", ""))
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip_markup(text):
    return _plain(drop_tags_and_links(drop_templates(_c(text))))


def infobox_map(text):
    """Non-empty parameters of the first infobox as a map; NULL without an infobox."""
    values = F.transform_values(_infobox_raw(_c(text)), lambda k, v: _plain(v))
    return F.map_filter(values, lambda k, v: v != "")


def template_usage(articles, text="text"):
    """How often each template is used."""
    return articles.select(F.explode(template_names(text)).alias("template")).groupBy("template").agg(F.count("*").alias("uses"))


def region_articles(pages, lat_range, long_range, template="coord"):
    """Records of the articles whose coordinate template lies strictly inside the box.

    Coordinates are read and tested first; templates, links and markup are processed only for the
    pages that remain.
    """
    point = extract_coordinates("text", first_only=True)

    def in_box(p):
        return ((F.lit(lat_range[0]) < p["lat"]) & (p["lat"] < F.lit(lat_range[1]))
                & (F.lit(long_range[0]) < p["long"]) & (p["long"] < F.lit(long_range[1])))

    # a generator yields the point only where it fits, so the parser runs once per page; a filter on
    # the parsed column would be pushed down and repeat it for every comparison
    inside = (pages.filter(F.array_contains(template_names("text"), template.lower()))
              .select("*", F.explode(F.filter(F.array(point), in_box)).alias("coords")))
    keep = [c for c in pages.columns if c not in ("title", "text")]
    out = inside.select(*keep, "title", "coords", infobox_map("text").alias("properties"), strip_markup("text").alias("plain"),
                        internal_links("text").alias("wikilinks"), external_links("text").alias("exlinks"))
    return out.withColumnRenamed("plain", "text").withColumn("text_length", F.length("text"))

