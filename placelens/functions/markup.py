"""HTML tags in one scan: linear in the page, without recursion, whatever is left open."""

import html
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s=>/"'][^\s=>/]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*+)))?+|[\s/]*+["'=]""")
_SPACE = re.compile(r"[\s/]*+")
_RAW = ("script", "style", "textarea", "title")      # what they hold is no markup


class _Finder:
    """str.find for one needle, which stops searching for good once it is not there."""

    def __init__(self, text, needle):
        self.text, self.needle, self.gone = text, needle, False

    def __call__(self, at):
        found = -1 if self.gone else self.text.find(self.needle, at)
        self.gone = found < 0
        return found


def tags(text):
    """(start, end, name, closing, attributes) of every tag in order; names in lower case, the first of equal attributes counts.

    Comments and declarations are tags named `!`. A tag without an end is text, as is all that script, style, textarea and title hold.
    """
    comment_end, tag_end = _Finder(text, "-->"), _Finder(text, ">")
    raw_end = {}
    at = 0
    while m := _OPEN.search(text, at):
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            find, length = (comment_end, 3) if m.group().endswith("--") else (tag_end, 1)
            stop = find(at)
            if stop >= 0:
                at = stop + length
                yield m.start(), at, "!", False, {}
            continue
        attributes = {}
        while a := _ATTRIBUTE.match(text, at):
            if a.group(1):
                value = next((v for v in a.groups()[1:] if v is not None), "")
                attributes.setdefault(a.group(1).lower(), html.unescape(value))
            at = a.end()
        at = _SPACE.match(text, at).end()
        if at >= len(text):
            return
        at += 1                                       # the closing bracket
        yield m.start(), at, name, bool(m.group(1)), attributes
        if name in _RAW and not m.group(1):
            if name not in raw_end:
                raw_end[name] = _pattern_finder(text, re.compile(rf"</{name}(?=[\s/>])", re.I))
            stop = raw_end[name](at)
            at = stop if stop >= 0 else at


def _pattern_finder(text, pattern):
    gone = False

    def find(at):
        nonlocal gone
        m = None if gone else pattern.search(text, at)
        gone = m is None
        return m.start() if m else -1
    return find


def hrefs_of(text):
    return [a["href"] for _, _, name, closing, a in tags(text) if name == "a" and not closing and "href" in a]


def items_of(text):
    """(text without tags, class) of every list item, in the order they begin.

    An item ends at its end tag, at the next item of its list, at the end of the list or of the page; it holds its inner lists' text.
    """
    pieces, items, levels, at = [], [], [[]], 0       # levels: items that are open in each list

    def close(level):
        while level:
            level.pop()["stop"] = len(pieces)

    raw = False
    for start, end, name, closing, attributes in tags(text):
        if not raw:
            pieces.append(text[at:start])
        at, raw = end, name in ("script", "style") and not closing
        if name in ("ul", "ol"):
            if not closing:
                levels.append([])
            elif len(levels) > 1:
                close(levels.pop())
        elif name == "li":
            close(levels[-1])
            if not closing:
                items.append({"start": len(pieces), "stop": None, "class": attributes.get("class")})
                levels[-1].append(items[-1])
    pieces.append(text[at:])
    return [(html.unescape("".join(pieces[i["start"]:i["stop"]])).strip(), i["class"]) for i in items]


@F.pandas_udf(T.ArrayType(T.StringType()))
def hrefs(page: pd.Series) -> pd.Series:
    return page.map(hrefs_of, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("css_class", T.StringType())])))
def list_items(page: pd.Series) -> pd.Series:
    return page.map(lambda t: [{"item": i, "css_class": c} for i, c in items_of(t)], na_action="ignore")
