"""Coordinates from `{{coord|...}}` templates, as Column expressions."""

from pyspark.sql import functions as F

VALID = r"^[0-9.\-]+$"
DIRECTIONS = ("N", "S", "E", "W")


def is_coordinate(c):
    """Only digits, dots and minus signs, and not one of the malformed combinations."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(VALID) & ~c.isin(".", "-") & ~c.contains("..") & ~c.contains("--"), F.lit(False))


def to_number(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.when(is_coordinate(c), c.try_cast("double"))


def _from_first_number(tokens):
    """Drop tokens before the first number (labels, blanks left by doubled pipes)."""
    first = F.array_position(F.transform(tokens, is_coordinate), F.lit(True))
    return F.when(first > 0, F.slice(tokens, first, F.size(tokens)))


def _half(tokens):
    """One degrees[-minutes[-seconds]]-direction sequence: (value, direction, tokens used)."""
    t = [F.get(tokens, F.lit(i)) for i in range(4)]
    side = [F.upper(x).isin(*DIRECTIONS) for x in t]
    n = [to_number(x) for x in t]
    return (F.when(side[1], F.struct(n[0].alias("v"), F.upper(t[1]).alias("side"), F.lit(2).alias("used")))
            .when(n[1].isNotNull() & side[2],
                  F.struct((n[0] + n[1] / 60).alias("v"), F.upper(t[2]).alias("side"), F.lit(3).alias("used")))
            .when(n[1].isNotNull() & n[2].isNotNull() & side[3],
                  F.struct((n[0] + n[1] / 60 + n[2] / 3600).alias("v"), F.upper(t[3]).alias("side"), F.lit(4).alias("used"))))


def _parse(body):
    tight = F.replace(F.replace(F.regexp_replace(body, r"[\n\t ]", ""), F.lit("|||"), F.lit("|")), F.lit("||"), F.lit("|"))
    # steps are bound one by one, so that no subexpression is written out many times
    def bind(value, fn):
        return F.get(F.transform(F.array(value), fn), F.lit(0))

    def parsed(tokens):
        def with_lat(lat):
            rest = _from_first_number(F.slice(tokens, lat["used"] + 1, F.size(tokens)))
            return bind(rest, lambda r: bind(_half(r), lambda long: F.when(long.isNotNull(), F.struct(
                F.when(lat["side"] == "S", -lat["v"]).otherwise(lat["v"]).alias("lat"),
                F.when(long["side"] == "W", -long["v"]).otherwise(long["v"]).alias("long")))))

        pair = [to_number(F.get(tokens, F.lit(i))) for i in range(3)]
        plain = F.when(pair[0].isNotNull() & pair[1].isNotNull() & pair[2].isNull(),
                       F.struct(pair[0].alias("lat"), pair[1].alias("long")))
        return bind(_half(tokens), lambda lat: F.when(lat.isNull(), plain).otherwise(with_lat(lat)))

    return bind(_from_first_number(F.split(tight, r"\|")), parsed)


def extract_coordinates(text, first_only=False):
    """Struct (lat, long) of the first coord template that parses, NULL if none.

    Accepted: degrees, degrees-minutes or degrees-minutes-seconds each with a direction, and a plain
    decimal pair, with or without a closing pipe. `first_only` looks at the first template alone.
    """
    bodies = F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(r"\{\{[cC]oord\|([^}]*)"), F.lit(1))
    if first_only:
        bodies = F.slice(bodies, 1, 1)
    return F.get(F.filter(F.transform(bodies, _parse), lambda p: p.isNotNull()), F.lit(0))
