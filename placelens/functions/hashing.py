"""Seeded pseudo-random columns that any engine with md5 can reproduce."""

from pyspark.sql import functions as F


def hash32(key, tag):
    """First 32 bits of md5(key:tag) as BIGINT."""
    text = F.concat(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"),
                    F.lit(f":{tag}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(key, tag):
    """Uniform number in [0, 1)."""
    return hash32(key, tag) / F.lit(4294967296.0)
