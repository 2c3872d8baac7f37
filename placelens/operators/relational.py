"""Check-in and venue tables: joins, filters, recodes and summaries."""

from functools import reduce

from pyspark.sql import functions as F

# Substrings and exclusions that define the target category, region merges.
BAR_SUBSTRINGS = ("bar", "pub")
BAR_EXCLUDED = ("Salon / Barbershop", "Public Art")
BUS_CATEGORIES = ("Bus Station", "Bus Line")
REGION_MERGES = {"JC + SI": ("Staten Island", "Jersey City"), "Bronx + Queens": ("Bronx", "Queens")}


def typed_checkins(raw):
    """Cast the text columns of raw check-ins. The time looks like `Tue Apr 03 18:00:06 +0000 2012`;
    the weekday is dropped because time patterns cannot parse it."""
    return raw.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("venue_id").cast("string").alias("venue_id"),
        F.try_to_timestamp(F.expr("substring(utc_time, 5)"), F.lit("MMM dd HH:mm:ss Z yyyy")).alias("utc_time"),
        F.expr("try_cast(timezone_offset_mins AS INT)").alias("timezone_offset_mins"),
    )


def checkins_with_venues(checkins, venues):
    """One row per check-in with its venue. Venue ids are unique, so a venue that takes a large
    share of the check-ins is split by the adaptive skew join without replicating rows."""
    return checkins.join(venues, "venue_id")


def venue_visits(checkins, venues):
    """Non-null users per venue, counted before the join: only partial counts are shuffled, so a
    venue with a third of all check-ins costs no more than any other."""
    counts = checkins.groupBy("venue_id").agg(F.count("user_id").alias("total_visits"))
    return (venues.join(counts, "venue_id")
            .groupBy("venue_id", "lat", "long", "category").agg(F.sum("total_visits").alias("total_visits")))


def top_countries(checkins, venues, n=10):
    counts = checkins.groupBy("venue_id").agg(F.count("*").alias("n"))
    return (venues.select("venue_id", "country_code").join(counts, "venue_id")
            .groupBy("country_code").agg(F.sum("n").alias("checkins"))
            .orderBy(F.desc("checkins"), "country_code").limit(n))


def value_counts(df, column, n=None):
    """Rows per value, largest first, ties by value."""
    out = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return out if n is None else out.limit(n)


def in_box(lat_range, long_range, lat="lat", long="long"):
    """Strictly inside a box."""
    return ((F.lit(lat_range[0]) < F.col(lat)) & (F.col(lat) < F.lit(lat_range[1]))
            & (F.lit(long_range[0]) < F.col(long)) & (F.col(long) < F.lit(long_range[1])))


def box_filter(df, lat_range, long_range, exclude=None):
    """Rows strictly inside the box and not strictly inside the excluded (lat, long) box."""
    out = df.filter(in_box(lat_range, long_range))
    return out if exclude is None else out.filter(~in_box(*exclude))


def matches_category(column="category", substrings=BAR_SUBSTRINGS, excluded=BAR_EXCLUDED):
    name = F.lower(F.col(column))
    hit = reduce(lambda a, b: a | b, [name.contains(s) for s in substrings])
    return hit & ~F.col(column).isin(*excluded)


def distinct_matching(df, column, substring, order):
    """Distinct values containing a substring, in order of first appearance by `order`."""
    return (df.filter(F.lower(F.col(column)).contains(substring))
            .groupBy(column).agg(F.min(order).alias("first_seen")).orderBy("first_seen"))


def recode(df, column, mapping):
    """Replace values by membership: {new value: old values}."""
    value = F.col(column)
    out = value
    for new, old in mapping.items():
        out = F.when(value.isin(*old), new).otherwise(out)
    return df.withColumn(column, out)


def unify_category(df, name="Bar"):
    """Keep the category as org_category and set one name for all rows."""
    cols = [c for c in df.columns if c != "category"]
    out = df.select(*cols, F.lit(name).alias("category"), F.col("category").alias("org_category"))
    return out.select(*cols[:3], "category", *cols[3:], "org_category")


def null_rows(df, subset=None):
    """Rows with at least one NULL (the complement of na.drop)."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in subset or df.columns]))


def null_profile(df):
    """Row count, column count and total number of NULLs in one pass."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    return df.agg(F.count("*").alias("row_count"), nulls.alias("null_count")).select(
        "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"), "null_count")


def column_range(df, first, last, keep=()):
    """Columns from `first` to `last` in schema order, inclusive."""
    i, j = df.columns.index(first), df.columns.index(last)
    return df.select(*keep, *df.columns[i:j + 1])


def _histogram(df, group, value):
    """Rows per (group, value). Exact quantiles then read frequencies, so no group's rows are ever
    gathered in one task, whatever share of the table it holds."""
    return df.groupBy(group, value).agg(F.count("*").alias("freq"))


def median_by(df, group="category", value="total_visits", n=None):
    """Exact median and count per group, highest median first."""
    out = (_histogram(df, group, value).groupBy(group)
           .agg(F.percentile(value, F.lit(0.5), F.col("freq")).alias("median_visits"), F.sum("freq").alias("n"))
           .orderBy(F.desc("median_visits"), group))
    return out if n is None else out.limit(n)


def box_stats(df, group="category", value="total_visits"):
    """Quartiles, whiskers at 1.5 IQR and outlier count per group."""
    hist = _histogram(df, group, value)
    q = hist.groupBy(group).agg(
        *[F.percentile(value, F.lit(p), F.col("freq")).alias(name)
          for p, name in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))])
    v, reach = F.col(value), 1.5 * (F.col("q3") - F.col("q1"))
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return hist.join(q, group).groupBy(group, "q1", "q2", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(F.col("freq"))).alias("outliers"))


def seeded_order(df, key, seed=42):
    """A reproducible full shuffle: rows ordered by a hash of the key."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.withColumn("order_key", order).orderBy("order_key")


def union_categories(df, categories):
    """Concatenation of the per-category subsets: one scan with a membership test."""
    return df.filter(F.col("category").isin(*categories))


def combine_features(left, right, key="venue_id"):
    """Two feature tables side by side, aligned by key."""
    return left.join(right, key, "full_outer")


def attach_coordinates(errors, places, key="venue_id"):
    return errors.join(places.select(key, "lat", "long"), key)
