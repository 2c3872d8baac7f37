"""Splits, one-hot columns, imputation and scaling."""

from functools import reduce

from pyspark.sql import functions as F

from placelens.functions.hashing import hash32

# Four formulas for a standard deviation are in use; each caller names its own:
# per feature, population (model pipelines) / per feature, sample (z-scores) / over folds, population /
# over regions, population weighted by size.


MOST_LEVELS = 10_000   # values that become columns


def dummy_columns(df, column, values=None, prefix="dummy_"):
    """One 0/1 column per value (spaces as underscores) in place of `column`."""
    if values is None:   # becomes one column each, so their number is bounded by the schema
        found = df.select(column).distinct().limit(MOST_LEVELS + 1).collect()
        if len(found) > MOST_LEVELS:
            raise ValueError(f"{column} has more than {MOST_LEVELS} values; name the ones to become columns")
        values = sorted(r[0] for r in found if r[0] is not None)
    hot = [F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(prefix + v.replace(" ", "_")) for v in values]
    return df.select(*[c for c in df.columns if c != column], *hot)


def dummy_category(df, values=None):
    """One-hot org_category, drop article_count, rename category to _category."""
    return dummy_columns(df.drop("article_count"), "org_category", values).withColumnRenamed("category", "_category")


def in_test(key, seed=42, share=0.25):
    """Reproducible hold-out: a hash of the key decides."""
    return hash32(key, seed) % 100 < int(round(share * 100))


def train_test_split(df, key, seed=42, share=0.25):
    return df.withColumn("split", F.when(in_test(key, seed, share), "test").otherwise("train"))


def nested_split(df, key, seed=42, share=0.25):
    """test, and the rest split again into train and validation."""
    again = hash32(key, f"{seed}:inner") % 100 < int(round(share * 100))
    return df.withColumn("split", F.when(in_test(key, seed, share), "test").when(again, "validation").otherwise("train"))


def make_train_test(df, key, target, dummies=(), drop=(), seed=42, share=0.25, levels=None):
    """Nested split with one-hot columns, leak columns dropped, and levels unseen in training removed.

    `levels` names the values of a column that become columns ({column: values}); otherwise all that occur do.

    Returns (table with `split`, names of the feature columns)."""
    out = nested_split(df.drop(*[c for c in drop if c not in dummies]), key, seed, share)
    for d in dummies:
        out = dummy_columns(out, d, (levels or {}).get(d), prefix=d + "_")
    names = [c for c in out.columns if c not in (key, target, "split")]
    dead = dead_levels(out.filter(F.col("split") != "test"), [c for c in names if "_" in c])
    return out.drop(*dead), [c for c in names if c not in dead]


def level_profile(train, columns):
    """Rows (column_name, lowest, highest, total, two_valued) from one pass over the training rows."""
    aggs = [F.array(F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double")), F.sum(F.col(c).cast("double"))).alias(c)
            for c in columns]
    wide = train.agg(*aggs)   # one row
    named = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("a")) for c in columns])
    return wide.select(F.inline(named)).select("column_name", F.col("a")[0].alias("lowest"), F.col("a")[1].alias("highest"),
                                               F.col("a")[2].alias("total"))


def dead_levels(train, columns):
    """Names of the two-valued columns that sum to 0 in the training rows."""
    if not columns:
        return []
    rows = level_profile(train, columns).filter((F.col("total") == 0) | F.col("total").isNull()).collect()   # <= one per column
    dead = [r.column_name for r in rows if r.lowest == r.highest]
    mixed = [r for r in rows if r.lowest != r.highest]   # negative and positive values that cancel out
    if mixed:
        other = reduce(lambda a, b: {**a, **b}, [{r.column_name: F.count_if(
            (F.col(r.column_name) != r.lowest) & (F.col(r.column_name) != r.highest))} for r in mixed])
        counts = train.agg(*[e.alias(c) for c, e in other.items()]).first()
        dead += [c for c in other if counts[c] == 0]
    return dead


def impute_mean(df, columns, train):
    """Fill NULLs with the mean over the rows where the Column `train` is true."""
    means = df.filter(train).agg(*[F.avg(c).alias(c) for c in columns]).first()   # one number per column
    return df.fillna({c: means[c] for c in columns if means[c] is not None})


def zscore(df, columns, train=None, std="population"):
    """(x - mean) / std per column, fitted on the training rows. With `sample` a zero spread gives 0."""
    spread = F.stddev_pop if std == "population" else F.stddev_samp
    base = df if train is None else df.filter(train)
    s = base.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[spread(c).alias(f"s_{c}") for c in columns]).first()

    def scaled(c):
        m, d = s[f"m_{c}"], s[f"s_{c}"]
        if not d:   # constant column: the model scaler only centres it, the z-score becomes 0
            return F.col(c) - m if std == "population" and m is not None else F.lit(0.0)
        out = (F.col(c) - m) / d
        return out if std == "population" else F.coalesce(out, F.lit(0.0))
    return df.withColumns({c: scaled(c) for c in columns})


def zscore_global(df, columns, train=None):
    """One mean and one population std over all known values of all columns together; centred before squaring."""
    base = df if train is None else df.filter(train)
    total = base.agg(*[F.sum(F.col(c).cast("double")).alias(f"s_{c}") for c in columns],
                     *[F.count(c).alias(f"n_{c}") for c in columns]).first()
    n = sum(total[f"n_{c}"] for c in columns)
    mean = sum(total[f"s_{c}"] or 0.0 for c in columns) / max(n, 1)
    squares = base.agg(*[F.sum(F.pow(F.col(c).cast("double") - mean, 2)).alias(c) for c in columns]).first()
    spread = (sum(squares[c] or 0.0 for c in columns) / max(n, 1)) ** 0.5
    return df.withColumns({c: (F.col(c) - mean) / (spread or 1.0) for c in columns})
