"""Ranks, relevance and NDCG for groups of any size."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from placelens.session import cut_lineage


def _list(x):
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def rank_table(df, value, group=None, weight=None):
    """Rows (group, value, n, rank, total): competition rank of every distinct value, largest first.
    A row stands for `weight` rows if that column is named.

    Rows are first counted per value. The distinct values are range-partitioned by group and value; a running count inside
    each partition plus the sum of the partitions above gives the rank. No window spans a whole group, so one group may hold
    most of the table, and partitions grow in number with the session's shuffle partitions.
    """
    keys = _list(group)
    hist = df.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    # stored: the ranges come from a sample, so they are drawn once
    hist = cut_lineage(hist.repartitionByRange(*keys, F.desc(value)).withColumn("_part", F.spark_partition_id()))
    sums = hist.groupBy(*keys, "_part").agg(F.sum("n").alias("_in_part"))
    above = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("_in_part").over(above), F.lit(0)).alias("_above"),
                       F.sum("_in_part").over(Window.partitionBy(*keys)).alias("total"))   # one row per group and partition
    inside = Window.partitionBy(*keys, "_part").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    return (hist.withColumn("_before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .join(sums, [*keys, "_part"])
            .select(*keys, value, "n", (F.col("_above") + F.col("_before") + 1).alias("rank"), "total"))


def _relevance():
    return (F.col("total") - F.col("rank") + 1) / F.col("total")


def relevance(df, value, group=None):
    """Add rank (ties share the best one) and relevance = (total - rank + 1) / total."""
    ranks = rank_table(df, value, group).withColumn("relevance", _relevance()).drop("n", "total")
    return df.join(ranks, [*_list(group), value])


def score_counts(df, y="y", pred="prediction", group=None):
    """Rows (group, y, prediction, c), stored: all metrics derive from these counts, so the table (and the
    models behind it) is evaluated once."""
    return cut_lineage(df.groupBy(*_list(group), y, pred).agg(F.count("*").alias("c")))


def ndcg(df, y="y", pred="prediction", group=None, k=300, cells=None):
    """NDCG@k per group with relevance from the rank of y; tied predictions share their gain evenly.

    Only the k highest distinct predictions can earn anything, so all that follows the first counts
    works on at most k values per group.
    """
    keys = _list(group)
    sums = [0.0]
    for i in range(k):
        sums.append(sums[-1] + 1 / math.log2(i + 2))
    table = F.array(*map(F.lit, sums))

    def discount(start, count):   # summed discounts of the positions start+1 .. start+count
        return F.get(table, F.least(start + count, F.lit(k)).cast("int")) - F.get(table, F.least(start, F.lit(k)).cast("int"))

    cells = score_counts(df, y, pred, group) if cells is None else cells
    order = Window.partitionBy(*keys).orderBy(F.desc(pred))
    top = (cells.groupBy(*keys, pred).agg(F.sum("c").alias("size"))
           .withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= k).drop("_i"))
    start = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = top.withColumn("start", start).filter(F.col("start") < k)
    ranks = rank_table(cells, y, group, weight="c").withColumn("rel", _relevance())
    gains = (cells.join(top, [*keys, pred]).join(ranks.select(*keys, y, "rel"), [*keys, y])
             .groupBy(*keys, pred, "size", "start").agg(F.sum(F.col("c") * F.col("rel")).alias("gain")))
    dcg = gains.groupBy(*keys).agg(F.sum(F.col("gain") / F.col("size") * discount(F.col("start"), F.col("size"))).alias("dcg"))
    ideal = ranks.filter(F.col("rank") <= k).groupBy(*keys).agg(
        F.sum(F.col("rel") * discount(F.col("rank") - 1, F.col("n"))).alias("ideal"))
    if keys:
        return dcg.join(ideal, keys).select(*keys, (F.col("dcg") / F.col("ideal")).alias("ndcg"))
    one = F.lit(0).alias("_one")
    return dcg.select("dcg", one).join(ideal.select("ideal", one), "_one").select((F.col("dcg") / F.col("ideal")).alias("ndcg"))
