"""Links within candidate groups of any size: blocks of bounded size, joined inside, then across what is still apart.

All links among the items of a group must be found, as far as connected components need them. First every item meets its
smallest lead, in blocks of bounded size, each with a copy of the lead; groups that are then one component are done,
whatever their size. The others are joined whole, block by block; pairs already in one component are not looked at. Where
such a group has several blocks and is still not one component, every item outside its largest component meets all its items,
again in blocks. So a large group of mutually similar items costs about one look at each item, and no pair is left out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from placelens.llm.common import PAIR, broadcast_if_small, components, drop, record_batch, stage

BLOCK = 256
AT_ONCE = 1 << 20      # bytes of payload that are prepared together


def runs(batches, keys):
    """Consecutive rows that agree in the first `keys` columns of a sorted partition, as lists of columns. Holds one run."""
    held, name = [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(n, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:]):
            this = tuple(c[a] for c in columns)
            if held and this != name:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            name = this
    if held:
        yield pa.Table.from_batches(held)


def _known(rows, found, item="item"):
    """`rows` with the component found so far of each item, itself if none."""
    found = broadcast_if_small(found.select(F.col("node").alias(item), F.col("component").alias("known")))
    return rows.join(found, item, "left").withColumn("known", F.coalesce("known", item))


def _batched(runs_):
    """Consecutive runs together, up to AT_ONCE bytes of payload, so that their payloads are prepared in one go."""
    held, size = [], 0
    for run in runs_:
        held.append(run)
        size += run.column("payload").nbytes
        if size >= AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _prepared(tables, prepare):
    """Each table with the prepared payloads of its rows."""
    every = prepare(pa.concat_arrays([c for t in tables for c in t.column("payload").chunks]))
    at = 0
    for t in tables:
        yield t, every[at:at + t.num_rows]
        at += t.num_rows


def _block_join(groups, items, prepare, links):
    """Links inside each block of the groups (gid, item, known, blocks); the group's lead is copied into all blocks."""
    own = F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")
    dealt = groups.withColumn("block", F.explode(
        F.when(F.col("item") == F.col("gid"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))

    def join(batches):
        for tables in _batched(runs(batches, 2)):
            found = [], []
            for run, sets in _prepared(tables, prepare):
                names, at = np.unique(run.column("item").to_numpy(), return_index=True)
                known = run.column("known").to_numpy()[at].tolist()
                for i, j in links(([sets[k] for k in at.tolist()], known), None) if len(names) > 1 else ():
                    found[0].append(names[i])
                    found[1].append(names[j])
            if found[0]:
                yield record_batch(PAIR, *found)

    rows = dealt.join(items, "item").select("gid", "block", "item", "known", "payload")
    made = rows.repartition("gid", "block").sortWithinPartitions("gid", "block").mapInArrow(join, "a long, b long")
    return stage(made, "links")


def _sized(groups):
    """A stored table of (gid, item, known) with the number of blocks of each group; few groups have more than one."""
    sizes = groups.groupBy("gid").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    sizes, _ = stage(sizes.select("gid", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large-groups")
    return groups.join(broadcast_if_small(sizes), "gid", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def link_groups(pairs, items, prepare, links):
    """Components of all links inside candidate groups: columns node, component.

    pairs: gid, item (long), stored; the group gid consists of the item gid, its lead, and the items paired with it. items: item,
    payload (string). prepare(array of payloads) gives a list of what links() compares; links(left, right) gets such lists
    and the components known so far, and returns index pairs into left + right of links that connect whatever is linked and not
    yet in one component; right is None for a join of left with itself.
    """
    spark = pairs.sparkSession
    # every item once, with its smallest lead: joins most of what belongs together
    once = pairs.groupBy("item").agg(F.min("gid").alias("gid")).select("gid", "item")
    once, first_path = stage(once.withColumn("known", F.col("item")), "groups")
    own = once.select("gid").distinct().select("gid", F.col("gid").alias("item"), F.col("gid").alias("known"))
    joined, _ = _block_join(_sized(once.union(own)), items, prepare, links)
    found, found_path = stage(components(joined), "components")
    drop(spark, first_path)

    # all groups whose items are not of one component yet, whole
    led = _known(_known(pairs, found).withColumnRenamed("known", "own"), found, "gid").select("gid", "item", "own", "known")
    led, led_path = stage(led, "led")
    open_ = led.where("own != known").select("gid").distinct()
    open_, open_path = stage(open_, "open")
    if open_.isEmpty():
        return found
    rest = led.join(broadcast_if_small(open_), "gid", "left_semi").select("gid", "item", F.col("own").alias("known"))
    own = rest.join(led.select("gid", F.col("known").alias("lead")).distinct(), "gid").select(
        "gid", F.col("gid").alias("item"), F.col("lead").alias("known")).distinct()
    rest, rest_path = stage(_sized(stage(rest.union(own), "rest")[0]), "rest")
    for path in (led_path, open_path, found_path):
        drop(spark, path)
    more, _ = _block_join(rest, items, prepare, links)
    joined = joined.union(more)
    large = rest.where("blocks > 1").drop("known")
    if large.isEmpty():
        return components(joined)

    # in groups of several blocks: what is outside the largest component meets all
    found, _ = stage(components(joined), "components")
    large, _ = stage(_known(large, found).withColumnRenamed("known", "component"), "large")
    parts = large.groupBy("gid", "component").count().groupBy("gid").agg(
        F.max_by("component", F.struct("count", "component")).alias("most"), F.count("*").alias("parts"))
    large = large.join(parts.where("parts > 1"), "gid")
    apart = large.where("component != most")
    counts = apart.groupBy("gid").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("probes"))
    if counts.isEmpty():
        return found
    own = F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")
    probe = F.pmod(F.xxhash64("item", F.lit(1)), F.col("probes")).cast("int")
    left = apart.join(counts, "gid").select("gid", "item", "component", probe.alias("p"), F.explode(
        F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"))
    right = large.join(counts, "gid").select("gid", "item", "component", F.explode(
        F.sequence(F.lit(0), F.col("probes") - 1)).alias("p"), own.alias("block"), F.lit(1).alias("side"))

    def meet(batches):
        for run in runs(batches, 3):
            side, names, known = (run.column(c).to_numpy() for c in ("side", "item", "component"))
            sets = prepare(run.column("payload").combine_chunks())
            lists = []
            for s in (0, 1):
                at = np.flatnonzero(side == s).tolist()
                lists.append(([sets[i] for i in at], known[at].tolist(), names[at].tolist()))
            if lists[0][0] and lists[1][0]:
                linked = links(lists[0][:2], lists[1][:2])
                if linked:
                    both = lists[0][2] + lists[1][2]
                    yield record_batch(PAIR, [both[i] for i, _ in linked], [both[j] for _, j in linked])

    cells = left.union(right).join(items, "item").select("gid", "p", "block", "side", "item", "component", "payload")
    met = cells.repartition("gid", "p", "block").sortWithinPartitions("gid", "p", "block").mapInArrow(meet, "a long, b long")
    return components(joined.union(stage(met, "links")[0]))          # stored, as a task with two Python workers takes twice the memory


def stars(batches):
    """Edges (first item, other item) of every signature that several items share, from rows sorted by signature and item.

    Only the first item of the running signature is held, so a signature of any number of items needs no memory.
    """
    sig, lead, last = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        s, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        new[0] = s[0] != sig
        where = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
        leads = np.where(where >= 0, d[np.maximum(where, 0)], lead if lead is not None else 0)
        other = leads != d
        other[1:] &= (d[1:] != d[:-1]) | new[1:]
        if sig == s[0] and last == d[0]:
            other[0] = False
        if other.any():
            yield record_batch(PAIR, leads[other], d[other])
        sig, lead, last = int(s[-1]), int(leads[-1]), int(d[-1])


def candidate_pairs(signatures):
    """Groups of items that share a signature with their lead: columns gid, item. From rows sig, item (long).

    The lead of a signature is its smallest item; a group is all that one lead leads, so it holds each set of items that
    share a signature, and never grows by chains of signatures.
    """
    shared = signatures.repartition("sig").sortWithinPartitions("sig", "item").mapInArrow(stars, "a long, b long")
    return shared.distinct().toDF("gid", "item")
