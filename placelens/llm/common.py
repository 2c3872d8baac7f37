"""Helpers that the corpus operators share: stage tables, hashed words of Arrow text, union-find over edges, group joins."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens.session import shared_dir

SLICE_BYTES = 1 << 19
BATCH_BYTES = 1 << 22     # of an Arrow batch, which a task holds whole on both sides
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


# ---- tables ------------------------------------------------------------------------------------------------------

def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df, purpose="stage"):
    """Write to the shared folder and read back: cuts lineage, survives lost executors. Returns (table, path).

    Spark deletes the shuffle files of the write when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark, path):
    """Delete a stage table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark):
    """Texts go to Python workers in Arrow batches of BATCH_BYTES, unless the session asks for other than Spark's 64 MB."""
    if spark.conf.get(_BATCH, None) == f"{64 << 20}b":
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def broadcast_if_small(df, rows=500_000):
    """Mark for broadcast only after counting: at most `rows` rows; larger tables are shuffled by the same join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# ---- hashing -----------------------------------------------------------------------------------------------------

def mix(x):
    """SplitMix64 finaliser over a uint64 array."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(n, seed):
    """n fixed pseudo-random uint64 numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


_WORDS = 4                                       # 8-byte words of a span that are hashed span by span; the rest in one go


def span_hashes(data, start, end):
    """Hash of every span [start, end) of a uint8 array, independent of where the span lies.

    The 8-byte words of a span, each mixed together with its place, are added up; so no regular text defeats it, and the last
    word's missing bytes count as zeros, told apart by the span's length.
    """
    start, size = np.asarray(start, np.int64), np.asarray(end - start, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))           # the word that begins at each byte

    def mixed(at, place, left):
        """Words at some bytes, mixed with a number of their place; `left` bytes of the span remain from there."""
        word = words[at]
        cut = np.flatnonzero(left < 8)
        word[cut] &= (np.uint64(1) << (left[cut] * 8).astype(np.uint64)) - np.uint64(1)
        return mix(word + place)

    total = size.astype(np.uint64) * np.uint64(_BASE)
    at = np.flatnonzero(size > 0)
    for k in range(_WORDS):
        total[at] += mixed(start[at] + 8 * k, np.uint64((k + 1) * _BASE & _MASK), size[at] - 8 * k)
        at = at[size[at] > 8 * (k + 1)]
        if not len(at):
            break
    if len(at):
        count = (size[at] - 8 * _WORDS + 7) // 8
        number = expand(np.full(len(at), _WORDS), count)
        first = np.repeat(start[at], count) + 8 * number
        sums = np.add.reduceat(mixed(first, (number.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE), np.repeat(end[at], count) - first), np.cumsum(count) - count)
        total[at] += sums
    return mix(total)


def expand(start, size):
    """Indices start[i] .. start[i] + size[i] - 1 of all i, one after another."""
    total = int(size.sum())
    before = np.cumsum(size) - size
    return np.arange(total) + np.repeat(start - before, size)


# ---- text in Arrow batches ---------------------------------------------------------------------------------------

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PUNCTUATION = ASCII_SPACE.copy()                 # all ASCII but letters and digits separates words
PUNCTUATION[[c for c in range(128) if not chr(c).isalnum()]] = True


def text_bytes(column):
    """(bytes, offsets) of a string array; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch, column="text", size=SLICE_BYTES):
    """Row slices of a record batch of about `size` bytes of text, so that working arrays stay small. Never cuts a row."""
    offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def spans(data, offsets, separator):
    """Start and end of every maximal run of non-separator bytes; runs end at row ends."""
    word = ~separator[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = word[edges]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = word[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data, offsets, separator=ASCII_SPACE, lower=LOWER):
    """(hash, start, end, row bounds) of every word: bounds[i]:bounds[i + 1] are the words of row i."""
    start, end = spans(data, offsets, separator)
    hashes = span_hashes(lower[data], start, end)
    return hashes, start, end, np.searchsorted(start, offsets)


def shingles(hashes, n):
    """Order-dependent hash of every run of n consecutive words of one row."""
    factors = randoms(n, 29) | np.uint64(1)
    m = len(hashes) - n + 1
    total = np.zeros(max(m, 0), np.uint64)
    for j in range(n if m > 0 else 0):
        total += hashes[j:j + m] * factors[j]
    return mix(total)


def distinct(x):
    """Distinct numbers in ascending order; by sorting, which for hashes is faster than numpy's table."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_set(hashes, n):
    """Distinct n-word shingles in ascending order; the whole sequence as one when shorter; empty without words."""
    if not len(hashes):
        return hashes
    return distinct(shingles(hashes, min(n, len(hashes))))


def record_batch(schema, *columns):
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                       for c, f in zip(columns, schema)], schema=schema)


def signed(x):
    return np.asarray(x, np.uint64).view(np.int64)


# ---- union-find --------------------------------------------------------------------------------------------------

class Forest:
    """Union-find over the rows 0..n-1 of one task's block."""

    def __init__(self, n):
        self.parent = list(range(n))

    def root(self, i):
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i, j):
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def roots(self):
        return np.array([self.root(i) for i in range(len(self.parent))], np.int64)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


FOREST = 1 << 18          # edges that a task unites at once


def _forest(a, b):
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(names))
    for i, j in zip(at[:len(a)].tolist(), at[len(a):].tolist()):
        forest.join(i, j)
    root = forest.roots()
    other = root != np.arange(len(names))
    return record_batch(PAIR, names[other], names[root[other]])


def _partition_forest(batches):
    """Replace some edges at a time by spanning stars of their components: union-find before the shuffle."""
    held, size = [], 0
    for batch in batches:
        held.append([batch.column(k).to_numpy() for k in (0, 1)])
        size += batch.num_rows
        if size >= FOREST:
            out = _forest(*map(np.concatenate, zip(*held)))
            yield out
            held, size = [], 0
    if size:
        yield _forest(*map(np.concatenate, zip(*held)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table (a, b long): columns node, component = smallest node reachable.

    Union-find inside each task first, then alternating large-star and small-star rounds (each a minimum per node,
    pre-aggregated, and a join back) until every node has one root. Nodes without edges, loops and nulls give no rows. Every
    round is a stage table in the shared folder, and the one before it is deleted.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b")
    now, path = stage(edges.mapInArrow(_partition_forest, "a long, b long"), "edges")      # a > b: b is the smaller
    while True:
        nodes = now.union(now.select("b", "b").toDF("a", "b")).groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
        found, to = stage(nodes, "roots")
        if found.where("low != high").isEmpty():
            drop(spark, path)
            return found.select(F.col("a").alias("node"), F.col("low").alias("component"))
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        after, next_path = stage(small.select("e.*").where("a != b").distinct().mapInArrow(_partition_forest, "a long, b long"), "edges")
        drop(spark, path)
        drop(spark, to)
        now, path = after, next_path


# ---- encoding by distinct chunks ---------------------------------------------------------------------------------

class ChunkCache:
    """Token ids of distinct chunks of text, so that a chunk is encoded once per worker and not once per occurrence.

    `encode(list of bytes)` gives (ids of all chunks one after another, number of ids of each). Chunks are known by 64-bit
    hash and length; the cache is emptied at `limit` entries, so its memory is bounded.
    """

    def __init__(self, encode, dtype, limit=400_000):
        self.encode, self.dtype, self.limit = encode, dtype, limit
        self.clear()

    def clear(self):
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)                  # in the order of keys
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def ids_of(self, keys, chunk):
        """(ids, number of ids per key); chunk(i) gives the bytes of occurrence i."""
        names, first, at = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.slot) + len(names) > self.limit:
            self.clear()
        where = np.searchsorted(self.keys, names)
        known = where < len(self.keys)
        known[known] = self.keys[where[known]] == names[known]
        slots = np.empty(len(names), np.int64)
        slots[known] = self.slot[where[known]]
        new = np.flatnonzero(~known)
        if len(new):
            ids, size = self.encode([chunk(i) for i in first[new].tolist()])
            slots[new] = np.arange(len(self.slot), len(self.slot) + len(new))
            self.keys, self.slot = np.insert(self.keys, where[new], names[new]), np.insert(self.slot, where[new], slots[new])
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, ids.astype(self.dtype)])
        slots = slots[at.ravel()]
        size = self.size[slots]
        return self.ids[expand(self.start[slots], size)], size
