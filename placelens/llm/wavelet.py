"""Token-id output as wavelet matrices: one compressed file per shard, with access, counting and occurrence lookup.

A shard holds the token ids of consecutive documents (ascending doc_id) as a wavelet matrix: one bit plane per id bit, from
the highest, each stably partitioned by the bits before it, packed eight to a byte, with the number of ones before every
block of 4096 positions. From the file alone, `access(i)`, `rank(id, i)`, `count(id)` and `select(id, k)` need a few block
reads per plane; `tokens()` restores the whole sequence.

Documents are range-partitioned and sorted by id, so a shard never holds more than SHARD_TOKENS ids besides its last
document. Rows with a null id come first; rows of one id follow each other in an order that the text decides; null and empty
texts consist of the end id. An empty table gives no file and no row. Files take a name of their own in each task attempt,
and only files that a finished attempt returned are read.
"""

import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from placelens.llm.common import ChunkCache, LOWER, record_batch, slices, span_hashes, spans, stage, table, text_bytes
from placelens.llm.warc import _open
from placelens.session import shared_dir

END_ID = 1
SHARD_TOKENS = 1 << 21
BLOCK = 4096                     # positions per rank sample
MAGIC = b"WVM1"
SIZE = 4 << 20

MANIFEST = pa.schema([("partition", pa.int32()), ("path", pa.string()), ("first", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST_DDL = "partition int, path string, first long, n_tokens long"
ROWS_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """Bit planes with rank samples over a sequence of unsigned integers."""

    def __init__(self, n, bits, planes, zeros, samples):
        self.n, self.bits, self.planes, self.zeros, self.samples = n, bits, planes, zeros, samples

    @classmethod
    def build(cls, ids, bits=None):
        ids = np.asarray(ids)
        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, samples = [], [], []
        for level in range(bits - 1, -1, -1):
            one = (now >> level) & 1 == 1
            planes.append(np.packbits(one))
            zeros.append(len(now) - int(np.count_nonzero(one)))
            samples.append(np.concatenate([[0], np.cumsum(np.add.reduceat(one, np.arange(0, len(one), BLOCK), dtype=np.int64))])
                           if len(one) else np.zeros(1, np.int64))
            now = np.concatenate([now[~one], now[one]])
        return cls(len(ids), bits, planes, zeros, samples)

    # -- queries ---------------------------------------------------------------------------------------------------

    def _bit(self, level, i):
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, level, i):
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        bits = np.unpackbits(self.planes[level][block * BLOCK >> 3:(i + 7) >> 3])
        return int(self.samples[level][block]) + int(bits[:i - block * BLOCK].sum())

    def access(self, i):
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, symbol, i):
        a, b = 0, i
        for level in range(self.bits):
            x, y = self._ones(level, a), self._ones(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if symbol >> (self.bits - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def rank(self, symbol, i):
        """Occurrences of the id among the first i tokens."""
        if symbol >> self.bits:
            return 0
        a, b = self._range(symbol, min(i, self.n))
        return b - a

    def count(self, symbol):
        return self.rank(symbol, self.n)

    def select(self, symbol, k):
        """Position of the k-th occurrence, k from 0; -1 if there are not so many."""
        if symbol >> self.bits:
            return -1
        a, b = self._range(symbol, self.n)
        if not 0 <= k < b - a:
            return -1
        at = a + k
        for level in range(self.bits - 1, -1, -1):
            one = symbol >> (self.bits - 1 - level) & 1
            at = self._find(level, at - self.zeros[level], one) if one else self._find(level, at, one)
        return at

    def _find(self, level, k, bit):
        """Position of the k-th one (or zero) of a plane."""
        sample = self.samples[level]
        before = sample if bit else np.minimum(np.arange(len(sample)) * BLOCK, self.n) - sample
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK >> 3:(block + 1) * BLOCK >> 3])[:self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def tokens(self):
        """The whole sequence: the partitions are undone from the last plane upwards."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).view(bool)
            before = np.empty_like(now)
            before[~one] = now[:self.zeros[level]]
            before[one] = now[self.zeros[level]:] | now.dtype.type(1 << (self.bits - 1 - level))
            now = before
        return now

    # -- file ------------------------------------------------------------------------------------------------------

    def to_bytes(self, extra=b""):
        head = struct.pack("<4sQII", MAGIC, self.n, self.bits, len(extra)) + extra
        return head + b"".join(struct.pack("<Q", z) + s.astype("<u4").tobytes() + p.tobytes()
                               for z, s, p in zip(self.zeros, self.samples, self.planes))

    @classmethod
    def from_bytes(cls, raw):
        magic, n, bits, size = struct.unpack_from("<4sQII", raw)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = struct.calcsize("<4sQII")
        extra, at = raw[at:at + size], at + size
        planes, zeros, samples = [], [], []
        blocks, length = -(-n // BLOCK) + 1, (n + 7) >> 3
        for _ in range(bits):
            zeros.append(struct.unpack_from("<Q", raw, at)[0])
            samples.append(np.frombuffer(raw, "<u4", blocks, at + 8).astype(np.int64))
            planes.append(np.frombuffer(raw, np.uint8, length, at + 8 + 4 * blocks))
            at += 8 + 4 * blocks + length
        return cls(n, bits, planes, zeros, samples), extra


# ---- tokens of texts ---------------------------------------------------------------------------------------------

BREAKS = np.zeros(256, bool)
BREAKS[[10, 32]] = True          # white space to the tokenizer, whatever follows or precedes it
_MARKS, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARKS[list(b".,;:!?")] = True
_ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True
_CACHES = {}


def _chunk_cache(path):
    if path not in _CACHES:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)

        def encode(chunks):
            found = tokenizer.encode([c.decode("utf-8") for c in chunks], is_pretokenized=True, add_special_tokens=False)
            size = np.bincount(np.array(found.word_ids, np.int64), minlength=len(chunks)) if found.ids else np.zeros(len(chunks), np.int64)
            return np.array(found.ids, np.uint32), size.astype(np.int64)

        _CACHES[path] = ChunkCache(encode, np.uint32, 600_000)
    return _CACHES[path]


def encode_column(column, path):
    """Token ids of a text column, each row ended by END_ID: (ids, row bounds)."""
    data, offsets = text_bytes(column)
    start, end = spans(data, offsets, BREAKS)
    # a mark after an ASCII letter or digit begins a word of its own to the tokenizer
    mark = np.zeros(len(data) + 1, bool)
    if len(data):
        mark[1:-1] = _MARKS[data[1:]] & _ALNUM[data[:-1]]
    mark[offsets] = False
    first, last = mark.copy(), mark
    first[start], last[end] = True, True
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    # the tokenizer lowers case, but only after it has looked for its special strings
    keys = span_hashes(data if b"<|" in data.tobytes() else LOWER[data], start, end)
    ids, size = _chunk_cache(path).ids_of(keys, lambda i: data[start[i]:end[i]].tobytes())
    total = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, offsets)]
    bounds = total + np.arange(len(total))
    out = np.full(bounds[-1], END_ID, np.uint32)
    out[np.arange(total[-1]) + np.repeat(np.arange(len(total) - 1), np.diff(total))] = ids
    return out, bounds


# ---- shards ------------------------------------------------------------------------------------------------------

def write_shards(documents, folder, path):
    """Encode and write; returns the manifest: partition, file, tokens of the partition before it, tokens in it."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", "text").select("doc_id", "text", F.spark_partition_id().alias("p"))

    def write(batches):
        held, docs, bounds, tokens, first = [], [], [0], 0, 0
        partition = None

        def flush():
            ids = np.concatenate(held)
            numbers = np.array([0 if d is None else d for d in docs], "<i8")
            none = np.array([d is None for d in docs], np.uint8)
            extra = zlib.compress(struct.pack("<Q", len(docs)) + numbers.tobytes() + none.tobytes()
                                  + np.array(bounds, "<u8").tobytes(), 1)
            fs, at = _open(name := f"{folder}/{uuid.uuid4().hex}.wvm")
            with fs.open_output_stream(at, compression=None) as out:
                out.write(WaveletMatrix.build(ids).to_bytes(extra))
            return record_batch(MANIFEST, [partition], [name], [first], [len(ids)])

        for batch in batches:
            for part in slices(batch, size=SIZE):
                partition = part.column(2)[0].as_py()
                ids, at = encode_column(part.column(1), path)
                row, names = 0, part.column(0).to_pylist()
                while row < len(names):
                    room = max(SHARD_TOKENS - tokens, 1)
                    to = max(row + 1, int(np.searchsorted(at, at[row] + room, "right")) - 1)
                    held.append(ids[at[row]:at[to]])
                    docs += names[row:to]
                    bounds += (at[row + 1:to + 1] - at[row] + tokens).tolist()
                    tokens, row = bounds[-1], to
                    if tokens >= SHARD_TOKENS or row < len(names):
                        yield flush()
                        first += tokens
                        held, docs, bounds, tokens = [], [], [0], 0
        if docs:
            yield flush()

    return ordered.mapInArrow(write, MANIFEST_DDL)


def read_shard(path):
    """(wavelet matrix, doc ids with None for null, document bounds) of one file."""
    fs, at = _open(path)
    with fs.open_input_stream(at, compression=None) as source:
        matrix, extra = WaveletMatrix.from_bytes(source.read())
    extra = zlib.decompress(extra)
    n = struct.unpack_from("<Q", extra)[0]
    numbers, none = np.frombuffer(extra, "<i8", n, 8), np.frombuffer(extra, np.uint8, n, 8 + 8 * n)
    return matrix, [None if x else int(d) for d, x in zip(numbers, none)], np.frombuffer(extra, "<u8", n + 1, 8 + 9 * n).astype(np.int64)


def read_shards(manifest):
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files.

    What lies before a shard is the total of the range partitions before its own (one number per partition goes to the
    driver, as many as the range exchange has partitions) and its place within its partition.
    """
    spark = manifest.sparkSession
    totals = sorted(manifest.groupBy("partition").agg(F.sum("n_tokens")).collect())
    before = dict(zip((p for p, _ in totals), np.cumsum([0] + [n for _, n in totals]).tolist()))

    def read(batches):
        for batch in batches:
            for partition, path, first in zip(*(batch.column(k).to_pylist() for k in range(3))):
                matrix, docs, bounds = read_shard(path)
                raw = matrix.tokens().astype("<u4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(bounds[:-1] + first + before[partition]), pa.array(np.diff(bounds)),
                     pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("partition", "path", "first").repartition(files).mapInArrow(read, ROWS_DDL)


def token_files(documents, path=None):
    """Write the shards of `documents` and read them back."""
    folder = shared_dir(documents.sparkSession, "wavelet")
    manifest, _ = stage(write_shards(documents, folder, path or public_tokenizers.path("word_bpe_49k.json")), "manifest")
    return read_shards(manifest)


def op5_wavelet(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"))
