"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces, with byte fallback.

The pieces and their log scores come from a SentencePiece model file. A text gets a leading marker, blanks become markers
(U+2581), and the path of pieces with the largest score sum wins; of equal sums the one whose last piece is longest. A
character that no piece of its own covers costs the smallest score less 10 and is written as the byte pieces of its UTF-8.
Decoding joins the pieces, turns byte pieces into bytes and markers into blanks, and drops the leading one.

No piece crosses from a word into the blank after it, nor holds a line feed (checked when the model is read), so the best
path of a text is the best paths of its chunks; distinct chunks are encoded once per worker, many at a time.

Null and empty texts give no ids and decode to the empty text; ids are null only where the text column is missing. Invalid
UTF-8 that decoding may make becomes U+FFFD. A text that holds U+2581 itself decodes to blanks (round_trip is false).
"""

from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import zlib
from pyspark.sql import functions as F

from placelens.llm.common import ChunkCache, expand, slices, small_batches, span_hashes, table, text_bytes

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNKNOWN_PENALTY = 10.0
SIZE = 1 << 18         # bytes of text that a task works on at once
AT_ONCE = 1 << 16      # bytes of chunks whose paths are searched at once; the arrays take some hundred times as much


def _varint(raw, i):
    value = shift = 0
    while True:
        value |= (raw[i] & 127) << shift
        shift += 7
        i += 1
        if raw[i - 1] < 128:
            return value, i


def _fields(raw):
    """(field, value) pairs of a protobuf message; nested messages stay bytes."""
    i = 0
    while i < len(raw):
        key, i = _varint(raw, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(raw, i)
        else:
            size, i = _varint(raw, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = raw[i:i + size], i + size
        yield key >> 3, value


def read_model(path=None):
    """(piece, score, kind) of every id of a SentencePiece model file."""
    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        raw = f.read()
    out = []
    for field, value in _fields(raw):
        if field == 1:
            x = dict(_fields(value))
            out.append((x[1].decode("utf-8"), float(np.frombuffer(x[2], np.float32)[0]) if 2 in x else 0.0, x.get(3, NORMAL)))
    return out


@dataclass
class DoubleArray:
    """child = base[node] + byte exists if check[child] = node; value[node] is a piece id or -1. The root is node 1."""
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    def get(self, key):
        node = 1
        for c in key:
            to = self.base[node] + c
            if to >= len(self.check) or self.check[to] != node:
                return -1
            node = to
        return int(self.value[node])


def build_trie(keys):
    """Double-array trie of {bytes: id}: children of a node go to the first free place that fits them all."""
    tree = {}
    for key, value in keys.items():
        node = tree
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = value
    size = 1 << 16
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[:2] = 0
    queue, free = [(1, tree)], 2
    while queue:
        at, node = queue.pop()
        value[at] = node.pop(-1, -1)
        if not node:
            continue
        bytes_ = sorted(node)
        while check[free] != -1:
            free += 1
        offset, tried = max(free - bytes_[0], 1), 0
        while any(check[offset + c] != -1 for c in bytes_):
            offset += 1
            tried += 1
            if offset + 512 > len(check):
                base, check, value = (np.concatenate([x, np.full(len(x), fill, np.int32)])
                                      for x, fill in ((base, 0), (check, -1), (value, -1)))
        if tried > 64 and len(bytes_) == 1:
            free = offset + bytes_[0]
        base[at] = offset
        for c in bytes_:
            check[offset + c] = at
            queue.append((offset + c, node[c]))
        if offset + 1024 > len(check):
            base, check, value = (np.concatenate([x, np.full(len(x), fill, np.int32)])
                                  for x, fill in ((base, 0), (check, -1), (value, -1)))
    return DoubleArray(base, check, value)


class Codec:
    """Encoder and decoder of one model. Small and of fixed size: it is sent to the tasks as it is."""

    def __init__(self, pieces):
        normal = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.scores = np.array([s for _, s, _ in pieces])
        self.lengths = np.array([len(p.encode()) for p, _, _ in pieces])
        self.unknown_score = min(self.scores[i] for i in normal.values()) - UNKNOWN_PENALTY
        self.trie = build_trie(normal)
        self.longest = max(map(len, normal))
        self.byte_ids = np.full(256, next(i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), np.int32)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.splits = not any(MARK in p.lstrip(MARK) or "\n" in p for p, _, k in pieces if k == NORMAL)
        out = [{CONTROL: b"", UNKNOWN: " ⁇ ".encode(), BYTE: bytes([int(p[3:5], 16)]) if k == BYTE else b""}.get(
            k, p.replace(MARK, " ").encode()) for p, _, k in pieces]
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.out_size = np.array([len(x) for x in out])
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.is_byte = np.array([k == BYTE for _, _, k in pieces])

    def viterbi(self, chunks):
        """Best ids of many chunks (UTF-8 bytes with markers) at once: (ids one after another, ids per chunk)."""
        size = np.array([len(c) for c in chunks], np.int64)
        data = np.frombuffer(b"".join(chunks), np.uint8)
        stop = np.cumsum(size)
        owner = np.repeat(np.arange(len(chunks)), size)
        head = (data & 0xC0) != 0x80
        begins = np.flatnonzero(head)
        width = np.diff(np.append(begins, len(data)))
        # all pieces that begin at each character
        where, node = begins, np.ones(len(begins), np.int64)
        number = np.arange(len(begins))
        single = np.zeros(len(begins), bool)
        found = []
        for k in range(self.longest):
            inside = where + k < stop[owner[where]]
            where, node, number = where[inside], node[inside], number[inside]
            to = self.trie.base[node] + data[where + k].astype(np.int64)
            ok = self.trie.check[np.minimum(to, len(self.trie.check) - 1)] == node
            where, node, number = where[ok], to[ok], number[ok]
            piece = self.trie.value[node]
            hit = piece >= 0
            found.append((where[hit], where[hit] + k + 1, piece[hit]))
            single[number[hit & (width[number] == k + 1)]] = True
        lone = begins[~single]
        found.append((lone, lone + width[~single], np.full(len(lone), -1)))
        begin, end, piece = (np.concatenate(x) for x in zip(*found))
        weight = np.where(piece >= 0, self.scores[piece], self.unknown_score)
        chunk = owner[begin]
        first = stop - size
        order = np.lexsort((begin, end, end - first[chunk]))
        begin, end, piece, weight, chunk = (x[order] for x in (begin, end, piece, weight, chunk))
        depth = end - first[chunk]
        node_at = lambda position: position + chunk_at     # noqa: E731  one more node than bytes in each chunk
        best = np.full(len(data) + len(chunks), -np.inf)
        best[first + np.arange(len(chunks))] = 0
        back = np.full(len(best), -1, np.int64)
        cuts = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1], True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            chunk_at = chunk[a:b]
            total = best[node_at(begin[a:b])] + weight[a:b]
            groups = np.flatnonzero(np.r_[True, end[a + 1:b] != end[a:b - 1]])
            top = np.maximum.reduceat(total, groups)
            sizes = np.diff(np.append(groups, b - a))
            ties = np.flatnonzero(total == np.repeat(top, sizes))
            win = ties[np.searchsorted(ties, groups)]
            to = end[a:b][win] + chunk_at[win]
            best[to], back[to] = total[win], win + a
        # walk back, all chunks in step
        live = np.flatnonzero(size > 0)
        at, links, owners = stop[live] + live, [], []
        while len(live):
            step = back[at]
            links.append(step)
            owners.append(live)
            at = begin[step] + live
            more = at > first[live] + live
            at, live = at[more], live[more]
        if not links:
            return np.zeros(0, np.int32), np.zeros(len(chunks), np.int64)
        turn = np.repeat(np.arange(len(links)), [len(x) for x in links])
        links, owners = np.concatenate(links), np.concatenate(owners)
        links, owners = (x[np.lexsort((-turn, owners))] for x in (links, owners))
        ids, count = piece[links].astype(np.int32), np.ones(len(links), np.int64)
        lone = ids < 0
        count[lone] = (end - begin)[links[lone]]
        source = expand(np.where(lone, begin[links], 0), count)
        ids = np.where(np.repeat(lone, count), self.byte_ids[data[np.where(np.repeat(lone, count), source, 0)]] if len(data) else 0,
                       np.repeat(ids, count))
        return ids.astype(np.int32), np.bincount(owners, count, len(chunks)).astype(np.int64)

    def encode_column(self, column, cache):
        """(ids, row bounds) of a string column."""
        data, offsets = text_bytes(column)
        mark = MARK.encode()
        full = offsets[:-1][offsets[1:] > offsets[:-1]]
        begins = np.zeros(len(data), bool)
        if self.splits and len(data):
            blank, feed = data == 32, data == 10
            begins = blank.copy()
            begins[1:] &= ~blank[:-1]
            begins |= feed
            begins[1:] |= feed[:-1]
        begins[full] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        keys = span_hashes(data, start, end)
        lead = np.zeros(len(data), bool)
        lead[full] = True
        lead = lead[start]
        keys ^= lead.astype(np.uint64)

        def chunk(i):
            return (mark if lead[i] else b"") + data[start[i]:end[i]].tobytes().replace(b" ", mark)

        ids, size = cache.ids_of(keys, chunk)
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, total[np.searchsorted(start, offsets)]

    def decode_rows(self, ids, bounds):
        """Texts of rows of ids, as an Arrow array."""
        size = self.out_size[ids]
        data = self.out[expand(self.out_start[ids], size)]
        total = np.concatenate([[0], np.cumsum(size)])[bounds]
        start, end = total[:-1].copy(), total[1:]
        start += (end > start) & (data[np.minimum(start, len(data) - 1)] == 32) if len(data) else 0
        data = data.tobytes()
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())], pa.large_string())

    def paths(self, chunks):
        """As viterbi, some chunks at a time, so that working arrays stay small."""
        size = np.cumsum([0, *map(len, chunks)])
        cuts, out = [0], []
        while cuts[-1] < len(chunks):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(size, size[cuts[-1]] + AT_ONCE, "right")) - 1))
            out.append(self.viterbi(chunks[cuts[-2]:cuts[-1]]))
        return tuple(map(np.concatenate, zip(*out))) if out else self.viterbi(chunks)

    def cache(self):
        return ChunkCache(self.paths, np.int32)


_CACHES = {}


def _worker(shared):
    """The codec of this task and the chunk cache that its worker keeps between tasks."""
    codec = shared.value
    key = (len(codec.scores), float(codec.scores.sum()))
    if key not in _CACHES:
        _CACHES[key] = codec.cache()
    return codec, _CACHES[key]


def encode(documents, pieces=None):
    """doc_id, ids, n_tokens, n_fallback (byte pieces), ids_crc32 (of 32-bit little-endian ids), round_trip."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(Codec(pieces or read_model()))

    def run(batches):
        codec, cache = _worker(shared)
        for batch in batches:
            for part in slices(batch, size=SIZE):
                ids, bounds = codec.encode_column(part.column(1), cache)
                back = codec.decode_rows(ids, bounds)
                fallback = np.concatenate([[0], np.cumsum(codec.is_byte[ids])])[bounds]
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                text = part.column(1).cast(pa.large_string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)),
                     pa.array(np.diff(bounds)), pa.array(np.diff(fallback)), pa.array(crc, pa.int64()),
                     pa.compute.equal(back, pa.compute.fill_null(text, ""))],
                    names=["doc_id", "ids", "n_tokens", "n_fallback", "ids_crc32", "round_trip"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, ids array<int>, n_tokens long, n_fallback long, ids_crc32 long, round_trip boolean")


def decode(encoded, pieces=None):
    """doc_id and text of rows of ids (null: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Codec(pieces or read_model()))

    def run(batches):
        codec, _ = _worker(shared)
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            ids = np.array([i for x in lists for i in x], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), codec.decode_rows(ids, bounds).cast(pa.string())],
                                             names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def op2_sentencepiece(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"))
