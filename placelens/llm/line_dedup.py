"""Fuzzy line deduplication by MinHash: of every component of similar lines, in the whole corpus, one line stays.

A line is a part of a text between line feeds, trimmed of ASCII white space, A-Z in lower case. Its set holds its shingles of
Q characters (the whole line, if shorter); two lines are similar at a Jaccard similarity of SIMILAR or more. Every distinct
line gets BANDS * ROWS minima of multiplied shingle hashes; ROWS minima make a band. A pair at the threshold shares no band
with probability (1 - 0.8^6)^31 < 1e-4. Longer lines, of which unrelated ones are more alike, get more bands of more rows
(SCHEMES), from the minima of hashed bins; lines not far below a scheme's least size are in both schemes, as they may be similar
to lines in it. Schemes are signed in passes, so that disk holds the signatures of one. A line and all that share a band of which it is the smallest line form a candidate
group, cut where the sizes of their sets differ too much. Sketches of BINS bins cut the groups first, where a similarity at the threshold would need 4.5 deviations more equal bins;
then exact similarities are taken in blocks; links make components by distributed union-find. Of each component the first occurrence by (doc_id,
line number) stays, all others go. Rows should grow with the logarithm of the corpus, so that unrelated lines seldom meet.

Blank lines take no part and stay. Rows with null id or null text are left as they are. Repeated rows of one id and text are
alike: they keep the same lines. Different texts of one id are known apart by the texts' hash, which orders them where id and
line number are the same. A text of which nothing is left becomes empty; n_kept then is 0. An empty table gives an
empty result; extra columns are carried along.
"""

from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from placelens.llm.common import (ASCII_SPACE, Forest, LOWER, PAIR, broadcast_if_small, distinct, drop, expand, mix, randoms,
                                  record_batch, signed, slices, small_batches, span_hashes, spans, stage, table, text_bytes)
from placelens.llm.groups import link_groups
from placelens.llm.vectors import local_components

Q = 4                  # one changed character leaves lines of 39 characters and more similar
SIMILAR = (80, 100)
BANDS, ROWS = 31, 6
SCHEMES = [(160, 8, 4, 13), (512, 10, 6, 14)]     # least size of a set, rows of a band, bands of a permutation, permutations
PASSES = [(0, 1), (2,)]                           # schemes that are signed together; 0 has BANDS and ROWS
COLUMNS = 8192         # tokens of one block of the overlap product
BINS = 64              # of a line's sketch
PART = 1 << 20         # signatures that a task sorts at once, about
FLUSH = 1 << 19        # signatures that a task gathers before it sends them
DONE = 1 << 17         # lines that a task knows as signed at once
ROWS_AT_ONCE = 32      # of a larger candidate group that sketches compare with all others
SIFTED = 2048          # larger candidate groups are not sifted by sketches
HOT = 1000             # occurrences of a line class that meet its first one in one task, about
FEW = 16               # lines of a block up to which pairs are compared one by one
CHUNK = 1 << 16        # shingles that are hashed at once
SIZE_STEP, NEAR = 1.06, 4     # ratio of sizes from one code to the next; 1.06^4 > 1 / 0.8
SLICE = 1 << 18       # bytes of text that a task works on at once; the arrays take some hundred times as much

BLOBS = pa.schema([("p", pa.int32()), ("blob", pa.binary())])
STARS = pa.schema([("gid", pa.int64()), ("short", pa.int64()), ("item", pa.int64()), ("sketch", pa.binary())])
LINES = pa.schema([("item", pa.int64()), ("payload", pa.string())])
OCCURRENCES = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("line", pa.int32())])

SHORT = np.uint64(32)
_LOW = np.uint32((1 << 26) - 1)
_MIXED = mix(np.arange(256, dtype=np.uint64))
_Q_FACTORS, _ROW_FACTORS = randoms(Q, 31) | np.uint64(1), randoms(ROWS, 41) | np.uint64(1)
_BAND_SALTS = mix(np.arange(BANDS))
_BIN_FACTORS = [(randoms(c, 78 + k) >> np.uint64(32)).astype(np.uint32) | np.uint32(1) for k, (_, _, _, c) in enumerate(SCHEMES)]
_BIN_ROWS = [randoms(r, 90 + k) | np.uint64(1) for k, (_, r, _, _) in enumerate(SCHEMES)]
_BIN_SALTS = [randoms(b * c, 100 + k) for k, (_, _, b, c) in enumerate(SCHEMES)]
_FACTORS = (randoms(BANDS * ROWS, 77) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def lines_of(column):
    """(bytes in lower case, row, line number, start, end, key) of every line that is not blank."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    start, end = spans(data, offsets, ASCII_SPACE)
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    row = np.searchsorted(offsets, start, "right") - 1
    number = feeds[start] - feeds[offsets[row]] if len(start) else feeds[:0]
    new = np.ones(len(start), bool)
    new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    start, end, row, number = start[first], end[last], row[first], number[first]
    return data, row, number, start, end, span_hashes(data, start, end)


def character_shingles(data, start, end):
    """(hash of the Q characters from each character on, place of each line's first one, number of shingles of each line)."""
    code, first, last = _MIXED[data], start, end
    if len(data) and data.max() >= 0x80:                                # characters of several bytes
        head = np.flatnonzero((data & 0xC0) != 0x80)
        several = np.flatnonzero(data >= 0xC0)
        width = np.diff(np.append(head, len(data)))[np.searchsorted(head, several)]
        packed = data[several].astype(np.uint64)
        for j in range(1, 4):
            more = np.flatnonzero(width > j)
            packed[more] |= data[several[more] + j].astype(np.uint64) << np.uint64(8 * j)
        code[several] = mix(packed)
        code, first, last = code[head], np.searchsorted(head, start), np.searchsorted(head, end)
    chars = last - first
    total = code * _Q_FACTORS[0]
    for j in range(1, Q):
        total[:-j] += code[j:] * _Q_FACTORS[j]
    short = np.flatnonzero(chars < Q)                                   # the whole line is its one shingle
    total[first[short]] = span_hashes(data, start[short], end[short])
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return total, first, np.maximum(chars - Q + 1, 1)


def distinct_shingles(data, start, end):
    """(32-bit hashes of the distinct shingles, line by line in ascending order, place of each line's first one, number of each line)."""
    hashes, first, count = character_shingles(data, start, end)
    line = np.repeat(np.arange(len(count), dtype=np.uint64), count)
    both = np.sort(line << np.uint64(32) | hashes[expand(first, count)] >> np.uint64(32))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    count = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(count))
    return both.astype(np.uint32), np.cumsum(count) - count, count


def signed_lines(data, start, end, key):
    """Of the distinct lines: signatures (a row for each band), keys, sketches and codes of their sizes."""
    _, once = np.unique(key, return_index=True)
    once.sort()
    start, end, key = start[once], end[once], key[once]
    x, first, count = distinct_shingles(data, start, end)
    return _minima(x, first, count), key, sketches_of(x, count), size_codes(count)


def _minima(x, first, count):
    """Signatures (a row for each band) of sets given by their hashes one after another."""
    sig = np.empty((BANDS, len(count)), np.uint64)
    if not len(count):
        return sig
    out = np.empty(min(len(x), CHUNK) + int(count.max()), np.uint32)
    cuts = distinct(np.append(np.searchsorted(first, np.arange(0, len(x), CHUNK)), len(count)))    # lines that are worked on at once
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        part, begin = x[first[a]:first[b - 1] + count[b - 1]], first[a:b] - first[a]
        product = out[:len(part)]
        for band in range(BANDS):
            total = np.full(b - a, band + 1, np.uint64)
            for j in range(ROWS):
                np.multiply(part, _FACTORS[band * ROWS + j], out=product)
                total += np.minimum.reduceat(product, begin).astype(np.uint64) * _ROW_FACTORS[j]
            sig[band, a:b] = mix(total + _BAND_SALTS[band])
    return sig


def _bin_minima(x, count, scheme):
    """Like _minima, by a scheme of SCHEMES: every permutation deals the hashes to bins, whose least hashes are the rows of its bands."""
    _, rows, bands, permutations = SCHEMES[scheme - 1]
    bins, n = rows * bands, len(count)
    sig = np.empty((permutations * bands, n), np.uint64)
    owner = np.repeat(np.arange(n) * bins, count)
    for k, factor in enumerate(_BIN_FACTORS[scheme - 1]):
        value = x * factor
        least = np.full(n * bins, 0xFFFFFFFF, np.uint32)
        np.minimum.at(least, owner + (value.astype(np.uint64) * np.uint64(bins) >> np.uint64(32)).astype(np.int64), value)
        total = (least.reshape(n, bands, rows).astype(np.uint64) * _BIN_ROWS[scheme - 1]).sum(axis=2)
        sig[k * bands:(k + 1) * bands] = mix(total + _BIN_SALTS[scheme - 1][k * bands:(k + 1) * bands]).T
    return sig


def _least_size(scheme):
    """Least size of a set that can be similar to one that has no lower scheme."""
    num, den = SIMILAR
    return -(-SCHEMES[scheme - 1][0] * num // den) if scheme else 0


def scheme_signatures(data, start, end, key, schemes):
    """(signatures, number of the line of each, keys, codes of sizes, which lines a later pass does not sign, their sketches) of
    some distinct lines, without those that none of `schemes` signs."""
    some = np.flatnonzero(end - start >= _least_size(schemes[0]))             # a set is no larger than its line
    if not len(some):
        return None
    x, first, count = distinct_shingles(data, start[some], end[some])
    low = np.array([0, *(t for t, *_ in SCHEMES), 1 << 62])
    sig, line = [], []
    for k in schemes:
        own = np.flatnonzero((count >= _least_size(k)) & (count < low[k + 1]))
        part, n = x[expand(first[own], count[own])], count[own]
        found = _bin_minima(part, n, k) if k else _minima(part, np.cumsum(n) - n, n)
        sig.append(found.ravel())
        line.append(np.tile(own, len(found)))
    here = np.flatnonzero((count >= low[schemes[0]]) & (count < low[schemes[-1] + 1]))
    sketch = sketches_of(x[expand(first[here], count[here])], count[here]) if len(here) else np.zeros((0, BINS // 2), np.uint8)
    return np.concatenate(sig), np.concatenate(line), key[some], size_codes(count), here, sketch


def size_codes(count):
    """Sizes of sets on a logarithmic scale: codes of two sets that may be similar differ by at most NEAR."""
    return np.minimum(np.log(count) / np.log(SIZE_STEP), 255).astype(np.uint8)


def signatures_of(data, start, end, key):
    """(signature, item) rows of the distinct lines, and (item, sketch) of each."""
    sig, key, sketch, _ = signed_lines(data, start, end, key)
    return sig.ravel(), np.tile(key, BANDS), key, sketch


def sketches_of(x, count):
    """One row of BINS // 2 bytes for each line: the least hash of every bin of its shingles as four bits, 0 for an empty bin.

    x: the hashes line by line, ascending, so that the first one of each bin is the least.
    """
    place = np.repeat(np.arange(len(count)) * BINS, count) + (x >> np.uint32(26))
    least = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    value = np.zeros(len(count) * BINS, np.uint8)
    value[place[least]] = 1 + (((x[least] & _LOW) * np.uint32(0x9E3779B1)) >> np.uint32(8)) % np.uint32(15)
    value = value.reshape(-1, 2)
    return (value[:, 0] | (value[:, 1] << 4)).reshape(len(count), BINS // 2)


def _filled(words):
    """A bit for each four bits that are not all zero."""
    words = words | words >> np.uint64(1)
    return (words | words >> np.uint64(2)) & np.uint64(0x1111111111111111)


def _values(sketches):
    """Of each sketch its 64-bit words, and after them those words with a bit for each bin that is not empty."""
    words = np.ascontiguousarray(sketches).view(np.uint64)
    return np.concatenate([words, _filled(words)], axis=1)


def _enough(same, either):
    """Whether so many equal bins leave a similarity at the threshold possible: fewer come 4.5 deviations below what it gives."""
    num, den = SIMILAR
    p = num / den + (1 - num / den) / 15
    return same >= p * either - 4.5 * np.sqrt(p * (1 - p) * either)


def may_be_similar(value, left, right):
    """For pairs of rows of _values, whether their sketches leave a similarity at the threshold possible."""
    out, half = np.zeros(len(left), bool), value.shape[1] // 2
    for k in range(0, len(left), 1 << 15):
        a, b = value[left[k:k + (1 << 15)]], value[right[k:k + (1 << 15)]]
        either = a[:, half:] | b[:, half:]
        same = either & ~_filled(a[:, :half] ^ b[:, :half])
        out[k:k + (1 << 15)] = _enough(np.bitwise_count(same).sum(axis=1), np.bitwise_count(either).sum(axis=1))
    return out


def sets_of(lines):
    """Shingle set of every line of an array, ascending."""
    data, offsets = text_bytes(lines)
    hashes, first, count = character_shingles(data, offsets[:-1], offsets[1:])
    return [distinct(hashes[a:a + n]) for a, n in zip(first.tolist(), count.tolist())]


def similar_pairs(sets):
    """Boolean matrix of the pairs of sets that are similar: exact overlaps as products of blocks of a token matrix."""
    num, den = SIMILAR
    size = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    names, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1                 # tokens of one set only are in no overlap
    shared = count[token] > 1
    token, owner = number[token[shared]], owner[shared]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    both = np.zeros((len(sets), len(sets)))
    for first in range(0, int((count > 1).sum()), COLUMNS):
        a, b = np.searchsorted(token, [first, first + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], token[a:b] - first] = 1
        both += part @ part.T
    return (both > 0) & (both * den >= num * (size[:, None] + size[None, :] - both))


def _similar(x, y):
    num, den = SIMILAR
    if min(len(x), len(y)) * den < num * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(distinct(np.concatenate([x, y])))
    return both * den >= num * (len(x) + len(y) - both)


def set_links(left, right):
    """Index pairs that connect whatever is similar in `left`, or between left and right, and not yet in one component."""
    sets, known = [*left[0], *(right[0] if right else [])], np.array([*left[1], *(right[1] if right else [])])
    if right is None and len(sets) <= FEW:
        names = {k: i for i, k in enumerate(dict.fromkeys(known.tolist()))}
        start, forest, out = [names[k] for k in known.tolist()], Forest(len(names)), []
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                if forest.root(start[i]) != forest.root(start[j]) and _similar(sets[i], sets[j]):
                    forest.join(start[i], start[j])
                    out.append((i, j))
        return out
    links = similar_pairs(sets)
    if right is not None:
        side = np.arange(len(sets)) < len(left[0])
        links &= side[:, None] != side[None, :]
    root = local_components(links | (known[:, None] == known[None, :]))
    return [(i, j) for i, j in enumerate(root.tolist()) if known[i] != known[j]]


# ---- operator ----------------------------------------------------------------------------------------------------

def _signed(texts, parts, schemes):
    """Rows (p, blob): entries of some distinct lines for each part p, and their keys and sketches under negative p.

    An entry is 32 bits of a signature (p tells it from others), the line's short key of 32 bits, and the code of its size.
    """
    def sign(batches):
        held, size, done = [], 0, set()

        def flush():
            sig, short, code, key, sketch = map(np.concatenate, zip(*held))
            part = sig % np.uint64(parts)
            order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable")
            names, at = np.unique(part[order], return_index=True)
            at = [*at.tolist(), len(part)]
            sig, short, code = (sig[order] >> np.uint64(32)).astype(np.uint32), short[order], code[order]
            blobs = [b"".join(x[a:b].tobytes() for x in (sig, short, code)) for a, b in zip(at[:-1], at[1:])]
            own = [-1 - int(key[0] % np.uint64(parts))] if len(key) else []
            return record_batch(BLOBS, [*names.astype(np.int64).tolist(), *own], [*blobs, *[key.tobytes() + sketch.tobytes()] * len(own)])

        for batch in batches:
            for part in slices(batch, size=SLICE):
                data, _, _, start, end, key = lines_of(part.column(1))
                if len(done) > DONE:
                    done.clear()
                new = [i for i, k in enumerate(key.tolist()) if not (k in done or done.add(k))]        # once for each task, about
                found = scheme_signatures(data, start[new], end[new], key[new], schemes) if new else None
                if found:
                    sig, line, key, code, here, sketch = found
                    held.append((sig, (key >> SHORT).astype(np.uint32)[line], code[line], key[here], sketch))
                    size += len(sig)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(sign, "p int, blob binary")


def _entries(blobs):
    """(signature, short key, code of the size) of entries by signature and size, without signatures that occur once."""
    fields = [[], [], []]
    for x in blobs:
        n = len(x) // 9
        for k, kind in enumerate(("<u4", "<u4", "u1")):
            fields[k].append(np.frombuffer(x, kind, n, 4 * k * n))
    sig, short, code = map(np.concatenate, fields)
    order = np.sort(sig.astype(np.uint64) << np.uint64(32) | np.arange(len(sig), dtype=np.uint64))
    sig = (order >> np.uint64(32)).astype(np.int64)
    alike = np.zeros(len(sig), bool)
    alike[1:] = sig[1:] == sig[:-1]
    alike[:-1] |= alike[1:]
    sig, order = sig[alike], order[alike].astype(np.uint32)
    short, code = short[order].astype(np.int64), code[order].astype(np.int64)
    order = np.lexsort((code, sig))
    return sig[order], short[order], code[order]


def _candidates(sig, short, code):
    """Rows (gid, short key): lines of one signature meet the one of the smallest key, cut where sizes leave no similarity possible."""
    if not len(sig):
        return record_batch(STARS, *(pa.nulls(0, f.type) for f in STARS))
    first = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (code[1:] > code[:-1] + NEAR)]))
    lead = np.repeat(np.minimum.reduceat(short, first), np.diff(np.append(first, len(sig))))
    lead, other = lead[lead != short], short[lead != short]
    order = np.lexsort((other, lead))
    lead, other = lead[order], other[order]
    new = np.ones(len(lead), bool)
    new[1:] = (lead[1:] != lead[:-1]) | (other[1:] != other[:-1])
    n = int(new.sum())
    return record_batch(STARS, lead[new], other[new], pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()))


def _stars(batches):
    """Rows (gid, short key) of candidate groups, in short keys, and (short key, null, item, sketch), from rows sorted by p."""
    held, name = [], None
    for batch in batches:
        for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and p != name:
                yield _candidates(*_entries(held))
                held = []
            name = p
            if p >= 0:
                held.append(blob)
            else:
                n = len(blob) // (8 + BINS // 2)
                key, sketch = np.frombuffer(blob, np.uint64, n), blob[8 * n:]
                yield record_batch(STARS, signed(key >> SHORT), pa.nulls(n, pa.int64()), signed(key),
                                   [sketch[k:k + BINS // 2] for k in range(0, len(sketch), BINS // 2)])
    if held:
        yield _candidates(*_entries(held))


def _sift(gid, item, sketch):
    """Whole groups, sorted by gid and item: each item with the smallest one that sketches connect it with."""
    value = _values(sketch)
    first = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
    size = np.diff(np.append(first, len(gid)))
    left = np.flatnonzero(np.repeat(size <= FEW, size))                  # in small groups every pair, all groups at once
    after = (np.repeat(first + size, size) - np.arange(len(gid)) - 1)[left]
    left, right = np.repeat(left, after), expand(left + 1, after)
    edges = [np.stack([left, right])[:, may_be_similar(value, left, right)]]
    for a, n in zip(first[size > FEW].tolist(), size[size > FEW].tolist()):
        root = np.arange(n)                                              # in larger ones some rows at a time, joined rows once
        forest = Forest(n)
        for low in range(0, n, ROWS_AT_ONCE):
            i, j = np.nonzero(root[low:low + ROWS_AT_ONCE, None] != root[None, low:])
            i, j = (x[j > i] + low for x in (i, j))
            alike = np.flatnonzero(may_be_similar(value[a:a + n], i, j))
            for x, y in zip(i[alike].tolist(), j[alike].tolist()):
                forest.join(x, y)
            if len(alike):
                root = forest.roots()
        edges.append(np.stack([a + root, a + np.arange(n)])[:, root != np.arange(n)])
    left, right = np.concatenate(edges, axis=1)
    names, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    forest = Forest(len(names))
    for i, j in zip(at[:len(left)].tolist(), at[len(left):].tolist()):
        forest.join(i, j)
    root = forest.roots()
    other = root != np.arange(len(names))
    return record_batch(PAIR, item[names[root[other]]], item[names[other]])


def _sifted(batches):
    """Groups (gid, item, sketch), sorted by gid and item, cut into the parts that their sketches leave connected. Holds one group."""
    held = None
    for batch in chain(batches, [None]):
        table = batch if held is None else held if batch is None else pa.concat_batches([held, batch])
        if table is None or not table.num_rows:
            continue
        gid = table.column(0).to_numpy()
        cut = len(gid) if batch is None else int(np.searchsorted(gid, gid[-1]))
        held = table.slice(cut)
        if cut:
            sketch = table.column(2).slice(0, cut)
            flat = np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(cut, BINS // 2)
            gid, item = gid[:cut], table.column(1).to_numpy()[:cut]
            new = np.ones(cut, bool)                                     # a line that several tasks signed comes several times
            new[1:] = (gid[1:] != gid[:-1]) | (item[1:] != item[:-1])
            yield _sift(gid[new], item[new], flat[new])


def line_components(texts, seen):
    """Components (node, component) of similar distinct lines of `texts`; lines without others are left out. seen: their occurrences."""
    spark = texts.sparkSession
    parts = max(-(-seen.count() * SCHEMES[0][2] * SCHEMES[0][3] // PART), 2 * spark.sparkContext.defaultParallelism)
    passes = [stage(_signed(texts, parts, schemes).repartition(parts, "p").sortWithinPartitions("p").mapInArrow(
        _stars, "gid long, short long, item long, sketch binary"), "signatures") for schemes in PASSES]
    made = reduce(DataFrame.union, [t for t, _ in passes])
    pairs = made.where("short IS NOT NULL").select("gid", "short")
    # pairs may repeat: those of groups that seem large are told apart first
    sizes = pairs.groupBy("gid").agg(F.count("*").alias("n")).where(F.col("n") > SIFTED).select("gid")
    large, _ = stage(pairs.join(broadcast_if_small(sizes), "gid", "left_semi").distinct().groupBy("gid").agg(
        F.count("*").alias("n")).where(F.col("n") > SIFTED).select("gid"), "large")
    # short keys stand for all lines that have them; these are told apart from here on
    sketches = made.where("short IS NULL").select(F.col("gid").alias("short"), "item", "sketch")
    groups = pairs.union(pairs.select("gid").distinct().select("gid", F.col("gid").alias("short")))
    small = groups.join(broadcast_if_small(large), "gid", "left_anti").repartition("short").distinct()
    small = small.join(sketches, "short").select("gid", "item", "sketch")
    found = small.repartition("gid").sortWithinPartitions("gid", "item").mapInArrow(_sifted, "gid long, item long")
    if not large.isEmpty():
        whole = groups.join(broadcast_if_small(large), "gid", "left_semi").join(sketches, "short").select("gid", "item").distinct()
        whole, _ = stage(whole, "whole")
        lead = broadcast_if_small(whole.groupBy("gid").agg(F.min("item").alias("lead")))
        found = found.union(whole.join(lead, "gid").where("item != lead").select(F.col("lead").alias("gid"), "item"))
    pairs, _ = stage(found.distinct(), "candidates")
    for _, path in passes:
        drop(spark, path)
    lines, _ = stage(_line_texts(texts, seen, pairs.select("gid").union(pairs.select("item")).distinct().toDF("item")), "candidate-lines")
    return link_groups(pairs, lines, sets_of, set_links)


def _line_texts(texts, seen, wanted):
    """(item, payload) of the wanted lines, each from the first text that holds it."""
    place = seen.join(wanted, "item", "left_semi").groupBy("item").agg(F.min(F.struct("doc_id", "text_hash", "line")).alias("at"))
    place = place.groupBy(F.col("at.doc_id").alias("d"), F.col("at.text_hash").alias("h")).agg(
        F.collect_list(F.struct(F.col("at.line").alias("line"), "item")).alias("w"))
    place, _ = stage(place.select("d", "h", F.col("w.line").alias("lines"), F.col("w.item").alias("items")), "places")
    place = broadcast_if_small(place, 100_000)
    held = texts.join(place, (F.col("doc_id") == F.col("d")) & (F.col("text_hash") == F.col("h"))).select("text", "lines", "items")

    def write(batches):
        for batch in batches:
            for part in slices(batch, size=SLICE):
                data, row, number, start, end, _ = lines_of(part.column(0))
                lines, items = part.column(1), part.column(2)
                asked = np.repeat(np.arange(part.num_rows), lines.value_lengths().to_numpy()) * (1 << 32) + lines.flatten().to_numpy()
                at = np.searchsorted(row * (1 << 32) + number, asked).tolist()
                raw = data.tobytes()
                yield record_batch(LINES, items.flatten(), [raw[start[i]:end[i]].decode() for i in at])

    return held.mapInArrow(write, "item long, payload string").dropDuplicates(["item"])


def removed_lines(texts):
    """doc_id, text_hash and line (number from 0) of every line that a similar or equal earlier one stands for."""
    def occur(batches):
        for batch in batches:
            for part in slices(batch, size=SLICE):
                _, row, number, _, _, key = lines_of(part.column(1))
                yield record_batch(OCCURRENCES, signed(key), part.column(0).to_numpy()[row],
                                   part.column(2).to_numpy()[row], number.astype(np.int32))

    seen, _ = stage(texts.mapInArrow(occur, "item long, doc_id long, text_hash long, line int"), "lines")
    found = line_components(texts, seen)
    seen = seen.join(broadcast_if_small(found), F.col("item") == F.col("node"), "left").select(
        F.coalesce("component", "item").alias("line_class"), "doc_id", "text_hash", "line")
    seen, _ = stage(seen, "line-classes")
    first = seen.groupBy("line_class").agg(F.min(F.struct("doc_id", "line", "text_hash")).alias("first"), F.count("*").alias("n"))
    first, _ = stage(first.where("n > 1").select(
        "line_class", F.col("first.doc_id").alias("d"), F.col("first.line").alias("l"), F.col("first.text_hash").alias("h"),
        F.ceil(F.col("n") / HOT).cast("int").alias("salts")), "first-lines")
    # a class of very many occurrences is dealt to several tasks; there are few such classes
    hot = broadcast_if_small(first.where("salts > 1").select("line_class", "salts"))
    seen = seen.join(hot, "line_class", "left").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "line", "text_hash"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return seen.join(first, ["line_class", "salt"]).where("doc_id != d OR line != l OR text_hash != h").select(
        "doc_id", "text_hash", "line").distinct()


def dedup_lines(documents, broadcast_lines=1_000_000):
    """`documents` with the removed lines taken out of `text`; columns __lines and __kept tell how many there were and stay."""
    small_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    removed, _ = stage(removed_lines(texts), "removed")
    gone = removed.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_list("line").alias("__gone"))
    if removed.limit(broadcast_lines + 1).count() <= broadcast_lines:
        gone = F.broadcast(gone)
    joined = documents.join(gone, (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left").drop(
        "__id", "__hash")

    def cut(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            at = batch.schema.get_field_index("text")
            _, row, _, _, _, _ = lines_of(batch.column(at))
            lines = np.bincount(row, minlength=batch.num_rows)
            gone = batch.column(batch.num_columns - 1)
            kept = lines.copy()
            text = batch.column(at)
            if gone.null_count < batch.num_rows:
                texts = text.to_pylist()
                for i in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    drop = set(gone[i].as_py())
                    if texts[i] is not None:
                        kept[i] -= len(drop)
                        parts = texts[i].split("\n")
                        texts[i] = "\n".join(p for k, p in enumerate(parts) if k not in drop) if kept[i] else ""
                text = pa.array(texts, text.type)
            columns = [*batch.columns[:-1], pa.array(lines, pa.int64()), pa.array(kept, pa.int64())]
            columns[at] = text
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "__lines", "__kept"])

    return joined.mapInArrow(cut, StructType([*documents.schema, StructField("__lines", LongType()),
                                              StructField("__kept", LongType())]))


def op10_line_dedup(spark, sf_dir):
    """doc_id, text without its removed lines, lines it had (blank ones aside) and lines kept."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(documents).withColumnsRenamed({"__lines": "n_lines", "__kept": "n_kept"})
