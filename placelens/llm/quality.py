"""Document quality by positive-unlabelled learning.

A linear model over binned surface features (letter case, symbols, digits, word and line repetition, lengths) minimises the
non-negative unbiased risk   prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])   with the logistic loss l, from
trusted positives (quality = 1) and unlabelled web text; negatives are never named to it. The class prior is the share of
positives among all labelled rows of the learning part. sigmoid(g) is the score.

Rows with crc32(doc_id as text) mod 5 = 0 are held out: no label of theirs is read, and they are not in the unlabelled sample
either. The fit takes bounded samples (`POSITIVES`, `UNLABELLED` rows, by hash of the id); bin edges and the prior are taken
over all rows, and every whole text is scored. Null and empty texts have a feature row of zeros and get its score. Label rows
with null id or quality are skipped, the largest quality of one id counts; repeated rows get equal scores; a null id is
scored, and never held out. Without positives every score is the prior (0.5 without any label).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from placelens.llm.common import distinct, record_batch, slices, spans, stage, table, text_bytes, words

POSITIVES = 15_000
UNLABELLED = 30_000
BINS = 12
CUT = 0.3

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "bang": b"!", "stop": b".,;:?'\"-()",
            "symbol": b"#$%&*+/<=>@[\\]^_`{|}~", "pipe": b"|", "newline": b"\n", "space": b" \t\r", "other": range(128, 256)}
NAMES = ["bytes", *_CLASSES, "words", "word_bytes", "distinct_words", "repeated_next", "top_word", "lines", "distinct_lines",
         "distinct_triples", "long_words"]
FEATURES = pa.schema([("doc_id", pa.int64()), *((n, pa.float32()) for n in NAMES)])
FEATURES_DDL = "doc_id long, " + ", ".join(f"{n} float" for n in NAMES)


def _sums(values, bounds):
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def surface_features(column):
    """One row of NAMES per text."""
    data, offsets = text_bytes(column)
    n = len(column)
    size = np.diff(offsets)
    out = {"bytes": np.log1p(size)}
    for name, members in _CLASSES.items():
        lut = np.zeros(256, np.uint8)
        lut[list(members)] = 1
        out[name] = _sums(lut[data], offsets) / np.maximum(size, 1)
    word, start, end, bounds = words(data, offsets)
    count = np.diff(bounds)
    some = np.maximum(count, 1)
    out["words"] = np.log1p(count)
    out["word_bytes"] = _sums(end - start, bounds) / some
    out["long_words"] = _sums(end - start > 20, bounds) / some
    same = np.zeros(len(word), np.int64)
    same[1:] = word[1:] == word[:-1]
    out["repeated_next"] = _sums(same, bounds) / some
    line_start, line_end = spans(data, offsets, _NEWLINE)
    line = np.add.reduceat(word, np.minimum(np.searchsorted(start, line_start), len(word) - 1)) if len(word) and len(line_start) \
        else np.zeros(0, np.uint64)
    line_bounds = np.searchsorted(line_start, offsets)
    out["lines"] = np.log1p(np.diff(line_bounds))
    distinct_words, top, triples, lines = (np.zeros(n) for _ in range(4))
    for i in range(n):
        w = word[bounds[i]:bounds[i + 1]]
        if len(w):
            _, counts = np.unique(w, return_counts=True)
            distinct_words[i], top[i] = len(counts) / len(w), counts.max() / len(w)
            t = w[:-2] + w[1:-1] * np.uint64(3) + w[2:] * np.uint64(9)
            triples[i] = len(distinct(t)) / len(t) if len(t) else 1
            x = line[line_bounds[i]:line_bounds[i + 1]]
            lines[i] = len(distinct(x)) / max(len(x), 1)
    out |= {"distinct_words": distinct_words, "top_word": top, "distinct_triples": triples, "distinct_lines": lines}
    return [out[k].astype(np.float32) for k in NAMES]


_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _featurise(batches):
    for batch in batches:
        for part in slices(batch):
            yield record_batch(FEATURES, part.column(0), *map(pa.array, surface_features(part.column(1))))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def design(x, edges):
    """Standing of each feature among its bin edges as indicator columns, and a constant."""
    parts = [np.ones((len(x), 1), np.float32)]
    for j, e in enumerate(edges):
        parts.append((x[:, j:j + 1] > e[None, :]).astype(np.float32))
    return np.hstack(parts)


def _loss(z):
    return np.logaddexp(0, -z)


def nonnegative_risk(g_p, g_u, prior):
    negative = _loss(-g_u).mean() - prior * _loss(-g_p).mean()
    return prior * _loss(g_p).mean() + max(0.0, negative)


def fit_nnpu(positive, unlabelled, prior, steps=500, rate=0.02, penalty=1e-3):
    """Weights that minimise the non-negative unbiased risk; where the negative part falls below 0, its ascent is undone."""
    w = np.zeros(positive.shape[1])
    m = np.zeros((2, len(w)))
    for step in range(1, steps + 1):
        g_p, g_u = positive @ w, unlabelled @ w
        s_p, s_u = 1 / (1 + np.exp(-np.clip(g_p, -40, 40))), 1 / (1 + np.exp(-np.clip(g_u, -40, 40)))
        negative = _loss(-g_u).mean() - prior * _loss(-g_p).mean()
        d_negative = s_u @ unlabelled / len(g_u) - prior * (s_p @ positive) / len(g_p)
        d_positive = prior * ((s_p - 1) @ positive) / len(g_p)
        g = (d_positive + d_negative if negative >= 0 else -d_negative) + penalty * np.r_[0, w[1:]]
        m[0] += 0.1 * (g - m[0])
        m[1] += 0.001 * (g * g - m[1])
        w -= rate * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.999 ** step)) + 1e-8)
    return w


def quality(documents, labels):
    """doc_id, held_out, score, predicted of every row of `documents`."""
    rows = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_featurise, FEATURES_DDL)
    rows, _ = stage(rows, "quality")
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
    known = known.where(~held_out())
    share = known.agg(F.avg((F.col("q") > 0).cast("double"))).first()[0]
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("q > 0").select("doc_id").orderBy(*order).limit(POSITIVES)
    positive = rows.join(F.broadcast(chosen), "doc_id").select(*NAMES).toPandas().to_numpy(np.float32)
    prior = 0.5 if share is None else min(max(share, 0.01), 0.99)
    if not len(positive):
        return rows.select("doc_id", held_out().alias("held_out"), F.lit(prior).alias("score"),
                           F.lit(int(prior >= CUT)).alias("predicted"))
    unlabelled = rows.where(~held_out()).orderBy(*order).limit(UNLABELLED).select(*NAMES).toPandas().to_numpy(np.float32)
    at = [k / BINS for k in range(1, BINS)] + [0.01, 0.03, 0.97, 0.99]
    quantiles = rows.agg(*(F.percentile_approx(n, at, 10_000).alias(n) for n in NAMES)).first()
    edges = [np.unique(np.asarray(quantiles[n], np.float32)) for n in NAMES]
    w = fit_nnpu(design(positive, edges), design(unlabelled, edges), prior).astype(np.float32)

    def scored(batches):
        for batch in batches:
            x = np.stack([batch.column(k + 1).to_numpy() for k in range(len(NAMES))], axis=1)
            p = 1 / (1 + np.exp(-np.clip(design(x, edges) @ w, -40, 40).astype(float)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= CUT).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    scores = rows.mapInArrow(scored, "doc_id long, score double, predicted int")
    return scores.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
