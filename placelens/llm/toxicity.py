"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are hashed words and hashed word beginnings (ASCII letters in lower case). Grades 0..3 come from the labels: 0 for
rows labelled clean; labelled toxic rows are graded by how many of the toxic-leaning features they hold. One weight vector is
shared by the ordered thresholds t1 < t2 < t3: P(grade >= k) = sigmoid(w.x - t_k). Expected severity is the sum of the three
probabilities, a row is toxic if P(grade >= 1) is at least one half.

The fit uses a bounded sample of labelled rows (`SAMPLE`, drawn by hash of the id); scoring reads every whole text. Null and
empty texts have no feature and get the score of the thresholds alone; repeated rows get equal scores; a null id is scored
like any other. Label rows with null id or label are skipped, and of several labels of one id the largest counts. Without
labels of both kinds every row is clean (severity 0).
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from placelens.llm.common import PUNCTUATION, LOWER, mix, record_batch, slices, span_hashes, spans, table, text_bytes

SAMPLE = 12_000        # labelled rows that the fit reads at most
BUCKETS = 1 << 20
BEGINNING = 5          # bytes of a word's beginning
FEATURES = 1024        # features kept, by chi-square
GRADES = (1, 2, 4)     # toxic-leaning features from which a toxic row has grade 1, 2, 3
PENALTY = 1e-4

SCORES = pa.schema([("severity", pa.float64()), ("p_toxic", pa.float64()), ("toxic", pa.bool_())])


@dataclass
class Model:
    place: np.ndarray       # int16 feature number of each bucket, -1 if unused
    weights: np.ndarray
    thresholds: np.ndarray  # ascending


def buckets(column):
    """(bucket of every word and word beginning, row bounds)."""
    data, offsets = text_bytes(column)
    start, end = spans(data, offsets, PUNCTUATION)
    codes = LOWER[data]
    whole = span_hashes(codes, start, end)
    part = mix(span_hashes(codes, start, np.minimum(end, start + BEGINNING)))
    both = np.stack([whole, part], axis=1).ravel() & np.uint64(BUCKETS - 1)
    return both.astype(np.int32), 2 * np.searchsorted(start, offsets)


def features(column, place):
    """Sparse rows over the kept features: (row, feature, log(1 + count)) of the non-zero ones."""
    bucket, bounds = buckets(column)
    feature = place[bucket]
    used = np.flatnonzero(feature >= 0)
    row = np.searchsorted(bounds, used, "right") - 1
    cell, count = np.unique(row * FEATURES + feature[used], return_counts=True)
    return cell // FEATURES, cell % FEATURES, np.log1p(count)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def exceedance(linear, thresholds):
    """P(grade >= k) for k = 1, 2, 3 as columns."""
    return _sigmoid(linear[:, None] - thresholds[None, :])


def fit_ordinal(row, feature, value, grade, width, steps=300, rate=0.1):
    """Maximum likelihood of the cumulative-link model by Adam; thresholds stay ordered as a start and positive steps."""
    n, levels = len(grade), int(len(GRADES))
    w, t = np.zeros(width), np.array([1.0, 0.0, 0.0])
    moments = [np.zeros((2, width)), np.zeros((2, levels))]
    for step in range(1, steps + 1):
        linear = np.bincount(row, value * w[feature], n)
        thresholds = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        p = np.hstack([np.ones((n, 1)), exceedance(linear, thresholds), np.zeros((n, 1))])
        at = np.arange(n)
        hi, lo = p[at, grade], p[at, grade + 1]
        mass = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / mass / n, lo * (1 - lo) / mass / n     # of -log mass, by sign below
        d_linear = -(d_hi - d_lo)
        d_threshold = np.zeros(levels)
        np.add.at(d_threshold, grade[grade > 0] - 1, d_hi[grade > 0])
        np.add.at(d_threshold, grade[grade < levels], -d_lo[grade < levels])
        later = np.cumsum(d_threshold[::-1])[::-1]
        grads = (np.bincount(feature, value * d_linear[row], width) + PENALTY * w,
                 later * np.concatenate([[1.0], np.exp(t[1:])]))
        for x, g, m in zip((w, t), grads, moments):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            x -= rate * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-9)
    return w, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))


SAMPLED = pa.schema([("toxic", pa.int64()), ("buckets", pa.list_(pa.int32()))])


def _sampled(batches):
    for batch in batches:
        for part in slices(batch):
            bucket, bounds = buckets(part.column(0))
            sets = [np.unique(bucket[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
            yield record_batch(SAMPLED, part.column(1).cast(pa.int64()), pa.array(sets, pa.list_(pa.int32())))


def fit(documents, labels) -> Model:
    """Fit on at most SAMPLE labelled rows of `documents`; equal feature sets count once."""
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("long"))
    got = texts.mapInArrow(_sampled, "toxic long, buckets array<int>").toArrow().combine_chunks()
    empty = Model(np.full(BUCKETS, -1, np.int16), np.zeros(0), np.full(len(GRADES), 40.0))
    if not got.num_rows:
        return empty
    lists = got.column("buckets").combine_chunks()
    sets = np.split(lists.values.to_numpy()[lists.offsets[0].as_py():], lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py())
    toxic = (got.column("toxic").to_numpy() > 0).astype(np.int64)
    seen = {(s.tobytes(), y): i for i, (s, y) in enumerate(zip(sets, toxic.tolist()))}
    keep = sorted(seen.values())
    sets, toxic = [sets[i] for i in keep], toxic[keep]
    if toxic.all() or not toxic.any():
        return empty
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    a = np.bincount(flat, toxic[row], BUCKETS)                 # toxic rows that hold the bucket
    b = np.bincount(flat, 1.0 - toxic[row], BUCKETS)
    n, pos = len(sets), toxic.sum()
    expected = (a + b) * pos / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num((a - expected) ** 2 / expected * n / (n - pos) * n / (n - a - b + 1))
    chosen = np.argsort(-chi, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[chi[chosen] > 0])
    place = np.full(BUCKETS, -1, np.int16)
    place[chosen] = np.arange(len(chosen))
    leaning = (a[chosen] + 0.5) / (pos + 1) > 8 * (b[chosen] + 0.5) / (n - pos + 1)
    used = place[flat] >= 0
    row, feature = row[used], place[flat][used].astype(np.int64)
    hits = np.bincount(row, leaning[feature], n)
    grade = toxic * np.maximum(1, np.searchsorted(GRADES, hits, "right"))
    w, thresholds = fit_ordinal(row, feature, np.full(len(row), np.log(2.0)), grade, len(chosen))
    return Model(place, w, thresholds)


def _score(column, model):
    row, feature, value = features(column, model.place)
    p = exceedance(np.bincount(row, value * model.weights[feature], len(column)) if len(row) else np.zeros(len(column)),
                   model.thresholds)
    return p.sum(axis=1), p[:, 0]


def score(documents, model):
    """doc_id, expected severity (0 to 3), P(toxic) and the decision, of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                severity, p = _score(part.column(1), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(severity), pa.array(p), pa.array(p >= 0.5)],
                                                 names=["doc_id", *SCORES.names])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, severity double, p_toxic double, toxic boolean")


def clean_documents(documents, model):
    """The rows of `documents`, all columns as they are, that are not toxic."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                _, p = _score(part.column(part.schema.get_field_index("text")), shared.value)
                yield part.filter(pa.array(p < 0.5))

    return documents.mapInArrow(run, documents.schema)


def op7_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))
