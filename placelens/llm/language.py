"""Language identification by hierarchical discrimination: the family first, then one-versus-one linear SVMs within it.

A text is the square roots of the relative frequencies of its hashed byte n-grams (2 to 4 bytes, A-Z in lower case, all that is
no ASCII letter and no byte above 127 is a blank, and runs of blanks give no n-gram). Families are the fixed table below; a
language outside it is a family of its own. A softmax model over families decides first; each pair of languages of one family
has a linear support vector machine (squared hinge, L2), and the language with most votes wins, then that with the larger
sum of margins, then the name. The score is the family's probability times the mean of the sigmoids of the winner's margins.

The fit uses a bounded sample of learnable rows (about TRAIN in all and PER_LANGUAGE of a language, drawn by hash of the id), all languages weighing the
same; prediction reads every whole text. lang, source and id are no input of a prediction. Rows with null text or without a
letter get `und` and score 0, as does every row where nothing can be learned; with one language every other row gets it, with
score 1. Repeated rows get equal predictions and count once in the fit; rows with a null id are not learned from and not
held out. An empty table gives an empty result; other columns are not read.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from placelens.llm.common import expand, slices, table, text_bytes

BUCKETS = 4096
GRAMS = (2, 3, 4)
TRAIN, PER_LANGUAGE = 6000, 1000
ROWS = 128                     # rows of a dense block
PENALTY = 1e-4

# Languages of each family, by ISO code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "indic": "hi ur bn mr gu pa ne si",
    "iranian": "fa ku ps tg",
    "turkic": "tr az kk ky uz tt tk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga cy br gd",
    "semitic": "ar he mt am",
    "malayic": "id ms jv su tl",
    "dravidian": "ta te kn ml",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_CODE = np.full(256, 32, np.uint8)
_CODE[128:] = np.arange(128, 256)
_CODE[97:123] = _CODE[65:91] = np.arange(97, 123)


def family_of(language):
    return _FAMILY.get(language.lower().split("-")[0], f"={language}")


# ---- features ----------------------------------------------------------------------------------------------------

def frequencies(column):
    """Dense blocks (rows, BUCKETS) of the square roots of relative n-gram frequencies, row after row."""
    data, offsets = text_bytes(column)
    code = _CODE[data]
    for a in range(0, len(column), ROWS):
        b = min(a + ROWS, len(column))
        part = code[offsets[a]:offsets[b]].astype(np.uint64)
        bounds = offsets[a:b + 1] - offsets[a]
        blank = part == 32
        row = np.repeat(np.arange(b - a), np.diff(bounds))
        total = np.zeros((b - a) * BUCKETS)
        for n in GRAMS:
            m = len(part) - n + 1
            if m <= 0:
                continue
            gram = np.full(m, n, np.uint64)
            good = row[:m] == row[n - 1:]
            for j in range(n):
                gram = (gram << np.uint64(8)) | part[j:j + m]
                if j:
                    good &= ~(blank[j - 1:j - 1 + m] & blank[j:j + m])
            bucket = (gram[good] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)
            total += np.bincount(row[:m][good] * BUCKETS + bucket.astype(np.int64), minlength=len(total))
        total = total.reshape(b - a, BUCKETS)
        yield np.sqrt(total / np.maximum(total.sum(axis=1, keepdims=True), 1)).astype(np.float32)


# ---- linear models -----------------------------------------------------------------------------------------------

def descend(gradient, start, bound, steps=400, tolerance=1e-5):
    """Minimise a smooth convex function by accelerated gradients with restarts; `bound` is a Lipschitz bound."""
    x, y, t = start, start, 1.0
    for _ in range(steps):
        g = gradient(y)
        if np.abs(g).max() < tolerance:
            break
        new = y - g / bound
        if (g * (new - x)).sum() > 0:
            t, y = 1.0, x
            new = y - gradient(y) / bound
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def _bound(x, weight):
    """Largest eigenvalue of the weighted second moments of x, by power iteration, and a margin."""
    v = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
    size = 1.0
    for _ in range(30):
        v = (weight * (x @ v)) @ x
        size = np.linalg.norm(v)
        if not size:
            return 1e-9
        v /= size
    return 1.2 * size


def fit_softmax(x, y, weight, classes):
    """Weights (features, classes) of the L2-penalised softmax model."""
    at = np.arange(len(y))

    def gradient(w):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[at, y] -= 1
        return x.T @ (p * weight[:, None]) + PENALTY * w

    return descend(gradient, np.zeros((x.shape[1], classes)), 0.5 * _bound(x, weight) + PENALTY)


def fit_svm(x, y, weight):
    """Weights of the linear support vector machine with squared hinge loss; y is 1 or -1."""
    def gradient(w):
        slack = np.maximum(0, 1 - y * (x @ w))
        return PENALTY * w - 2 * ((weight * y * slack) @ x)

    return descend(gradient, np.zeros(x.shape[1]), 2 * _bound(x, weight) + PENALTY)


class Model:
    """Languages by family, the families' weights, and a machine for each pair of one family."""

    def __init__(self, x, language):
        self.names = sorted(set(language))
        families = sorted({family_of(n) for n in self.names})
        self.members = [[k for k, n in enumerate(self.names) if family_of(n) == f] for f in families]
        y = np.array([self.names.index(v) for v in language])
        self.mean = x.mean(axis=0)
        x = self._centred(x)
        each = 1 / (np.bincount(y, minlength=len(self.names)) * len(self.names))
        family = np.zeros(len(self.names), int)
        for k, members in enumerate(self.members):
            family[members] = k
        self.family = fit_softmax(x, family[y], each[y], len(families)) if len(families) > 1 else None
        self.pairs = {}
        for members in self.members:
            for i, j in combinations(members, 2):
                at = np.flatnonzero((y == i) | (y == j))
                share = each[y[at]] * len(self.names) / 2
                self.pairs[i, j] = fit_svm(x[at], np.where(y[at] == i, 1.0, -1.0), share)

    def _centred(self, x):
        return np.hstack([10 * (x - self.mean), np.ones((len(x), 1), np.float32)]).astype(np.float64)

    def predict(self, x):
        """(number of the language, score) of every row."""
        x = self._centred(x)
        if self.family is None:
            p = np.ones((len(x), 1))
        else:
            z = x @ self.family
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
        chosen = p.argmax(axis=1)
        score = p[np.arange(len(x)), chosen]
        out = np.zeros(len(x), np.int64)
        for k, members in enumerate(self.members):
            at = np.flatnonzero(chosen == k)
            if not len(at):
                continue
            votes, margins, sure = (np.zeros((len(at), len(members))) for _ in range(3))
            for a, b in combinations(range(len(members)), 2):
                m = x[at] @ self.pairs[members[a], members[b]]
                for one, sign in ((a, 1), (b, -1)):
                    votes[:, one] += (sign * m >= 0) if sign > 0 else (m < 0)
                    margins[:, one] += sign * m
                    sure[:, one] += 1 / (1 + np.exp(-np.clip(4 * sign * m, -40, 40)))
            best = np.lexsort((np.broadcast_to(-np.arange(len(members)), votes.shape), margins, votes), axis=1)[:, -1]
            out[at] = np.array(members)[best]
            if len(members) > 1:
                score[at] *= sure[np.arange(len(at)), best] / (len(members) - 1)
        return out, np.clip(score, 0, 1)


# ---- operator ----------------------------------------------------------------------------------------------------

def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(documents):
    """A model fitted on a sample of the rows of (doc_id, text, lang) that are not held out, or None without any."""
    known = documents.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    per = max(min(PER_LANGUAGE, TRAIN // len(counts)), 2)
    share = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per / n))))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share[F.col("lang")] * (1 << 40))

    def vectors(batches):
        for batch in batches:
            for part in slices(batch):
                at = 0
                for x in frequencies(part.column(1)):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(at, len(x)), part.column(2).slice(at, len(x)),
                         pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())], names=["doc_id", "lang", "x"])
                    at += len(x)

    drawn = drawn.where(F.col("text").rlike(r"\p{L}")).select(F.col("doc_id").cast("long"), "text", "lang")
    got = drawn.mapInArrow(vectors, "doc_id long, lang string, x binary").dropDuplicates(["doc_id", "lang"]).toArrow()
    if not got.num_rows:
        return None
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")       # the same model whatever order rows come in
    x = np.stack([np.frombuffer(v, np.float16) for v in got.column("x").to_pylist()])
    language = got.column("lang").to_pylist()
    return Model(x[order].astype(np.float32), [language[i] for i in order.tolist()])


def predict(documents, model):
    """doc_id, held_out, lang_pred, score of every row of (doc_id, text)."""
    rows = documents.select(F.col("doc_id").cast("long"), "text",
                            F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select("doc_id", held_out().alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names = pa.array([*shared.value.names, "und"])
        for batch in batches:
            for part in slices(batch):
                letters = part.column(2).to_numpy(zero_copy_only=False)
                found = [shared.value.predict(x) for x in frequencies(part.column(1))]
                language, score = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), names.take(pa.array(np.where(letters, language, len(names) - 1))),
                     pa.array(np.where(letters, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op13_language(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(documents, fit(documents))
