"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds what they miss.

The patterns (kinds email, ip, card, phone) are always kept. The tagger is trained in numpy from labelled spans: windows of
the corpus with their pattern matches, the same windows with matches rewritten as people also write them (phones without the
plus and country code, cards in groups parted by dots, blanks around the at sign), and windows with digits but no match.
Texts are covered by overlapping windows; each is decoded by Viterbi over emissions and transitions, and the spans of all
windows of a text are reconciled: a span cut by a window's edge yields to the window that sees it whole, overlapping spans to
the most certain, and every span to the patterns' matches. A span needs an at sign or a digit, so windows without either are
all outside and are not run. Added spans must also hold what their kind needs (`plausible`).

The fit reads a bounded sample (`SAMPLE` windows of each sort, by hash); whole texts are tagged, and equal windows of a
batch once. Null and empty texts have no span. Offsets are code points, ends exclusive. Repeated rows get equal results, a null id is
carried along. Without any match in the corpus nothing is added.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from placelens.llm.common import record_batch, slices, table, text_bytes

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
SAMPLE = 300           # windows with a match, and as many without, that the fit reads at most
CERTAIN = 0.9
HIDDEN = 12

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")       # a match never begins inside a run of digits
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_HAS_TRIGGER = np.zeros(256, bool)
_HAS_TRIGGER[[*range(48, 58), 64]] = True


# ---- patterns ----------------------------------------------------------------------------------------------------

def emails(text):
    """Matches of local part, at sign and domain: the run of local characters before each at sign, in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        while domain and start > end and text[start - 1] in _LOCAL:
            start -= 1
        if domain and start < at:
            end = domain.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def digits(text):
    return [int(c) for c in text if "0" <= c <= "9"]


def octet(part):
    """Whether a run of digits, of any length, is 255 at most."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(numbers):
    doubled = [2 * n - 9 * (n > 4) if k % 2 else n for k, n in enumerate(reversed(numbers))]
    return sum(doubled) % 10 == 0


def base_spans(text):
    """(kind number, start, end) of the pattern matches, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(octet(p) for p in m[0].split("."))]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


def doubtful_spans(text):
    """Pattern matches that fail their check: they may hold personal data all the same, so the fit leaves them alone."""
    base = base_spans(text)
    return [m.span() for p in (_IP, _CARD, _PHONE) for m in p.finditer(text)
            if len(digits(m[0])) >= 7 and not any(a <= m.start() and m.end() <= b for _, a, b in base)]


def plausible(kind, span):
    """What an added span must hold to be of its kind."""
    d = digits(span)
    if kind == 0:
        name, at, host = span.partition("@")
        return bool(at and name.strip() and "." in host.strip(" ."))
    if kind == 1:
        parts = re.findall(r"[0-9]+", span)
        return len(parts) == 4 and all(map(octet, parts))
    if kind == 2:
        return 16 <= len(d) <= 19 and luhn(d)
    return 8 <= len(d) <= 15 and not re.search(r"[A-Za-z0-9]", re.sub(r"[0-9]", "", span))


# ---- model -------------------------------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)                       # outside; begin and inside of each kind


def _allowed():
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


_FORBIDDEN = np.where(_allowed(), 0.0, -1e4)
_START = np.array([-1e4 if t and t % 2 == 0 else 0.0 for t in range(TAGS)])
_CHARS = 130                                    # padding, ASCII, all others


def codes(windows, width=WINDOW):
    out = np.zeros((len(windows), width), np.int64)
    for i, w in enumerate(windows):
        c = np.frombuffer(w.encode("utf-32-le"), np.uint32)[:width]
        out[i, :len(c)] = np.where(c < 128, c + 1, 129)
    return out


def new_parameters(seed=5):
    rng = np.random.default_rng(seed)
    p = {}
    for side in "fb":
        p[f"x{side}"] = rng.normal(0, 0.3, (_CHARS, 4 * HIDDEN))
        p[f"h{side}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
    p["out"] = rng.normal(0, 0.2, (2 * HIDDEN, TAGS))
    p["bias"] = np.zeros(TAGS)
    p["trans"] = np.zeros((TAGS, TAGS))
    return p


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


def lstm(x, w_x, w_h, tape=None):
    """Hidden states (steps, rows, HIDDEN) over code rows x (rows, steps); keeps what the backward pass needs in `tape`."""
    n, steps = x.shape
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    out = np.empty((steps, n, HIDDEN))
    for t in range(steps):
        z = w_x[x[:, t]] + h @ w_h
        gate = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN:2 * HIDDEN], gate[:, 2 * HIDDEN:]
        g = np.tanh(z[:, 3 * HIDDEN:])
        before = c
        c = f * before + i * g
        squashed = np.tanh(c)
        if tape is not None:
            tape.append((h, before, i, f, o, g, squashed))
        h = o * squashed
        out[t] = h
    return out


def lstm_gradient(x, w_h, tape, d_out):
    n, steps = x.shape
    d_z, d_h = np.empty((steps, n, 4 * HIDDEN)), np.zeros_like(w_h)
    h_next, c_next = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    for t in range(steps - 1, -1, -1):
        h, before, i, f, o, g, squashed = tape[t]
        dh = d_out[t] + h_next
        dc = c_next + dh * o * (1 - squashed ** 2)
        dz = np.hstack([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g ** 2)])
        d_z[t] = dz
        d_h += h.T @ dz
        h_next, c_next = dz @ w_h.T, dc * f
    order = np.argsort(x.T, axis=None, kind="stable")
    seen, first = np.unique(x.T.ravel()[order], return_index=True)
    d_x = np.zeros((_CHARS, 4 * HIDDEN))
    d_x[seen] = np.add.reduceat(d_z.reshape(-1, 4 * HIDDEN)[order], first, axis=0)
    return d_x, d_h


def emissions(p, x, tapes=None):
    forward = lstm(x, p["xf"], p["hf"], tapes[0] if tapes else None)
    backward = lstm(x[:, ::-1], p["xb"], p["hb"], tapes[1] if tapes else None)[::-1]
    both = np.concatenate([forward, backward], axis=2)
    return both @ p["out"] + p["bias"], both


def _logsum(z, axis):
    top = z.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(z - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(e, trans):
    """(log partition, tag marginals, forward and backward scores) of emissions (steps, rows, TAGS)."""
    steps = len(e)
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0] + _START
    for t in range(1, steps):
        a[t] = e[t] + _logsum(a[t - 1][:, :, None] + trans, 1)
    for t in range(steps - 2, -1, -1):
        b[t] = _logsum(trans + (e[t + 1] + b[t + 1])[:, None, :], 2)
    total = _logsum(a[-1], 1)
    return total, np.exp(a + b - total[None, :, None]), a, b


def viterbi(e, trans):
    steps, n, _ = e.shape
    score, back = e[0] + _START, np.empty(e.shape, np.int8)
    for t in range(1, steps):
        all_ = score[:, :, None] + trans
        back[t] = all_.argmax(axis=1)
        score = all_.max(axis=1) + e[t]
    tags = np.empty((steps, n), np.int64)
    tags[-1] = score.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = back[t][np.arange(n), tags[t]]
    return tags.T


def loss_and_gradient(p, x, y):
    """Negative log-likelihood per row of tag rows y (rows, steps), and its gradient."""
    tapes = ([], [])
    e, both = emissions(p, x, tapes)
    trans = p["trans"] + _FORBIDDEN
    total, m, a, b = marginals(e, trans)
    n, steps = x.shape
    rows = np.arange(n)
    d_e, d_trans = m.copy(), np.zeros_like(trans)
    gold = e[0][rows, y[:, 0]] + _START[y[:, 0]]
    d_e[0][rows, y[:, 0]] -= 1
    for t in range(1, steps):
        gold += e[t][rows, y[:, t]] + trans[y[:, t - 1], y[:, t]]
        d_e[t][rows, y[:, t]] -= 1
        pair = np.exp(a[t - 1][:, :, None] + trans + (e[t] + b[t])[:, None, :] - total[:, None, None])
        d_trans += pair.sum(axis=0)
        np.add.at(d_trans, (y[:, t - 1], y[:, t]), -1)
    d_both = d_e @ p["out"].T
    g = {"out": np.einsum("tnh,tnk->hk", both, d_e), "bias": d_e.sum(axis=(0, 1)), "trans": d_trans}
    g["xf"], g["hf"] = lstm_gradient(x, p["hf"], tapes[0], d_both[:, :, :HIDDEN])
    g["xb"], g["hb"] = lstm_gradient(x[:, ::-1], p["hb"], tapes[1], d_both[::-1, :, HIDDEN:])
    return float((total - gold).mean()), {k: v / n for k, v in g.items()}


def tags_of(spans, width=WINDOW):
    y = np.zeros(width, np.int64)
    for kind, a, b in spans:
        if 0 <= a and b <= width:
            y[a:b] = 2 + 2 * kind
            y[a] = 1 + 2 * kind
    return y


def rewritten(window, spans):
    """The window with its spans written another way; spans move along."""
    out, moved, at = "", [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        out += window[at:a]
        old = window[a:b]
        new = {0: lambda: old.replace("@", " @ "), 1: lambda: old, 2: lambda: _grouped(old),
               3: lambda: re.sub(r"^\+[0-9]{1,3}[ .-]?", "", old)}[kind]()
        moved.append((kind, len(out), len(out) + len(new)))
        out, at = out + new, b
    return out + window[at:], moved


def joined(window, spans, more):
    """The window with another match's text set beside its first span, a blank between."""
    kind, a, b = min(spans, key=lambda s: s[1])
    kind_2, text = more
    out = f"{window[:b]} {text}{window[b:]}"
    n = len(text) + 1
    moved = [(k, x + n * (x >= b), y + n * (x >= b)) for k, x, y in spans]
    return out, [*moved, (kind_2, b + 1, b + n)]


def _grouped(card):
    d = "".join(map(str, digits(card)))
    return ".".join(d[k:k + 4] for k in range(0, len(d), 4))


def train(examples, epochs=14, batch=96, rate=0.04):
    """Parameters from (window, spans) examples by Adam on the conditional likelihood."""
    p = new_parameters()
    x, y = codes([w for w, _ in examples]), np.array([tags_of(s) for _, s in examples])
    rng, moments, step = np.random.default_rng(6), {k: np.zeros((2, *v.shape)) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            part = order[a:a + batch]
            _, g = loss_and_gradient(p, x[part], y[part])
            step += 1
            for k in p:
                grad = np.clip(g[k], -5, 5)
                m = moments[k]
                m[0] += 0.1 * (grad - m[0])
                m[1] += 0.01 * (grad * grad - m[1])
                p[k] -= rate * (1 - 0.9 * epoch / epochs) * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-8)
    return p


# ---- windows -----------------------------------------------------------------------------------------------------

def windows_of(text):
    """Starts of the overlapping windows that hold an at sign or a digit."""
    if len(text) <= WINDOW:
        return [0] if _TRIGGER.search(text) else []
    starts = set()
    for m in _TRIGGER.finditer(text):
        k = m.start() // STRIDE
        starts.update(range(max(0, k - WINDOW // STRIDE + 1) * STRIDE, k * STRIDE + 1, STRIDE))
    return sorted(starts)


def window_spans(p, windows):
    """Per window the decoded spans: (kind, start, end, certainty)."""
    out = []
    trans = p["trans"] + _FORBIDDEN
    for at in range(0, len(windows), 512):
        part = windows[at:at + 512]
        e, _ = emissions(p, codes(part))
        tags = viterbi(e, trans)
        _, m, _, _ = marginals(e, trans)
        for i, row in enumerate(tags):
            spans, t = [], 0
            for t in np.flatnonzero(row % 2 == 1).tolist():
                kind, end = (row[t] - 1) // 2, t + 1
                while end < WINDOW and row[end] == 2 + 2 * kind:
                    end += 1
                spans.append((int(kind), t, end, float((m[t:end, i, 1 + 2 * kind] + m[t:end, i, 2 + 2 * kind]).min())))
            out.append(spans)
    return out


def reconciled(text, starts, decoded, base):
    """Spans of all windows of one text as one set without overlaps, apart from the base spans."""
    best = {}
    for at, spans in zip(starts, decoded):
        for kind, a, b, certainty in spans:
            cut = (a == 0 and at > 0) or (b == WINDOW and at + WINDOW < len(text))
            a, b = a + at, min(b + at, len(text))
            while a < b and text[a].isspace():
                a += 1
            while a < b and text[b - 1] in " \n\t.,;:":
                b -= 1
            if not cut and certainty >= CERTAIN and a < b <= len(text) and plausible(kind, text[a:b]):
                best[kind, a, b] = max(certainty, best.get((kind, a, b), 0))
    taken, out = [(a, b) for _, a, b in base], []
    for (kind, a, b), _ in sorted(best.items(), key=lambda x: (-x[1], x[0][1], -x[0][2])):
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            out.append((kind, a, b))
    return out


EXAMPLES = pa.schema([("found", pa.bool_()), ("mark", pa.int64()), ("window", pa.string()), ("spans", pa.string())])
RESULT_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _with_trigger(column):
    """(row, text) of the texts that hold a digit or an at sign."""
    data, offsets = text_bytes(column)
    at = np.flatnonzero(_HAS_TRIGGER[data])
    rows = np.unique(np.searchsorted(offsets, at, "right") - 1)
    return zip(rows.tolist(), column.take(pa.array(rows)).to_pylist())


def _mark(text):
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _examples(batches):
    for batch in batches:
        for part in slices(batch):
            rows = {True: {}, False: {}}
            for _, text in _with_trigger(part.column(0)):
                base, doubtful = base_spans(text), doubtful_spans(text)
                for kind, a, b in base:
                    begin = max(0, a - 8 - _mark(text[a:b]) % 40)
                    window = text[begin:begin + WINDOW]
                    if any(x < begin + WINDOW and begin < y for x, y in doubtful):
                        continue
                    rows[True][window] = ",".join(f"{k}:{x - begin}:{y - begin}" for k, x, y in base
                                                  if x >= begin and y <= begin + len(window))
                for begin in windows_of(text):
                    if not any(a < begin + WINDOW and begin < b for _, a, b in [*base, *((None, *d) for d in doubtful)]):
                        rows[False][text[begin:begin + WINDOW]] = ""
            for found, kept in rows.items():
                kept = sorted((_mark(w), w, s) for w, s in kept.items())[:SAMPLE]     # the sample's smallest are among these
                if kept:
                    yield record_batch(EXAMPLES, [found] * len(kept), *zip(*kept))


def fit(documents):
    """The tagger's parameters, or None where the corpus holds no match at all."""
    rows = documents.select("text").where("text IS NOT NULL").mapInArrow(_examples, "found boolean, mark long, window string, spans string")
    rows = rows.distinct()
    rows = [r for found in ("found", "NOT found") for r in rows.where(found).orderBy("mark", "window").limit(SAMPLE).collect()]
    examples = [(r.window, [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s]) for r in rows]
    if not any(s for _, s in examples):
        return None
    positive = [(w, s) for w, s in examples if s]
    texts = [(k, w[a:b]) for w, s in positive for k, a, b in s]
    beside = [joined(w, s, texts[(7 * i + 3) % len(texts)]) for i, (w, s) in enumerate(positive)]
    return train(examples + [rewritten(w, s) for w, s in positive] + beside)


def _joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal_data(documents, parameters):
    """doc_id, counts and digest of the pattern matches, and all spans, of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(parameters)
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                n = part.num_rows
                counts, digests, spans = np.zeros((len(KINDS), n), np.int64), [nothing] * n, [""] * n
                texts = list(_with_trigger(part.column(1)))
                places = [(row, text, windows_of(text), base_spans(text)) for row, text in texts]
                number = {}
                for _, text, starts, _ in places:
                    for at in starts:
                        number.setdefault(text[at:at + WINDOW], len(number))
                decoded = window_spans(shared.value, list(number)) if shared.value and number else None
                for row, text, starts, base in places:
                    for k, _, _ in base:
                        counts[k, row] += 1
                    digests[row] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    more = reconciled(text, starts, [decoded[number[text[at:at + WINDOW]]] for at in starts], base) if decoded else []
                    spans[row] = _joined(base + more)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT_DDL)


def op6_pii(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return find_personal_data(documents, fit(documents))
