"""Small tables with the awkward rows that every corpus operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, item string, component string, line int"


def text(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(3)}" for _ in range(words))


def changed(rng, words, n):
    words = words.split(" ")
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def documents(seed=3, groups=6, copies=12):
    """(doc_id, text): unrelated texts, exact and near copies, shared lines, repeated rows, null, empty and very long texts."""
    rng = random.Random(seed)
    rows, n = [], 0

    def add(t):
        nonlocal n
        rows.append((n * 7 % 1009, t))
        n += 1

    shared = [text(rng, 14) for _ in range(3)]
    for _ in range(30):
        add("\n".join([text(rng, rng.randrange(1, 60)), rng.choice(shared), text(rng, rng.randrange(1, 40))]))
    for _ in range(groups):
        original = text(rng, rng.randrange(12, 200))
        for k in range(copies):
            add(changed(rng, original, min(k // 4, 3)))
    for t in ("", " ", "\n\n", None, "one", "ONE", "one two", "Zwei Wörter ñandú 漢字", "a" * 5000, text(rng, 20_000), "\n".join(shared)):
        add(t)
    rows += [rows[0], rows[1], (None, text(rng, 20)), (None, None), (None, rows[2][1])]
    return rows


def table(spark, rows):
    """With more columns, some named as the operators name theirs."""
    return spark.createDataFrame([(i, t, "en", "src", len(t or ""), "x", "y", 3) for i, t in rows], DOCS)
