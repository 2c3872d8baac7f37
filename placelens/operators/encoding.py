"""Batch text encoding with a pluggable encoder."""

import hashlib
import re

import numpy as np

MAX_TOKENS = 512   # two of them are the special tokens that transformer encoders add


def hashing_encoder(dims=64):
    """Built-in encoder: token counts hashed into `dims` places (no model weights needed)."""
    word = re.compile(r"\w+")
    place = {}

    def encode(texts):
        out = np.zeros((len(texts), dims), dtype="float32")
        for i, text in enumerate(texts):
            for n, m in enumerate(word.finditer(text.lower())):
                if n >= MAX_TOKENS - 2:
                    break   # the encoder's own input limit
                t = m.group()
                if t not in place:
                    if len(place) > 1_000_000:
                        place.clear()   # keeps the worker's memory bounded
                    place[t] = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dims
                out[i, place[t]] += 1
        return out
    return encode


def encode_text(df, encoder_factory=hashing_encoder, key="article_id", text="text", batch=128):
    """Rows (key, embedding). The factory runs once per task (load a model there); the encoder it returns
    maps a list of texts to a matrix. Texts are grouped by similar length to limit padding."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        encode = encoder_factory()
        for pdf in batches:
            pdf = pdf.iloc[np.argsort(pdf[text].str.len().to_numpy(), kind="stable")]
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at:at + batch]
                yield part[[key]].assign(embedding=list(np.asarray(encode(part[text].tolist()), dtype="float32")))

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")
