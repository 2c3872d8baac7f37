"""Mean and spread of feature arrays by group, from one pass of vector sums."""

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F


def known_sums(df, group, features="features", target="y"):
    """{group: (rows, sum of y, per feature: known values, their sum, their sum of squares)}; shifted by the first moments of
    a row, so that large offsets do not cancel. One pass, vectors only. Returns (sums, shift)."""
    first = df.select(features).where(F.col(features).isNotNull()).first()
    shift = np.nan_to_num(np.array(first[0], float)) if first else np.zeros(0)
    rows = df.select(F.col(group).cast("string").alias("g"), features, F.col(target).cast("double").alias("t"))

    def partial(batches):
        acc = {}
        for pdf in batches:
            for g, part in pdf.groupby("g", dropna=False):
                x = np.stack(part[features].to_numpy()).astype(float) - shift
                known = ~np.isnan(x)
                x = np.where(known, x, 0)
                g = None if pd.isna(g) else g
                acc[g] = acc.get(g, 0) + np.concatenate([[len(part), part["t"].sum()], known.sum(axis=0), x.sum(axis=0), (x * x).sum(axis=0)])
        for g, s in acc.items():
            yield pd.DataFrame({"g": [g], "row": [s]})

    parts = rows.mapInPandas(partial, "g string, row array<double>")
    rows = parts.groupBy("g").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).collect()   # one per group
    return {r.g: np.array(r.row) for r in rows}, shift


class Scale:
    """Mean and spread of the features of some rows, NULLs filled with the mean of the known values."""

    def __init__(self, total, shift, sample=False):
        n, (known, s, q) = total[0], total[2:].reshape(3, -1)
        near = s / np.maximum(known, 1)
        self.fill = near + shift
        spread = np.maximum(q - known * near * near, 0)          # filled values add nothing
        spread = np.where(spread <= 1e-12 * np.maximum(q, 1e-300), 0, spread)
        self.std = np.sqrt(spread / max(n - 1 if sample else n, 1))
        self.live = self.std > 0
        self.ybar, self.n = total[1] / max(n, 1), n

    def __call__(self, x):
        return (np.where(np.isnan(x), self.fill, x) - self.fill) / np.where(self.live, self.std, 1) * self.live
