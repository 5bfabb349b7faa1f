"""Quality by a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Learned filters slide over
each chunk and keep their maximum; a logistic unit combines the maxima's mean and maximum over the
chunks into one probability. Filters step over two bytes, so scoring adds up rows of tables of byte
pairs. The threshold is set on labelled rows that the gradient has not seen and moved to
``decision``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released
from .training import Adam, fold, labelled_sample, sigmoid, threshold

#: Filter width in bytes, filters, size of a byte's embedding; chunk and how far the next one begins.
WIDTH, FILTERS, DIM, CHUNK, STEP = 8, 12, 6, 512, 448
#: Chunks scored at a time.
BLOCK = 256


def chunks(text: bytes | None):
    """Rows of CHUNK bytes, the last padded with zeros; an empty text is one row of zeros."""
    import numpy as np

    raw = np.frombuffer(text or b"", np.uint8)
    n = max(1, -(-(len(raw) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def pairs(c):
    """Byte pairs of chunks at every second byte."""
    return c[:, ::2].astype("int64") * 256 + c[:, 1::2]


class ByteNet:
    def __init__(self, params: dict):
        import numpy as np

        self.p = p = params
        k = WIDTH // 2
        w = p["filters"].reshape(WIDTH, DIM, FILTERS)
        single = np.stack([p["bytes"] @ w[j] for j in range(WIDTH)])  # WIDTH, 256, FILTERS
        self.tables = [(single[2 * j][:, None, :] + single[2 * j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(k)]

    def windows(self, c):
        """Sums of each filter at every second byte of blocks of chunks."""
        for at in range(0, len(c), BLOCK):
            q = pairs(c[at : at + BLOCK])
            n = q.shape[1] - len(self.tables) + 1
            s = self.tables[0][q[:, :n]]
            for j, t in enumerate(self.tables[1:], 1):
                s += t[q[:, j : j + n]]
            yield s

    def maxima(self, c):
        """Maximum of each filter in each chunk."""
        import numpy as np

        return np.concatenate([np.maximum(s.max(axis=1) + self.p["shift"], 0) for s in self.windows(c)])

    def tops(self, c):
        """Where each filter's maximum stands in each chunk, and the maximum before it is cut at zero."""
        import numpy as np

        where, value = [], []
        for s in self.windows(c):
            where.append(s.argmax(axis=1))
            value.append(np.take_along_axis(s, where[-1][:, None, :], 1)[:, 0] + self.p["shift"])
        return np.concatenate(where), np.concatenate(value)

    def logit(self, text: bytes | None) -> float:
        m = self.maxima(chunks(text))
        return float(m.mean(axis=0) @ self.p["mean"] + m.max(axis=0) @ self.p["most"] + self.p["bias"][0])


def train(sample: list, shares: dict, decision: float, *, epochs: int = 5, batch: int = 32, rate: float = 0.01, seed: int = 8) -> dict | None:
    """Parameters and threshold from [(text, label, fold)]; None without both classes."""
    import numpy as np

    fit = [(chunks(t), y) for t, y, f in sample if f != 1]
    if len({y for _, y in fit}) < 2:
        return None
    rng = np.random.default_rng(seed)
    p = {"bytes": rng.normal(0, 0.5, (256, DIM)), "filters": rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)), "shift": np.zeros(FILTERS), "mean": rng.normal(0, 0.3, FILTERS), "most": rng.normal(0, 0.1, FILTERS), "bias": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    adam, cols = Adam(p, rate), np.arange(FILTERS)
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for at in range(0, len(order), batch):
            some = [fit[i] for i in order[at : at + batch]]
            c, y = np.concatenate([x for x, _ in some]), np.array([y for _, y in some])  # a batch's chunks stand behind each other
            sizes = np.array([len(x) for x, _ in some])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            where, v = ByteNet(p).tops(c)
            m = np.maximum(v, 0)
            mean, most = np.add.reduceat(m, starts) / sizes[:, None], np.maximum.reduceat(m, starts)
            first = np.where(m == np.repeat(most, sizes, axis=0), np.arange(len(c))[:, None], len(c))
            top = np.minimum.reduceat(first, starts)  # texts, filters
            d = (sigmoid(mean @ p["mean"] + most @ p["most"] + p["bias"][0]) - y) / len(some)
            up = np.repeat(d / sizes, sizes)[:, None] * p["mean"]
            up[top, cols] += d[:, None] * p["most"]
            up *= v > 0
            found = c[np.arange(len(c))[:, None, None], 2 * where[:, :, None] + np.arange(WIDTH)]  # chunks, filters, WIDTH
            e = p["bytes"][found].reshape(len(c), FILTERS, -1)
            back = (up[:, :, None] * p["filters"].T[None]).reshape(-1, DIM)
            grads = {
                "bias": d.sum(keepdims=True), "mean": d @ mean, "most": d @ most, "shift": up.sum(axis=0), "filters": np.einsum("cf,cfk->kf", up, e),
                "bytes": np.stack([np.bincount(found.ravel(), weights=back[:, k], minlength=256) for k in range(DIM)], axis=1),
            }
            adam.step({k: g.astype(np.float32) for k, g in grads.items()})
    net = ByteNet(p)
    told = [(net.logit(t), y) for t, y, f in sample if f == 1]
    cut = 0.0
    if told:
        z, y = np.array([t[0] for t in told]), np.array([t[1] for t in told])
        weight = np.array([shares.get(v, 0.5) / max(1, (y == v).sum()) for v in y.tolist()])
        cut = threshold(z, y, weight, 0 if shares.get(0, 0) <= shares.get(1, 0) else 1)
    return {"params": p, "shift": log(decision / (1 - decision)) - cut}


def scorer(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", decision: float = 0.3, **how):
    """Learn from the labelled rows of docs; a pandas UDF from a text's bytes to its score."""
    sample, shares = labelled_sample(docs, labels, label, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(train(sample, shares, decision, **how))
    sample.clear()
    released()  # the driver's Python, too, is used by what follows

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model.value
        net = ByteNet(m["params"]) if m else None
        for texts in batches:
            yield pd.Series([float(sigmoid(net.logit(t) + m["shift"])) if net else 0.0 for t in texts], dtype=float)
        released()

    return score


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", decision: float = 0.3, **how) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (score at least ``decision``).

    Only texts make scores. The model travels as a broadcast of a fixed size.

    Defined cases: null and empty texts score as a chunk of zeros; without labels of both classes
    every score is 0; null ids keep their rows and are not held out; repeated rows repeat; other
    columns are not read; an empty table gives no rows.
    """
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), scorer(docs, labels, id_col, text_col, label, decision, **how)(F.col(text_col).cast("string").cast("binary")).alias("score"))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= decision).cast("int").alias("predicted"))
