"""What both classifiers share: labelled samples, Adam, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILE_ROWS, staged

#: Labelled rows that a model learns from, half of each class at most, taken by a hash of the id,
#: and the bytes that all of them may have together: the rows beyond are left out whatever their
#: length. Both bound training only: every row of the input is scored, and over its whole text.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 64 << 20


def fold(doc_id: Column) -> Column:
    """0 to 4; rows of fold 0 are held out, those of fold 1 set thresholds and train nothing."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES
) -> tuple[list, dict[int, float]]:
    """[(text bytes, label, fold)] of a bounded sample by hash of the id, and each class's share of all labels.

    Labels of held-out rows are filtered out before anything is counted. Null labels and ids are no labels.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(fold(F.col("id")) != 0)
    known = staged(known.groupBy("id").agg(F.max("y").alias("y")), labels.count())
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(share.values())
    picked = None
    for y in share:
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(2 * rows)
        picked = some if picked is None else picked.union(some)
    if picked is None:
        return [], {}
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = texts.join(F.broadcast(picked), "id")  # at most 4 * rows ids are broadcast
    found = staged(found.groupBy("id", "y").agg(F.max(F.struct(F.length("text").alias("size"), F.xxhash64("text").alias("h"), "text")).alias("x")).select("id", "y", "x.size", "x.text", F.xxhash64("id").alias("k")), FILE_ROWS * 4)  # 4 * rows texts at most
    out: list = []
    for y in sorted(share):
        part, held, last = found.where(F.col("y") == y), 0, None
        for r in part.orderBy("k", "id").limit(rows // 2).select("k", "size").collect():
            held += r["size"] or 0
            if held > size // 2:
                break
            last = r["k"]
        if last is not None:
            out += [(bytes(r["text"] or b""), r["y"], r["f"]) for r in part.where(F.col("k") <= last).orderBy("k", "id").select("text", "y", fold(F.col("id")).alias("f")).collect()]
    return out, {y: n / total for y, n in share.items()}


class Adam:
    """Adam over named arrays; a sparse gradient is (rows, values)."""

    def __init__(self, params: dict, rate: float, decay: float = 1e-5):
        import numpy as np

        self.np, self.params, self.rate, self.decay, self.n = np, params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict) -> None:
        np = self.np
        self.n += 1
        fix = np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, g in grads.items():
            if isinstance(g, tuple):
                rows, at = np.unique(g[0], return_inverse=True)
                dense = np.zeros((len(rows), *self.params[k].shape[1:]), self.params[k].dtype)
                np.add.at(dense, at, g[1])
                g = dense
            else:
                rows = slice(None)
            m, v = self.m[k], self.v[k]
            m[rows] = 0.9 * m[rows] + 0.1 * g
            v[rows] = 0.999 * v[rows] + 0.001 * g * g
            self.params[k][rows] -= self.rate * (fix * m[rows] / (np.sqrt(v[rows]) + 1e-8) + self.decay * self.params[k][rows])


def threshold(z, y, weight, rare: int) -> float:
    """The logit above which label 1 is told, best by F1 of the rare class; the middle of the best gap."""
    import numpy as np

    if len(z) == 0 or len(set(y.tolist())) < 2:
        return 0.0
    order = np.argsort(z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    is_rare = (y == rare) * weight
    other = weight - is_rare
    below_rare, below_other = np.concatenate([[0], np.cumsum(is_rare)]), np.concatenate([[0], np.cumsum(other)])
    hit, false = (below_rare, below_other) if rare == 0 else (below_rare[-1] - below_rare, below_other[-1] - below_other)
    f1 = 2 * hit / np.maximum(hit + false + below_rare[-1], 1e-12)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    gaps = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    widest = best[np.argmax(gaps[best + 1] - gaps[best])]
    return float((gaps[widest] + gaps[widest + 1]) / 2)


def sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
