"""Toxicity by a convolutional text classifier in numpy.

Words are hashed to embeddings, with a second embedding for the hash of their first letters, which
inflected forms share. Filters of several widths slide over the whole text, each keeps its
maximum, and a logistic unit combines the maxima. All of it starts at random and is trained by
Adam. The decision threshold is set for each language, which is inferred from the text's own
function words, on labelled rows that the gradient has not seen, and moved to a score of 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released
from .licences import WORDS
from .training import Adam, fold, labelled_sample, sigmoid, threshold

BUCKETS, STEMS, STEM = 1 << 16, 1 << 15, 4
WIDTHS, FILTERS, DIM = (1, 2, 3), 8, 8
#: Words scored at a time; neighbouring blocks overlap by the widest filter.
BLOCK = 1 << 16
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with be by on are this from",
    "fr": "le la les de des et un une que qui dans pour est sur pas au du avec",
    "de": "der die das und ist ein eine nicht mit den von zu im sich auf des dem",
    "es": "el la los las de del y un una que en por con para es no se lo",
}


class Ids(dict):
    """Word to bucket * STEMS + stem bucket, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word) % BUCKETS * STEMS + zlib.crc32(word[:STEM], 1) % STEMS
        if len(self) < 200_000:
            self[word] = value
        return value


def word_ids(text: bytes | None, ids: Ids):
    import numpy as np

    words = (text or b"").translate(WORDS).split()
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def language_of(ids, tables: dict) -> str:
    """The language whose function words make up the largest part of the text."""
    import numpy as np

    counts = {k: sum(int(np.isin(ids[at : at + BLOCK], t).sum()) for at in range(0, len(ids), BLOCK)) for k, t in tables.items()} if len(ids) else {}
    return max(counts, key=lambda k: (counts[k], k), default="") if any(counts.values()) else ""


def function_ids() -> dict:
    import numpy as np

    ids = Ids()
    return {k: np.array(sorted({ids[w.encode()] for w in v.split()})) for k, v in FUNCTION_WORDS.items()}


class TextNet:
    """The trained network: logit() of a text's word ids."""

    def __init__(self, params: dict):
        self.p = params
        self.fold()

    def fold(self) -> None:
        """Embedding times filter weight, so that scoring only adds up rows."""
        p = self.p
        self.words, self.stems = p["words"] @ p["filters"], p["stems"] @ p["filters"]

    def logit(self, ids) -> float:
        return float(self.maxima(ids) @ self.p["out"] + self.p["bias"][0])

    def maxima(self, ids):
        import numpy as np

        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        for at in range(0, len(ids), BLOCK):
            part = ids[at : at + BLOCK + max(WIDTHS) - 1]
            g = self.words[part // STEMS] + self.stems[part % STEMS]
            for k, (w, c) in enumerate(_columns()):
                if len(g) >= w:
                    s = g[: len(g) - w + 1, c : c + FILTERS]
                    for j in range(1, w):
                        s = s + g[j : len(g) - w + 1 + j, c + j * FILTERS : c + (j + 1) * FILTERS]
                    cut = slice(k * FILTERS, (k + 1) * FILTERS)
                    np.maximum(best[cut], s.max(axis=0) + self.p["shift"][cut], out=best[cut])
        return best


def _columns():
    """(width, first column of its filters) for each width."""
    at = 0
    for w in WIDTHS:
        yield w, at
        at += w * FILTERS


def train(sample: list, shares: dict, *, epochs: int = 12, batch: int = 32, rate: float = 0.05, seed: int = 5) -> dict | None:
    """Parameters and thresholds from [(text, label, fold)]; None without both classes.

    Everything starts at random. A batch's texts stand behind each other in one array; windows that
    would reach from one into the next are left out of the maxima.
    """
    import numpy as np

    ids = Ids()
    rows = [(word_ids(t, ids), y, f) for t, y, f in sample]
    fit = [(x, y) for x, y, f in rows if f != 1 and len(x)]
    if len({y for _, y in fit}) < 2:
        return None
    rng = np.random.default_rng(seed)
    cols, total = sum(WIDTHS) * FILTERS, len(WIDTHS) * FILTERS
    p = {
        "words": rng.normal(0, 0.05, (BUCKETS, DIM)), "stems": rng.normal(0, 0.05, (STEMS, DIM)), "filters": rng.normal(0, 0.3, (DIM, cols)),
        "shift": np.zeros(total), "out": np.abs(rng.normal(0, 0.3, total)) * np.where(np.arange(total) % 2, -1, 1), "bias": np.array([-1.0]),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    adam, columns, every = Adam(p, rate), list(_columns()), np.arange(FILTERS)
    for epoch in range(epochs):
        adam.rate = rate * (1 - epoch / epochs)
        order = rng.permutation(len(fit))
        for at in range(0, len(order), batch):
            some = [fit[i] for i in order[at : at + batch]]
            x, y = np.concatenate([t for t, _ in some]), np.array([y for _, y in some])
            sizes = np.array([len(t) for t, _ in some])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            left = np.repeat(starts + sizes, sizes) - np.arange(len(x))  # words from here to the text's end
            b, s = x // STEMS, x % STEMS
            e = p["words"][b] + p["stems"][s]
            g = e @ p["filters"]
            best, where = np.zeros((len(some), total), np.float32), np.zeros((len(some), total), np.int64)
            for k, (w, c) in enumerate(columns):
                r = np.zeros((len(x), FILTERS), np.float32)
                for j in range(w):
                    r[: len(x) - j] += g[j:, c + j * FILTERS : c + (j + 1) * FILTERS]
                r[left < w] = -np.inf
                top = np.maximum.reduceat(r, starts)
                first = np.where(r == np.repeat(top, sizes, axis=0), np.arange(len(x))[:, None], len(x))
                cut = slice(k * FILTERS, (k + 1) * FILTERS)
                best[:, cut] = np.maximum(top + p["shift"][cut], 0)
                where[:, cut] = np.minimum.reduceat(first, starts)
            d = ((sigmoid(best @ p["out"] + p["bias"][0]) - y) / len(some)).astype(np.float32)
            up = d[:, None] * p["out"] * (best > 0)
            grads = {"out": d @ best, "bias": d.sum(keepdims=True), "shift": up.sum(axis=0), "filters": np.zeros_like(p["filters"])}
            touched, values = [], []
            for k, (w, c) in enumerate(columns):
                cut = slice(k * FILTERS, (k + 1) * FILTERS)
                live, f = np.nonzero(up[:, cut])
                u, t = up[:, cut][live, f], where[:, cut][live, f]
                for j in range(w):
                    at_col = c + j * FILTERS + f
                    np.add.at(grads["filters"].T, at_col, u[:, None] * e[t + j])
                    touched.append(t + j)
                    values.append(u[:, None] * p["filters"].T[at_col])
            touched, values = np.concatenate(touched), np.concatenate(values)
            if len(touched):
                grads |= {"words": (b[touched], values), "stems": (s[touched], values)}
            adam.step(grads)
    net, tables = TextNet(p), function_ids()
    told = [(net.logit(x), y, language_of(x, tables)) for x, y, f in rows if f == 1]
    n = [max(1, sum(1 for _, y, _ in told if y == k)) for k in (0, 1)]
    weigh = lambda y: shares.get(y, 0.5) / n[y]  # noqa: E731  classes count as in all labels

    def cut(part):
        z, y = np.array([t[0] for t in part]), np.array([t[1] for t in part])
        return threshold(z, y, np.array([weigh(v) for v in y]), 1)

    whole = cut(told) if told else 0.0
    cuts = {"": whole}
    for k in FUNCTION_WORDS:
        part = [t for t in told if t[2] == k]
        few = min(sum(1 for t in part if t[1] == y) for y in (0, 1)) if part else 0
        share = few / (few + 5)  # few rows of a class say little about a language of their own
        cuts[k] = share * cut(part) + (1 - share) * whole if few else whole
    return {"params": p, "cuts": cuts}


def scorer(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", **how):
    """Learn from the labelled rows of docs; a pandas UDF from a text's bytes to its score."""
    sample, shares = labelled_sample(docs, labels, label, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(train(sample, shares, **how))
    sample.clear()
    released()  # the driver's Python, too, is used by what follows

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, ids, tables = model.value, Ids(), function_ids()
        net = TextNet(m["params"]) if m else None

        def one(text):
            x = word_ids(text, ids)
            return float(sigmoid(net.logit(x) - m["cuts"][language_of(x, tables)]))

        for texts in batches:
            yield pd.Series([one(t) if net else 0.0 for t in texts], dtype=float)
        ids.clear()
        released()

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", **how) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (score at least 0.5).

    Only texts make scores. The model travels as a broadcast of a fixed size.

    Defined cases: null and empty texts score as a text without words; without labels of both
    classes every score is 0; null ids keep their rows and are not held out; repeated rows repeat;
    other columns are not read; an empty table gives no rows.
    """
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), scorer(docs, labels, id_col, text_col, label, **how)(F.col(text_col).cast("string").cast("binary")).alias("score"))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
