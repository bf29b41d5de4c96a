"""Quality classifier: histogram gradient-boosted trees over document statistics, as flat arrays.

Trees are grown level by level on quantile bins (second-order gain, logistic loss)
from at most ``SAMPLE`` labelled documents (a parameter), then flattened: feature,
threshold, and children as implicit heap positions, so a batch goes down all trees
by a few numpy gathers per level.

Defined results: null and empty texts have all statistics 0 and are scored like any
other; without labelled rows of both kinds every score is the share of label 1 (0.5
with no rows); rows that repeat get equal scores; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .katz import held
from .labelled import sample
from .vec import chunks, runs, word_arrays

SAMPLE = 20000
TREES, DEPTH, RATE, BINS = 60, 4, 0.15, 64
THRESHOLD = 0.3
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>", "mark": b".,;:", "shout": b"!?", "pipe": b"|", "line": b"\n", "wide": bytes(range(128, 256)), "other": b"()[]{}@/\\_=+^~`'\"-"}
_CLASS = np.zeros(256, np.int64)
for _i, _k in enumerate(_KINDS.values()):
    for _b in _k:
        _CLASS[_b] |= 1 << _i
NAMES = ["n_words", "n_bytes", "word_mean", "word_max", "short", "distinct", "repeated_8", "repeated_2", "lines_distinct", "first_share", *(f"{k}_share" for k in _KINDS), *(f"{k}_words" for k in ("upper", "symbol", "shout"))]


def _per(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.append(0, np.cumsum(values))
    return c[first[1:]] - c[first[:-1]]


def _distinct(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    o = np.lexsort((values, row))
    v, r = values[o], row[o]
    new = np.append(True, (v[1:] != v[:-1]) | (r[1:] != r[:-1])) if len(v) else np.zeros(0, bool)
    return np.bincount(r[new], minlength=n)


def statistics(texts: list) -> np.ndarray:
    """(texts, features), from whole texts."""
    h, first, buf, s, e = word_arrays(texts)
    n, size = len(texts), np.diff(first).astype(float)
    enc = np.array([len(t.encode("utf-8", "replace")) if isinstance(t, str) else 0 for t in texts], np.int64)
    at = np.append(0, np.cumsum(enc + 1))
    row, length = np.repeat(np.arange(n), np.diff(first)), (e - s).astype(float)
    words, total = np.maximum(size, 1), np.maximum(enc, 1).astype(float)
    top = np.zeros(n)
    full = np.flatnonzero(size)
    if len(full):
        top[full] = np.maximum.reduceat(length, first[full])
    out = [size, enc.astype(float), _per(length, first) / words, top, _per(length <= 3, first) / words, _distinct(h, row, n) / words]
    for k in (8, 2):
        g = runs(h, k)
        r = row[: len(g)]
        ok = np.arange(k, len(h) + 1) <= first[r + 1] if len(g) else np.zeros(0, bool)
        m = np.bincount(r[ok], minlength=n)
        out.append(1 - _distinct(g[ok], r[ok], n) / np.maximum(m, 1))
        out[-1][m == 0] = 0
    lines = [[x for x in t.split("\n") if x.strip()] if isinstance(t, str) else [] for t in texts]
    out.append(np.array([len(set(x)) / len(x) if x else 0.0 for x in lines]))
    out.append(np.array([len(x[0]) / max(1, len(t)) if x else 0.0 for x, t in zip(lines, texts, strict=True)]))
    cls = _CLASS[buf]
    for i in range(len(_KINDS)):
        out.append(_per(cls >> i & 1, at) / total)
    for name in ("upper", "symbol", "shout"):
        c = np.append(0, np.cumsum(cls >> list(_KINDS).index(name) & 1))
        out.append(_per((c[e] - c[s]) >= (np.maximum(length / 2, 1) if name == "upper" else 1), first) / words)
    return np.stack(out, 1)


class Trees:
    """Flat arrays: tree t's node i splits x[feature] > threshold to 2i + 2, else 2i + 1; leaf values are by position."""

    def __init__(self, base: float, feature=None, threshold=None, leaf=None):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.feature is None:
            return out
        depth = int(np.log2(self.feature.shape[1] + 1))
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
        return out + self.leaf[tree, node - (2**depth - 1)].sum(1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, ridge: float = 1.0, least: float = 5.0) -> Trees:
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        return Trees(float(np.log((p + 1e-6) / (1 - p + 1e-6))))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])  # bin b: v <= cuts[b]
    k, base = len(cuts), float(np.log(y.mean() / (1 - y.mean())))
    raw, inner = np.full(len(y), base), 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
        for d in range(depth):
            m = 2**d
            gain = np.zeros((m, k, bins))
            for f in range(k):
                at = node * bins + binned[f]
                gs, hs = (np.bincount(at, v, m * bins).reshape(m, bins) for v in (g, h))
                gl, hl = np.cumsum(gs, 1), np.cumsum(hs, 1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                s = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                s[(hl < least * 0.05) | (ht - hl < least * 0.05)] = 0
                s[:, len(cuts[f]) :] = 0
                gain[:, f] = s
            best = gain.reshape(m, -1).argmax(1)
            bf, bb = best // bins, best % bins
            good = gain.reshape(m, -1).max(1) > 1e-9
            i = np.arange(m) + m - 1
            feature[t, i] = np.where(good, bf, 0)
            threshold[t, i] = [cuts[f][b] if ok else np.inf for f, b, ok in zip(bf, bb, good, strict=True)]
            right = good[node] & (binned[bf[node], np.arange(len(y))] > bb[node])
            node = 2 * node + right
        gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        leaf[t] = rate * gs / (hs + ridge)
        raw += leaf[t][node]
    return Trees(base, feature, threshold, leaf)


def train(docs: DataFrame, labels: DataFrame, allowed, limit: int = SAMPLE) -> Trees:
    """Statistics are computed where the texts are; the driver gets at most ``limit`` rows of them."""

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in chunks(texts):
                yield pd.DataFrame({"x": list(statistics(texts[a:b])), "y": pdf["y"].to_numpy()[a:b]})

    got = sample(docs, labels, "quality", allowed, limit).mapInPandas(run, "x array<double>, y int").toPandas()
    return fit(np.stack(got["x"]) if len(got) else np.zeros((0, len(NAMES))), got["y"].to_numpy(float))


def score(docs: DataFrame, model: Trees, column: str = "text") -> DataFrame:
    """docs plus ``score``."""
    docs = docs.drop("score")

    def run(batches):
        for pdf in batches:
            texts = pdf[column].tolist()
            got = [model.predict(statistics(texts[a:b])) for a, b in chunks(texts)]
            pdf["score"] = np.concatenate(got) if got else np.zeros(0)
            yield pdf

    return docs.mapInPandas(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op10_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), ~held("doc_id", 5, 0))
    return score(docs, model).select("doc_id", held("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
