"""Toxicity: a linear-chain CRF tags toxic words; forward-backward marginals give document scores and offsets.

Words are runs of letters, lower-cased. A word's features are its own hash and the
hashes of its first four and five bytes. Token labels come from labelled documents:
in a toxic one, words with a feature that is found almost only in toxic documents;
in others, none. Those token labels train the CRF (two states, Adam on the exact
gradient of the conditional likelihood), and a logistic curve over a document's
marginals is fitted to the document labels.

With two states the messages reduce to one ratio per word, so a step is a few
vector operations over all documents of a chunk, longest first; whole texts are
scored, however long.

The sample for fitting has at most ``SAMPLE`` labelled documents (a parameter).
Defined results: null and empty texts have no words and get the score of a document
without toxic words; without labelled rows of both kinds every score is the share of
toxic ones (0 with no rows); rows that repeat get equal scores; extra columns pass.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, table
from .katz import held
from .labelled import sample
from .vec import _LOWER, chunks, mix, powers

SAMPLE = 10000
MIN_DOCS, MIN_SHARE, MIN_WEAK = 5, 0.85, 30
STEPS, RATE = 25, 0.3
GROUP = 1 << 18
THRESHOLD = 0.7
_APART = np.ones(256, bool)
_APART[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_U = np.uint64


def letter_words(texts: list):
    """(features (3, words), first word of each text with the end last, byte start, byte end, start of each text)."""
    enc = [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
    buf = np.frombuffer(b" ".join([*enc, b""]) or b" ", np.uint8)
    at = np.zeros(len(enc) + 1, np.int64)
    np.cumsum([len(e) + 1 for e in enc], out=at[1:])
    edge = np.diff(_APART[buf].view(np.int8), prepend=np.int8(1))
    s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    p, q = powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_LOWER[buf] * p[:-1], out=c[1:])
    f = np.stack([mix((c[x] - c[s]) * q[s] + _U(k)) for k, x in enumerate((e, np.minimum(s + 4, e), np.minimum(s + 5, e)))])
    return f, np.searchsorted(s, at), s, e, at


def packed(first: np.ndarray):
    """(order of words by position then document, offsets of the positions, document of each packed word): longest first."""
    n = np.diff(first)
    rank = np.argsort(-n, kind="stable")
    n_sorted = n[rank]
    steps = int(n_sorted[0]) if len(n) else 0
    active = len(n) - np.searchsorted(n_sorted[::-1], np.arange(steps), side="right")
    off = np.zeros(steps + 1, np.int64)
    np.cumsum(active, out=off[1:])
    col = np.arange(off[-1]) - np.repeat(off[:-1], active)
    return first[rank[col]] + np.repeat(np.arange(steps), active), off, rank[col]


def messages(e: np.ndarray, off: np.ndarray, trans: np.ndarray, start: float):
    """Forward and backward ratios (state 1 to state 0) of packed words with emission ratios e."""
    (t00, t01), (t10, t11) = trans.tolist()
    r, b = np.empty_like(e), np.ones_like(e)
    o = off.tolist()
    for i in range(len(o) - 1):
        x = slice(o[i], o[i + 1])
        if i == 0:
            r[x] = e[x] * start
        else:
            v = r[o[i - 1] : o[i - 1] + o[i + 1] - o[i]]
            r[x] = e[x] * (t01 + t11 * v) / (t00 + t10 * v)
    for i in range(len(o) - 3, -1, -1):
        k = o[i + 2] - o[i + 1]
        v = e[o[i + 1] : o[i + 2]] * b[o[i + 1] : o[i + 2]]
        b[o[i] : o[i] + k] = (t10 + t11 * v) / (t00 + t01 * v)
    return r, b


class Crf:
    """Feature weights of the toxic state (sorted keys), bias, transitions, start, and the document curve."""

    def __init__(self, keys, weights, bias, trans, start, curve, prior):
        self.keys, self.weights, self.bias, self.trans, self.start, self.curve, self.prior = keys, weights, bias, trans, start, curve, prior

    def emissions(self, f: np.ndarray) -> np.ndarray:
        out = np.full(f.shape[1], self.bias)
        if len(self.keys):
            for x in f:
                i = np.searchsorted(self.keys, x)
                i[i == len(self.keys)] = 0
                out += np.where(self.keys[i] == x, self.weights[i], 0.0)
        return np.exp(np.clip(out, -30, 30))

    def marginals(self, texts: list):
        """(probability of each word being toxic, then what letter_words gives)."""
        f, first, s, e, at = letter_words(texts)
        order, off, _ = packed(first)
        p = np.zeros(f.shape[1])
        r, b = messages(self.emissions(f)[order], off, np.exp(self.trans), np.exp(self.start))
        p[order] = r * b / (1 + r * b)
        return p, first, s, e, at

    def document(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(first) - 1, self.prior)
        x = summary(p, first) @ self.curve
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1, log(1 + sum of marginals), highest marginal, square root of the mean marginal, per document."""
    n = np.diff(first)
    c = np.append(0, np.cumsum(p))
    total = np.maximum(c[first[1:]] - c[first[:-1]], 0)
    top = np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        top[full] = np.maximum.reduceat(p, first[full])
    return np.stack([np.ones(len(n)), np.log1p(total), top, np.sqrt(total / np.maximum(n, 1))], 1)


def _adam(w, grad, state, rate):
    state[0] = 0.9 * state[0] + 0.1 * grad
    state[1] = 0.99 * state[1] + 0.01 * grad**2
    state[2] += 1
    return w + rate * (state[0] / (1 - 0.9 ** state[2])) / (np.sqrt(state[1] / (1 - 0.99 ** state[2])) + 1e-8)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


class _packed_group:
    """Feature places, labels and neighbours of the packed words of some documents."""

    def __init__(self, texts: list, y: np.ndarray, keys: np.ndarray, sure: np.ndarray):
        f, first, *_ = letter_words(texts)
        order, self.off, _ = packed(first)
        at = np.full(f.shape, len(keys), np.int32)
        for i, x in enumerate(f):
            j = np.searchsorted(keys, x)
            j[j == len(keys)] = 0
            if len(keys):
                at[i] = np.where(keys[j] == x, j, len(keys))
        label = sure[at].any(0) & (np.repeat(y, np.diff(first)) > 0)
        self.at, self.label, o = at[:, order], label[order], self.off
        self.lead = int(o[1]) if len(o) > 1 else 0
        # the word that follows packed word i of position t is the one in the same column at t + 1
        self.nxt = np.arange(self.lead, len(order), dtype=np.int32)
        self.prev = np.concatenate([np.arange(o[i], o[i] + o[i + 2] - o[i + 1], dtype=np.int32) for i in range(len(o) - 2)]) if len(o) > 2 else np.zeros(0, np.int32)
        self.seen = np.array([[np.sum((self.label[self.prev] == a) & (self.label[self.nxt] == b)) for b in (False, True)] for a in (False, True)], float)


def fit(texts: list, y: np.ndarray) -> Crf:
    """Fit on labelled texts: a bounded sample, held in one process."""
    y = np.asarray(y, float)
    prior = float(y.mean()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Crf(np.zeros(0, np.uint64), np.zeros(0), -5.0, np.zeros((2, 2)), -5.0, None, prior)
    sizes, stats = [], [[] for _ in range(3)]
    for a, b in chunks(texts):  # documents and toxic documents that hold each feature
        f, first, *_ = letter_words(texts[a:b])
        sizes.append(np.diff(first))
        doc = np.repeat(np.arange(a, b), sizes[-1])
        for own, x in zip(stats, f):
            o = np.lexsort((doc, x))
            k, d = x[o], doc[o]
            new = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])) if len(k) else np.zeros(0, bool)
            keys, inv = np.unique(k[new], return_inverse=True)
            own.append((keys, np.bincount(inv, minlength=len(keys)), np.bincount(inv, y[d[new]], len(keys))))
    merged = []
    for own in stats:
        keys, inv = np.unique(np.concatenate([x[0] for x in own]), return_inverse=True)
        merged.append((keys, *(np.bincount(inv, np.concatenate([x[i] for x in own]), len(keys)) for i in (1, 2))))
    keys, docs, toxic = (np.concatenate([x[i] for x in merged]) for i in range(3))
    del stats, merged
    used = docs >= MIN_DOCS
    keys, docs, toxic = keys[used], docs[used], toxic[used]
    share = (toxic + prior) / (docs + 1)
    chosen = (share >= MIN_SHARE) | (docs >= MIN_WEAK) & (np.abs(np.log((share + 0.02) / (prior + 0.02))) > 0.7)
    o = np.argsort(keys[chosen])
    keys, sure = keys[chosen][o], np.append((share >= MIN_SHARE)[chosen][o], False)
    # documents of like length together, the longest first, so that a step works on few words at a time and memory stays low
    sizes = np.concatenate(sizes)
    rank = np.argsort(-sizes, kind="stable")
    total = np.cumsum(sizes[rank])
    groups = [_packed_group([texts[i] for i in part], y[part], keys, sure) for part in np.split(rank, np.flatnonzero(np.diff(total // GROUP)) + 1) if len(part)]
    w, bias, trans, start = np.zeros(len(keys) + 1), -3.0, np.zeros((2, 2)), -3.0
    states = [[0, 0, 0] for _ in range(4)]
    seen = sum(g.seen for g in groups)
    scale = max(1.0, sum(float(g.label.sum()) for g in groups))
    for _ in range(STEPS):
        gw, gb, gs, want, tr = np.zeros(len(w)), 0.0, 0.0, np.zeros((2, 2)), np.exp(trans)
        for x in groups:
            e = np.full(len(x.label), bias)
            for i in x.at:
                e += w[i]
            e = np.exp(np.clip(e, -30, 30))
            r, b = messages(e, x.off, tr, np.exp(start))
            v, u = r[x.prev], (e * b)[x.nxt]
            z = tr[0, 0] + tr[1, 0] * v + tr[0, 1] * u + tr[1, 1] * v * u
            want += [[np.sum(tr[0, 0] / z), np.sum(tr[0, 1] * u / z)], [np.sum(tr[1, 0] * v / z), np.sum(tr[1, 1] * v * u / z)]]
            r *= b
            g = x.label - r / (1 + r)
            for i in x.at:
                gw += np.bincount(i, g, len(w))
            gb, gs = gb + g.sum(), gs + g[: x.lead].sum()
        gw[-1] = 0
        w = _adam(w, gw / scale - 1e-4 * w, states[0], RATE)
        bias = float(_adam(bias, gb / scale, states[1], RATE))
        trans = _adam(trans, (seen - want) / scale - 1e-3 * trans, states[2], RATE / 3)
        start = float(_adam(start, gs / scale, states[3], RATE))
    w = np.clip(w, -20, 20)
    keep = w[:-1] != 0
    model = Crf(keys[keep], w[:-1][keep], bias, trans, start, None, prior)
    del groups
    model.curve = logistic(np.concatenate([summary(*model.marginals(texts[a:b])[:2]) for a, b in chunks(texts)]), y)
    return model


def train(docs: DataFrame, labels: DataFrame, allowed, limit: int = SAMPLE) -> Crf:
    """Fit in one task, on at most ``limit`` documents; the driver gets the weights only."""

    def run(batches):
        texts, y = [], []
        for pdf in batches:
            texts += pdf["text"].tolist()
            y += pdf["y"].tolist()
        yield pd.DataFrame({"model": [pickle.dumps(fit(texts, np.array(y)))]})

    got = sample(docs, labels, "toxic", allowed, limit).repartition(1).mapInPandas(released(run), "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else fit([], np.zeros(0))


def score(docs: DataFrame, model: Crf, column: str = "text", least: float = 0.5) -> DataFrame:
    """docs plus ``score`` and ``spans``: code-point spans of words whose marginal is ``least`` or more."""
    docs = docs.drop("score", "spans")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

    def run(batches):
        for pdf in batches:
            texts, scores, spans = pdf[column].tolist(), [], []
            for a, b in chunks(texts, 1 << 21):
                p, first, s, e, at = model.marginals(texts[a:b])
                scores.append(model.document(p, first))
                own = [[] for _ in range(b - a)]
                hit = np.flatnonzero(p >= least)
                if len(hit):
                    row = np.searchsorted(first, hit, side="right") - 1
                    for i in np.unique(row).tolist():
                        raw = texts[a + i].encode("utf-8", "replace")
                        lead = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
                        j = hit[row == i]
                        own[i] = [{"start": int(x), "end": int(y)} for x, y in zip(lead[s[j] - at[i]], lead[e[j] - at[i]], strict=True)]
                spans += own
            pdf["score"], pdf["spans"] = np.concatenate(scores) if scores else np.zeros(0), spans
            yield pdf

    return docs.mapInPandas(released(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("spans", span)]))


def op8_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), ~held("doc_id", 3, 1))
    return score(docs, model).select("doc_id", held("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
