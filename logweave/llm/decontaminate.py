"""Benchmark decontamination by the q-gram lemma in diagonal bands, with banded alignment to verify.

Texts are compared as bytes with A-Z lower-cased, runs of white space as one space and
runs of another byte as ``RUN`` of it at most, so rules of dashes and the like make no
q-gram of their own. A benchmark item becomes overlapping segments of ``SEGMENT``
bytes (or itself, if shorter). A copy of a segment of m bytes within e edits shares at
least m - q + 1 - e q of its q-grams with the document, all within e diagonals of each
other; so q-grams of a document that the benchmark has are counted per segment in
bands of e diagonals, and two neighbouring bands that reach the bound are a region.
Regions are then verified by alignment in the diagonals that an alignment within the
budget can reach, with free ends in the text. So any excerpt of SEGMENT + STRIDE - 1
compared bytes of an item is found, whatever its place, and shorter ones by luck.

The benchmark travels with the tasks as texts, in slices of about ``SLICE`` bytes, and
each Python worker indexes a slice once; a larger benchmark is handled slice by slice
over all documents, each slice's result written before the next is read, so the driver
holds one slice at a time. Documents are never collected, joined or shuffled to find
hits. Meetings of a document's q-grams with the benchmark's are counted in pieces of
about ``MEETINGS``, whatever the number of places a q-gram has.

Defined results: null and empty texts and items have no hits; items below ``Q`` bytes
match exactly and as whole words, those below Q + 4 exactly; several regions of one
item in a document become one row with the outer span and the fewest edits; rows that
repeat give rows that repeat; extra columns are ignored, or kept by
``remove_contaminated``. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, released, table
from .vec import chunks

Q, SEGMENT, STRIDE, EDITS = 8, 80, 40, 0.1
SLICE, MEETINGS, RUN = 4 << 20, 1 << 20, 3
CHUNK = 1 << 20
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[[9, 10, 11, 12, 13]] = 32
_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)
_BITS = 20


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def compared(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as they are compared, place of each in the source)."""
    x = _NORMAL[np.frombuffer(raw, np.uint8)]
    at = np.arange(len(x))
    first = np.maximum.accumulate(np.where(np.append(True, x[1:] != x[:-1]), at, 0)) if len(x) else at
    use = (at - first < np.where(x == 32, 1, RUN)) if len(x) else np.zeros(0, bool)
    return x[use], at[use]


def normal(raw: bytes) -> np.ndarray:
    return compared(raw)[0]


def grams(buf: np.ndarray) -> np.ndarray:
    """Each run of eight bytes as one number, by doubling."""
    if len(buf) < Q:
        return np.zeros(0, np.uint64)
    a = buf.astype(np.uint64)
    a = a[:-1] | a[1:] << _U(8)
    a = a[:-2] | a[2:] << _U(16)
    return a[:-4] | a[4:] << _U(32)


class Index:
    """Segments of benchmark items and the places of their q-grams."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.item, self.text, self.edits = [], [], []
        short: dict[int, list] = {}
        for i, t in items:
            b = normal((t or "").strip().encode("utf-8", "replace"))
            if 0 < len(b) < Q:
                short.setdefault(len(b), []).append((int.from_bytes(b.tobytes(), "little"), i))
            starts = [0] if len(b) <= SEGMENT else sorted({*range(0, len(b) - SEGMENT, STRIDE), len(b) - SEGMENT})
            for s in starts:
                part = b[s : s + SEGMENT]
                if len(part) >= Q:
                    self.item.append(i)
                    self.text.append(part)
                    self.edits.append(min(int(EDITS * len(part)), (len(part) - Q) // Q))
        self.short = {n: (np.array([k for k, _ in sorted(x)], np.uint64), np.array([i for _, i in sorted(x)], np.int64)) for n, x in short.items()}
        self.size = np.array([len(x) for x in self.text], np.int64)
        self.edits = np.array(self.edits, np.int64)
        self.least = self.size - Q + 1 - self.edits * Q
        self.item = np.array(self.item, np.int64)
        self.width = max(1, int(self.edits.max())) if len(self.text) else 1
        parts = [grams(x) for x in self.text]
        k = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        seg = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])
        pos = np.concatenate([np.arange(len(x), dtype=np.uint8) for x in parts]) if parts else np.zeros(0, np.uint8)
        o = np.argsort(k, kind="stable")
        self.seg, self.pos = seg[o], pos[o]
        self.keys, self.first = np.unique(k[o], return_index=True)
        self.count = np.diff(np.append(self.first, len(k)))
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.keys * _K) >> _U(64 - _BITS)] = True

    def regions(self, buf: np.ndarray, at: int = 0):
        """(segments, first diagonals of a double band) wherever the lemma's bound is met, in pieces.

        A buffer with too many meetings is halved, with an overlap that holds a whole
        region, so memory follows the index and not the places that q-grams share.
        """
        g = grams(buf)
        pos = np.flatnonzero(self.bits[(g * _K) >> _U(64 - _BITS)])
        if not len(self.keys) or not len(pos):
            return
        i = np.searchsorted(self.keys, g[pos])
        i[i == len(self.keys)] = 0
        ok = self.keys[i] == g[pos]
        pos, i = pos[ok], i[ok]
        n, both = self.count[i], SEGMENT + 4 * self.width
        if n.sum() > MEETINGS and len(buf) > 8 * both:
            mid = len(buf) // 2
            start = (mid - both) // self.width * self.width  # so bands stay where they are
            yield from self.regions(buf[: mid + both], at)
            yield from self.regions(buf[start:], at + start)
            return
        if not len(pos):
            return
        bands = (len(buf) + SEGMENT) // self.width + 2
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[i], n)
        diagonal = np.repeat(pos, n) - self.pos[j] + SEGMENT  # never below 0
        key, c = np.unique(self.seg[j].astype(np.int64) * bands + diagonal // self.width, return_counts=True)
        nxt = np.zeros(len(c), np.int64)
        follow = np.flatnonzero(key[1:] == key[:-1] + 1)
        nxt[follow] = c[follow + 1]
        seg = key // bands
        # a band alone also stands for the pair that ends with it
        hit = c + nxt >= self.least[seg]
        yield seg[hit], (key[hit] % bands) * self.width - SEGMENT + at

    def words(self, buf: np.ndarray):
        """(item, start, end) of each short item that stands in a text as a whole word."""
        for n, (keys, items) in self.short.items():
            g = np.zeros(max(0, len(buf) - n + 1), np.uint64)
            for k in range(n):
                g |= buf[k : k + len(g)].astype(np.uint64) << _U(8 * k)
            i = np.searchsorted(keys, g)
            i[i == len(keys)] = 0
            at = np.flatnonzero(keys[i] == g)
            edge = np.concatenate([[False], _WORD[buf], [False]])
            for x in at[~(edge[at] & edge[at + 1]) & ~(edge[at + n] & edge[at + n + 1])].tolist():
                for j in range(int(np.searchsorted(keys, g[x])), len(keys)):
                    if keys[j] != g[x]:
                        break
                    yield int(items[j]), x, x + n


def align(pattern: np.ndarray, window: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of a pattern in a window with free ends, or None beyond ``most`` edits."""
    n = len(window)
    d, src = np.zeros(n + 1, np.int64), np.arange(n + 1)
    col = np.arange(n + 1)
    for i, p in enumerate(pattern, 1):
        sub = d[:-1] + (window != p)
        up = d[1:] + 1
        best = np.append(i, np.minimum(sub, up))
        own = np.append(0, np.where(sub <= up, src[:-1], src[1:]))
        low = np.minimum.accumulate(best - col)  # a run of insertions costs its length
        keep = np.maximum.accumulate(np.where(best - col == low, col, 0))
        d, src = low + col, own[keep]
        if d.min() > most:
            return None
    end = int(d.argmin())
    return int(d[end]), int(src[end]), end


def distances(index: Index, seg: np.ndarray, buf: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Fewest edits of each segment along the diagonals from ``low`` on that an alignment within its budget can reach.

    One recurrence over all at once, a row per byte of the segments, as wide as the
    band. ``buf`` has margins that match nothing; against them a byte costs what
    leaving it out costs.
    """
    m, e = index.size[seg], index.width
    band, most = 2 * index.width + 2 * e + 1, int(m.max())
    p = np.full((len(m), most), 0xFFFF, np.uint16)
    for i, x in enumerate(seg.tolist()):
        p[i, : len(index.text[x])] = index.text[x]
    col, live = np.arange(band, dtype=np.int16), np.arange(len(m))
    d, out = np.zeros((len(m), band), np.int16), np.full(len(m), 30000, np.int64)
    cols = (low - e)[:, None] + np.arange(band)[None, :]
    for i in range(most):
        new = d + (np.take(buf, cols + i, mode="clip") != p[live, i : i + 1])
        np.minimum(new[:, :-1], d[:, 1:] + 1, out=new[:, :-1])
        new -= col
        np.minimum.accumulate(new, axis=1, out=new)  # a run of insertions costs its length
        new += col
        d = new.astype(np.int16)
        if (done := m[live] == i + 1).any():
            out[live[done]] = d[done].min(1)
        if i % 8 == 7:  # what is over its budget stays over it
            left = (m[live] > i + 1) & (d.min(1) <= index.edits[seg[live]])
            live, d, cols = live[left], d[left], cols[left]
            if not len(live):
                break
    return out


def find(index: Index, texts: list) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) of each matching item, in code points of the text."""
    raw = [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
    seen = [compared(r) for r in raw]
    gap = SEGMENT + 4 * index.width
    at = np.append(0, np.cumsum([len(x) + gap for x, _ in seen])) + gap
    buf = np.zeros(int(at[-1]) + gap, np.uint8)
    for a, (x, _) in zip(at.tolist(), seen):
        buf[a : a + len(x)] = x
    inside = np.zeros(len(buf), bool)
    for a, (x, _) in zip(at.tolist(), seen):
        inside[a : a + len(x)] = True
    marked = np.where(inside, buf.astype(np.uint16), 0xFFFE)
    out: dict[tuple[int, int], list[int]] = {}

    def add(r, item, a, b, e):
        o = out.get((r, item))
        out[r, item] = [a, b, e] if o is None else [min(o[0], a), max(o[1], b), min(o[2], e)]

    for seg, low in index.regions(buf):
        order = np.lexsort((low, seg, index.size[seg]))
        for i in range(0, len(order), 2048):
            part = order[i : i + 2048]
            best = distances(index, seg[part], marked, low[part])
            for k in np.flatnonzero(best <= index.edits[seg[part]]).tolist():
                x, y = int(seg[part[k]]), int(low[part[k]])
                m, e, w = int(index.size[x]), int(index.edits[x]), index.width
                r = min(max(int(np.searchsorted(at, y + w + m // 2, side="right")) - 1, 0), len(raw) - 1)
                lo, hi = max(int(at[r]), y - w), min(int(at[r]) + len(seen[r][0]), y + 3 * w + m + 1)
                got = align(index.text[x], buf[lo:hi], e) if hi > lo else None
                if got:
                    add(r, int(index.item[x]), lo + got[1] - int(at[r]), lo + got[2] - int(at[r]), got[0])
    if index.short:
        for r, (x, _) in enumerate(seen):
            for item, a, b in index.words(x):
                add(r, item, a, b, 0)
    points = lambda r, i: int(np.sum((np.frombuffer(raw[r][:i], np.uint8) & 0xC0) != 0x80))
    source = lambda r, a, b: (points(r, int(seen[r][1][a])), points(r, int(seen[r][1][b - 1]) + 1)) if b > a else (0, 0)
    return [(r, item, *source(r, a, b), e) for (r, item), (a, b, e) in sorted(out.items())]


_built: list = [None, None]


def indexed(items: list) -> Index:
    """The index of a slice, built once in a worker process."""
    if _built[0] != items:
        _built[:] = items, Index(items)
    return _built[1]


def _search(items: list):
    def run(batches):
        index = indexed(items)
        for pdf in batches:
            texts, ids, rows = pdf["text"].tolist(), pdf["doc_id"].tolist(), []
            for a, b in chunks(texts, CHUNK):
                rows += [(ids[a + r], *x) for r, *x in find(index, texts[a:b])]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "edits"]).astype({"doc_id": "Int64"})

    return run


def slices(benchmark: DataFrame, limit: int = SLICE):
    """The benchmark's items in slices, each of at most ``limit`` bytes of text but for the spread of the hash; one at a time."""
    b = benchmark.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    total = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // limit))
    for i in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def indexes(benchmark: DataFrame, limit: int = SLICE):
    """Indexes of the benchmark's slices."""
    for items in slices(benchmark, limit):
        yield Index(items)


def contaminated(docs: DataFrame, benchmark: DataFrame, limit: int = SLICE) -> DataFrame:
    """doc_id, item_id, start, end (code points of the document), edits. A slice's hits are written before the next slice is read; the last one's are a plan."""
    d, out, last = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None, None
    for items in slices(benchmark, limit):
        if last is not None:
            last = keep(last, "hits")
            out = last if out is None else out.unionByName(last)
        last = d.mapInPandas(released(_search(items)), "doc_id long, item_id long, start long, end long, edits long")
    return last if out is None else out.unionByName(last)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, limit: int = SLICE) -> DataFrame:
    """The documents without a hit; the same columns. What a slice leaves is written before the next slice is read."""
    out, schema = None, docs.schema
    for items in slices(benchmark, limit):

        def run(batches, items=items):
            index = indexed(items)
            for pdf in batches:
                texts, ok = pdf["text"].tolist(), np.ones(len(pdf), bool)
                for a, b in chunks(texts, CHUNK):
                    ok[[a + r for r, *_ in find(index, texts[a:b])]] = False
                yield pdf[ok]

        out = (docs if out is None else keep(out, "clean")).mapInPandas(released(run), schema)
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
