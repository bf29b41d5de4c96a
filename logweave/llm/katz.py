"""Language-model scoring: a Katz back-off model of any order, counted and evaluated where its n-grams meet.

Tokens are words (A-Z lower-cased) and one end per document; a document starts
from one begin mark, so its first words have shorter histories. Counts cover every
training document. An n-gram seen at least ``min_count`` times keeps a Good-Turing
discounted share, by counts of counts of its order; the rest of a history's mass goes
to the back-off, exactly normalised against the next lower order. Unigrams are
(c + 0.5) / (N + 0.5 (V + 1)), which sum to 1 over the V known words and one unknown.
h' is h without its first word:

    P(w | h) = d(c) c / C(h)      if the n-gram is kept, else alpha(h) P(w | h')

All histories of a token, of every order, end in the word before it. So tokens are dealt
out by that word, training and scored ones together, and a bucket has all that P takes
but the counts of words; those are sent to the buckets that need them. What a document's
tokens add up to goes back by chunk. No table of n-grams is written: it would take
several times the disk of the texts. Steps:

1. ``fit``: counts of words and n-grams, by key, for N, V and counts of counts.
2. ``_pack_routes``, ``_sum_routes``: each word's count, for each bucket that has the word.
3. ``_pack_tokens``, ``_score_tokens``: tokens meet, a slice of the buckets at a time, so
   that shuffle files hold one slice.

Each chunk of documents sends a key once to a bucket. A word with more than a bucket's
share of the training tokens is hot: its tokens are dealt out by the two words before
them, and the counts and sums of its bigrams come with the words' counts. At most HOT
words are, the most frequent, which bounds what is sent along with tasks.

Defined results: null and blank texts have one token, the end; with no training
document every word is unknown (N = 0, V = 0); rows that repeat get equal scores;
a null doc_id counts as training. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets, discard, input_bytes, keep, released, table
from .vec import chunks, mix, word_arrays

MIN_COUNT = 2
#: What the registered query uses: trigrams, and n-grams seen once are kept.
ORDER, LEAST = 3, 1
GT_MAX = 5
#: Characters of a chunk, and of what is split into words at once. A batch of texts has 8 MB.
CHUNK, PIECE = 1 << 23, 1 << 21
#: Bytes of input a bucket; slices of the buckets, bytes of input from which there are slices, and from which there is one more.
BUCKET_BYTES, SLICES, SLICE_BYTES, MORE_BYTES = 4 << 20, 3, 32 << 20, 1 << 30
#: Parts of a bucket whose probabilities are worked out one after the other.
PARTS = 8
#: Most hot words (16 bits hold their numbers), and the fewest tokens of one.
HOT, HOT_TOKENS = 1 << 14, 1 << 14
_U = np.uint64
END, BEGIN = _U(0x7D3A5C1F9B2E4D61), _U(0x1B9F3E5D7C2A4861)
_K1, _K2 = _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25)
#: Within a bucket, words are told apart by these bits of their hash; n-grams by all 64.
_BITS = _U(48)
_LOW = (_U(1) << _BITS) - _U(1)


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end per text, first token of each text with the end last)."""
    hashes, firsts, n = [], [], 0
    for a, b in chunks(texts, PIECE):
        h, first, *_ = word_arrays(texts[a:b], lower=True)
        hashes.append(h)
        firsts.append(first[:-1] + n)
        n += len(h)
    h, first = np.concatenate(hashes), np.append(np.concatenate(firsts), n)
    at = first + np.arange(len(first))
    out = np.full(len(h) + len(texts), END, np.uint64)
    mask = np.ones(len(out), bool)
    mask[at[1:] - 1] = False
    out[mask] = h
    return out, at


def bigram_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(h * _K1) + w * _K2)


def histories(t: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of each token's histories of 1 to order - 1 words, the begin mark among them; 0 where the document's start cuts one off."""
    pos = np.arange(len(t)) - np.repeat(at[:-1], np.diff(at))
    before = np.roll(t, 1)
    before[at[:-1]] = BEGIN
    out, k = [before], before
    for n in range(2, order):
        k = bigram_key(np.roll(k, 1), before)
        out.append(np.where(pos >= n - 1, k, _U(0)))
    return out


def bucket_of(x: np.ndarray, n: int) -> np.ndarray:
    return (mix(x) % _U(n)).astype(np.int64)


def _pack_sorted(x: np.ndarray) -> bytes:
    """Differences of sorted keys, the halves and quarters of each apart: in a bucket that is a range of keys, the last are nearly all 0 and compress."""
    d = np.diff(x, prepend=_U(0))
    return d.astype(np.uint32).tobytes() + (d >> _U(32)).astype(np.uint16).tobytes() + (d >> _U(48)).astype(np.uint16).tobytes()


def _sorted(b: bytes) -> np.ndarray:
    n = len(b) // 8
    return np.cumsum(_keys(b[: 6 * n]) | np.frombuffer(b, np.uint16, n, 6 * n).astype(np.uint64) << _BITS, dtype=np.uint64)


def _pack_keys(x: np.ndarray) -> bytes:
    return x.astype(np.uint32).tobytes() + ((x & _LOW) >> _U(32)).astype(np.uint16).tobytes()


def _keys(b: bytes) -> np.ndarray:
    n = len(b) // 6
    return np.frombuffer(b, np.uint32, n).astype(np.uint64) | np.frombuffer(b, np.uint16, n, 4 * n).astype(np.uint64) << _U(32)


def _pack_ints(x: np.ndarray) -> bytes:
    """In the fewest bytes a number that hold the largest; the first byte tells how many."""
    most = int(x.max()) if len(x) else 0
    size = next(s for s in (1, 2, 4, 8) if most < 1 << 8 * s)
    return bytes([size]) + x.astype(f"u{size}").tobytes()


def _ints(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"u{b[0]}", offset=1).astype(np.int64)


def _pack(*blobs: bytes) -> bytes:
    return np.array([len(blobs), *map(len, blobs)], np.uint32).tobytes() + b"".join(blobs)


def _blobs(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    ends = np.cumsum([4 * (n + 1), *np.frombuffer(data, np.uint32, n, 4)])
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.uint64)


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where one of the columns changes; the first row included."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for x in sorted_columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


_PACKED = "bucket int, data binary"


def _pack_counts(nb: int, order: int):
    """Keys and counts of the words and of the n-grams of each order; the buckets of order m are ranges of keys and begin at m * nb."""
    ends = np.array([(j << 64) // nb for j in range(1, nb)], np.uint64)

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in chunks(texts, CHUNK):
                t, at = tokens(texts[a:b])
                rows = []
                for m, h in enumerate([None, *histories(t, at, order)], 1):
                    k, n = np.unique(t if m == 1 else bigram_key(h, t)[h != 0], return_counts=True)
                    cut = [0, *np.searchsorted(k, ends), len(k)]
                    rows += [(m * nb + j, _pack(_pack_sorted(k[x:y]), _pack_ints(n[x:y]))) for j, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if x < y]
                yield pd.DataFrame(rows, columns=["bucket", "data"])

    return run


def _count(nb: int, most: int, frequent: int):
    """Rows (order, kind, x, c): kind 0 has the number of keys seen c times at x = c up to ``most`` + 1, kind 1 the sum of counts and kind 2 the number of keys, kind 3 the count of frequent words."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_blobs(x) for x in pdf["data"]]
        k, n = np.concatenate([_sorted(x) for x, _ in parts]), np.concatenate([_ints(x) for _, x in parts])
        o = np.argsort(k)
        first = _starts(k[o])
        c = np.add.reduceat(n[o], first)
        m = int(pdf["bucket"].iloc[0]) // nb
        few = np.bincount(np.minimum(c, most + 2), minlength=most + 3)
        rows = [(m, 0, r, int(few[r])) for r in range(1, most + 2)] + [(m, 1, 0, int(c.sum())), (m, 2, 0, len(c))]
        if m == 1:
            i = np.flatnonzero(c >= frequent)
            rows += [(m, 3, int(x), int(y)) for x, y in zip(k[o][first][i] & _LOW, c[i], strict=True)]
        return pd.DataFrame(rows, columns=["m", "kind", "x", "c"]).astype({"m": "int32", "kind": "int32"})

    return run


def discounts(of: dict[int, int], least: int = MIN_COUNT, most: int = GT_MAX) -> dict[int, float]:
    """Katz's Good-Turing discounts for counts up to ``most``; 1 above. Where counts of counts give none in (0, 1), (r - 0.5) / r."""
    n1 = of.get(1, 0)
    tail = (most + 1) * of.get(most + 1, 0) / n1 if n1 else 0
    out = {}
    for r in range(least, most + 1):
        nr, nx = of.get(r, 0), of.get(r + 1, 0)
        d = ((r + 1) * nx / (nr * r) - tail) / (1 - tail) if nr and tail < 1 else 0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(c: np.ndarray, of: dict[int, float], least: int) -> np.ndarray:
    """d(c) c of n-grams that are kept, 0 of others."""
    factor = np.ones(GT_MAX + 2)
    for r, d in of.items():
        factor[r] = d
    factor[:least] = 0
    return factor[np.minimum(c, GT_MAX + 1)] * c if least <= GT_MAX + 1 else np.where(c >= least, c, 0.0)


class KatzModel:
    """The training texts, totals, discounts per order from 2, and frequent words (low bits of the hash) with their counts, the most frequent first."""

    def __init__(self, texts: DataFrame, order: int, least: int, n: int, v: int, discounts: list[dict], frequent: list[tuple[int, int]]):
        self.texts, self.order, self.least, self.n, self.v, self.discounts, self.frequent = texts, order, least, n, v, discounts, frequent


def parts(docs: DataFrame) -> int:
    """Buckets: a bucket goes through memory as a whole, so their number follows the size of the tables read, or else the number of input splits."""
    size = input_bytes(docs)
    return max(64, -(-size // BUCKET_BYTES)) if size else buckets(docs, 2)


def fit(docs: DataFrame, min_count: int = MIN_COUNT, order: int = 2) -> KatzModel:
    """docs(text): the training documents."""
    texts = docs.select("text")
    nb = parts(texts)
    packed = texts.mapInPandas(released(_pack_counts(nb, order)), _PACKED)
    counted = keep(packed.groupBy("bucket").applyInPandas(_count(nb, GT_MAX, HOT_TOKENS), "m int, kind int, x long, c long"), "katz-counts")
    few = {(m, kind, x): c for m, kind, x, c in counted.where("kind < 3").groupBy("m", "kind", "x").agg(F.sum("c")).collect()}
    frequent = [(x, c) for x, c in counted.where("kind = 3").orderBy(F.desc("c"), "x").select("x", "c").limit(HOT).collect()]
    discard(counted)
    used = [discounts({r: few.get((m, 0, r), 0) for r in range(1, GT_MAX + 2)}, min_count) for m in range(2, order + 1)]
    return KatzModel(texts, order, min_count, few.get((1, 1, 0), 0), few.get((1, 2, 0), 0), used, frequent)


def hot_words(model: KatzModel, nb: int) -> np.ndarray:
    """Sorted low bits of the words before a token that are hot; the begin mark stands as often as the end."""
    end = int(END & _LOW)
    return np.array(sorted(int(BEGIN & _LOW) if x == end else x for x, c in model.frequent if c > max(HOT_TOKENS, model.n / nb)), np.uint64)


def _find(keys: np.ndarray, sorted_keys: np.ndarray):
    i = np.searchsorted(sorted_keys, keys)
    i[i == len(sorted_keys)] = 0
    return i, (sorted_keys[i] == keys if len(sorted_keys) else np.zeros(len(keys), bool))


def _hot_number(before: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """From 1 for hot words, 0 for others."""
    if not len(hot):
        return np.zeros(len(before), np.uint64)
    i, hit = _find(before & _LOW, hot)
    return np.where(hit, i + 1, 0).astype(np.uint64)


def _deal(t: np.ndarray, h: list[np.ndarray], number: np.ndarray, nb: int) -> np.ndarray:
    """Bucket of each token: by the word before it; after a hot word by the two before it, or by the token itself where there are no two or none count."""
    key = h[0]
    if number.any():
        two = np.where(h[1] != 0, h[1], t) if len(h) > 1 else t
        key = np.where(number > 0, two, key)
    return bucket_of(key, nb)


def _pack_routes(nb: int, order: int, hot: np.ndarray):
    """To a word's bucket: the word, and it after each hot word (an item's high bits have the hot word's number), with counts in training and the buckets that need it."""

    def run(batches):
        for pdf in batches:
            texts, train = pdf["text"].tolist(), (pdf["flags"].to_numpy(np.int64) & 1).astype(bool)
            for a, b in chunks(texts, CHUNK):
                t, at = tokens(texts[a:b])
                h = histories(t, at, order)
                number = _hot_number(h[0], hot)
                to = _deal(t, h, number, nb).astype(np.uint64)
                seen = np.repeat(train[a:b], np.diff(at))
                item, own = t & _LOW, bucket_of(t, nb)
                if i := np.flatnonzero(number).tolist():
                    i = np.array(i)
                    item, own, to, seen = np.append(item, item[i] | number[i] << _BITS), np.append(own, own[i]), np.append(to, to[i]), np.append(seen, seen[i])
                rank = _ranks(item)
                pair = rank << _U(32) | to
                o = np.argsort(pair)
                o = o[_starts(pair[o])]  # a row for each item and bucket
                o = o[np.argsort(own[o].astype(np.uint16) if nb < 65536 else own[o], kind="stable")]
                count = np.bincount(rank.astype(np.int64), seen).astype(np.int64)
                own, item, to, rank = own[o], item[o], to[o], rank[o].astype(np.int64)
                first = _starts(own, rank)
                need = _lengths(first, len(own))
                cut = _starts(own[first])
                rows = []
                for x, y in zip(cut, [*cut[1:], len(first)], strict=True):
                    i = first[x:y]
                    end = first[y] if y < len(first) else len(own)
                    rows.append((int(own[i[0]]), _pack(_pack_keys(item[i]), _pack_ints(item[i] >> _BITS), _pack_ints(count[rank[i]]), _pack_ints(need[x:y]), _pack_ints(to[i[0] : end]))))
                yield pd.DataFrame(rows, columns=["bucket", "data"])

    return run


_ROUTES = "bucket int, data binary, hot int, c long, dc double, p double"


def _sum_routes(of: dict[int, float], least: int):
    """A row for each bucket that needs words, with their counts; a row for each hot word, with sums over its bigrams here (p: of counts and a half)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_blobs(x) for x in pdf["data"]]
        item = np.concatenate([_keys(x[0]) | _ints(x[1]).astype(np.uint64) << _BITS for x in parts])
        n, need, to = (np.concatenate([_ints(x[i]) for x in parts]) for i in (2, 3, 4))
        u, at = np.unique(item, return_inverse=True)
        c = np.bincount(at, n).astype(np.int64)
        pair = np.unique(to << 32 | np.repeat(at, need), return_counts=True)[0]
        to, at = pair >> 32, pair & 0xFFFFFFFF
        cut = _starts(to)
        rows = []
        for x, y in zip(cut, [*cut[1:], len(to)], strict=True):
            i = at[x:y]
            rows.append((int(to[x]), _pack(_pack_keys(u[i]), _pack_ints(u[i] >> _BITS), _pack_ints(c[i])), 0, 0, 0.0, 0.0))
        number = (u >> _BITS).astype(np.int64)
        if i := np.flatnonzero(number).tolist():
            i = np.array(i)
            of_word = c[np.searchsorted(u, u[i] & _LOW)] + 0.5
            own = c[i], discounted(c[i], of, least), np.where(c[i] >= least, of_word, 0.0)
            sums = [np.bincount(number[i], x) for x in own]
            rows += [(-1, b"", int(k), int(sums[0][k]), float(sums[1][k]), float(sums[2][k])) for k in np.unique(number[i], return_counts=True)[0]]
        return pd.DataFrame(rows, columns=["bucket", "data", "hot", "c", "dc", "p"]).astype({"bucket": "int32", "hot": "int32"})

    return run


def _pack_tokens(nb: int, order: int, hot: np.ndarray, part: int, parts_: int):
    """Tokens of the buckets of one slice, nested: word before, token, longer histories, row of the chunk.

    Each level has its distinct keys and how many of the next they hold. The chunk's
    first bucket also gets the documents' keys.
    """

    def run(batches):
        for pdf in batches:
            texts, ids, flags = pdf["text"].tolist(), pdf["key"].to_numpy(np.int64), pdf["flags"].to_numpy(np.uint8)
            for a, b in chunks(texts, CHUNK):
                t, at = tokens(texts[a:b])
                h = histories(t, at, order)
                to = _deal(t, h, _hot_number(h[0], hot), nb)
                i = np.flatnonzero(to % parts_ == part)
                if not len(i):
                    continue
                # the lowest bit tells whether the document is a training document
                row = np.repeat(np.arange(b - a) << 1 | flags[a:b] & 1, np.diff(at))[i].astype(np.uint64)
                to, levels = to[i], [h[0][i] & _LOW, t[i] & _LOW, *(x[i] for x in h[1:])]
                rank = _ranks(to.astype(np.uint64) << _BITS | levels[0]) if nb < 65536 else _ranks(_ranks(levels[0]) | to.astype(np.uint64) << _U(32))
                for x in levels[1:]:
                    rank = _ranks(rank << _U(32) | _ranks(x))
                o = np.argsort(rank << _U(32) | row)
                to, row, rank, levels = to[o], row[o], rank[o], [x[o] for x in levels]
                starts = [_starts(to, *levels[: j + 1]) for j in range(len(levels))]
                starts.append(_starts(rank, row))
                inner = [_lengths(np.searchsorted(y, x), len(y)) for x, y in zip(starts[:-1], starts[1:], strict=True)]
                count = _lengths(starts[-1], len(row))
                cut = _starts(to)
                edges = [np.searchsorted(x, np.append(cut, len(to))) for x in starts]
                own, marks = ids[a:b].tobytes(), flags[a:b].tobytes()
                chunk = int.from_bytes(blake2b(own + marks, digest_size=8).digest(), "little", signed=True)
                rows = []
                for j in range(len(cut)):
                    blobs = []
                    for m, (s, e, keys, n) in enumerate(zip(starts[:-1], edges[:-1], levels, inner, strict=True)):
                        x, y = e[j], e[j + 1]
                        blobs += [_pack_keys(keys[s[x:y]]) if m < 2 else keys[s[x:y]].tobytes(), _pack_ints(n[x:y])]
                    x, y = edges[-1][j], edges[-1][j + 1]
                    blobs += [_pack_ints(row[starts[-1][x:y]]), _pack_ints(count[x:y]), *((own, marks) if j == 0 else (b"", b""))]
                    rows.append((int(to[cut[j]]), chunk, _pack(*blobs)))
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "data"])

    return run


def _backed_off(h: np.ndarray, w: np.ndarray, n: np.ndarray, lower: np.ndarray, of: dict[int, float], least: int, given=None) -> np.ndarray:
    """P of each n-gram, h and w, by its counts n (a row may repeat with others' counts) and P of the next lower order.

    given: (rows whose counts come from elsewhere, their counts, and C(h), discounted sum and sum of lower P of their h).
    """
    heads, of_row = np.unique(h, return_inverse=True)
    _, gram = np.unique(bigram_key(h, w), return_inverse=True)
    c = np.bincount(gram, n).astype(np.int64)
    at = np.empty(len(c), np.int64)
    at[gram] = np.arange(len(gram))
    head, low = of_row[at], lower[at]
    if given:
        c[gram[given[0]]] = given[1]
    dc = discounted(c, of, least)
    total, kept, mass = (np.bincount(head, x, len(heads)) for x in (c, dc, np.where(dc > 0, low, 0.0)))
    if given:
        for x, y in zip((total, kept, mass), given[2:], strict=True):
            x[of_row[given[0]]] = y
    some = kept > 0
    share = np.divide(kept, total, out=np.zeros(len(heads)), where=some)
    # a history whose discounted shares leave nothing keeps a floor, and its shares are scaled to what is left
    left = np.maximum(1 - share, 1e-6)
    alpha = np.where(some, left / np.maximum(1 - mass, 1e-12), 1.0)
    scale = np.divide(1 - left, kept, out=np.zeros(len(heads)), where=some)  # (1 - left) / share / C(h)
    return np.where(dc > 0, scale[head] * dc, alpha[head] * low)[gram]


_SUMS = "chunk long, ids binary, flags binary, row binary, n binary, known binary, ends binary, base binary, score binary"


def _score_tokens(n_all: int, v: int, of: list[dict], least: int, hot: np.ndarray, hot_sums: np.ndarray):
    floor = n_all + 0.5 * (v + 1)
    order = len(of) + 1

    def run(packed: pd.DataFrame, routes: pd.DataFrame) -> pd.DataFrame:
        levels: list[list] = [[] for _ in range(order)]
        entries, counts, grams, seen, heads = [], [], [], [], []
        offset = 0
        for chunk, data in zip(packed["chunk"], packed["data"], strict=True):
            *nested, row, count, ids, flags = _blobs(data)
            keys, inner = [_keys(x) if m < 2 else np.frombuffer(x, np.uint64) for m, x in enumerate(nested[::2])], [_ints(x) for x in nested[1::2]]
            for j, x in enumerate(keys):
                # each key as often as there are innermost keys below it
                levels[j].append(reduce(np.repeat, inner[j:-1], x))
            grams.append(inner[-1].astype(np.int32))
            row = _ints(row)
            seen.append((row & 1).astype(np.int8))
            entries.append(((row >> 1) + offset).astype(np.int32))
            counts.append(_ints(count).astype(np.int32))
            end = int(entries[-1].max()) + 1
            heads.append((chunk, offset, end, ids, flags))
            offset = end
        before, w, *longer = (np.concatenate(levels.pop(0)) for _ in range(order))
        grams, row, count, seen = map(np.concatenate, (grams, entries, counts, seen))
        del entries, counts
        n = np.add.reduceat(count * seen, np.cumsum(grams) - grams)
        del seen
        parts = [_blobs(x) for x in routes["data"]]
        item = np.concatenate([_keys(x[0]) | _ints(x[1]).astype(np.uint64) << _BITS for x in parts])
        c_item = np.concatenate([_ints(x[2]) for x in parts])
        o = np.argsort(item)
        item, c_item = item[o], c_item[o]
        del parts, o
        # a part of the words before at a time: what P takes is the most that a worker holds
        which = (mix(before) % _U(PARTS)).astype(np.uint8)
        tokens_ = np.bincount(row, count, offset)
        known, ends, base, total = np.zeros((4, offset))
        for part in range(PARTS):
            own = np.flatnonzero(which == part)
            if not len(own):
                continue
            b, t, m = before[own], w[own], n[own]
            c = c_item[np.searchsorted(item, t)]
            p1 = (c + 0.5) / floor
            number = _hot_number(b, hot)
            i = np.flatnonzero(number)
            given = (i, c_item[np.searchsorted(item, t[i] | number[i] << _BITS)], *(hot_sums[number[i].astype(np.int64), j] for j in range(3))) if len(i) else None
            p = _backed_off(b, t, m, p1, of[0], least, given)
            del given, number, b
            for h, d in zip(longer, of[1:], strict=True):
                h = h[own]
                i = np.flatnonzero(h)
                if len(i):
                    p[i] = _backed_off(h[i], t[i], m[i], p[i], d, least)
            e = np.flatnonzero(np.repeat(which == part, grams))
            r, times, held_by = row[e], count[e], grams[own]
            for to, x in ((known, c > 0), (ends, t == END & _LOW), (base, np.log10(p1)), (total, np.log10(p))):
                to += np.bincount(r, np.repeat(x, held_by) * times, offset)
        out = []
        for chunk, x, y, ids, flags in heads:
            i = x + np.flatnonzero(tokens_[x:y])
            out.append((chunk, ids, flags, _pack_ints(i - x), *(_pack_ints(z[i].astype(np.int64)) for z in (tokens_, known, ends)), base[i].tobytes(), total[i].tobytes()))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _SUMS.split(", ")])

    return run


def _sum_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of a chunk's scored documents over its buckets; equal chunks add up."""
    given = pdf["ids"].map(len) > 0
    ids, flags = (np.frombuffer(pdf[x][given].iloc[0], kind) for x, kind in (("ids", np.int64), ("flags", np.uint8)))
    row = np.concatenate([_ints(x) for x in pdf["row"]])
    out = {"key": ids}
    for name in ("n", "known", "ends", "base", "score"):
        x = np.concatenate([np.frombuffer(y, np.float64) if name in ("base", "score") else _ints(y) for y in pdf[name]])
        out[name] = np.bincount(row, x, len(ids)).astype(np.float64 if name in ("base", "score") else np.int64)
    return pd.DataFrame(out)[(flags & 2) > 0]


def score(docs: DataFrame, model: KatzModel, training: Column | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, n_known, base_score, score.

    training: which of docs the model was fitted on; then the training texts are read with them. If None, they are read apart.
    """
    d = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text", (F.lit(2) + (F.lit(0) if training is None else F.coalesce(training, F.lit(False)).cast("int"))).alias("flags"))
    rows = d.select("key", "text", "flags")
    if training is None:
        rows = rows.unionByName(model.texts.select(F.lit(0).cast("long").alias("key"), "text", F.lit(1).alias("flags")))
    nb, size = parts(rows), input_bytes(rows)
    slices = SLICES + (size is not None and size >= MORE_BYTES) if size is None or size >= SLICE_BYTES else 1
    hot = hot_words(model, nb)
    routes = rows.select("text", "flags").mapInPandas(released(_pack_routes(nb, model.order, hot)), _PACKED)
    routes = keep(routes.groupBy("bucket").applyInPandas(_sum_routes(model.discounts[0], model.least), _ROUTES), "katz-routes")
    hot_sums = np.zeros((len(hot) + 1, 3))
    if len(hot):
        for k, *sums in routes.where("bucket < 0").groupBy("hot").agg(F.sum("c"), F.sum("dc"), F.sum("p")).collect():
            hot_sums[k] = sums
        hot_sums[:, 2] /= model.n + 0.5 * (model.v + 1)
    kept = []
    for part in range(slices):
        packed = rows.mapInPandas(released(_pack_tokens(nb, model.order, hot, part, slices)), "bucket int, chunk long, data binary").groupBy("bucket")
        own = routes.where((F.col("bucket") >= 0) & (F.col("bucket") % slices == part)).select("bucket", "data").groupBy("bucket")
        run = _score_tokens(model.n, model.v, model.discounts, model.least, hot, hot_sums)
        sums = packed.cogroup(own).applyInPandas(run, _SUMS).groupBy("chunk").applyInPandas(_sum_chunk, "key long, n long, known long, ends long, base double, score double")
        kept.append(keep(sums, "katz-sums"))
    discard(routes)
    sums = reduce(DataFrame.unionByName, kept).groupBy("key").agg(*(F.sum(x).alias(x) for x in ("n", "known", "base", "score", "ends")))
    # rows that repeat a whole row share a key; "ends" is their number
    return d.select("doc_id", "key").join(sums, "key").select(
        "doc_id",
        (F.col("n") / F.col("ends")).cast("long").alias("n_tokens"),
        (F.col("known") / F.col("ends")).cast("long").alias("n_known"),
        (F.col("base") / F.col("ends")).alias("base_score"),
        (F.col("score") / F.col("ends")).alias("score"),
    )


def held(doc_id, mod: int, rest: int):
    """crc32 of the doc_id as text falls in the held-out class; null ids do not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = ~held("doc_id", 5, 1)
    model = fit(docs.where(training), LEAST, ORDER)
    out = score(docs, model, training)
    return out.select("doc_id", held("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
