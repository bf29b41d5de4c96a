"""Byte-level BPE over Arrow batches: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Pre-tokenisation never runs a regex. Each code point becomes a symbol (letter,
number, space, other white space, apostrophe, other, and the few letters that
matter in contractions; white space and letters look one code point ahead). A small
automaton reads symbols; its transition functions form a finite monoid, so the
state before every code point comes from an associative scan (doubling) over
function ids with one composition table. A second table says whether a boundary
stands before a code point, given state and symbol.

Defined results: null and empty texts have no ids; every whole text is encoded
without special tokens; decoding the ids gives the UTF-8 bytes of the text back.
Extra columns pass through; one very long text is handled as one array, never cut.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, table
from .vec import chunks

MAX_CACHE = 1 << 18
_CODE = 0x110000

# symbols
L, N, O, AP, SP, SPX, WS, WSX, ONE, TWO, END = range(11)
# L other letter; SPX and WSX: last white space before something else; ONE: s t m d; TWO: r, v before e or l before l
S_START, S_L, S_N, S_O, S_A, S_P, S_C, S_SP, S_W = range(9)
_TO_L = {S_P: S_C}
#: next state by symbol, then by state (default first)
_NEXT = {
    L: (S_L, _TO_L), ONE: (S_L, {S_A: S_C, S_P: S_C}), TWO: (S_L, {S_A: S_P, S_P: S_C}), N: (S_N, {}), O: (S_O, {}),
    AP: (S_A, {S_O: S_O, S_A: S_O, S_SP: S_O}), SP: (S_W, {}), SPX: (S_SP, {}), WS: (S_W, {}), WSX: (S_W, {}), END: (S_START, {}),
}


def _boundary(state: int, sym: int) -> bool:
    if state == S_START or sym == END:
        return True
    letter = sym in (L, ONE, TWO)
    if state == S_SP:
        return sym in (SP, SPX, WS, WSX)
    if state == S_P:
        return False
    if state == S_A:
        return not (sym in (ONE, TWO, O, AP))
    if state == S_W:
        return sym not in (SP, WS)  # a last white space and anything else start anew
    return not (state == S_L and letter or state == S_N and sym == N or state == S_O and sym in (O, AP))


def _tables():
    k = 9
    gens = [tuple(_NEXT[s][1].get(q, _NEXT[s][0]) for q in range(k)) for s in range(11)]
    ids = {f: i for i, f in enumerate(dict.fromkeys(gens))}
    todo = list(ids)
    while todo:  # closure under composition
        f = todo.pop()
        for g in gens:
            for h in (tuple(g[f[q]] for q in range(k)), tuple(f[g[q]] for q in range(k))):
                if h not in ids:
                    ids[h] = len(ids)
                    todo.append(h)
    fs = list(ids)
    comp = np.array([[ids[tuple(g[f[q]] for q in range(k))] for g in fs] for f in fs], np.uint16)  # first f, then g
    const = np.array([len(set(f)) == 1 for f in fs])
    value = np.array([f[S_START] for f in fs], np.uint8)
    bound = np.array([[_boundary(q, s) for s in range(11)] for q in range(k)])
    return np.array([ids[g] for g in gens], np.uint16), comp, const, value, bound


_SYM, _COMP, _CONST, _VALUE, _BOUND = _tables()
_CLASS: list[np.ndarray] = []
#: The white space of Unicode, and the letters and numbers that Unicode 16 added.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


def _classes() -> np.ndarray:
    """Symbol of each code point, by the Unicode 16 categories that the tokenizer library follows."""
    if not _CLASS:
        kinds = {"L": L, "N": N}
        out = np.array([kinds.get(unicodedata.category(chr(c))[0], O) for c in range(_CODE)], np.uint8)
        if unicodedata.unidata_version < "16":
            for sym, ranges in ((L, NEW_LETTERS), (N, NEW_NUMBERS)):
                for a, b in ranges:
                    out[a : b + 1] = sym
        out[WHITE] = WS
        out[ord(" ")], out[ord("'")] = SP, AP
        out[[ord(c) for c in "stmd"]] = ONE
        _CLASS.append(out)
    return _CLASS[0]


def boundaries(code: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Token starts in a run of code points; ``ends`` marks the code points that only close a text."""
    sym = _classes()[code]
    sym[ends] = END
    nxt, ahead = np.append(code[1:], 0), np.append(sym[1:], END)
    two = (((code == ord("r")) | (code == ord("v"))) & (nxt == ord("e")) | (code == ord("l")) & (nxt == ord("l"))) & (ahead != END)
    sym[two] = TWO
    solid = (ahead <= AP) | (ahead == ONE) | (ahead == TWO)
    sym[(sym == SP) & solid] = SPX
    sym[(sym == WS) & solid] = WSX
    f = _SYM[sym]
    d = 1
    while d < len(f) and not _CONST[f[d - 1 :]].all():  # inclusive scan; functions soon become constant
        g = f.copy()
        g[d:] = _COMP[f[:-d], f[d:]]
        f, d = g, 2 * d
    before = np.empty(len(f), np.uint8)
    before[0] = S_START
    before[1:] = _VALUE[f[:-1]]
    return np.flatnonzero(_BOUND[before, sym])


class Codec:
    """Ranks of a byte-level vocabulary, with a bounded cache of merged slices."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
        n = max(self.ranks.values()) + 1
        vocab = [b""] * n
        for k, v in self.ranks.items():
            vocab[v] = k
        self.sizes = np.array([len(x) for x in vocab], np.int64)
        self.flat = np.frombuffer(b"".join(vocab), np.uint8)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.cache: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> bytes:
        """Ids of one slice, packed; lowest rank first, leftmost among equals."""
        r = self.ranks
        if piece in r:
            return r[piece].to_bytes(4, "little")
        n = len(piece)
        if n <= 48:
            parts = [piece[i : i + 1] for i in range(n)]
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    x = r.get(parts[i] + parts[i + 1])
                    if x is not None and (best is None or x < best):
                        best, at = x, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return b"".join(r[p].to_bytes(4, "little") for p in parts)
        right, left, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in r]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or not alive[i] or end[j] != e:
                continue
            alive[j], end[i], right[i] = False, end[j], right[j]
            if right[i] < n:
                left[right[i]] = i
                if (x := r.get(piece[i : end[right[i]]])) is not None:
                    heapq.heappush(heap, (x, i, end[right[i]]))
            if left[i] >= 0 and (x := r.get(piece[left[i] : end[i]])) is not None:
                heapq.heappush(heap, (x, left[i], end[i]))
        out, i = [], 0
        while i < n:
            out.append(r[piece[i : end[i]]].to_bytes(4, "little"))
            i = right[i]
        return b"".join(out)

    def encode(self, texts: list) -> list[bytes]:
        """Packed little-endian ids of each text."""
        clean = [t if isinstance(t, str) else "" for t in texts]
        joined = "\n".join([*clean, ""])  # each text is closed by one code point that is not part of it
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.array([len(t) for t in clean], np.int64)
        close = np.cumsum(lens + 1) - 1
        starts = boundaries(code, close)
        raw = joined.encode("utf-8", "replace")
        if len(raw) != len(code):
            width = np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF).astype(np.int64))
            cuts = width[starts - 1]
            cuts[starts == 0] = 0
        else:
            cuts = starts
        per = np.searchsorted(starts, close).tolist()  # the slice that closes each text
        cuts = cuts.tolist()
        cache, merge, out, i = self.cache, self.merge, [], 0
        for j in per:
            ids = []
            b = cuts[i]
            for e in cuts[i + 1 : j + 1]:
                s = raw[b:e]
                b = e
                x = cache.get(s)
                if x is None:
                    if len(cache) >= MAX_CACHE:
                        cache.clear()
                    x = cache[s] = merge(s)
                ids.append(x)
            out.append(b"".join(ids))
            i = j + 1
        return out

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset at which each token starts, and the end of the last."""
        n = self.sizes[np.frombuffer(ids, "<u4")]
        out = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=out[1:])
        return out

    def decode(self, ids: bytes, offsets: np.ndarray | None = None) -> bytes:
        """Bytes of packed ids: one gather from the flat vocabulary, placed by the tokens' offsets."""
        i = np.frombuffer(ids, "<u4")
        o = self.offsets(ids) if offsets is None else offsets
        where = np.repeat(self.at[i] - o[:-1], np.diff(o))
        return self.flat[where + np.arange(len(where))].tobytes()


_CODECS: dict[int, Codec] = {}


def codec(data: bytes) -> Codec:
    key = hash(data)
    if key not in _CODECS:
        _CODECS[key] = Codec(data)
    return _CODECS[key]


def vocabulary(path: str) -> bytes:
    """The rank file, read on the driver and shipped with the tasks; it must stay below 64 MB."""
    with open(path, "rb") as f:
        data = f.read((64 << 20) + 1)
    if len(data) > 64 << 20:
        raise ValueError("a rank file of over 64 MB is not shipped with tasks")
    return data


def encode(docs: DataFrame, path: str, column: str = "text", offsets: bool = True) -> DataFrame:
    """docs plus ``ids`` (binary, little-endian uint32) and ``offsets`` (binary, int64 byte starts, then the end)."""
    data = vocabulary(path)

    def run(batches):
        c = codec(data)
        for pdf in batches:
            texts, ids = pdf[column].tolist(), []
            for a, b in chunks(texts):
                ids += c.encode(texts[a:b])
            pdf["ids"] = ids
            if offsets:
                pdf["offsets"] = [c.offsets(x).tobytes() for x in ids]
            yield pdf

    extra = [T.StructField("ids", T.BinaryType())] + ([T.StructField("offsets", T.BinaryType())] if offsets else [])
    names = {"ids", "offsets"}
    docs = docs.drop(*(x for x in docs.columns if x in names))
    return docs.mapInPandas(released(run), T.StructType([*docs.schema.fields, *extra]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(ids, offsets if any, ...) plus ``decoded`` (binary)."""
    data = vocabulary(path)
    with_offsets = "offsets" in encoded.columns

    def run(batches):
        c = codec(data)
        for pdf in batches:
            o = [np.frombuffer(x, np.int64) for x in pdf["offsets"]] if with_offsets else [None] * len(pdf)
            pdf["decoded"] = [c.decode(x, y) for x, y in zip(pdf["ids"], o, strict=True)]
            yield pdf

    return encoded.mapInPandas(released(run), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def encode_decode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """docs plus ids, decoded, and n_tokens; both directions in one pass over the batches."""
    data = vocabulary(path)
    docs = docs.drop("ids", "decoded", "n_tokens")

    def run(batches):
        c = codec(data)
        for pdf in batches:
            texts, ids = pdf[column].tolist(), []
            for a, b in chunks(texts):
                ids += c.encode(texts[a:b])
            pdf["ids"], pdf["decoded"] = ids, [c.decode(x, c.offsets(x)) for x in ids]
            pdf["n_tokens"] = np.array([len(x) // 4 for x in ids], np.int64)
            yield pdf

    fields = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    return docs.mapInPandas(released(run), T.StructType([*docs.schema.fields, *fields]))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), default_vocabulary())
    return d.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
