"""Substring dedup by seed and extend: removes every word that a repeated passage covers.

Seed: winnowing picks, in each window of ``LENGTH`` words, the smallest hash of its
``ANCHOR``-word runs. Equal windows pick equal anchors, so any passage of ``LENGTH``
words that occurs twice shares an anchor at the same place; documents are joined on
anchors alone. Extend: around an anchor that met another, the fingerprints of the
windows it stands for are compared; windows that match and touch join into maximal
repeats, which go back to their documents as word spans.

Hot passages: a chunk of documents sends each window once, marked if the chunk
itself holds it again (those are settled on the spot), so a passage that a third of
all documents share costs one entry a chunk; no pairs are ever formed.

Defined results: null and blank texts have no words; texts below ``LENGTH`` words
lose nothing; rows that repeat a whole row count as separate documents (each repeats
the other); every occurrence is removed, the first included. Fingerprints have 64
bits. Extra columns pass through.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import input_bytes, keep, table
from .vec import chunks, runs, word_arrays

LENGTH = 35
ANCHOR = 10
CHUNK = 1 << 21
#: Text per bucket: a bucket goes through memory as a whole, so buckets and the tasks that hold them, about two in each, follow the size of the input.
BUCKET_BYTES = 4 << 20
_U = np.uint64


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    if len(a) < w:
        return a[:0]
    m, size = a, 1
    while 2 * size <= w:
        m, size = np.minimum(m[:-size], m[size:]), 2 * size
    return np.minimum(m[: len(a) - w + 1], m[w - size : len(a) - size + 1])


def _spans(row: np.ndarray, pos: np.ndarray, length: int):
    """Touching windows of a row (sorted by row, position) as word spans."""
    if not len(row):
        return row, pos, pos
    cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (pos[1:] > pos[:-1] + length)))
    last = np.append(cut[1:], len(row)) - 1
    return row[cut], pos[cut], pos[last] + length


def _seed(nb: int, length: int, anchor: int):
    def run(batches):
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["key"].to_numpy(np.int64)
            for a, b in chunks(texts, CHUNK):
                h, first, *_ = word_arrays(texts[a:b])
                window = runs(h, length)
                if not len(window):
                    continue
                row = np.repeat(np.arange(b - a), np.diff(first))
                j = np.flatnonzero(np.arange(length, len(h) + 1) <= first[row[: len(window)] + 1])
                if not len(j):
                    continue
                mark, window, row = sliding_min(runs(h, anchor), length - anchor + 1)[j], window[j] & ~_U(1), row[j]
                pos, own, rows = j - first[row], ids[a:b], []
                _, one, inv, n = np.unique(window, return_index=True, return_inverse=True, return_counts=True)
                again = n[inv] > 1
                r, s, e = _spans(row[again], pos[again], length)
                if len(r):
                    rows.append((int(own[0] % nb), True, b"", b"", own[r].tobytes(), s.astype(np.uint32).tobytes(), e.astype(np.uint32).tobytes()))
                i = np.sort(one)
                i = i[np.argsort(mark[i] % _U(nb), kind="stable")]
                to, w, row, pos, mark = (mark[i] % _U(nb)).astype(np.int64), window[i] | again[i], row[i], pos[i], mark[i]
                start = np.append(True, (mark[1:] != mark[:-1]) | (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1))
                at = np.flatnonzero(start)
                size = np.diff(np.append(at, len(w)))
                cut = np.flatnonzero(np.diff(to[at], prepend=-1))
                for x, y in zip(cut, np.append(cut[1:], len(at)), strict=True):
                    lo, hi = at[x], at[y] if y < len(at) else len(w)
                    rows.append((int(to[lo]), False, w[lo:hi].tobytes(), mark[at[x:y]].tobytes(), own[row[at[x:y]]].tobytes(), pos[at[x:y]].astype(np.uint32).tobytes(), size[x:y].astype(np.uint32).tobytes()))
                yield pd.DataFrame(rows, columns=["bucket", "settled", "windows", "marks", "keys", "starts", "n"])

    return run


_SEEDS = "bucket int, settled boolean, windows binary, marks binary, keys binary, starts binary, n binary"


def _extend(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        get = lambda d, c, kind: np.concatenate([np.frombuffer(x, kind) for x in d[c]]) if len(d) else np.zeros(0, kind)
        done, open_ = pdf[pdf["settled"]], pdf[~pdf["settled"]]
        out = [pd.DataFrame({"key": get(done, "keys", np.int64), "start": get(done, "starts", np.uint32).astype(np.int64), "end": get(done, "n", np.uint32).astype(np.int64)})]
        if len(open_):
            marks, keys, starts, n = get(open_, "marks", np.uint64), get(open_, "keys", np.int64), get(open_, "starts", np.uint32).astype(np.int64), get(open_, "n", np.uint32).astype(np.int64)
            w = get(open_, "windows", np.uint64)
            _, inv, count = np.unique(marks, return_inverse=True, return_counts=True)
            met = count[inv] > 1
            at = np.cumsum(n) - n
            run_of = np.repeat(np.arange(len(n))[met], n[met])
            pos = np.arange(len(run_of)) - np.repeat(np.cumsum(n[met]) - n[met], n[met])
            w = w[at[run_of] + pos]
            _, inv, count = np.unique(w >> _U(1), return_inverse=True, return_counts=True)
            hit = (count[inv] > 1) & (w & _U(1) == 0)
            r, s, e = _spans(run_of[hit], starts[run_of[hit]] + pos[hit], length)
            out.append(pd.DataFrame({"key": keys[r], "start": s, "end": e}))
        return pd.concat(out).astype({"key": "int64", "start": "int32", "end": "int32"})

    return run


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """docs(key long, text) -> key, start, end: word spans of repeated passages (they may touch or overlap)."""
    size = input_bytes(docs)
    nb = max(8, -(-size // BUCKET_BYTES) if size is not None else 4 * docs.rdd.getNumPartitions())
    return docs.select("key", "text").mapInPandas(_seed(nb, length, anchor), _SEEDS).repartition(max(8, nb // 2), "bucket").groupBy("bucket").applyInPandas(_extend(length), "key long, start int, end int")


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """docs plus n_words, n_removed, spans (array of removed word spans), kept_text (kept words, one space between)."""
    names = ["n_words", "n_removed", "spans", "kept_text"]
    docs = docs.drop(*names)
    found = keep(repeats(docs.select(F.xxhash64("doc_id", "text").alias("key"), "text"), length, anchor), "repeats")
    spans = found.groupBy(F.col("key").alias("_key")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    joined = docs.withColumn("_k", F.xxhash64("doc_id", "text")).join(spans, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")

    def run(batches):
        for pdf in batches:
            n, gone, kept, merged = [], [], [], []
            for t, s in zip(pdf["text"], pdf["spans"], strict=True):
                words = t.encode("utf-8", "replace").split() if isinstance(t, str) else []
                n.append(len(words))
                out = []
                if s is not None:
                    for x in s:
                        a, b = x["start"], x["end"]
                        if out and a <= out[-1][1]:
                            out[-1][1] = max(out[-1][1], b)
                        else:
                            out.append([a, b])
                    mask = np.ones(len(words), bool)
                    for a, b in out:
                        mask[a:b] = False
                    words = list(compress(words, mask))
                gone.append(n[-1] - len(words))
                merged.append([{"start": a, "end": b} for a, b in out])
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            pdf["n_words"], pdf["n_removed"], pdf["spans"], pdf["kept_text"] = np.array(n, np.int64), np.array(gone, np.int64), merged, kept
            yield pdf

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept_text", T.StringType())]
    return joined.mapInPandas(run, T.StructType([*docs.schema.fields, *fields]))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 34) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(array_to_string(x, ' '))) AS n FROM win) WHERE n > 1),
isl AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 35 THEN 0 ELSE 1 END AS new FROM rep),
grp AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM isl),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 34 AS b FROM grp GROUP BY doc_id, g),
gone AS (SELECT doc_id, sum(b - a + 1)::BIGINT AS n, list({'a': a, 'b': b}) AS s FROM sp GROUP BY doc_id),
kept AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, coalesce(len(s), 0)::INTEGER AS n_spans,
  CASE WHEN s IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: len(list_filter(s, lambda y: i BETWEEN y.a AND y.b)) = 0), ' ') END AS k
  FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, n_spans, sha256(coalesce(k, '')) AS kept_sha256 FROM kept
"""
