"""Katz back-off of higher orders with n-grams seen once, against plain Python."""

import math
import random
import re
from collections import Counter
from functools import cache
from zlib import crc32

from logweave.llm import katz


def brute(train, docs, order, least):
    toks = lambda t: ["<s>"] + [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["</s>"]
    c = {m: Counter(tuple(x[i : i + m]) for x in map(toks, train) for i in range(len(x) - m + 1)) for m in range(1, order + 1)}
    del c[1]["<s>",]
    n, v = sum(c[1].values()), len(c[1])
    d = {m: katz.discounts(Counter(c[m].values()), least) for m in range(2, order + 1)}
    hist = {m: Counter() for m in d}
    for m in d:
        for g, x in c[m].items():
            hist[m][g[:-1]] += x
    kept = {m: {g: d[m].get(x, 1.0) * x for g, x in c[m].items() if x >= least} for m in d}
    nexts = {}
    for m in d:
        for g in kept[m]:
            nexts.setdefault(g[:-1], []).append(g[-1])

    @cache
    def weights(h):
        if h not in nexts:
            return 1.0, 0.0
        m = len(h) + 1
        s = sum(kept[m][*h, w] for w in nexts[h]) / hist[m][h]
        left = max(1 - s, 1e-6)
        return left / (1 - sum(p(h[1:], w) for w in nexts[h])), (1 - left) / s

    def p(h, w):
        if not h:
            return (c[1][w,] + 0.5) / (n + 0.5 * (v + 1))
        m = len(h) + 1
        alpha, scale = weights(h)
        return scale * kept[m][*h, w] / hist[m][h] if (*h, w) in kept[m] else alpha * p(h[1:], w)

    for h in [h for m in d for h in list(hist[m])[:15]]:  # exactly normalised over the known words and one unknown
        assert math.isclose(sum(p(h, w) for w in [*(x for (x,) in c[1]), "<unknown>"]), 1, rel_tol=1e-9)
    out = {}
    for i, t in docs:
        x = toks(t)
        out[i] = sum(math.log10(p(tuple(x[max(0, j - order + 1) : j]), x[j])) for j in range(1, len(x)))
    return out


def corpus(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefgh", weights=[9, 7, 5, 3, 2, 1, 1, 1], k=rng.randrange(12))) for _ in range(60)]
    docs = list(enumerate([*texts, None, "", "q", "A b C", "z z z a b c", "a b " * 50, *texts[:5]]))
    return docs, spark.createDataFrame(docs, "doc_id long, text string")


def test_higher_orders_and_singletons(spark):
    docs, df = corpus(spark)
    train = df.where(~katz.held("doc_id", 5, 1))
    texts = [t for i, t in docs if crc32(str(i).encode()) % 5 != 1]
    for least, order in ((1, 2), (1, 3), (2, 3), (1, 4)):
        want = brute(texts, docs, order, least)
        for r in katz.score(df, katz.fit(train, least, order)).collect():
            assert math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9), (least, order, r)


def test_registered_query_keeps_trigrams_seen_once(spark, tmp_path):
    docs, df = corpus(spark)
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute([t for i, t in docs if crc32(str(i).encode()) % 5 != 1], docs, 3, 1)
    got = {r["doc_id"]: r["score"] for r in katz.op5_katz_backoff(spark, str(tmp_path)).collect()}
    assert all(math.isclose(got[i], x, rel_tol=1e-9) for i, x in want.items()) and len(got) == len(docs)


def test_only_empty_documents(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert katz.score(df, katz.fit(df, 1, 3)).count() == 2 and katz.score(df, katz.fit(df.limit(0), 1, 3)).count() == 2
