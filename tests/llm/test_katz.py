import math
import re
from collections import Counter
from zlib import crc32

from logweave.llm import katz


def brute(train, docs):
    toks = lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["</s>"]
    uni, bi, hist = Counter(), Counter(), Counter()
    for t in train:
        x = toks(t)
        uni.update(x)
        pairs = list(zip(["<s>", *x], x))
        bi.update(pairs)
        hist.update(h for h, _ in pairs)
    n, v = sum(uni.values()), len(uni)
    d = katz.discounts(Counter(bi.values()))
    p1 = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    kept = {k: d.get(c, 1.0) * c for k, c in bi.items() if c >= 2}
    alpha, scale = {}, {}
    for h in {h for h, _ in kept}:
        s = sum(x for (a, _), x in kept.items() if a == h) / hist[h]
        left = max(1 - s, 1e-6)
        scale[h] = (1 - left) / s
        alpha[h] = left / (1 - sum(p1(w) for a, w in kept if a == h))
    def p(h, w):
        return scale[h] * kept[h, w] / hist[h] if (h, w) in kept else alpha.get(h, 1) * p1(w)
    words = [*uni, "<unknown>"]
    for h in list(hist)[:20]:  # exactly normalised over the known words and one unknown
        assert math.isclose(sum(p(h, w) for w in words), 1, rel_tol=1e-9)
    out = {}
    for i, t in docs:
        x = toks(t)
        out[i] = (len(x), sum(uni[w] > 0 for w in x), sum(math.log10(p1(w)) for w in x), sum(math.log10(p(h, w)) for h, w in zip(["<s>", *x], x)))
    return n, out


def test_against_plain_python(spark):
    docs = [(i, t) for i, t in enumerate(["a b a b A c", "a b c", "b a", None, "", "x y z a b", "a b " * 50, "é ñ é ñ", "a b c a b c", "b a"] * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", katz.F.lit("clash"))
    held = {i for i, _ in docs if crc32(str(i).encode()) % 5 == 1}
    assert {r[0] for r in df.where(katz.held("doc_id", 5, 1)).collect()} == held
    model = katz.fit(df.where(~katz.held("doc_id", 5, 1)))
    n, want = brute([t for i, t in docs if i not in held], docs)
    got = katz.score(df, model).collect()
    assert model.n == n and len(got) == len(docs)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == w[:2]
        assert math.isclose(r["base_score"], w[2], rel_tol=1e-9) and math.isclose(r["score"], w[3], rel_tol=1e-9)


def test_empty_training_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "q"), (2, "w " * 70000)], "doc_id long, text string")
    model = katz.fit(df.limit(0))
    rows = katz.score(df, model).collect()
    assert len(rows) == 4 and sorted(r["n_tokens"] for r in rows) == [2, 3, 3, 70001] and {r["n_known"] for r in rows} == {0}
    assert katz.score(df.limit(0), model).count() == 0
