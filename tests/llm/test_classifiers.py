import itertools
import random

import numpy as np

from logweave.llm import katz, quality_trees, toxicity


def corpus(n=500):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(2, 7)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(10, 80))]
        toxic, bad = rng.random() < 0.2, rng.random() < 0.3
        if bad:
            w = [x.upper() + "!!" for x in w[:6]] * 6
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["zagvulgus", "zagvumor", "zagvupli", "qorb"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def auc(score, y):
    o = np.argsort(score)
    r = np.empty(len(o))
    r[o] = np.arange(len(o))
    y = np.asarray(y)
    return (r[y == 1].mean() - (y == 1).sum() / 2 + 0.5) / (y == 0).sum()


def test_held_out(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "zagvulgus qorb " * 9000)], "doc_id long, text string").withColumn("score", katz.F.lit("clash"))
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3000, None, None)], "doc_id long, quality int, toxic int")
    y = {i: (q, t) for i, q, t in labels}
    for module, mod, rest, at in ((toxicity, 3, 1, 1), (quality_trees, 5, 0, 0)):
        got = module.score(docs, module.train(docs, lab, ~katz.held("doc_id", mod, rest))).withColumn("h", katz.held("doc_id", mod, rest)).collect()
        out = [(r["score"], y[r["doc_id"]][at]) for r in got if r["h"] and r["doc_id"] in y]
        assert auc(*map(np.array, zip(*out))) > 0.95
        assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows) + 3
        empty = module.train(docs, lab.limit(0), katz.F.lit(True))
        assert len({r["score"] for r in module.score(docs, empty).collect()}) == 1
        assert module.score(docs.limit(0), empty).count() == 0
    tox = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit([t for _, t in rows], np.array([t for *_, t in labels]))).collect()}
    texts = dict(rows)
    hit = [texts[i][s["start"] : s["end"]] for i in texts for s in tox[i]["spans"]]
    assert hit and np.mean([h.lower().startswith(("zagvu", "qorb")) for h in hit]) > 0.95
    assert tox[902]["score"] > 0.9 and tox[900]["score"] == tox[901]["score"] < 0.5


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(1)
    first = np.array([0, 5, 5, 8, 9])
    order, off, _ = toxicity.packed(first)
    e, trans, start = np.exp(rng.normal(size=9)), np.exp(rng.normal(size=(2, 2))), 0.4
    r, b = toxicity.messages(e[order], off, trans, start)
    p = np.empty(9)
    p[order] = r * b / (1 + r * b)
    for a, z in zip(first, first[1:]):
        want, total = np.zeros(z - a), 0
        for path in itertools.product((0, 1), repeat=z - a):
            v = np.prod([e[a + i] ** s for i, s in enumerate(path)]) * np.prod([trans[s, t] for s, t in zip(path, path[1:])]) * (start if path and path[0] else 1)
            total += v
            want += v * np.array(path)
        assert np.allclose(p[a:z], want / total)


def test_traversal_is_that_of_nested_rules():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = quality_trees.fit(x, y, trees=30, depth=3)
    def walk(row):
        total = m.base
        for f, c, leaf in zip(m.feature, m.threshold, m.leaf):
            i = 0
            while i < len(f):
                i = 2 * i + 1 + int(row[f[i]] > c[i])
            total += leaf[i - len(f)]
        return total
    assert np.allclose(m.raw(x), [walk(r) for r in x]) and auc(m.predict(x), y) > 0.9
