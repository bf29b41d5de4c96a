import random

import numpy as np

from logweave.llm import decontaminate as D


def distance(p, t):
    d = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(t, 1):
            prev, d[j] = d[j], min(prev + (x != y), d[j] + 1, d[j - 1] + 1)
    return min(d)


def material():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices(["th", "er", "on", "é", "an", "st"], k=rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.choice([4, 14, 20, 40]))) for i in range(12)] + [(50, None), (51, ""), (52, "ab")]
    docs = []
    for i in range(120):
        t, item = text(rng.randrange(60)), items[rng.randrange(12)][1]
        if i % 2:
            c = list(item)
            for _ in range(rng.randrange(len(c) // 6 + 1)):
                k = rng.randrange(len(c))
                c[k : k + 1] = rng.choice([[], ["x"], [c[k], "y"]])
            t = t + rng.choice([" ", "\n", ""]) + "".join(c).upper() + " " + text(5)
        docs.append(t)
    return items, docs


def brute(items, docs):
    """Segments within their budget, by plain edit distance over the whole document."""
    out = set()
    index = D.Index(items)
    for s, p in enumerate(index.text):
        for r, t in enumerate(docs):
            if t and distance(p.tolist(), D.normal(t.encode()).tolist()) <= index.edits[s]:
                out.add((r, int(index.item[s])))
    return out


def test_against_brute_force(spark):
    items, docs = material()
    want = brute(items, docs)
    assert len(want) > 20
    assert {(r, i) for r, i, *_ in D.find(D.Index(items), docs)} == want
    df = spark.createDataFrame([*enumerate(docs), (900, None), (901, ""), (902, docs[1] * 200)], "doc_id long, text string").withColumn("item_id", D.F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["doc_id"] < 900} == want
    for r in rows:
        t = docs[r["doc_id"]] if r["doc_id"] < 900 else docs[1] * 200
        assert 0 <= r["start"] < r["end"] <= len(t)
    hit = {r["doc_id"] for r in rows}
    assert {r["doc_id"] for r in D.remove_contaminated(df, bench).collect()} == {*range(len(docs)), 900, 901, 902} - hit
    assert D.contaminated(df, bench.limit(0)).count() == 0 and D.contaminated(df.limit(0), bench).count() == 0


def test_slices(spark):
    items, docs = material()
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = list(D.indexes(bench, 200))
    assert len(cut) > 2 and {(r, i) for x in cut for r, i, *_ in D.find(x, docs)} == brute(items, docs)


def test_alignment():
    rng = np.random.default_rng(3)
    for _ in range(300):
        p, t = rng.integers(0, 3, rng.integers(1, 12)), rng.integers(0, 3, rng.integers(1, 30))
        want, got = distance(p.tolist(), t.tolist()), D.align(p, t, 100)
        assert got[0] == want


def test_short_items_and_runs(spark):
    items = [(1, "short item"), (2, "Yes"), (3, "a"), (4, "-" * 30 + " a rule and a line of words that follows it closely"), (5, ""), (6, "yes")]
    docs = ["this holds a Short  item here", "oh YES, no", "yesterday", "x" * 50, "==\n" + "-" * 4000 + "\n a rule\tand a line of   words that follows it closely", "-" * 20000, "", None, "é" * 30 + " yes"]
    got = {(r, i) for r, i, *_ in D.find(D.Index(items), docs)}
    assert got == {(0, 1), (0, 3), (1, 2), (1, 6), (4, 4), (4, 3), (8, 2), (8, 6)}
    spans = {(r, i): docs[r][a:b] for r, i, a, b, _ in D.find(D.Index(items), docs)}
    assert spans[0, 1] == "Short  item" and spans[1, 2] == "YES" and spans[8, 2] == "yes"


def test_grams_with_many_places(spark, monkeypatch):
    """A phrase that every item and one long text repeat: the same hits in small pieces."""
    items, docs = material()
    items = [(i, (t or "") + " again and again and again") for i, t in items]
    docs = [t + " again and again" for t in docs[:40]] + ["again and " * 3000]
    whole = D.find(D.Index(items), docs)
    monkeypatch.setattr(D, "MEETINGS", 500)
    assert D.find(D.Index(items), docs) == whole
    assert {(r, i) for r, i, *_ in whole} == brute(items, docs)


def test_slice_by_slice(spark):
    items, docs = material()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("index", D.F.lit("clash"))
    want = brute(items, docs)
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(df, bench, 300).collect()} == want
    left = D.remove_contaminated(df, bench, 300)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {*range(len(docs))} - {r for r, _ in want}
