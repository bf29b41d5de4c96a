"""The number of links of each document, in large groups of near copies too, against brute force."""

import random
import re

import numpy as np

from logweave.llm import jaccard


def brute(docs, width, percent):
    sets = []
    for t in docs:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return [sum(i != j and len(a & b) > 0 and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    docs = []
    for size, length in ((70, 90), (30, 60), (12, 40), (3, 120)):
        base = [word() for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(length)] = word()
            docs.append(" ".join(w))
    return docs + docs[:6] + [None, "", "one", "One", "two three"]


def test_every_link_counts(spark, monkeypatch, tmp_path):
    docs = corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    want = brute(docs, 3, 90)
    assert max(want) > 20
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_links"] for r in jaccard.op1_ngram_jaccard_join(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(docs))] == want
    monkeypatch.setattr(jaccard, "BLOCK", 300)  # many blocks a group
    monkeypatch.setattr(jaccard, "HUB", 3)  # many slots a hub
    got = {r["doc_id"]: r["n_links"] for r in jaccard.jaccard_join(df, 5, 80, count=True).collect()}
    assert [got[i] for i in range(len(docs))] == brute(docs, 5, 80)


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [rng.choice(60, rng.integers(1, 50), replace=False) for _ in range(25)]
    for a, b in ((sets, sets), (sets[:7], sets[7:]), (sets[:1], sets[1:3])):
        assert jaccard.overlaps(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
