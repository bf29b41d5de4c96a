import random
import re
from collections import defaultdict

from logweave.llm import substring


def brute(docs, length):
    where = defaultdict(list)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in docs]
    for d, w in enumerate(words):
        for i in range(len(w) - length + 1):
            where[tuple(w[i : i + length])].append((d, i))
    gone = [set() for _ in docs]
    for at in where.values():
        if len(at) > 1:
            for d, i in at:
                gone[d] |= set(range(i, i + length))
    return [(len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for w, g in zip(words, gone)]


def test_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcé", k=3))
    passages = [[word() for _ in range(rng.choice([5, 6, 7, 9, 20]))] for _ in range(12)]
    docs = []
    for _ in range(150):
        w = []
        for _ in range(rng.randrange(6)):
            w += rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(12))]
        docs.append(rng.choice([" ", "\n", " \t "]).join(w))
    docs += [None, "", " \n", "x " * 200, docs[0], docs[0], "a b c d e f", "A b c d e f"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("spans", substring.F.lit(1)).repartition(7)
    old, substring.CHUNK = substring.CHUNK, 300
    try:
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeats(df, 6, 3).collect()}
    finally:
        substring.CHUNK = old
    want = brute(docs, 6)
    assert [got[i] for i in range(len(docs))] == want
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_repeated_rows(spark):
    t = " ".join(map(str, range(40)))
    rows = substring.remove_repeats(spark.createDataFrame([(1, t), (1, t), (2, t[:80])], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows) == [(1, 40), (1, 40), (2, 0)]
