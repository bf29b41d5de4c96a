import random
import re

from logweave.llm import components, jaccard


def brute(docs, width, percent):
    sets = []
    for t in docs:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if x and 100 * x >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdEé", k=3))
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(rng.choice([3, 8, 40, 120]))] for _ in range(14)]
    docs = []
    for _ in range(260):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.4:
            w += passage
        docs.append(" ".join(w))
    docs += [None, "", " \n", "one", "One", "one two", "one two", docs[0], docs[0].upper().lower(), "x " * 500, "x " * 3]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("n", jaccard.F.lit("clash"))
    for width, percent in ((3, 90), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(df, width, percent).collect()}
        assert [got[i] for i in range(len(docs))] == brute(docs, width, percent)
    assert sorted(r["doc_id"] for r in jaccard.keep_one(df).collect()) == [i for i, (_, c) in enumerate(brute(docs, 5, 80)) if i == c]


def test_nulls_repeats_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (2, "a b c d"), (2, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_join(df).select("doc_id", "component_id").collect()), key=str) == [(1, 1), (2, 1), (2, 1), (None, None)]
    assert jaccard.jaccard_join(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in root.items() if x in got} and {x for a, b in edges if a != b for x in (a, b)} == set(got)


def test_rows_that_repeat_a_doc_id(spark):
    t = "a b c d e f g h"
    rows = [(1, t), (1, t), (2, t), (5, "k l m n o p q"), (5, "r s t u v w x"), (6, "k l m n o p q"), (6, None), (None, t), (None, t)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", jaccard.F.lit("clash"))
    got = [tuple(r) for r in jaccard.jaccard_join(df, count=True).select("doc_id", "component_id", "n_links").collect()]
    assert sorted(x for x in got if x[0] in (1, 2)) == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert sum(x[0] is None and x[1] is None for x in got) == 2 and len(got) == len(rows)
    kept = jaccard.keep_one(df, 3, 90)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) in ([0, 0, 1, 5], [0, 0, 1, 5, 6])


def test_two_clusters_of_near_copies(spark):
    """Two groups side by side: blocks meet, not pairs of documents; components and links are exact."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    base = [word() for _ in range(200)]
    other = base[:186] + [word() for _ in range(14)]
    docs = []
    for k in range(160):
        w = list(base if k % 2 else other)
        w[rng.randrange(200)] = word()
        docs.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(df, 3, 90).collect()}
    assert [got[i] for i in range(len(docs))] == brute(docs, 3, 90)
