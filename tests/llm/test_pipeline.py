import corpus_pipeline as P
from logweave.llm import decontaminate, jaccard


def test_stages(spark, tmp_path):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    text = lambda a, n=40: " ".join(words[a : a + n])
    docs = [(i, text(i * 7), "en", "s", 0) for i in range(30)]
    docs += [(40, docs[0][1], "en", "s", 0), (41, docs[0][1] + " extra", "en", "s", 0), (42, text(300) + " x@y.zz", "de", None, 1), (43, None, None, None, None), (44, "", "en", "s", 0)]
    docs += [(100 + i, f"qorbword zagword {text(220 + i, 9)} {i} {i * i} {i * 7}", "en", "s", 0) for i in range(40)]
    bench = [(1, text(350, 30))]
    docs.append((60, text(260, 20) + " " + bench[0][1], "en", "s", 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i)) for i, *_ in docs], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    d, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/s{i}")
        new = spark.read.parquet(f"{tmp_path}/s{i}")
        assert i == len(P.STAGES) - 1 or new.columns == d.columns
        d = new
        seen.append({r["doc_id"] for r in d.collect()})
    every = {i for i, *_ in docs}
    assert seen[0] == {i for i in every if i < 100}
    assert seen[1] == seen[0] - {40, 41}
    assert seen[2] == seen[1] - {60} and seen[3] == seen[4] == seen[2]
    final = P.run(spark, str(tmp_path))
    assert sorted(final.collect(), key=str) == sorted(d.collect(), key=str)
    assert final.where("doc_id IN (43, 44)").agg({"n_tokens": "sum"}).first()[0] == 0


def test_odd_tables(spark, tmp_path):
    """Null and empty texts, null and repeated ids, columns with the operators' own names, no labels, no rows."""
    t = " ".join(f"word{i}" for i in range(30))
    rows = [(1, t, 0.5, "x"), (1, t, 0.5, "x"), (2, None, None, None), (3, "", 1.0, "y"), (None, t, 2.0, "z"), (None, t, 2.0, "z"), (4, "mail a@b.example.org now", 3.0, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, spans string")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    for docs, want in ((df, [1, 2, 3, 4, None, None]), (df.limit(0), [])):
        for i, (_, stage) in enumerate(P.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == (df.columns if i < 4 else ["doc_id", "score", "spans", "n_tokens", "ids"])
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert sorted((r["doc_id"] for r in docs.collect()), key=lambda x: (x is None, x)) == want
