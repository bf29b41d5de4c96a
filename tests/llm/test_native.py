"""The operators on DataFrame functions only, against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logweave.llm import chat, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, source string, text string"


def brute_quality(rows, max_docs, max_share):
    hosts, holders = Counter(s for _, s, _ in rows), defaultdict(int)
    lines = [[x for x in (t or "").split("\n") if WORD.search(x)] for *_, t in rows]
    normal = lambda x: " ".join(WORD.findall(x)).lower()
    for (_, s, _), own in zip(rows, lines):
        for x in {normal(x) for x in own}:
            holders[s, x] += 1
    out = []
    for (i, s, t), own in zip(rows, lines):
        w = WORD.findall(t or "")
        windows = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        seen = Counter(windows)
        repeat = len({j + k for j, x in enumerate(windows) if seen[x] > 1 for k in range(8)})
        gone = [x for x in own if holders[s, normal(x)] > max_docs and holders[s, normal(x)] > max_share * hosts[s]]
        chars, lost = sum(map(len, w)), sum(len(y) for x in gone for y in WORD.findall(x))
        failed = len(w) < 20 or 100 * repeat > 30 * len(w)
        text = t if not gone else "\n".join(x for x in t.split("\n") if x not in gone)
        out.append((i, len(w), chars, sum(c in "#*$%&|<>" for c in t or ""), len(own) - len(set(own)), repeat, failed, not failed and chars - lost >= 0.5 * chars, len(gone), lost, text))
    return out


def test_quality_rules(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdeÉß#|", k=rng.randrange(1, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    common = [line(6), line(30), "All Rights  Reserved"]
    rows = []
    for i in range(80):
        own = [line(rng.randrange(1, 15)) for _ in range(rng.randrange(1, 6))]
        own += [rng.choice([x, x.lower(), "\t" + x + " "]) for x in common if rng.random() < 0.3]
        own += rng.choices(own, k=rng.randrange(3)) + [""]
        rng.shuffle(own)
        rows.append((i, rng.choice(["a", "a", "b", None]), "\n".join(own)))
    rows += [(100, "a", None), (101, "a", ""), (102, None, " \n\t"), (103, "b", "x " * 8), (104, "b", "x y " * 9000), (105, "c", "w1 w2 w3 w4 w5 w6 w7 w8"), rows[0], (None, "b", rows[3][2]), (None, "b", rows[4][2])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit("clash") for x in ("removed_chars", "kept", "n_words", "_th", "h", "host")})
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_lines", "removed_chars", "cleaned"]
    got = quality_rules.quality(df, max_docs=3, max_share=0.05).select(*names).collect()
    want = brute_quality(rows, 3, 0.05)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(x[8] for x in want) and any(not x[6] and not x[7] for x in want)
    assert quality_rules.quality(df.limit(0)).count() == 0


def fold(events):
    """Final messages of one conversation's (turn, seq, role, text, kind)."""
    out = []
    at = {}
    for turn, _, role, text, kind in sorted(events, key=lambda x: (x[1], x[0], *x[2:])):
        if turn not in at or kind == "message":
            at[turn] = len(out)
            out.append([role, text])
        elif kind == "delta":
            out[at[turn]][1] += text
        else:
            out[at[turn]][1] = "" if kind == "regenerate" else text
    return [tuple(x) for x in out]


def test_chat_folds_events(spark):
    rng = random.Random(3)
    rows, per = [], defaultdict(list)
    odd = ["", "\\", "\\l", "<", "#", "</turn>\n", "### user: ", ": ", "é\n", "\\\\h", "ok "]
    for c in range(25):
        seq = 0
        for turn in range(rng.randrange(1, 5)):
            for n in range(rng.randrange(1, 6)):
                kind = "message" if n == 0 and rng.random() < 0.6 else rng.choice(["delta", "delta", "delta", "edit", "regenerate"])
                e = (turn, seq, rng.choice(["user", "assistant", "a:b#<"]), "".join(rng.choices(odd, k=3)), kind)
                per[c].append(e)
                rows.append((c, e[1], e[0], e[2], e[4], e[3]))
                seq += 1
    # events of turns that alternate, and turns that come out of order
    for seq, (turn, kind, text) in enumerate([(5, "message", "five"), (2, "message", "t"), (5, "delta", "+"), (2, "delta", "wo"), (5, "edit", "5"), (2, "delta", "!"), (5, "delta", ".")]):
        per[40].append((turn, seq, "user", text, kind))
        rows.append((40, seq, turn, "user", kind, text))
    assert fold(per[40]) == [("user", "5."), ("user", "two!")]
    rng.shuffle(rows)
    rows += [(None, 0, 0, "user", "message", "null id"), (50, 0, None, None, None, None), (51, 0, 0, "user", "message", "x" * 200000), (52, 0, 0, "user", "message", "tie"), (52, 0, 0, "user", "message", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, seq long, turn long, role string, kind string, text string").withColumns({x: F.lit(1) for x in ("turns", "formatted", "log", "e")})
    out = chat.format_chat(df).withColumn("back", chat.parse(F.col("formatted")))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["back"]] for r in out.collect()}
    want = {c: fold(e) for c, e in per.items()} | {50: [("", "")], 51: [("user", "x" * 200000)], 52: [("user", "tie")] * 2, None: [("user", "null id")]}
    assert got == want
    assert chat.format_chat(df.limit(0)).count() == 0


def test_whole_tables_equal_their_sql(spark):
    import os

    duckdb = pytest.importorskip("duckdb")
    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no tables")
    from logweave.llm import registry

    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    q, sql = registry.queries(), registry.oracle_sql()
    for name in sql:
        got = q[name](spark, at)
        cols = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql[name]})").fetchall()
        assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(want, key=str), name


def test_chat_fold_is_linear_and_rows_make_a_log(spark):
    """One long message and one of many events; rows with ties, repeats and nulls come back as they are."""
    n = 20000
    events = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("seq"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.when(F.col("id") == 0, "message").otherwise("delta").alias("kind"), F.lit("ab").alias("text"))
    assert chat.fold_events(events).select(F.length(F.col("turns")[0]["text"])).collect()[0][0] == 2 * n
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "assistant", "né"), (1, 1, None, None), (None, None, "assistant", "q" * 9), (1, 2, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.fold_events(chat.as_events(df)).collect()}
    assert got == {1: [("assistant", "né"), ("user", "x"), ("user", "x"), ("", ""), ("assistant", "")], None: [("assistant", "q" * 9)]}
    kinds = {r[0] for r in chat.as_events(df).select("kind").distinct().collect()}
    assert kinds == {"message", "delta", "edit", "regenerate"}
