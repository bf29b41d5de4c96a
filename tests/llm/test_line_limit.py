"""One absolute limit on the documents of a host that hold a line, for small and large hosts."""

import os

import pytest

from logweave.llm import quality_rules, registry

OWN = "own{0} words{0} of{0} document{0}"


def test_limit_does_not_depend_on_the_size_of_the_host(spark):
    rows = [(i, "small", "The footer\n" * (i < 11) + OWN.format(i)) for i in range(20)]
    rows += [(100 + i, "large", "The  FOOTER\n" * (i < 11) + "Seldom seen\n" * (i < 10) + OWN.format(i)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    lost = quality_rules.line_frequency(df).collect()
    assert {(r["doc_id"], r["removed_lines"]) for r in lost} == {(i + x, 1) for x in (0, 100) for i in range(11)}


def test_registered_query_equals_its_sql_where_lines_go(spark):
    duckdb = pytest.importorskip("duckdb")
    at = "/root/testdata/sf0.01"
    if not os.path.isdir(at):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    name = "op2_quality_rules"
    got = registry.queries()[name](spark, at)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)
    assert any(x[cols.index("removed_lines")] for x in want)
