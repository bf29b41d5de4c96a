import os

import pytest

from logweave.plans import catalogue


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_pause_resume_of_every_record_equals_its_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    at = f"/root/testdata/{sf}"
    if not os.path.isdir(at):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet'")
    cols = "topic, part, largest, pause, resume"
    got = sorted(map(tuple, catalogue.queries()["pause_resume"](spark, at).select(*cols.split(", ")).collect()))
    assert got == sorted(con.execute(f"SELECT {cols} FROM ({catalogue.oracle_sql()['pause_resume']})").fetchall())
    assert {x[3] for x in got} == {True, False}
    sizes = {(r["topic"], r["part"]): r["size"] for r in catalogue.queries()["queue_sizes"](spark, at).groupBy("topic", "part").agg({"size": "max"}).withColumnRenamed("max(size)", "size").collect()}
    assert {x[:2]: x[2] for x in got} == sizes | {("idle", 0): 0}
