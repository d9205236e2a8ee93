import glob
import os

import duckdb
import pytest

from tamarack import audit_queries, kernel_queries, plans, queries, report_queries  # noqa: F401
from tamarack.operators import curves
from tests.conftest import SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(SF + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def shown(v):
    return "" if v is None else f"{float(v):.6f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    cursor = duck.execute(queries.ORACLES[name])
    place = {c[0]: k for k, c in enumerate(cursor.description)}
    want = sorted(tuple(shown(r[place[c]]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in got.collect()) == want


def test_holm_by_hand(spark):
    got = curves.holm(spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, 0.03), ("f", 4, None)], "family string, i int, p double"), "family", "p", ["i"])
    assert [None if x.p_holm is None else round(x.p_holm, 9) for x in got.orderBy("i").collect()] == [0.03, 0.06, 0.06, None]


def test_tampering_is_found(spark):
    from tamarack.operators import assign
    from tamarack.sources import trials

    split, sample = assign.latest_session(trials(spark, SF)), queries.sample(spark, SF)
    plans.gate(plans.audit(plans.assignment_rules(split, sample)))
    with pytest.raises(ValueError, match="sample_in_pool"):
        plans.gate(plans.audit(plans.assignment_rules(split.filter("session <> 0"), sample)))


def test_stream_appends_once(spark, tmp_path):
    from tamarack.streaming import append_new

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows.write.parquet(str(tmp_path / "in"))
    for n in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        append_new(stream, str(tmp_path / "out"), str(tmp_path / f"check{n}"), ["k"]).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
