"""Every query of the library against its SQL on the smallest tables, and a streaming run."""

from pathlib import Path

import pytest

from crosswise.plans import QUERIES, SQL
from crosswise.plans.shapes import sections, table
from crosswise.streaming.runs import current, recompute_on_arrival, windowed_types

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="sample tables are not here")


def rows(names, found):
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([cell(r[k]) for k in order]) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    want = con.sql(SQL[name])
    df = QUERIES[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_streaming_counts_match_batch(spark, tmp_path):
    table(spark, str(DATA), "events").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table(spark, str(DATA), "events").schema).parquet(str(tmp_path / "in"))
    found = windowed_types(stream.selectExpr("ts", "event_type AS label", "'t' AS section_type"), late="0 seconds")
    q = found.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == table(spark, str(DATA), "events").count()


def test_streaming_recompute(spark, tmp_path):
    table(spark, str(DATA), "events").select("user_id").withColumnRenamed("user_id", "doc_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long").parquet(str(tmp_path / "in"))
    q = recompute_on_arrival(stream, lambda docs: sections(spark, str(DATA)).join(docs, "doc_id").groupBy("doc_id").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg({"count": "sum"}).first()[0] == 1000


def test_a_document_that_comes_again_has_its_last_results(spark, tmp_path):
    out = str(tmp_path / "out")
    for k, ids in enumerate(([1, 2, 3], [2, 3])):
        spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("doc_id long").parquet(str(tmp_path / "in"))
        made = lambda docs, k=k: docs.filter(f"{k} = 0 OR doc_id <> 3").selectExpr("doc_id", f"{k} AS v")
        recompute_on_arrival(stream, made, out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(tuple(r) for r in current(spark, out).select("doc_id", "v").collect()) == [(1, 0), (2, 1)]


@pytest.mark.parametrize("name", ["consensus_order", "reaction_clusters"])
def test_records_are_shuffled_once(spark, name):
    """The records are numbered by document, so what follows by document needs no further shuffle."""
    plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
