"""Registered queries against their SQL on the smallest tables; sources; streaming."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from claimloom.plans import registry
from claimloom.sources import files
from claimloom.streaming import events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    df = df.astype(object).where(df.notna(), None)
    show = lambda x: str(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(show(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_review_buckets_gives_no_column_beside_its_sql(spark):
    assert registry.QUERIES["review_buckets"](spark, SF).columns == ["document_id", "bucket", "findings", "errors"]


@pytest.mark.parametrize("name", ["split_cells", "column_bounds"])
def test_lines_of_two_digits_and_words_without_a_place(spark, tmp_path, name):
    """No two words of a line are equal, so the SQL leaves no tie open."""
    odd = [(1, 5, 3, 2), (1, 5, 3, 10), (1, 5, 3, 9), (1, 95, 3, 11), (2, None, 3, 1), (2, 8, None, 2), (2, 8, 1, 3), (2, 40, 2, 4), (3, 7, 1, 12), (3, 7, 1, None), (None, 7, 1, 1)]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE lineitem (l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int)")
    duck.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?)", odd if name == "split_cells" else [r for i, r in enumerate(odd) if r[1:3] not in [x[1:3] for x in odd[:i]]])
    duck.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    assert rows(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(duck.execute(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.csv").write_text("Claim;Paid\n\"x;y\";5\n")
    (tmp_path / "c.csv").write_bytes(b"PK\x03\x04zzz")
    got = {r["name"]: (r["kind"], r["refused"]) for r in files.ingest(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("pdf", None), "b.csv": ("csv", None), "c.csv": ("xlsx", "name contradicts content")}
    cells = [r["cells"] for r in files.read_delimited(spark, str(tmp_path / "b.csv")).orderBy("line").collect()]
    assert cells == [["Claim", "Paid"], ["x;y", "5"]]
    (tmp_path / "e.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.read_events(spark, str(tmp_path / "e.jsonl"), "a int").collect()) == [1, 2]


def test_stream_gives_the_table_s_windows(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = events.windowed_rates(stream, late="60 days").writeStream.format("memory").queryName("w").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["n"], r["cents"]) for r in df.collect())
    assert key(spark.table("w")) == key(events.windowed_rates(table))
    assert json.loads(q.lastProgress.json if hasattr(q.lastProgress, "json") else json.dumps(q.lastProgress))["numInputRows"] >= 0
