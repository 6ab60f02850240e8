"""Every query that SQL can state, against DuckDB on the same tables; and the streaming forms."""

import duckdb
import pytest

from palimpsest import registry
from palimpsest.streaming import activity

TABLES = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TABLES}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = registry.queries()[name](spark, TABLES)
    columns = sorted(frame.columns)
    found = duck.execute(registry.oracle_sql()[name])
    at = {d[0]: k for k, d in enumerate(found.description)}
    assert sorted(at) == columns
    wanted = sorted((tuple(row[at[c]] for c in columns) for row in found.fetchall()), key=repr)
    got = sorted((tuple(row[c] for c in columns) for row in frame.collect()), key=repr)
    assert got == wanted


def test_sliding_counts_as_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{TABLES}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = activity.sliding_counts(stream).writeStream.format("memory").queryName("sliding").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("sliding").collect())) == sorted(map(tuple, activity.sliding_counts(events).collect()))


def test_first_failures(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")]
    frame = spark.createDataFrame(rows, "url string, at string").selectExpr("url", "to_timestamp_ntz(at) ts")
    frame.write.parquet(f"{tmp_path}/in")
    stream = activity.first_failures(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), ["url"])
    query = stream.writeStream.format("memory").queryName("failures").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["url"] for r in spark.table("failures").collect()) == ["a", "b"]
