"""Every query that has SQL against DuckDB, value by value."""

import duckdb
import pytest
from pyspark.sql import functions as F

from leadloom.operators import decide
from leadloom.plans import catalogue
from leadloom.streaming import claims

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return f"{v:.6g}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(tuple(plain(v) for v in r) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want and want


@pytest.mark.parametrize("name", sorted(catalogue.UNLISTED))
def test_cascade_without_lists_equals_its_sql(spark, sf_dir, duck, name, monkeypatch):
    none = {"name_score": "int", "short_hit": "boolean", "domain_score": "int", "second_score": "int", "second_screen": "string"}
    monkeypatch.setattr(decide, "with_list_hits", lambda cases, *hits: cases.withColumns({c: F.lit(None).cast(t) for c, t in none.items()}))
    got = catalogue.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(catalogue.UNLISTED[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(v) for v in r) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns and df.count() >= 0


@pytest.mark.parametrize("name", ["stream_tracker", "stream_cache"])
def test_streams_over_many_batches(spark, duck, sf_dir, name, monkeypatch):
    """One file a batch, the latest rows first."""
    poll, stream = claims.poll, catalogue._stream
    order = {"stream_tracker": "lead_id", "stream_cache": "fetched_at"}[name]

    def written(session, rows):
        source, root = stream(session, rows.limit(0))
        parts = rows.repartitionByRange(3, F.col(order).desc()).withColumn("_p", F.spark_partition_id()).persist()
        for p in range(3):
            parts.where(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(f"{root}/in")
        return source, root

    monkeypatch.setattr(claims, "poll", lambda session, path, schema, per_pass=1: poll(session, path, schema, 1))
    monkeypatch.setattr(catalogue, "_stream", written)
    got = catalogue.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(v) for v in r) for r in cursor.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
