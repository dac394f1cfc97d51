"""Every query against its SQL, at the smallest scale."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF
from plotweave.plans import registry
from plotweave.streaming import ledger

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 7)
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sql, name):
    df = registry.QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    r = sql.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(plain(x[names.index(c)]) for c in sorted(names)) for x in r.fetchall()), key=str)
    assert got == expected


def test_projected_units_near_and_beyond_the_poles(spark, tmp_path):
    c = duckdb.connect()
    c.execute("CREATE TABLE customer AS SELECT unnest([7, 14999, 29700, 29950, 29999, 30000, 30050, 89999, 120049, 899999]) AS c_custkey")
    c.execute("CREATE TABLE orders AS SELECT 1::BIGINT AS o_orderkey, 30000::BIGINT AS o_custkey")
    for t in ("customer", "orders"):
        c.execute(f"COPY (SELECT * REPLACE (CAST({t[0]}_custkey AS BIGINT) AS {t[0]}_custkey) FROM {t}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got = registry.QUERIES["projected_units"](spark, str(tmp_path)).select("state_code", "unit_id", "x", "y", "lon", "lat").collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(registry.ORACLE_SQL["projected_units"]).fetchall())


@pytest.mark.parametrize("name", ["splitline_realized", "kway_partition", "kl_refine", "anneal", "repair_contiguity", "hull_and_circle"])
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_anneal_runs_all_iterations(monkeypatch):
    asked = []
    monkeypatch.setattr(registry.partitioners, "anneal_kernel", lambda *given, **named: asked.append((given, named)))
    monkeypatch.setattr(registry, "_improved", lambda *_: ())
    monkeypatch.setattr(registry, "_measured", lambda *_: None)
    registry.QUERIES["anneal"](None, SF)
    assert asked == [((0.05,), {})]


def test_ledger_stream(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "ledger")
    schema = "state_code string, at int, status string"
    for i, rows in enumerate(([("ID", 1, "ok"), ("MT", 1, "ok")], [("ID", 2, "failed"), ("MT", 0, "failed")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        ledger.follow(spark.readStream.schema(schema).parquet(path), folder, ["state_code"], "at", str(tmp_path / "cp")).awaitTermination()
        got = {r["state_code"]: r["status"] for r in spark.read.parquet(f"{folder}/v={i}").collect()}
    assert got == {"ID": "failed", "MT": "ok"}


def test_prefix_sums_of_one_large_group(spark):
    from plotweave.operators import sweeps
    df = spark.range(1000).select(F.lit("A").alias("g"), "id", F.lit(1).alias("v"))
    got = sweeps.prefix_sums(df, ["g"], ["id"], "v", slices=7)
    assert got.where("running <> id + 1").count() == 0
    whole = sweeps.prefix_sums(df.withColumn("w", F.col("id") * 2), [], ["id"], {"v": "a", "w": "b"}, slices=7)
    assert whole.where("a <> id + 1 or b <> id * (id + 1)").count() == 0 and whole.count() == 1000


def test_ranked(spark):
    from plotweave.operators.ranks import ranked
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id")
    got = ranked(df, ["g"], ["id"], rows_per_slice=20)
    assert [(r["g"], r["n"], r["low"], r["high"], r["u"]) for r in got.groupBy("g").agg(
        F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.countDistinct("rank").alias("u")).orderBy("g").collect()
    ] == [(0, 167, 0, 166, 167), (1, 167, 0, 166, 167), (2, 166, 0, 165, 166)]


def test_telemetry(spark, tmp_path):
    from plotweave.streaming import telemetry
    telemetry.sample(tmp_path / "cpu", 3, 0.0, iter([10.0, 20.0, 60.0]).__next__)
    stream = telemetry.follow_samples(spark, str(tmp_path / "cpu"))
    out = ledger.windowed_mean(stream, "ts", "cpu_pct", "1 hour", "1 minute")
    q = out.writeStream.outputMode("complete").format("memory").queryName("load").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("load").agg(F.sum("samples"), F.avg("window_mean")).first()[0] == 3


def test_working_tables(spark):
    from plotweave.sources import workspace
    t = workspace.staged(spark.range(3), "t")
    assert t.count() == 3 and t._staged_path.startswith(workspace.shared_root(spark))
    workspace.discard(t)
    from pyspark.errors import AnalysisException
    with pytest.raises(AnalysisException):
        spark.read.parquet(t._staged_path)
