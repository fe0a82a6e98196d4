"""Scans, sinks and the incremental landing stream (SC1–SC8, SK1–SK3, ST1)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewise.operators.windows import dedup_keep_last
from ratewise.sources import tables as tb
from ratewise.streaming import incremental as inc

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("code", T.StringType()),
                       T.StructField("label", T.StringType())])


def _write(path, lines):
    path.write_bytes(("\n".join(["id;code;label"] + lines) + "\n").encode("latin-1"))


def test_scan_csv_latin1_keeps_leading_zeros(spark, tmp_path):
    _write(tmp_path / "a.csv", ["1;0111;Cultivo de café", "2;7;Ação"])
    df = tb.scan_csv(spark, str(tmp_path / "a.csv"), SCHEMA)
    assert [tuple(r) for r in df.drop(tb.CORRUPT).orderBy("id").collect()] == [("1", "0111", "Cultivo de café"), ("2", "7", "Ação")]


def test_overlapping_files_keep_last_in_file_order(spark, tmp_path):
    _write(tmp_path / "cat_2023_01.csv", ["k1;A;old", "k2;B;only"])
    _write(tmp_path / "cat_2023_02.csv", ["k1;A;new", "k3;C;x"])
    df = tb.scan_many_ordered(spark, str(tmp_path / "*.csv"), SCHEMA)
    kept = dedup_keep_last(df.select("id", "code", "label", "_file", "_split", "_row"),
                           ["id", "code"], ["_file", "_split", "_row"])
    assert sorted((r.id, r.label) for r in kept.collect()) == [("k1", "new"), ("k2", "only"), ("k3", "x")]


def test_land_append_and_counts(spark, tmp_path, sf_dir):
    df = spark.range(10).withColumn("y", F.col("id") % 2)
    tb.land(df, str(tmp_path / "t"), partition_by=["y"])
    tb.append(df, str(tmp_path / "t"), partition_by=["y"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20
    tb.land(df, str(tmp_path / "c"), fmt="csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 10
    counts = {r.table_name: r.n_rows for r in tb.table_counts(spark, sf_dir, ["nation", "region"]).collect()}
    assert counts == {"nation": 25, "region": 5}


def test_publish_refreshes_dependants_after_dimensions(spark, tmp_path):
    one = spark.range(1)
    tables = {"dim_sector": one, "fact_events": one, "fact_exposure": one, "dim_other": one}
    deps = {"fact_events": ["dim_sector"], "fact_exposure": ["dim_sector", "dim_other"]}
    order = tb.publish(tables, str(tmp_path), deps, selected=["dim_sector"])
    assert order[0] == "dim_sector" and set(order) == {"dim_sector", "fact_events", "fact_exposure"}
    assert spark.read.parquet(str(tmp_path / "fact_events")).count() == 1


def test_union_all_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([(2,)], "a int")
    assert sorted((r.a, r.b) for r in tb.union_all([a, b]).collect()) == [(1, "x"), (2, None)]


def test_landing_stream_keep_last_across_batches(spark, tmp_path):
    landing, bronze, ckpt = tmp_path / "landing", tmp_path / "bronze", tmp_path / "ckpt"
    landing.mkdir()
    _write(landing / "m_2023_01.csv", ["k1;A;v1", "k2;B;v1"])
    _write(landing / "m_2023_02.csv", ["k1;A;v2"])
    q = inc.start_landing(spark, str(landing), str(bronze), str(ckpt), SCHEMA)
    q.awaitTermination(120)
    got = {r.id: r.label for r in inc.current_view(spark, str(bronze), ["id", "code"]).collect()}
    assert got == {"k1": "v2", "k2": "v1"}
    # a later file arrives: the restarted stream only picks up the new file
    _write(landing / "m_2023_03.csv", ["k2;B;v3"])
    q = inc.start_landing(spark, str(landing), str(bronze), str(ckpt), SCHEMA)
    q.awaitTermination(120)
    view = inc.current_view(spark, str(bronze), ["id", "code"])
    assert {r.id: r.label for r in view.collect()} == {"k1": "v2", "k2": "v3"}
    assert spark.read.parquet(str(bronze)).count() == 4


def test_silver_roles_give_the_same_analysis(spark, tmp_path, sf_dir):
    from ratewise.plans import rates as rt
    from ratewise.sources import fixtures as fx
    from ratewise.sources import silver
    order = silver.publish_silver(spark, sf_dir, str(tmp_path))
    assert order.index("sectors") < order.index("events_fact")
    s = fx.Study()
    raw = rt.expected_vs_observed(fx.events_fact(spark, sf_dir), fx.exposure(spark, sf_dir),
                                  fx.sectors(spark, sf_dir), s)
    ev = silver.read_role(spark, str(tmp_path), "events_fact")
    plan = ev.where(F.col("event_date") >= "1999-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_date), GreaterThanOrEqual(event_date" in plan
    sil = rt.expected_vs_observed(ev, silver.read_role(spark, str(tmp_path), "exposure"),
                                  silver.read_role(spark, str(tmp_path), "sectors"), s)
    assert sorted(tuple(r) for r in raw.collect()) == sorted(tuple(r) for r in sil.collect())


def test_date_clustering_spreads_a_hot_date(spark):
    """A date holding 90 % of the rows is split over several writers, files stay date-sorted."""
    import datetime as dt
    from ratewise.sources import silver
    hot = [(dt.date(2024, 1, 1), i) for i in range(9000)]
    rest = [(dt.date(2024, 1, 1) + dt.timedelta(days=1 + i % 300), i) for i in range(1000)]
    df = spark.createDataFrame(hot + rest, "d date, v int")
    out = silver.date_clustered(df, "d", partitions=8)
    sizes = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in sizes) < 3000 and len(sizes) >= 5
    ranges = out.groupBy(F.spark_partition_id().alias("p")).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    spans = sorted((r.lo, r.hi) for r in ranges.collect())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))      # ranges do not interleave
    assert out.count() == 10000
