"""Batches that arrive, arrive again, and are checked on the way in; catalog, dictionary and bound texts."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from ratewise import queries as q
from ratewise.operators import joins as jn
from ratewise.operators import quality as dq
from ratewise.operators.windows import dedup_keep_last
from ratewise.plans import bound_sql as bq
from ratewise.sources import tables as tb
from ratewise.streaming import upsert as up
from tests.test_plans import joins, reads, walk

KIND = "k int, s string, at int, v string"


def some(spark, seed, keys, n=200):
    rng = random.Random(seed)
    return spark.createDataFrame([(rng.choice([None, *keys]), rng.choice(["x", None]), rng.randint(0, 50), f"{seed}.{i}")
                                  for i in range(n)], KIND)


def rows(df):
    return sorted(map(str, df.collect()))


def files(root) -> dict[str, int]:
    return {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_upsert_equals_one_pass_over_all_batches(spark, tmp_path):
    root = str(tmp_path / "table")
    batches = [some(spark, seed, range(60)) for seed in range(4)]
    for number, b in enumerate(batches):
        up.apply_batch(b, number, root, ["k", "s"], ["at"], buckets=8)
    whole = batches[0]
    for b in batches[1:]:
        whole = whole.unionByName(b)
    want = rows(dedup_keep_last(whole, ["k", "s"], ["at"]))
    assert rows(up.current(spark, root, whole.schema)) == want
    # the last batch again, and one before it: both start from the versions before them
    before = files(root)
    up.apply_batch(batches[3], 3, root, ["k", "s"], ["at"], buckets=8)
    assert rows(up.current(spark, root, whole.schema)) == want
    assert {p for p in before if "/batch=3/" not in p} == {p for p in files(root) if "/batch=3/" not in p}
    assert up.vacuum(spark, root) > 0 and up.vacuum(spark, root) >= 0
    assert rows(up.current(spark, root, whole.schema)) == want


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    root = str(tmp_path / "table")
    up.apply_batch(some(spark, 1, range(60)), 0, root, ["k"], ["at"], buckets=16)
    heads, before = up.heads(spark, root), files(root)
    one = spark.createDataFrame([(5, "x", 99, "new"), (5, "x", 98, "old")], KIND)
    touched = up.apply_batch(one, 1, root, ["k"], ["at"], buckets=16)
    assert len(touched) == 1 and {b: v for b, v in up.heads(spark, root).items() if v} == {touched[0]: 1}
    after = files(root)
    assert {p: t for p, t in after.items() if p in before} == before and len(heads) > 1
    assert [r.v for r in up.current(spark, root, one.schema).where("k = 5").collect()] == ["new"]
    assert up.apply_batch(one.limit(0), 2, root, ["k"], ["at"], buckets=16) == []


def test_a_batch_without_heads_does_not_count(spark, tmp_path):
    """A batch that stopped before its heads were written is not seen, and is taken in whole when run again."""
    root = str(tmp_path / "table")
    up.apply_batch(some(spark, 1, range(9)), 0, root, ["k"], ["at"], buckets=4)
    want = rows(up.current(spark, root, some(spark, 1, [1]).schema))
    up.apply_batch(some(spark, 2, range(9)), 1, root, ["k"], ["at"], buckets=4)
    tb.remove(spark, f"{root}/heads/batch=1")
    assert rows(up.current(spark, root, some(spark, 1, [1]).schema)) == want


def test_stream_takes_new_files_only(spark, tmp_path):
    landing, root, state = (str(tmp_path / x) for x in ("landing", "table", "state"))
    batches = [some(spark, seed, range(30)) for seed in (5, 6)]
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(landing)
        up.start_upsert(spark, landing, root, state, b.schema, ["k", "s"], ["at"], buckets=4).awaitTermination()
    up.start_upsert(spark, landing, root, state, b.schema, ["k", "s"], ["at"], buckets=4).awaitTermination()
    assert rows(up.current(spark, root, b.schema)) == rows(dedup_keep_last(batches[0].unionByName(batches[1]), ["k", "s"], ["at"]))


def test_a_batch_is_shuffled_and_sorted_once(spark, tmp_path, monkeypatch):
    """One exchange serves keep-last and the writing; no task sorts before it, and the writer needs no order of its own."""
    root, plans, write = str(tmp_path / "table"), [], DataFrameWriter.parquet

    def parquet(writer, path, *args, **options):
        if "/rows/" in path:
            writer._df.collect()
            plans.append([n.nodeName() for n in walk(writer._df._jdf.queryExecution().executedPlan())])
        write(writer, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    for number in range(2):
        up.apply_batch(some(spark, number, range(60)), number, root, ["k", "s"], ["at"], buckets=8)
    assert [(p.count("Exchange"), p.count("Sort")) for p in plans] == [(1, 1), (1, 1)]
    buckets = [f.parent.name for f in Path(root, "rows", "batch=1").rglob("*.parquet")]
    assert len(set(buckets)) > 1 and max(map(buckets.count, buckets)) <= up.PARTS


def test_a_large_bucket_is_shared_out(spark, tmp_path):
    """All rows in one bucket: several tasks sort and write it, and each key stays in one of them."""
    batch = spark.range(8000).selectExpr("cast(id % 4000 AS int) AS k", "'x' AS s", "cast(id AS int) AS at", "'v' AS v")
    root = str(tmp_path / "table")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        up.apply_batch(batch, 0, root, ["k", "s"], ["at"], buckets=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 1 < len(files(f"{root}/rows")) <= up.PARTS
    assert rows(up.current(spark, root, batch.schema)) == rows(dedup_keep_last(batch, ["k", "s"], ["at"]))


def test_landing_a_batch_again_replaces_it(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None), (None, None)], "`x.y` int, v string")
    judged = dq.with_verdict(df, ["x.y", "v"])
    for batch in (7, 8, 7):
        tb.land_batch(judged, path, batch, ["verdict"])
    found = {(r.batch, r.verdict): r["count"] for r in spark.read.parquet(path).groupBy("batch", "verdict").count().collect()}
    assert found == {(b, v): n for b in (7, 8) for v, n in (("accepted", 1), ("rejected", 3))}
    # a batch that has no rejected rows any more leaves none behind
    tb.land_batch(judged.where("verdict = 'accepted'"), path, 7, ["verdict"])
    assert spark.read.parquet(path).where("batch = 7").count() == 1


def test_constraints_are_measured_in_the_scan_that_writes(spark, sf_dir, tmp_path):
    ev = q.fx.events_fact(spark, sf_dir)
    rules = [dq.has_rows(), dq.not_null("occupation"), dq.max_width("diag_raw", 5), dq.filled("kind")]
    through, seen = dq.watched(ev, rules)
    assert through.collect() and seen.get["rows"] == ev.count()
    found = reads(through._jdf.queryExecution().executedPlan(), set())
    assert sum("/lineitem.parquet" in p for p in found) == 1
    report = {(r["constraint"], r.column_name): (r.rows, r.violations, r.passed)
              for r in dq.write_checked(ev, rules, str(tmp_path / "out")).collect()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == ev.count()
    assert report["not_null", "occupation"] == (ev.count(), ev.where("occupation is null").count(), False)
    assert report["rows_1", "*"][1:] == (0, True) and report["filled", "kind"][1:] == (0, True)


def test_constraints_of_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "a int, `b.c` string")
    rules = [dq.has_rows(), dq.not_null("a"), dq.filled("b.c"), dq.fits("a", "tinyint"), dq.one_of("b.c", ["x"])]
    report = [(r.violations, r.passed) for r in dq.write_checked(none, rules, str(tmp_path / "none")).collect()]
    assert report == [(1, False), (0, True), (1, False), (0, True), (0, True)]


def test_catalog_counts_whatever_is_listed(spark, sf_dir):
    names = tb.register_tables(spark, sf_dir, "cat_")
    assert set(q.ALL_TABLES) <= set(names)
    before = {r.table_name: r.n_rows for r in tb.catalog_counts(spark, "cat_").collect()}
    assert before["nation"] == 25 and set(before) == set(names)
    spark.range(17).createOrReplaceTempView("cat_added")
    after = {r.table_name: r.n_rows for r in tb.catalog_counts(spark, "cat_").collect()}
    assert after == before | {"added": 17}
    for n in [*names, "added"]:
        spark.catalog.dropTempView(f"cat_{n}")
    assert tb.catalog_counts(spark, "cat_").collect() == []


def test_text_with_bound_values_equals_its_dataframe_twin(spark, sf_dir):
    text, frame = (rows(q.QUERIES[n](spark, sf_dir).select("year", "adequate_months", "jobs", "events", "rate"))
                   for n in ("overall_rate_sql", "overall_rate_by_year"))
    assert text == frame and len(text) == 3


def test_a_hostile_value_stays_a_value(spark):
    t = spark.createDataFrame([("a", 1), ("x' OR '1'='1", 2), ("{t}; :term", 3)], "label string, n int")
    find = lambda term: [r.n for r in bq.bound(spark, "SELECT n FROM {t} WHERE label = :term", {"term": term}, t=t).collect()]
    assert find("a") == [1] and find("x' OR '1'='1") == [2] and find("{t}; :term") == [3]
    assert find("a' --") == [] and find("'; DROP VIEW t; --") == []


def test_subquery_null_rules(spark):
    """A NULL key is in no list and matches nothing, and its row stays under the flag."""
    ev = spark.createDataFrame([(1, "a"), (1, None), (1, "z"), (None, "a"), (2, "a")], "sector int, occupation string")
    occ = spark.createDataFrame([("a",), ("a",), (None,)], "code string")
    sec = spark.createDataFrame([(1, "A"), (None, "A"), (2, "C")], "sector4 int, section string")
    got = sorted((r.sector, r.known, r.events) for r in bq.known_by_sector(spark, ev, occ, sec, "B").collect())
    assert got == [(1, False, 2), (1, True, 1)]


@pytest.mark.parametrize("map_bytes", [jn.MAP_BYTES, 0])
def test_decoding_by_maps_and_by_joins(spark, map_bytes):
    """NULL codes, NULL and repeated keys, names with dots, two columns of one dictionary name."""
    facts = spark.createDataFrame([("1", 1, None), ("2", 9, "k"), (None, 2, "k"), ("1", None, "q")], "`a.b` string, n int, c string")
    dic = spark.sql("SELECT * FROM VALUES ('num', '1', 'one'), ('num', '1', 'eins'), ('num', '2', NULL), ('num', NULL, 'none'), "
                    "('c', 'k', 'K'), ('other', '1', 'no') AS d(column_name, key, value)")
    out = jn.decode_dictionary(facts, dic, {"a.b": "num", "n": "num", "c": "c"}, map_bytes=map_bytes)
    assert out.columns == ["a.b", "n", "c", "a.b_label", "n_label", "c_label"]
    assert rows(out) == rows(spark.createDataFrame([
        ("1", 1, None, "eins", "eins", None), ("2", 9, "k", None, None, "K"), (None, 2, "k", None, None, "K"),
        ("1", None, "q", "eins", None, None)], out.schema))
    out.collect()
    assert len(joins(out._jdf.queryExecution().executedPlan())) == (0 if map_bytes else 3)


def test_large_files_are_split_by_default(spark, tmp_path):
    spark.range(4000).select(F.col("id").cast("string").alias("a"), F.lit("é;\"x\"").alias("b"), F.lit("y").alias("c")) \
        .coalesce(1).write.option("sep", ";").option("header", "true").option("escape", '"').option("encoding", "ISO-8859-1").csv(str(tmp_path / "f"))
    from tests.test_parity import TEXT
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = tb.scan_csv(spark, str(tmp_path / "f"), TEXT)
        assert df.rdd.getNumPartitions() > 4
        assert df.where(F.col("b") == 'é;"x"').count() == df.select("a").distinct().count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
