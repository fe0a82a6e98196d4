"""Dense line numbers, ranges by quantiles, running sums and exact medians without a funnel."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewise.operators import ranks as rk
from ratewise.operators import windows as wn
from ratewise.sources import tables as tb

SHEET = T.StructType([T.StructField(c, T.StringType()) for c in ("level", "leaf")])


@pytest.fixture(scope="module")
def sheet(tmp_path_factory):
    """Three folders with files of several lengths, one empty, equal names in two of them."""
    root = tmp_path_factory.mktemp("sheet")
    lines, n = [], 0
    for folder, sizes in (("2001", (40, 1)), ("2002", (0, 333)), ("2010", (5,))):
        (root / folder).mkdir()
        for k, size in enumerate(sizes):
            rows = [(f"L{n + i}" if (n + i) % 9 == 0 else "", f"leaf {n + i}") for i in range(size)]
            n += size
            lines += rows
            (root / folder / f"part{k}.csv").write_text("level;leaf\n" + "".join(f"{a};{b}\n" for a, b in rows), encoding="latin-1")
    return root, lines


@pytest.mark.parametrize("split", ["1g", "512b", "97b"])
def test_line_numbers_do_not_depend_on_splits(spark, sheet, split):
    root, lines = sheet
    paths = [str(root / f) for f in ("2010", "2001", "2002")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = wn.number_lines(tb.scan_many_ordered(spark, paths, SHEET))
        got = sorted((r.line, r.level, r.leaf) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(k, a or None, b) for k, (a, b) in enumerate(lines, 1)]


def test_line_numbers_feed_the_fill(spark, sheet):
    root, lines = sheet
    df = wn.number_lines(tb.scan_many_ordered(spark, str(root / "*"), SHEET), "no")
    got = {r.no: r.level for r in wn.fill_hierarchy(df, ["level"], "no", "level", "none", "leaf", ranges=5).collect()}
    assert got == {k: f"L{(k - 1) // 9 * 9}" for k in range(1, len(lines) + 1)}


#: name, then nothing, 'desc', or the name of a sort order
ORDERS = ["v", "v desc", "t desc, v", "t asc_nulls_last, d desc_nulls_last, v", "x desc, v asc", "d desc_nulls_first, v desc",
          "b desc, v", "ts desc, v desc", "a.b, v"]


def sort_orders(text):
    """Columns of an order; names alone stay names."""
    out = []
    for item in text.split(", "):
        name, _, how = item.partition(" ")
        out.append(getattr(F.col(name), how)() if how else name)
    return out


@pytest.fixture(scope="module")
def kinds(spark):
    """Rows with NULLs, prefixes, negative numbers and ties in columns of several types; v is unique."""
    rng = random.Random(4)
    rows = []
    for v in range(300):
        t = rng.choice([None, "", "a", "ab", "abc", "b", "é", "\U0001f600"])
        d = rng.choice([None, dt.date(1960, 1, 1), dt.date(2020, 2, 2)])
        rows.append((v - 150, t, d, rng.choice([None, -1.5, 0.0, 2.5]), rng.choice([None, True, False]),
                     rng.choice([None, dt.datetime(1950, 1, 1), dt.datetime(2001, 1, 1, 1)]), rng.choice([None, 1, 2])))
    return spark.createDataFrame(rows, "v int, t string, d date, x double, b boolean, ts timestamp, `a.b` int").repartition(5)


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("ranges", [1, 4, 9])
def test_running_sum_in_any_order(kinds, order, ranges):
    """Descending texts, dates and numbers, NULLs at either end: as one window gives it."""
    order = sort_orders(order)
    got = {r.v: (r.run, r.place, r.whole) for r in
           wn.running_sum(kinds, "v", order, "run", ranges=ranges, count="place", total="whole").collect()}
    w = Window.orderBy(*[F.col(f"`{o}`") if isinstance(o, str) else o for o in order])
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = kinds.select("v", F.sum("v").over(upto).alias("run"), F.row_number().over(w).alias("place")).collect()
    whole = sum(r.v for r in plain)
    assert got == {r.v: (r.run, r.place, whole) for r in plain}


def test_ranges_follow_the_rows(spark):
    """A sparse order and a group with two thirds of the rows: ranges of like size, the same whenever they are taken."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("g"),
                                  (F.col("id") * F.col("id") * 10 ** 9).alias("at"))
    key = wn.order_key(df, ["g", "at"])
    sizes = wn.with_range(df, key, 20).groupBy("_range").count()
    first, again = ({r["_range"]: r["count"] for r in s.collect()} for s in (sizes, sizes.coalesce(1)))
    assert first == again and sum(first.values()) == 6000
    assert len(first) >= 18 and max(first.values()) < 3 * 300


def test_order_by_an_expression_is_refused(kinds):
    with pytest.raises(ValueError):
        wn.order_key(kinds, [(F.col("v") + 1).desc()])


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_fill_by_ranges_matches_pandas(spark, sf_dir, ranges):
    ev = tb.scan_table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 3 > 0, F.col("user_id")).alias("u"), (F.col("event_id") * F.lit(10 ** 12)).alias("at"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    want = ev.toPandas().sort_values("at")
    want["v"] = want.groupby("u", dropna=False)["v"].ffill()
    got = wn.fill_forward(ev, ["u"], "at", ["v"], ranges=ranges).toPandas().sort_values("at")
    pd.testing.assert_series_equal(got["v"].reset_index(drop=True), want["v"].reset_index(drop=True))


@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_group_median_matches_pandas(spark, ranges):
    """Even and odd counts, ties, NULL values, a group without values, a NULL group and a hot one."""
    rng = random.Random(9)
    rows = [("hot", rng.choice([rng.random() * 100, 7.0])) for _ in range(2001)]
    rows += [(None, float(k)) for k in range(10)] + [("odd", 3.0), ("odd", 1.0), ("odd", None), ("odd", 9.0), ("none", None), ("none", None)]
    rows += [(f"g{k % 40}", float(rng.randint(-5, 5))) for k in range(300)]
    df = spark.createDataFrame(rows, "`g.x` string, v double").repartition(4)
    got = {r["g.x"]: (r["rows"], r["median"]) for r in rk.group_median(df, ["g.x"], "v", ranges=ranges).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    want = {None if pd.isna(k) else k: (int(v["v"].count()), None if v["v"].isna().all() else v["v"].median())
            for k, v in pdf.groupby("g", dropna=False)}
    assert got == {k: (n, m if m is None else pytest.approx(m)) for k, (n, m) in want.items()}
    whole = rk.group_median(df, [], "v", ranges=ranges).collect()
    assert [(r["rows"], r["median"]) for r in whole] == [(int(pdf.v.count()), pytest.approx(pdf.v.median()))]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert rk.group_median(none, ["g"], "v").collect() == []
    assert wn.running_sum(none, "v", ["v"], "run", ["g"]).collect() == []
    assert wn.fill_forward(none, ["g"], "v", ["v"], ranges=3).collect() == []
