"""NULL groups: kept by totals, running sums and fills, whatever the ranges and chunks."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratewise.operators import windows as wn
from ratewise.plans.shares import with_total


@pytest.fixture(scope="module")
def grouped(spark):
    rows = [(g, i, (i * 7) % 5 + 1) for i, g in enumerate(["a", None, "b", None, "a", None, "b", "a"] * 6)]
    return spark.createDataFrame(rows, "g string, i int, v int").repartition(3)


@pytest.mark.parametrize("ranges", [None, 1, 2, 3, 7])
def test_running_sum(grouped, ranges):
    got = wn.running_sum(grouped, "v", [F.col("i")], "run", ["g"], ranges).toPandas()
    want = grouped.toPandas().sort_values("i")
    want["run"] = want.groupby("g", dropna=False)["v"].cumsum()
    cols = ["g", "i", "v", "run"]
    pd.testing.assert_frame_equal(got.sort_values("i")[cols].reset_index(drop=True),
                                  want[cols].reset_index(drop=True), check_dtype=False)


def test_with_total(grouped):
    rows = with_total(grouped, "v", ["g"]).collect()
    totals = grouped.toPandas().groupby("g", dropna=False)["v"].sum()
    assert len(rows) == grouped.count()
    by = {None if pd.isna(k) else k: v for k, v in totals.items()}
    assert all(r["_total"] == by[r.g] for r in rows)


@pytest.mark.parametrize("chunk", [None, 1, 3, 10, 1000])
@pytest.mark.parametrize("levels", [0, 1, 2])
def test_fill_forward(grouped, chunk, levels):
    sparse = grouped.withColumn("x", F.when(F.col("i") % 5 == 1, F.col("v"))).withColumn("y.z", F.when(F.col("i") % 7 == 2, "t"))
    got = wn.fill_forward(sparse, ["g"], "i", ["x", "y.z"], chunk, levels).toPandas().sort_values("i").reset_index(drop=True)
    want = sparse.toPandas().sort_values("i").reset_index(drop=True)
    want[["x", "y.z"]] = want.groupby("g", dropna=False)[["x", "y.z"]].ffill()
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)
