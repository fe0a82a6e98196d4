"""Parity with the usual CSV and date readers, exact column names, and traps K7 and K12."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewise.functions import text as tx
from ratewise.operators import clean as cl
from ratewise.operators import joins as jn
from ratewise.operators import quality as dq
from ratewise.plans import shares as sh
from ratewise.sources import fixtures as fx
from ratewise.sources import tables as tb

TEXT = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b", "c")])


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    body = 'a;b;c\n007;"say ""hi"" now";x\n1;"two\nlines; one field";y\n2;plain;z\n'
    (tmp_path / "f.csv").write_text(body, encoding="latin-1")
    got = tb.scan_csv(spark, str(tmp_path / "f.csv"), TEXT, multi_line=True).select("a", "b", "c").toPandas()
    want = pd.read_csv(tmp_path / "f.csv", sep=";", dtype=str, encoding="latin-1")
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_csv_rows_that_do_not_fit_are_kept(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a;b;c\n1;2;3\n1;2;3;extra\n1;2\n")
    rows = tb.scan_csv(spark, str(tmp_path / "f.csv"), TEXT).collect()
    assert [r[tb.CORRUPT] for r in rows] == [None, "1;2;3;extra", "1;2"]
    with pytest.raises(Exception):
        tb.scan_csv(spark, str(tmp_path / "f.csv"), TEXT, corrupt=None).collect()


def test_equal_file_names_in_two_folders_keep_path_order(spark, tmp_path):
    for folder, value in (("2001", "old"), ("2002", "new")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "data.csv").write_text(f"a;b;c\nk;{value};\n")
    df = tb.scan_many_ordered(spark, [str(tmp_path / "2002" / "data.csv"), str(tmp_path / "2001" / "data.csv")], TEXT)
    assert [r.b for r in df.orderBy("_file", "_split", "_row").collect()] == ["old", "new"]


def test_a_table_written_again_is_read_again(spark, tmp_path):
    path = str(tmp_path)
    spark.range(3).write.parquet(f"{path}/t.parquet")
    assert tb.scan_table(spark, path, "t").count() == 3
    spark.range(5).write.mode("overwrite").parquet(f"{path}/t.parquet")
    assert tb.scan_table(spark, path, "t").count() == 5


def test_dates_with_one_digit_and_without_separators(spark):
    df = spark.createDataFrame([("1/2/2023", "20230105"), ("31/12/2023", "2023-01-05"), ("31/02/2023", "20230231"),
                                ("", "x"), (None, None)], "d string, iso string")
    got = cl.parse_dates(cl.parse_dates(df, ["d"]), ["iso"], fmt=None).collect()
    assert [r.d for r in got] == [dt.date(2023, 2, 1), dt.date(2023, 12, 31), None, None, None]
    assert [r.iso for r in got] == [dt.date(2023, 1, 5), dt.date(2023, 1, 5), None, None, None]
    assert [r.birth_year for r in cl.generalise_birth(df, "d").collect()] == [2023, 2023, None, None, None]


def test_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([(" x\t", "k", 1), (" y", "k", 2)], "`CBO.1` string, `a b` string, n int")
    assert [r["CBO.1"] for r in cl.strip_text(df).collect()] == ["x", "y"]
    assert {(r.column_name, r.non_null) for r in dq.empty_columns(df).collect()} == {("CBO.1", 2), ("a b", 2), ("n", 2)}
    from ratewise.operators.windows import dedup_keep_last
    assert [r.n for r in dedup_keep_last(df, ["a b"], ["n"]).collect()] == [2]
    assert cl.geo_filter(df, "CBO.1", " y").count() == 1


def test_label_search_folds_accents(spark):
    df = spark.createDataFrame([("CONSTRUÇÃO CIVIL",), ("comércio",), (None,)], "label string")
    assert df.where(tx.regex_contains_ci("label", "construção")).count() == 1
    assert df.where(tx.regex_contains_ci("label", "COMÉR")).count() == 1


def test_decode_hot_codes_and_large_dictionary(spark):
    facts = spark.range(2000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("a"),
                                     (F.col("id") % 7).alias("b"))
    rows = [("a", "hot", "Hot"), ("a", "hot", "Hotter"), ("b", "1", "one")] + [("a", str(k), f"n{k}") for k in range(0, 40)]
    dic = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, rows)) + " AS d(column_name, key, value)")
    small = jn.decode_dictionary(facts, dic, {"a": "a", "b": "b"})
    large = jn.decode_dictionary(facts, dic, {"a": "a", "b": "b"}, map_bytes=3)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert small.where("a_label = 'Hot'").count() == facts.where("a = 'hot'").count() and small.count() == 2000


def test_or_join_is_one_left_join(spark):
    facts = spark.createDataFrame([("A", 1), ("A/1", 2), (None, 3), ("X", 4), ("S", 5)], "code string, n int")
    dim = spark.createDataFrame([("A/1", "A", "s1", "c"), ("A/2", "A", "s2", "c"), ("S", "S", "s", "cs"), (None, "N", "x", "y")],
                                "sub string, cat string, sub_label string, cat_label string")
    got = sorted((r.n, r.sub_label) for r in jn.or_join_labels(facts, dim).where("n <> 3 and n <> 4").collect())
    assert got == [(1, "s1"), (1, "s2"), (2, "s1"), (5, "s")]
    assert jn.or_join_labels(facts, dim).where("sub_label is null").count() == 2


def test_k7_report_year_and_place_filter(spark):
    """The period of A20 is the report year, and a place filter compares as text."""
    rows = [(dt.date(1999, 12, 31), 2000, 1, None, "3"), (dt.date(2000, 1, 1), 2000, 2, None, "3"),
            (dt.date(2000, 1, 1), 2000, 2, None, "30"), (dt.date(2000, 5, 5), 1999, 1, None, "3"),
            (dt.date(2000, 1, 1), 2000, 9, None, None)]
    notes = spark.createDataFrame(rows, "event_date date, report_year int, status int, flag string, residence string")
    s = fx.Study()
    whole = {(r.year, r.group): r.notices for r in sh.status_by_year(notices=notes, s=s, years=[2000]).collect()}
    assert whole == {(2000, "formal"): 1, (2000, "informal"): 2, (2000, "not informed"): 1}
    here = {(r.year, r.group): (r.notices, r.pct_in_year)
            for r in sh.status_by_year(notes, s, [2000], "residence", "3").collect()}
    assert here == {(2000, "formal"): (1, 50.0), (2000, "informal"): (1, 50.0)}


def test_k12_null_order(spark, monkeypatch):
    """Descending rates: NULL first in the ranking (as in SQL), last in the page's search; NULL codes
    come last among ties of the composition."""
    from ratewise.plans import rates
    s = fx.Study()
    table = spark.createDataFrame([(1, "a", 2.0, 1.0, 5.0), (2, "b", 2.0, None, None), (3, "c", 2.0, 3.0, 7.0)],
                                  "sector int, label string, rate_1998 double, rate_1999 double, rate_2000 double")
    monkeypatch.setattr(rates, "sector_rate_table", lambda *a, **k: table)
    assert [r.sector for r in rates.sector_rate_ranking(spark, None, None, None, s).collect()] == [2, 3, 1]
    assert [r.sector for r in rates.ranking_search(spark, None, None, None, s, None, 1999, 5).collect()] == [3, 1, 2]
    ev = spark.createDataFrame([(dt.date(1998, 1, 1), c) for c in (None, "b", "a")], "event_date date, occupation string")
    dim = spark.createDataFrame([("a", "x")], "code string, label string")
    got = [r.code for r in sh.composition_share(spark, ev, F.col("occupation"), dim, s, "-").collect()]
    assert got == ["a", "b", None]
