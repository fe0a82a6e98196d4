"""Operator-level tests: equivalent plans agree, brute force on small fixtures."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratewise.functions import text as tx
from ratewise.operators import clean as cl
from ratewise.operators import joins as jn
from ratewise.operators import quality as dq
from ratewise.operators import windows as wn
from ratewise.sources import tables as tb


def rows(df):
    return sorted(tuple("" if v is None else v for v in r) for r in df.collect())


def test_dedup_window_equals_aggregate_on_lineitem(spark, sf_dir):
    li = tb.scan_table(spark, sf_dir, "lineitem")
    k, o = ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"]
    a = wn.dedup_keep_last(li, k, o)
    b = wn.dedup_keep_last_agg(li, k, o)
    assert rows(a) == rows(b)
    assert a.count() == li.select(*k).distinct().count()


def test_dedup_is_idempotent(spark, sf_dir):
    li = tb.scan_table(spark, sf_dir, "lineitem")
    k, o = ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"]
    once = wn.dedup_keep_last(li, k, o)
    assert rows(once) == rows(wn.dedup_keep_last(once, k, o))


def test_dedup_keeps_last_of_hot_key(spark):
    # one key holds most rows; the last in ingest order must win
    data = [("hot", i, f"v{i}") for i in range(5000)] + [("cold", 1, "c")]
    df = spark.createDataFrame(data, "k string, pos int, v string").repartition(8)
    got = {r.k: r.v for r in wn.dedup_keep_last(df, ["k"], ["pos"]).collect()}
    assert got == {"hot": "v4999", "cold": "c"}


def _ffill_pandas(pdf, group, order, col):
    pdf = pdf.sort_values(group + [order]).copy()
    pdf[col] = pdf.groupby(group)[col].ffill()
    return pdf


@pytest.mark.parametrize("chunk", [None, 7, 100, 10_000])
def test_fill_forward_matches_pandas(spark, sf_dir, chunk):
    ev = tb.scan_table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    got = wn.fill_forward(ev, ["user_id"], "event_id", ["v"], chunk=chunk).toPandas()
    exp = _ffill_pandas(ev.toPandas(), ["user_id"], "event_id", "v")
    m = got.merge(exp, on=["event_id", "user_id"], suffixes=("_s", "_p"))
    assert len(m) == len(exp)
    assert ((m.v_s == m.v_p) | (m.v_s.isna() & m.v_p.isna())).all()


def test_sector_dim_drops_headers_and_titles_before_fill(spark):
    sheet = spark.createDataFrame([
        (1, "Seção", "Divisão", "Grupo", "Classe", None),            # header
        (2, "A", None, None, None, "Agriculture"),
        (3, None, "1", None, None, "Crops"),
        (4, None, None, "01.1", None, "Annual crops"),
        (5, None, None, None, "01.11-3", "Cereal"),
        (6, "2.2 - detailed structure", None, None, None, None),     # title row
        (7, "Seção", "Divisão", "Grupo", "Classe", None),            # repeated header
        (8, None, None, None, "01.12-1", "Rice"),
        (9, "B", None, None, None, "Mining"),
        (10, None, "5", None, None, "Coal"),
        (11, None, None, "05.0", None, "Coal mining"),
        (12, None, None, None, "05.00-3", "Coal"),
    ], "pos int, section string, division string, grp string, class string, name string")
    out = cl.build_sector_dim(sheet, ["section", "division", "grp"], "pos", "grp", "Grupo", "class",
                              "class", "name", "section", pad_col="division", dotted_col="grp",
                              unknown={"class5": "99999", "class4": "9999", "name": "not classified"})
    got = sorted((r["class"] or "", r.section or "", r.division or "", r.grp or "", r.class5, r.class4)
                 for r in out.collect())
    assert got == [("", "", "", "", "99999", "9999"),
                   ("01.11-3", "A", "01", "011", "01113", "0111"),
                   ("01.12-1", "A", "01", "011", "01121", "0112"),
                   ("05.00-3", "B", "05", "050", "05003", "0500")]


def test_other_builders(spark):
    occ = cl.build_occupations(spark.createDataFrame([("010105", "Officer")], "CODIGO string, TITULO string"),
                               "CODIGO", "TITULO")
    assert sorted(tuple(r) for r in occ.collect()) == [("010105", "Officer"), ("999999", "not classified")]
    ex = cl.build_exposure(spark.createDataFrame([("8610101", "x", 3)], "sub string, descr string, jobs int"),
                           ["descr"], "sub", "class5")
    assert ex.columns == ["sub", "jobs", "class5"] and ex.first().class5 == "86101"
    no = spark.createDataFrame([("V89.", "S62", "2023-05-01", "bad", None)],
                               "CID_ACID string, CID_LESAO string, DT_ACID string, DT_NOTIFIC string, EVO_OUTR string")
    b = cl.build_notifications(no, ["cid_acid", "cid_lesao"], ["dt_acid", "dt_notific"], drop=["evo_outr"]).first()
    assert (b.cid_acid, b.cid_lesao, b.dt_acid, b.dt_notific) == ("V89", "S62", dt.date(2023, 5, 1), None)
    assert "evo_outr" not in b.asDict()


def test_decode_dictionary_distinct_and_unmatched(spark):
    dic = spark.createDataFrame([("sex", "1", "M"), ("sex", "1", "M"), ("sex", "2", "F"), ("race", "1", "X")],
                                "column_name string, key string, value string")
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 9), (None, None)], "sex int, race int")
    out = jn.decode_dictionary(df, dic, {"sex": "sex", "race": "race"})
    assert out.count() == 4                                  # no fan-out from the repeated row
    got = sorted((r.sex or 0, r.sex_label or "", r.race_label or "") for r in out.collect())
    assert got == [(0, "", ""), (1, "M", "X"), (2, "F", "X"), (3, "", "")]


def test_text_functions(spark):
    df = spark.createDataFrame(
        [("7", "410001-Harbour", "V89.", "01.11-3", " s602NU ", "{ñ class}"),
         ("0111", "123", "S62", "0111-2", "T10", "x"),
         ("01113", None, "A..", None, None, None)],
        "code string, mun string, cat string, cnae string, cid string, agent string")
    out = (df.select(tx.zero_pad("code", 5).alias("pad"), tx.before_sep("mun").alias("mun"),
                     tx.rstrip_char("cat", ".").alias("cat"), tx.remove_chars("cnae", ".-").alias("cnae"),
                     F.upper(tx.left(tx.strip_ws("cid"), 4)).alias("cid"),
                     tx.marker_to_null("agent", "{ñ class}").alias("agent")).collect())
    assert [tuple(r) for r in out] == [
        ("00007", "410001", "V89", "01113", "S602", None),
        ("00111", "123", "S62", "01112", "T10", "x"),
        ("01113", None, "A", None, None, None)]
    over = spark.createDataFrame([("123456",)], "c string").select(tx.zero_pad("c", 4)).first()[0]
    assert over == "123456"                                     # never truncates


def test_parse_dates_coerce(spark):
    df = spark.createDataFrame([("31/12/2023",), ("31/02/2023",), ("",), ("2023-12-31",), (None,)], "d string")
    got = [r.d for r in cl.parse_dates(df, ["d"]).collect()]
    assert got == [dt.date(2023, 12, 31), None, None, None, None]
    iso = [r.d for r in cl.parse_dates(df, ["d"], fmt=None).collect()]
    assert iso[3] == dt.date(2023, 12, 31) and iso[1] is None
    b = cl.generalise_birth(df, "d").collect()
    assert [r.birth_year for r in b] == [2023, None, None, None, None] and "d" not in b[0].asDict()


def test_strip_text_all_string_columns(spark):
    df = spark.createDataFrame([("\ta b \n", 1, " x")], "s string, i int, t string")
    assert tuple(cl.strip_text(df).first()) == ("a b", 1, "x")


def test_strip_ws_equals_python_strip_on_whole_documents(spark, sf_dir):
    """SF2 over every whole document text, against Python ``str.strip`` (brute force)."""
    docs = tb.scan_table(spark, sf_dir, "documents").select("doc_id", "text")
    got = {r.doc_id: r.t for r in docs.select("doc_id", tx.strip_ws("text").alias("t")).collect()}
    want = {r.doc_id: (None if r.text is None else r.text.strip()) for r in docs.collect()}
    assert got == want


def test_strip_ws_every_whitespace_code_point(spark):
    ws = tx.WHITESPACE
    vals = [ws + "a" + ws + "b" + ws, "　x\x1c", "​ y ​", "", ws, None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.t for r in df.select(tx.strip_ws("s").alias("t")).collect()]
    assert got == [None if v is None else v.strip() for v in vals]


def test_unknown_member_and_snake_names(spark):
    dim = spark.createDataFrame([("01", "Agro")], "CODE string, Title string")
    dim = cl.rename_snake(dim, {"Title": "label"})
    assert dim.columns == ["code", "label"]
    out = cl.add_unknown_member(dim, {"code": "999999", "label": "not classified"})
    assert sorted(r.code for r in out.collect()) == ["01", "999999"]


def test_geo_filter_variants(spark):
    df = spark.createDataFrame([("410001-Harbour", 410001), ("410002-X", 410002), (None, None)], "s string, n int")
    assert cl.geo_filter(df, "s", "410001", "prefix").count() == 1
    assert cl.geo_filter(df, "n", "410001", "cast").count() == 1
    assert cl.geo_filter(df, "n", 410002).count() == 1


def test_quality_checks(spark):
    fact = spark.createDataFrame([("a", "1234"), ("a", "12345"), ("b", None), ("z", "1"), (None, "2")],
                                 "k string, code string")
    dim = spark.createDataFrame([("a",), ("b",)], "k string")
    kc = dq.key_check(fact, ["k"]).first()
    assert (kc.rows, kc.distinct_keys, kc.duplicated_keys, kc.surplus_rows) == (5, 4, 1, 1)
    o = dq.orphans(fact, "k", dim, "k").first()
    assert (o.rows, o.orphan_rows, o.orphan_keys, o.pct_orphan) == (5, 1, 1, 20.0)
    assert [r.k for r in dq.orphan_rows(fact, "k", dim, "k").collect()] == ["z"]
    assert dq.width_check(fact, {"code": 4}).first().code_too_long == 1
    ok, bad = dq.split_not_null(fact, ["k", "code"])
    assert (ok.count(), bad.count()) == (3, 2)
    e = {r.column_name: (r.non_null, r.all_null) for r in dq.empty_columns(fact.withColumn("x", F.lit(None).cast("int"))).collect()}
    assert e == {"k": (4, False), "code": (4, False), "x": (0, True)}
    r = dq.range_check(spark.createDataFrame([(1.5,), (123.456,), (None,)], "v double"), "v", "decimal(4,2)").first()
    assert (r.non_null, r.out_of_range) == (2, 1)
    oo = dq.one_to_one(spark.createDataFrame([("0111", "01113"), ("0111", "01114"), ("0112", "01121")],
                                             "k4 string, k5 string"), "k4", "k5").first()
    assert (oo.short_keys, oo.ambiguous_keys) == (2, 1)


def test_top_n_per_group_matches_pandas(spark, sf_dir):
    """SL4/WN6: first n rows per group (explicit tie-break) against pandas."""
    li = tb.scan_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    order = [F.col("l_quantity").desc(), F.col("l_orderkey").asc(), F.col("l_linenumber").asc()]
    got = sorted((r.l_suppkey, r.l_orderkey, r.l_linenumber, r.ranking)
                 for r in wn.top_n_per_group(li, ["l_suppkey"], order, 3).collect())
    pdf = li.toPandas().sort_values(["l_suppkey", "l_quantity", "l_orderkey", "l_linenumber"],
                                    ascending=[True, False, True, True])
    pdf["ranking"] = pdf.groupby("l_suppkey").cumcount() + 1
    want = sorted((int(a), int(b), int(c), int(d)) for a, b, c, d in
                  pdf[pdf.ranking <= 3][["l_suppkey", "l_orderkey", "l_linenumber", "ranking"]].itertuples(index=False))
    assert got == want


@pytest.mark.parametrize("ranges", [1, 3, 7])
def test_running_sum_matches_pandas(spark, sf_dir, ranges):
    """WN3/WN5: running sum per group in (n desc, key) order, one window or range pieces."""
    li = tb.scan_table(spark, sf_dir, "lineitem")
    per = li.groupBy((F.col("l_suppkey") % 3).alias("g"), "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), F.col("l_partkey").asc()]
    got = {(r.g, r.l_partkey): r.run for r in wn.running_sum(per, "n", order, "run", ["g"], ranges).collect()}
    pdf = per.toPandas().sort_values(["g", "n", "l_partkey"], ascending=[True, False, True])
    pdf["run"] = pdf.groupby("g")["n"].cumsum()
    assert got == {(int(g), int(k)): int(r) for g, k, r in pdf[["g", "l_partkey", "run"]].itertuples(index=False)}
    flat = {r.l_partkey: r.run for r in wn.running_sum(per.where("g = 0"), F.lit(1), order, "run",
                                                        ranges=ranges).collect()}
    assert sorted(flat.values()) == list(range(1, len(flat) + 1))


def test_identifiers_dropped_after_dedup(spark):
    """CL8: identifiers are removed only after the keep-last dedup has used the rows."""
    raw = spark.createDataFrame([(1, "s62", "E1", "10/01/2024", "a"), (1, "s62", "E2", "11/01/2024", "b"),
                                 (2, "t10", "E3", "12/01/2024", "c")],
                                "id int, cid string, employer string, d string, v string")
    out = cl.build_events(raw, ["id", "cid"], ["v"], "cid", None, ["d"], ["employer"])
    assert "employer" not in out.columns
    got = sorted((r.id, r.cid, r.v, r.d) for r in out.collect())
    assert got == [(1, "S62", "b", dt.date(2024, 1, 11)), (2, "T10", "c", dt.date(2024, 1, 12))]
