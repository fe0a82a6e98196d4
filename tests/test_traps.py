"""Semantic traps K1–K21 on hand-made frames."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ratewise.functions.exact import percent_half_up, ratio_half_up
from ratewise.operators import joins as jn
from ratewise.operators import windows as wn
from ratewise.operators import clean as cl
from ratewise.plans import coverage as cv
from ratewise.plans import rates as rt
from ratewise.plans import shares as sh
from ratewise.sources.fixtures import Study

EV_SCHEMA = ("event_id bigint, event_date date, sector int, occupation string, diag_raw string, "
             "kind string, death string, sex string, birth_year int, status int, diag_code string")
DEFAULT = dict(sector=1, occupation="A", diag_raw="X10 ", kind="SMALL ", death="N", sex="Male",
               birth_year=1990, status=1, diag_code=None)


def events(spark, rows):
    out = []
    for i, r in enumerate(rows):
        d = {**DEFAULT, **r}
        out.append((i, d["event_date"], d["sector"], d["occupation"], d["diag_raw"], d["kind"],
                    d["death"], d["sex"], d["birth_year"], d["status"], d["diag_code"]))
    return spark.createDataFrame(out, EV_SCHEMA)


def D(y, m, d=15):
    return dt.date(y, m, d)


def many(date, n, **kw):
    return [dict(event_date=date, **kw) for _ in range(n)]


def test_k1_median_includes_zero_months(spark):
    # monthly counts 10, 0, 10, 4 → median over all four months = 7, threshold 3.5
    ev = events(spark, many(D(2023, 1), 10) + many(D(2023, 3), 10) + many(D(2023, 4), 4))
    cov = {r.month: (r.events, r.adequate) for r in
           cv.coverage_monthly(spark, ev, "2023-01-01", "2023-04-01").collect()}
    assert cov["2023-02"] == (0, False)
    assert cov["2023-04"] == (4, True)          # would fail if zeros were left out
    assert len(cov) == 4


def test_k1_exact_half_of_median_is_adequate(spark):
    ev = events(spark, many(D(2023, 1), 10) + many(D(2023, 2), 10) + many(D(2023, 3), 5))
    cov = {r.month: r.adequate for r in cv.coverage_monthly(spark, ev, "2023-01-01", "2023-03-01").collect()}
    assert cov["2023-03"] is True


def test_k16_k17_events_outside_calendar_ignored(spark):
    ev = events(spark, many(D(2023, 1), 3) + many(D(2026, 1), 50) + many(D(2022, 12), 50))
    rows = cv.coverage_monthly(spark, ev, "2023-01-01", "2023-02-01").collect()
    assert [(r.month, r.events) for r in sorted(rows)] == [("2023-01", 3), ("2023-02", 0)]


def test_k18_calendar_end_day_inside_month(spark):
    a = cv.calendar(spark, "2023-01-01", "2025-12-01").count()
    b = cv.calendar(spark, "2023-01-01", "2025-12-31").count()
    assert a == b == 36


def test_comparable_months(spark):
    # every month has 10 events except Feb 2024 (1): Feb is adequate only in 2023
    rows = [e for y, m in [(2023, m) for m in range(1, 13)] + [(2024, 1)] for e in many(D(y, m), 10)]
    rows += many(D(2024, 2), 1)
    cov = cv.coverage(spark, events(spark, rows), "2023-01-01", "2024-02-01")
    got = sorted(r.month_of_year for r in cv.comparable_months(cov, 2023, 2024).collect())
    assert got == [1]


def _exposure(spark, rows):
    return spark.createDataFrame(rows, "year int, sector5 int, jobs bigint, active_jobs bigint, postcode string")


def _sectors(spark, ids):
    return spark.createDataFrame([(i, i, f"S{i}", "A") for i in ids],
                                 "sector4 int, sector5 int, label string, section string")


def test_k2_year_without_adequate_month_gives_null_rate(spark):
    s = Study(calendar_start="2023-01-01", calendar_end="2024-12-01", rate_years=(2023, 2024),
              min_jobs_per_year=0, min_events=0)
    rows = []
    for m in range(1, 13):
        rows += many(D(2023, m), 10)
    rows += many(D(2024, 1), 1)        # 2024: far below half the median in every month
    ev = events(spark, rows)
    ex = _exposure(spark, [(2023, 1, 1000, 0, "x"), (2024, 1, 1000, 0, "x")])
    out = {r.year: r for r in rt.overall_rate_by_year(spark, ev, ex, s).collect()}
    assert out[2023].adequate_months == 12 and out[2023].rate == 120.0
    assert 2024 not in out or out[2024].rate is None
    t = rt.sector_rate_table(spark, ev, ex, _sectors(spark, [1]), s).collect()[0]
    assert t.rate_2023 == 120.0 and t.rate_2024 is None


def test_k9_expected_equals_observed_in_total(spark):
    s = Study(period_start="2023-01-01", period_end="2023-12-31", rate_years=(2023,), min_job_years=0)
    ev = events(spark, many(D(2023, 3), 30, sector=1) + many(D(2023, 5), 10, sector=2)
                + many(D(2023, 6), 20, sector=3))
    ex = _exposure(spark, [(2023, 1, 1000, 0, "a"), (2023, 2, 3000, 0, "b"), (2023, 3, 2000, 0, "c")])
    t = rt.expected_vs_observed_table(ev, ex, _sectors(spark, [1, 2, 3]), s).collect()
    # expected = jobs × 60/6000 = jobs / 100 → 10, 30, 20: exact integers here
    assert sum(r.expected for r in t) == sum(r.events for r in t) == 60
    assert {r.sector: r.gap for r in t} == {1: -20.0, 2: 20.0, 3: 0.0}


def test_k9_unmatched_events_count_in_overall_rate(spark):
    s = Study(period_start="2023-01-01", period_end="2023-12-31", rate_years=(2023,), min_job_years=0)
    ev = events(spark, many(D(2023, 3), 10, sector=1) + many(D(2023, 3), 10, sector=None))
    ex = _exposure(spark, [(2023, 1, 1000, 0, "a")])
    t = rt.expected_vs_observed_table(ev, ex, _sectors(spark, [1]), s).collect()[0]
    assert t.expected == 20.0 and t.observed_over_expected == 0.5
    u = rt.unmatched_event_share(ev, ex, _sectors(spark, [1]), s).collect()[0]
    assert (u.events, u.in_sector_without_jobs, u.pct) == (20, 10, 50.0)


def _occ(spark):
    return spark.createDataFrame([("A", "occ A"), ("B", "occ B")], "code string, label string")


def test_k3_k4_null_code_in_totals_but_not_in_yearly_shares(spark):
    s = Study(calendar_start="2023-01-01", calendar_end="2024-12-01", period_start="2023-01-01",
              period_end="2024-12-31", compare_years=(2023, 2024), top_n=10)
    rows = []
    for y in (2023, 2024):
        for m in range(1, 13):
            rows += many(D(y, m), 2, occupation="A") + many(D(y, m), 1, occupation=None)
            rows += many(D(y, m), 1, occupation="Z")
    ev = events(spark, rows)
    out = {r.code: r for r in sh.composition_share(spark, ev, F.col("occupation"), _occ(spark), s,
                                                   "(outside)").collect()}
    assert out[None].events == 24 and out[None].pct_total == 25.0
    assert out[None].pct_2023 == 0.0 and out[None].label == "(outside)"   # K3
    # K4: the NULL rows stay in the yearly denominator → A is 50 %, not 66.7 %
    assert out["A"].pct_2023 == 50.0
    assert out["Z"].label == "(outside)"
    assert [out[c].pct_cumulative for c in ("A", "Z")] == [50.0, 75.0]
    assert out[None].pct_cumulative == 100.0             # NULL sorts last on the tie


def test_k3_stacked_replaces_null_by_ni_with_real_shares(spark):
    s = Study(calendar_start="2023-01-01", calendar_end="2024-12-01", period_start="2023-01-01",
              period_end="2024-12-31", compare_years=(2023, 2024))
    rows = []
    for y in (2023, 2024):
        for m in range(1, 13):
            rows += many(D(y, m), 3, occupation="A") + many(D(y, m), 1, occupation=None)
    diag = spark.createDataFrame([("X10/1", "X10", "X10", "s", "cat X10")],
                                 "sub string, cat string, cat3 string, sub_label string, cat_label string")
    out = {(r.dimension, r.code): r for r in
           sh.composition_stacked_all(spark, events(spark, rows), _occ(spark), diag, s).collect()}
    ni = out[("occupation", "NI")]
    assert ni.pct_2023 == 25.0 and ni.description == "not informed" and ni.ranking == 2
    assert out[("diagnosis", "X10")].description == "cat X10"
    # Dropping NI keeps positions
    shown = sh.not_informed_toggle(sh.composition_stacked_all(spark, events(spark, rows), _occ(spark),
                                                              diag, s), "occupation", 5).collect()
    assert [(r.code, r.ranking) for r in shown] == [("A", 1)]


def test_k5_null_and_unknown_flags_are_separate_rows(spark):
    s = Study(period_start="2023-01-01", period_end="2023-12-31")
    no = spark.createDataFrame(
        [(D(2023, 1), 2023, 1, f, "1") for f in ["F", "F", None, "Q", "X"]],
        "event_date date, report_year int, status int, flag string, residence string")
    rows = sorted((r.flag_label, r.notices) for r in sh.followup_flag_share(no, s).collect())
    assert rows == [("issued", 2), ("no information", 1), ("no information", 1), ("not issued", 1)]
    tot = sh.no_followup_share(sh.followup_flag_share(no, s), ["not issued", "no information"]).collect()[0]
    assert tot.pct_without_followup == pytest.approx(60.0)


@pytest.mark.parametrize("groups,expected", [
    (Study().status_groups, {1: "formal", 2: "unregistered", 6: "other", 10: "unregistered", 12: "other",
                             99: "unknown", None: "unknown"}),
    (Study().status_groups_yearly, {1: "formal", 4: "informal", 7: "other ties", 8: "not informed",
                                    None: "not informed"}),
    (Study().status_groups_coarse, {1: "formal", 3: "informal", 5: "other or not informed",
                                    None: "other or not informed"}),
])
def test_k6_status_mappings_are_parameters(spark, groups, expected):
    other = {Study().status_groups: "unknown", Study().status_groups_yearly: "not informed",
             Study().status_groups_coarse: "other or not informed"}[groups]
    df = spark.createDataFrame([(k,) for k in expected], "status int")
    got = {r.status: r.g for r in df.select("status", sh.bucket(F.col("status"), groups, other).alias("g")).collect()}
    assert got == expected


def _diag(spark):
    return spark.createDataFrame(
        [("S62/0", "S62", "S62", "sub S62.0", "cat S62"), ("S62/1", "S62", "S62", "sub S62.1", "cat S62"),
         ("T10/0", "T10", "T10", "sub T10.0", "cat T10")],
        "sub string, cat string, cat3 string, sub_label string, cat_label string")


def test_k8_or_join_fans_out_category_codes(spark):
    facts = spark.createDataFrame([("S62", 5), ("S62/1", 2), ("Q99", 1), (None, 4)], "code string, n bigint")
    got = sorted((r.code or "", r.sub_label or "", r.n) for r in jn.or_join_labels(facts, _diag(spark)).collect())
    assert got == [("", "", 4), ("Q99", "", 1), ("S62", "sub S62.0", 5), ("S62", "sub S62.1", 5),
                   ("S62/1", "sub S62.1", 2)]
    exact = sorted((r.code or "", r.sub_label, r.cat_label) for r in
                   jn.or_join_labels(facts, _diag(spark), prefer_exact=True).collect())
    assert exact == [("", None, None), ("Q99", None, None), ("S62", None, "cat S62"),
                     ("S62/1", "sub S62.1", "cat S62")]


def test_k8_or_join_equals_nested_loop(spark):
    facts = spark.createDataFrame([(c,) for c in ["S62", "S62/0", "T10", "T10/0", None, "Z"] * 3], "code string")
    d = _diag(spark)
    def norm(rows):
        return sorted(tuple("" if v is None else v for v in r) for r in rows)
    fast = norm(jn.or_join_labels(facts, d).select("code", "sub_label", "cat_label").collect())
    slow = norm(facts.join(d, (facts.code == d.sub) | (facts.code == d.cat), "left")
                .select("code", "sub_label", "cat_label").collect())
    assert fast == slow and len(fast) == 3 * 7


def test_k10_sector_pct_base_is_matched_total(spark):
    s = Study(period_start="2023-01-01", period_end="2023-12-31")
    ev = events(spark, many(D(2023, 1), 3, sector=1) + many(D(2023, 1), 1, sector=9))
    r = sh.sector_counts_by_type(ev, _sectors(spark, [1]), s).collect()
    assert [(x.sector, x.events, x.pct_total) for x in r] == [(1, 3, 100.0)]
    assert sh.event_summary(ev, s).collect()[0].total == 4


def test_k11_ties_at_limit_broken_by_key(spark):
    s = Study(calendar_start="2023-01-01", calendar_end="2023-01-01", period_start="2023-01-01",
              period_end="2023-12-31", compare_years=(2023, 2023), top_n=2)
    ev = events(spark, many(D(2023, 1), 2, occupation="C") + many(D(2023, 1), 2, occupation="B")
                + many(D(2023, 1), 2, occupation="A"))
    for _ in range(3):
        got = [r.code for r in sh.composition_share(spark, ev, F.col("occupation"), _occ(spark), s, "-").collect()]
        assert got == ["A", "B"]


def test_k13_kind_spellings(spark):
    s = Study(period_start="2023-01-01", period_end="2023-12-31", kind_typical_one="T_pico",
              kind_typical_like="T%pico", kind_commute="Trajeto", kind_disease_like="Doen%")
    kinds = ["Típico", "TIPICO", "T?pico ", "Trajeto  ", "TRAJETO", "Doença", "Tpico"]
    ev = events(spark, [dict(event_date=D(2023, 1), kind=k) for k in kinds])
    r = sh.event_summary(ev, s).collect()[0]
    assert (r.typical, r.commute, r.disease) == (3, 1, 1)   # '_' needs one char, '=' is case-sensitive
    c = sh.sector_counts_by_type(ev, _sectors(spark, [1]), s).collect()[0]
    assert (c.typical, c.commute) == (4, 2)                  # '%' also matches 'Tpico'; ILIKE folds case


def test_k14_category_with_dot_differs_between_rules(spark):
    df = spark.createDataFrame([(" s6.2x ",), ("S62.1",), ("v89.",)], "diag_raw string")
    a = [r[0] for r in df.select(sh.diagnosis_category_sql()).collect()]
    b = [r[0] for r in df.select(sh.diagnosis_category_dotless()).collect()]
    assert a == ["S6.", "S62", "V89"] and b == ["S62", "S62", "V89"]


def test_k15_age_band_edges(spark):
    ages = [(24, "up to 24"), (25, "25 to 34"), (34, "25 to 34"), (35, "35 to 44"), (44, "35 to 44"),
            (45, "45 to 54"), (54, "45 to 54"), (55, "55 or more")]
    df = spark.createDataFrame([(2023, 2023 - a) for a, _ in ages] + [(2023, None)], "y int, b int")
    got = [r[0] for r in df.select(sh.age_band(F.col("y") - F.col("b"), F.col("b"))).collect()]
    assert got == [b for _, b in ages] + ["no information"]


def test_k19_correlation_rounding(spark):
    df = spark.createDataFrame([(0.125,), (-0.125,), (0.994,), (-0.995,)], "x double")
    from ratewise.functions.exact import round_double_half_up
    got = [r[0] for r in df.select(round_double_half_up(F.col("x"), 2)).collect()]
    assert got == [0.13, -0.13, 0.99, -1.0]


def test_k20_pareto_two_formulas(spark):
    st = spark.createDataFrame([("d", 1, 30.0), ("d", 2, 49.9), ("d", 3, 50.0), ("d", 4, 70.0)],
                               "dimension string, ranking bigint, pct_cumulative double")
    r = sh.pareto_cut(st, 4).collect()[0]
    assert (r.items_to_50, r.items_to_80, r.items_below_50_plus_one) == ("3", "more than 4", 3)


def test_k21_cleaning_order_keeps_case_variants(spark):
    raw = spark.createDataFrame(
        [("k1", "s602NU", "01/02/2023", "f1", 1), ("k1", "S602", "01/02/2023", "f2", 2),
         ("k1", "S602", "01/02/2023 ", "f3", 3)],
        "id string, cid string, d string, _file string, _pos int")
    keep = cl.build_events(raw, ["id", "cid", "d"], ["_file", "_pos"], "cid", None, ["d"], [])
    assert sorted((r.cid, r.d) for r in keep.collect()) == [("S602", dt.date(2023, 2, 1))] * 2
    merged = cl.build_events(raw, ["id", "cid", "d"], ["_file", "_pos"], "cid", None, ["d"], [],
                             normalise_first=True)
    assert merged.count() == 1


def test_exact_rounding_half_away_from_zero(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (5, 1000), (2, 3), (0, 5), (1, 0)], "a bigint, b bigint")
    got = [r[0] for r in df.select(ratio_half_up(F.col("a"), F.col("b"), 2)).collect()]
    assert got == [0.13, -0.13, 0.01, 0.67, 0.0, None]
    got = [r[0] for r in df.select(percent_half_up(F.col("a"), F.col("b"), 1)).collect()]
    assert got[:4] == [12.5, -12.5, 0.5, 66.7]


def test_dedup_ties_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("x", 1, "c"), ("x", 1, "d")],
                               "k string, o int, v string")
    got = sorted((r.k or "", r.v) for r in wn.dedup_keep_last(df, ["k"], ["o"]).collect())
    assert got == [("", "b"), ("x", "d")]
    alt = sorted((r.k or "", r.v) for r in wn.dedup_keep_last_agg(df, ["k"], ["o"]).collect())
    assert alt == got


def test_two_source_ratio_only_in_adequate_months(spark):
    s = Study(calendar_start="2023-01-01", calendar_end="2023-03-01", period_start="2023-01-01",
              period_end="2023-12-31")
    ev = events(spark, many(D(2023, 1), 10) + many(D(2023, 2), 10))
    no = spark.createDataFrame([(D(2023, m), 2023, 1, "F", "1") for m in (1, 1, 1, 3)],
                               "event_date date, report_year int, status int, flag string, residence string")
    rows = {r.month: r for r in sh.two_source_monthly(spark, ev, no, s).collect()}
    assert rows["2023-01"].notices_per_event == 0.3
    assert rows["2023-03"].adequate is False and rows["2023-03"].notices_per_event is None
    c = sh.two_source_correlation(spark, ev, no, s).collect()[0]
    assert c.months_used == 2


def test_pf11_exclusion_keeps_null_sections(spark):
    s = Study(period_start="2023-01-01", period_end="2023-12-31", rate_years=(2023,), min_job_years=0)
    ev = events(spark, many(D(2023, 3), 10, sector=1) + many(D(2023, 3), 5, sector=2))
    ex = _exposure(spark, [(2023, 1, 1000, 0, "a"), (2023, 2, 1000, 0, "b")])
    sec = spark.createDataFrame([(1, 1, "S1", "A"), (2, 2, "S2", None)],
                                "sector4 int, sector5 int, label string, section string")
    got = sorted((r.sector, r.big_sector) for r in rt.gap_filtered(ev, ex, sec, s, {"A": "Agro"}, ["Agro"], 10).collect())
    assert got == [(2, None)]
