"""Metamorphic properties on the fixture tables."""

from __future__ import annotations

from functools import reduce

import pytest
from pyspark.sql import functions as F

from ratewise.plans import coverage as cv
from ratewise.plans import rates as rt
from ratewise.plans import shares as sh
from ratewise.sources import fixtures as fx

S = fx.Study()


@pytest.fixture(scope="module")
def roles(spark, sf_dir):
    return dict(ev=fx.events_fact(spark, sf_dir), ex=fx.exposure(spark, sf_dir), sec=fx.sectors(spark, sf_dir),
                occ=fx.occupations(spark, sf_dir), diag=fx.diagnoses(spark, sf_dir), no=fx.notices(spark, sf_dir))


def test_cumulative_share_monotone_and_complete(spark, roles):
    st = sh.composition_stacked_all(spark, roles["ev"], roles["occ"], roles["diag"], S, top=1000).collect()
    for dim in ("occupation", "diagnosis"):
        rows = sorted((r for r in st if r.dimension == dim), key=lambda r: r.ranking)
        cum = [r.pct_cumulative for r in rows]
        assert cum == sorted(cum) and cum[-1] == 100.0
        assert abs(sum(r.pct_total for r in rows) - 100.0) <= 0.05 * len(rows)
        assert [r.ranking for r in rows] == list(range(1, len(rows) + 1))


def test_calendar_densifies_to_every_month(spark, roles):
    cov = cv.coverage_monthly(spark, roles["ev"], S.calendar_start, S.calendar_end)
    assert cov.count() == 84 and cov.where("events < 0").count() == 0


def test_split_by_flag_partitions_rows(spark, roles):
    t = rt.gap_filtered(roles["ev"], roles["ex"], roles["sec"], S, fx.section_names(), [], 1000)
    all_rows = rt.expected_vs_observed_table(roles["ev"], roles["ex"], roles["sec"], S).count()
    groups = {r.group: r.n for r in t.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(groups.values()) == all_rows and set(groups) <= {"below half", "half or more"}


def test_status_groups_cover_all_notifications(spark, roles):
    got = sh.status_share(roles["no"], S).agg(F.sum("notices")).first()[0]
    n = roles["no"].where(F.col("event_date").between(F.lit(S.period_start).cast("date"),
                                                      F.lit(S.period_end).cast("date"))).count()
    assert got == n


def test_tripled_fact_triples_counts_and_keeps_shares(spark, roles):
    ev = roles["ev"]
    tripled = reduce(lambda a, b: a.unionByName(b), [ev, ev, ev])
    a = {(r.dimension, r.code): r for r in
         sh.composition_stacked_all(spark, ev, roles["occ"], roles["diag"], S).collect()}
    b = {(r.dimension, r.code): r for r in
         sh.composition_stacked_all(spark, tripled, roles["occ"], roles["diag"], S).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert b[k].events == 3 * a[k].events
        assert (b[k].pct_total, b[k].pct_cumulative, b[k].ranking) == (a[k].pct_total, a[k].pct_cumulative,
                                                                       a[k].ranking)


def test_occupation_share_equals_stacked_when_code_present(spark, roles):
    """A6 restricted to non-NULL codes and A8's occupation rows agree on counts and shares."""
    a6 = {r.code: r for r in sh.composition_share(spark, roles["ev"], F.col("occupation"), roles["occ"],
                                                  fx.Study(top_n=1000), "-").collect() if r.code is not None}
    a8 = {r.code: r for r in sh.composition_stacked_all(spark, roles["ev"], roles["occ"], roles["diag"], S, 1000)
          .where("dimension = 'occupation'").collect() if r.code != "NI"}
    assert a6.keys() == a8.keys()
    for c in a6:
        assert (a6[c].events, a6[c].pct_total, a6[c].pct_1995, a6[c].pct_2001) == \
               (a8[c].events, a8[c].pct_total, a8[c].pct_1995, a8[c].pct_2001)


@pytest.mark.parametrize("name", ["composition_stacked", "occupation_share", "diagnosis_share"])
@pytest.mark.parametrize("ranges", [1, 5])
def test_composition_same_with_any_number_of_ranges(spark, sf_dir, monkeypatch, name, ranges):
    """Cumulative share and ranking don't depend on how many ranges the sums are computed in."""
    from ratewise.plans import shares as sh
    from ratewise.queries import QUERIES
    want = sorted(tuple(r) for r in QUERIES[name](spark, sf_dir).collect())
    plain = sh.running_sum
    monkeypatch.setattr(sh, "running_sum", lambda *a, **k: plain(*a, **k, ranges=ranges))
    assert sorted(tuple(r) for r in QUERIES[name](spark, sf_dir).collect()) == want
