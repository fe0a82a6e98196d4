"""Rates against an exposure base.

Rates are kept as integer triples (events, jobs, adequate months) until the
last projection and rounded exactly with ``ratio_half_up``:

    rate = 1000 * events / (jobs * months / 12) = 12000 * events / (jobs * months)

Scale notes
* the event fact is scanned once per query: it is reduced to
  (month, sector) counts, cached (``shared``), and both the coverage frame
  and the per-sector counts are derived from that one aggregate;
* the exposure fact is reduced to (year, sector) sums by a partial/final
  aggregate before any join;
* joined frames are bounded by #months × #sectors; the calendar, the
  coverage frame and one-row totals are broadcast by hint (bounded by
  construction); the sector dimension is left to the planner's size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.functions.exact import DEC, percent_half_up, ratio_half_up
from ratewise.functions.text import regex_contains_ci
from ratewise.plans.coverage import adequate_months_per_year, coverage_from_counts
from ratewise.plans.shared import shared
from ratewise.sources.fixtures import Study


def _in_period(col: str, s: Study) -> Column:
    return F.col(col).between(F.lit(s.period_start).cast("date"), F.lit(s.period_end).cast("date"))


def _rate(events: Column, jobs: Column, months: Column, scale: int = 1) -> Column:
    return ratio_half_up(F.lit(12000).cast(DEC) * events.cast(DEC), jobs.cast(DEC) * months.cast(DEC), scale)


def sector_month_counts(events: DataFrame, s: Study) -> DataFrame:
    """(month, sector4, dis, n) — the one aggregate of the event fact.

    Every attribute a later branch needs is a grouping key and there is a
    single measure, so column pruning cannot turn the branches into
    different aggregates: the fact is scanned and shuffled once per query.
    """
    disease = F.btrim(F.col("kind")).ilike(s.kind_disease_like)
    return (events.select(F.trunc("event_date", "month").alias("month"),
                          F.col("sector").alias("sector4"), disease.alias("dis"))
                  .groupBy("month", "sector4", "dis")
                  .agg(F.count(F.lit(1)).alias("n")))


def exposure_by_sector_year(exposure: DataFrame, sectors: DataFrame, s: Study,
                            positive_only: bool = False) -> DataFrame:
    """Exposure conformed to the event key (JN14 bridge): (year, sector4, jobs)."""
    ex = exposure.where(F.col("year").between(min(s.rate_years), max(s.rate_years)))
    if positive_only:
        ex = ex.where(F.col("jobs") > 0)
    per5 = ex.groupBy("year", "sector5").agg(F.sum("jobs").alias("jobs"))
    return (per5.join(sectors.select("sector5", "sector4"), "sector5")
                .groupBy("year", "sector4").agg(F.sum("jobs").alias("jobs")))


def _yearly_sector_events(spark: SparkSession, events: DataFrame, s: Study, base: DataFrame | None = None):
    base = base if base is not None else shared(sector_month_counts(events, s))
    monthly = base.groupBy("month").agg(F.sum("n").alias("n"))
    cov = coverage_from_counts(spark, monthly, s.calendar_start, s.calendar_end, s.adequate_fraction)
    ok = cov.where("ok").select("month")
    acc = (base.join(F.broadcast(ok), "month")
               .groupBy(F.year("month").alias("year"), "sector4")
               .agg(F.sum("n").alias("events"),
                    F.coalesce(F.sum(F.when(F.col("dis"), F.col("n"))), F.lit(0)).alias("diseases")))
    return cov, acc


def sector_rate_table(spark: SparkSession, events: DataFrame, exposure: DataFrame,
                      sectors: DataFrame, s: Study, base: DataFrame | None = None) -> DataFrame:
    """A4 without the ranking cut: one row per qualifying sector, all columns."""
    cov, acc = _yearly_sector_events(spark, events, s, base)
    months = adequate_months_per_year(cov)
    jobs = exposure_by_sector_year(exposure, sectors, s)
    rates = (jobs.join(F.broadcast(months), "year")
                 .join(acc, ["year", "sector4"], "left")
                 .where(F.col("jobs") > 0)
                 .select("year", "sector4", "jobs", "adequate_months",
                         F.coalesce("events", F.lit(0)).alias("events"),
                         F.coalesce("diseases", F.lit(0)).alias("diseases")))
    first, last = min(s.rate_years), max(s.rate_years)

    def at(col: str, y: int) -> Column:
        return F.max(F.when(F.col("year") == y, F.col(col)))

    aggs = [at("jobs", last).alias("jobs_last"),
            F.sum("events").cast("bigint").alias("events"),
            F.sum("diseases").cast("bigint").alias("diseases"),
            F.count(F.lit(1)).alias("_years"), F.min("jobs").alias("_min_jobs")]
    for y in s.rate_years:
        aggs += [at("events", y).alias(f"_e{y}"), at("jobs", y).alias(f"_j{y}"),
                 at("adequate_months", y).alias(f"_m{y}")]
    per = (rates.groupBy("sector4").agg(*aggs)
                .where((F.col("_years") == len(s.rate_years))
                       & (F.col("_min_jobs") >= s.min_jobs_per_year)
                       & (F.col("events") >= s.min_events)))
    e_f, j_f, m_f = (F.col(f"_e{first}"), F.col(f"_j{first}"), F.col(f"_m{first}"))
    e_l, j_l, m_l = (F.col(f"_e{last}"), F.col(f"_j{last}"), F.col(f"_m{last}"))
    d = lambda c: c.cast(DEC)
    change = ratio_half_up(F.lit(12000).cast(DEC) * (d(e_l) * d(j_f) * d(m_f) - d(e_f) * d(j_l) * d(m_l)),
                           d(j_l) * d(m_l) * d(j_f) * d(m_f), 1)
    out = per.join(sectors.select("sector4", "label").distinct(), "sector4")
    cols = [F.col("sector4").alias("sector"), "label", F.col("jobs_last").cast("bigint").alias(f"jobs_{last}"),
            "events", "diseases"]
    cols += [_rate(F.col(f"_e{y}"), F.col(f"_j{y}"), F.col(f"_m{y}")).alias(f"rate_{y}") for y in s.rate_years]
    cols += [change.alias(f"change_{first}_{last}")]
    return out.select(*cols)


def sector_rate_ranking(spark: SparkSession, events: DataFrame, exposure: DataFrame,
                        sectors: DataFrame, s: Study, base: DataFrame | None = None) -> DataFrame:
    """A4: top sectors by last-year annualised rate per 1000 jobs."""
    last = max(s.rate_years)
    t = sector_rate_table(spark, events, exposure, sectors, s, base)
    return t.orderBy(F.col(f"rate_{last}").desc_nulls_first(), F.col("sector").asc()).limit(s.top_n)


def ranking_search(spark: SparkSession, events: DataFrame, exposure: DataFrame, sectors: DataFrame,
                   s: Study, term: str | None, year: int, n: int) -> DataFrame:
    """A4 filtered by a case-insensitive regex on the label, ranked by a chosen year."""
    first, last = min(s.rate_years), max(s.rate_years)
    t = sector_rate_table(spark, events, exposure, sectors, s)
    if term:
        t = t.where(regex_contains_ci("label", term))
    return (t.withColumn("change", F.col(f"rate_{last}") - F.col(f"rate_{first}"))
             .orderBy(F.col(f"rate_{year}").desc_nulls_last(), F.col("sector").asc()).limit(n))


def rose_count(ranking: DataFrame, s: Study) -> DataFrame:
    """Among the ranked rows, how many have a higher last-year rate than first-year."""
    first, last = min(s.rate_years), max(s.rate_years)
    return ranking.agg(F.count(F.lit(1)).alias("shown"),
                       F.count_if(F.col(f"rate_{last}") > F.col(f"rate_{first}")).alias("rose"))


def overall_rate_by_year(spark: SparkSession, events: DataFrame, exposure: DataFrame,
                         s: Study, monthly: DataFrame | None = None) -> DataFrame:
    """A5: city-wide annualised rate per year (same coverage rule as A4).

    ``monthly`` may pass an existing (month, n) reduction of the same fact
    (every event counted once, any sector) so the fact is not read again.
    """
    base = monthly if monthly is not None else shared(
        events.select(F.trunc("event_date", "month").alias("month")).groupBy("month")
              .agg(F.count(F.lit(1)).alias("n")))
    cov = coverage_from_counts(spark, base, s.calendar_start, s.calendar_end, s.adequate_fraction)
    months = adequate_months_per_year(cov)
    acc = cov.where("ok").groupBy(F.year("month").alias("year")).agg(F.sum("n").cast("bigint").alias("events"))
    jobs = (exposure.where(F.col("year").between(min(s.rate_years), max(s.rate_years)))
                    .groupBy("year").agg(F.sum("jobs").cast("bigint").alias("jobs")))
    return (jobs.join(F.broadcast(months), "year").join(F.broadcast(acc), "year")
                .select("year", "adequate_months", "jobs", "events",
                        _rate(F.col("events"), F.col("jobs"), F.col("adequate_months")).alias("rate")))


def ratio_to_overall(spark: SparkSession, events: DataFrame, exposure: DataFrame,
                     sectors: DataFrame, s: Study) -> DataFrame:
    """Top sector's last-year rate over the city rate; city change first→last.

    Computed from the displayed (rounded to 0.1) rates, as the reference page does.
    """
    first, last = min(s.rate_years), max(s.rate_years)
    base = shared(sector_month_counts(events, s))      # one read of the event fact for both rates
    # one read of the exposure fact too: both rates only sum jobs per
    # (year, sector) or per year over the rate years
    jobs = shared(exposure.where(F.col("year").between(first, last))
                          .groupBy("year", "sector5").agg(F.sum("jobs").alias("jobs")))
    top = sector_rate_ranking(spark, events, jobs, sectors, s, base).limit(1) \
        .select("sector", "label", F.col(f"rate_{last}").alias("top_rate"))
    city = overall_rate_by_year(spark, events, jobs, s,
                                monthly=base.groupBy("month").agg(F.sum("n").alias("n")))
    # one-row city rates as a scalar subquery (PF18), not a join
    piv = city.agg(F.struct(F.max(F.when(F.col("year") == last, F.col("rate"))).alias("last"),
                            F.max(F.when(F.col("year") == first, F.col("rate"))).alias("first"))).scalar()
    # rates carry one decimal: scale by 10 to integers, then exact ratio
    t10 = F.round(F.col("top_rate") * 10).cast("bigint")
    c10 = F.round(F.col("city_rate") * 10).cast("bigint")
    f10 = F.round(F.col("city_first") * 10).cast("bigint")
    return top.withColumns({"city_rate": piv.getField("last"), "city_first": piv.getField("first")}).select(
        "sector", "label", "top_rate", "city_rate",
        ratio_half_up(t10, c10, 1).alias("times_city"),
        ((c10 - f10).cast("double") / F.lit(10.0)).alias("city_change"))


def unmatched_event_share(events: DataFrame, exposure: DataFrame, sectors: DataFrame, s: Study) -> DataFrame:
    """Events in sectors with no positive exposure in the rate years (count and %)."""
    with_jobs = (exposure_by_sector_year(exposure, sectors, s, positive_only=True)
                 .select("sector4").distinct().withColumn("_has", F.lit(True)))
    per = (events.where(_in_period("event_date", s))
                 .groupBy(F.col("sector").alias("sector4")).agg(F.count(F.lit(1)).alias("n")))
    j = per.join(with_jobs, "sector4", "left")
    return j.agg(F.sum("n").cast("bigint").alias("events"),
                 F.coalesce(F.sum(F.when(F.col("_has").isNull(), F.col("n"))), F.lit(0))
                  .cast("bigint").alias("in_sector_without_jobs")) \
            .select("events", "in_sector_without_jobs",
                    percent_half_up(F.col("in_sector_without_jobs"), F.col("events"), 2).alias("pct"))


def expected_vs_observed_table(events: DataFrame, exposure: DataFrame, sectors: DataFrame,
                               s: Study) -> DataFrame:
    """A10 without the cut: every sector with enough job-years.

    overall rate = all events in the period (any sector, K9) / all exposure that
    joins the sector dimension; expected = job-years × overall rate.
    """
    # both aggregates serve the join and the grand totals: each fact is read once
    acc = shared(events.where(_in_period("event_date", s))
                 .groupBy(F.col("sector").alias("sector4")).agg(F.count(F.lit(1)).alias("events")))
    jobs = shared(exposure_by_sector_year(exposure, sectors, s)
                  .groupBy("sector4").agg(F.sum("jobs").alias("job_years")))
    # grand totals (AG12) as scalar subqueries: evaluated once, no join
    E = acc.agg(F.sum("events")).scalar().cast(DEC)
    J = jobs.agg(F.sum("job_years")).scalar().cast(DEC)
    v = F.col("job_years").cast(DEC)
    a = F.coalesce(F.col("events"), F.lit(0)).cast(DEC)
    return (jobs.join(acc, "sector4", "left")
                .join(sectors.select("sector4", "label", "section").distinct(), "sector4")
                .where(F.col("job_years") >= s.min_job_years)
                .select(F.col("sector4").alias("sector"), "label", "section",
                        F.col("job_years").cast("bigint").alias("job_years"),
                        F.coalesce("events", F.lit(0)).cast("bigint").alias("events"),
                        ratio_half_up(F.lit(1000).cast(DEC) * a, v, 2).alias("per_thousand"),
                        ratio_half_up(v * E, J, 0).alias("expected"),
                        ratio_half_up(v * E - a * J, J, 0).alias("gap"),
                        ratio_half_up(a * J, v * E, 2).alias("observed_over_expected")))


def expected_vs_observed(events: DataFrame, exposure: DataFrame, sectors: DataFrame, s: Study) -> DataFrame:
    """A10: top sectors by expected − observed events."""
    t = expected_vs_observed_table(events, exposure, sectors, s).drop("section")
    return t.orderBy(F.col("gap").desc_nulls_first(), F.col("sector").asc()).limit(s.top_n)


def gap_filtered(events: DataFrame, exposure: DataFrame, sectors: DataFrame, s: Study,
                 section_names: dict[str, str], exclude: list[str], n: int) -> DataFrame:
    """A10 with the section name, hidden sections, chosen N and the 0.5 split."""
    t = expected_vs_observed_table(events, exposure, sectors, s)
    if section_names:
        m = F.create_map(*[F.lit(x) for kv in sorted(section_names.items()) for x in kv])
        big = F.coalesce(F.try_element_at(m, F.col("section")), F.col("section"))
    else:
        big = F.col("section")
    t = t.withColumn("big_sector", big)
    if exclude:
        # PF11: an exclusion list keeps rows whose value is NULL (pandas ~isin)
        t = t.where(~F.col("big_sector").isin(list(exclude)) | F.col("big_sector").isNull())
    group = F.when(F.col("observed_over_expected") < 0.5, F.lit("below half")) \
             .when(F.col("observed_over_expected") >= 0.5, F.lit("half or more"))
    return (t.withColumn("group", group).drop("section")
             .orderBy(F.col("gap").desc_nulls_last(), F.col("sector").asc()).limit(n))
