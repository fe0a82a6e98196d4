"""Composition and share operators.

Every operator reduces the fact to counts per (small) key first — a single
scan with partial aggregation — and computes shares on that aggregate.
Totals come from an aggregate joined back (or a scalar subquery); they and
dimensions supplied by the caller get no hint (the planner broadcasts them only
when their measured size is under the threshold), so no window ever spans raw
rows.  The ordered computations (cumulative share, ranking) run on the per-code
aggregate with ``running_sum``: range-partitioned pieces with carried offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.functions.exact import DEC, pearson_of_counts, percent_half_up, ratio_half_up, round_double_half_up
from ratewise.operators.clean import geo_filter
from ratewise.operators.joins import or_join_labels
from ratewise.plans.coverage import comparable_months, coverage_from_counts
from ratewise.operators.windows import null_safe_join, running_sum
from ratewise.plans.shared import shared
from ratewise.sources.fixtures import Study


def bucket(col: Column, groups, other: str) -> Column:
    """SF18: map integer codes to group labels; anything else (NULL too) → other."""
    expr = None
    for label, codes in groups:
        cond = col.isin(list(codes))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(other))


def with_total(df: DataFrame, n: str, by: list[str] | None = None, name: str = "_total") -> DataFrame:
    """Attach sum(n) over the whole frame (or per ``by`` key) as ``name``.

    Equivalent to ``sum(n) OVER (PARTITION BY by)``, NULL keys included, but
    computed as an aggregate joined back, which never funnels the frame into one
    task.  ``df`` is an aggregate, shared by both uses; the planner broadcasts
    the totals only when their measured size is small.
    """
    df = shared(df)
    if by:
        return null_safe_join(df, df.groupBy(*by).agg(F.sum(n).alias(name)), by)
    return df.withColumn(name, df.agg(F.sum(n)).scalar())


def _period(s: Study) -> Column:
    return F.col("event_date").between(F.lit(s.period_start).cast("date"), F.lit(s.period_end).cast("date"))


def _month_base(events: DataFrame, s: Study, keys: dict[str, Column]) -> DataFrame:
    """One aggregate of the fact: (month, in_period, *keys) → n, read by all branches."""
    cols = [F.trunc("event_date", "month").alias("month"), _period(s).alias("in_period")]
    cols += [c.alias(k) for k, c in keys.items()]
    return shared(events.select(*cols).groupBy("month", "in_period", *keys).agg(F.count(F.lit(1)).alias("n")))


def _comparables(spark: SparkSession, base: DataFrame, s: Study) -> DataFrame:
    monthly = base.groupBy("month").agg(F.sum("n").alias("n"))
    cov = coverage_from_counts(spark, monthly, s.calendar_start, s.calendar_end, s.adequate_fraction)
    return comparable_months(cov, *s.compare_years)


def _is_comparable(df: DataFrame, comp: DataFrame, s: Study) -> DataFrame:
    """Flag rows whose month is comparable in a comparison year (PF17, ExistenceJoin-like)."""
    flags = comp.select(F.col("month_of_year").alias("_moy"), F.lit(True).alias("_cmp"))
    y0, y1 = s.compare_years
    return (df.join(F.broadcast(flags), F.month("month") == F.col("_moy"), "left")
              .withColumn("comparable", F.year("month").isin(y0, y1) & F.col("_cmp").isNotNull())
              .drop("_moy", "_cmp"))


def composition_share(spark: SparkSession, events: DataFrame, code: Column, dim: DataFrame,
                      s: Study, outside_label: str) -> DataFrame:
    """Share of each code in the period and in the two comparison years.

    ``dim`` is (code, label).  The NULL code is a group of its own in the
    totals but never matches in the yearly shares or labels (K3, SQL USING
    semantics); yearly denominators include every code (K4).
    """
    base = _month_base(events, s, {"code": code})
    comp_m = _comparables(spark, base, s)
    total = base.where("in_period").groupBy("code").agg(F.sum("n").alias("n"))
    y0, y1 = s.compare_years
    flagged = _is_comparable(base.where(F.year("month").isin(y0, y1)), comp_m, s).where("comparable")
    comp = flagged.groupBy(F.year("month").alias("year"), "code").agg(F.sum("n").alias("n"))
    ytot = comp.agg(F.struct(F.sum(F.when(F.col("year") == y0, F.col("n"))).alias("T0"),
                             F.sum(F.when(F.col("year") == y1, F.col("n"))).alias("T1"))).scalar()
    pct = (comp.groupBy("code").agg(F.sum(F.when(F.col("year") == y0, F.col("n"))).alias("c0"),
                                    F.sum(F.when(F.col("year") == y1, F.col("n"))).alias("c1"))
               .withColumns({"T0": ytot.getField("T0"), "T1": ytot.getField("T1")}))
    # cumulative share (WN3)
    order = [F.col("n").desc(), F.col("code").asc_nulls_last()]
    t = running_sum(total, "n", order, "run", total="_tot")
    t = t.join(pct, "code", "left").join(dim.select("code", "label"), "code", "left")
    c0 = F.coalesce(F.col("c0"), F.lit(0)).cast(DEC)
    c1 = F.coalesce(F.col("c1"), F.lit(0)).cast(DEC)
    T0, T1 = F.col("T0").cast(DEC), F.col("T1").cast(DEC)
    p0 = F.coalesce(percent_half_up(c0, T0, 1), F.lit(0.0))
    p1 = F.coalesce(percent_half_up(c1, T1, 1), F.lit(0.0))
    change = F.coalesce(ratio_half_up(F.lit(100).cast(DEC) * (c1 * T0 - c0 * T1), T0 * T1, 1), F.lit(0.0))
    return (t.select("code", F.coalesce("label", F.lit(outside_label)).alias("label"),
                     F.col("n").cast("bigint").alias("events"),
                     percent_half_up(F.col("n"), F.col("_tot"), 1).alias("pct_total"),
                     percent_half_up(F.col("run"), F.col("_tot"), 1).alias("pct_cumulative"),
                     p0.alias(f"pct_{y0}"), p1.alias(f"pct_{y1}"), change.alias("change_pp"))
             .orderBy(F.col("events").desc(), F.col("code").asc_nulls_last()).limit(s.top_n))


def diagnosis_category_sql(col: str = "diag_raw") -> Column:
    """Category as in the analysis SQL: trim, first 3, upper (K14: dots kept)."""
    return F.upper(F.substring(F.btrim(F.col(col)), 1, 3))


def diagnosis_category_dotless(col: str = "diag_raw") -> Column:
    """Category as in the dashboard: dots removed first."""
    return F.upper(F.substring(F.replace(F.btrim(F.col(col)), F.lit("."), F.lit("")), 1, 3))


def diagnosis_categories(diagnoses: DataFrame) -> DataFrame:
    """AG15: one label per 3-char category (min of the duplicates)."""
    return diagnoses.groupBy(F.col("cat3").alias("code")).agg(F.min("cat_label").alias("label"))


def composition_stacked_all(spark: SparkSession, events: DataFrame, occupations: DataFrame,
                            diagnoses: DataFrame, s: Study, top: int | None = 30) -> DataFrame:
    """Occupation and diagnosis composition in one frame, NULL → 'NI', ranked per dimension
    (the first ``top`` of each, or all)."""
    # SO1 without a second scan: every event feeds both dimensions; the
    # explode runs before the partial aggregation, so the cached aggregate
    # has #months × (#occupations + #categories) rows, not their product
    pairs = F.explode(F.array(
        F.struct(F.lit("occupation").alias("dimension"),
                 F.coalesce(F.col("occupation"), F.lit("NI")).alias("code")),
        F.struct(F.lit("diagnosis").alias("dimension"),
                 F.coalesce(diagnosis_category_dotless(), F.lit("NI")).alias("code"))))
    base = shared(events.select(F.trunc("event_date", "month").alias("month"),
                                        _period(s).alias("in_period"), pairs.alias("it"))
                                .groupBy("month", "in_period", F.col("it.dimension").alias("dimension"),
                                         F.col("it.code").alias("code"))
                                .agg(F.count(F.lit(1)).alias("n")))
    comp_m = _comparables(spark, base.where(F.col("dimension") == "occupation"), s)
    items = (_is_comparable(base.where("in_period"), comp_m, s)
             .select("dimension", "code", F.year("month").alias("year"), "comparable", "n"))
    total = items.groupBy("dimension", "code").agg(F.sum("n").alias("n"))
    # cumulative share (WN5) and ranking (WN6) per dimension; (n, code) is a
    # total order, so the running count of rows is the row number
    order = [F.col("n").desc(), F.col("code").asc()]
    total = running_sum(total, "n", order, "run", ["dimension"], count="ranking", total="_tot")
    y0, y1 = s.compare_years
    comp = items.where("comparable").groupBy("dimension", "code", "year").agg(F.sum("n").alias("n"))
    comp = with_total(comp, "n", ["dimension", "year"], "Ty")
    pct = comp.groupBy("dimension", "code").agg(
        F.max(F.when(F.col("year") == y0, percent_half_up(F.col("n"), F.col("Ty"), 1))).alias(f"pct_{y0}"),
        F.max(F.when(F.col("year") == y1, percent_half_up(F.col("n"), F.col("Ty"), 1))).alias(f"pct_{y1}"))
    descr = (occupations.groupBy("code").agg(F.max("label").alias("descr")).withColumn("dimension", F.lit("occupation"))
             .unionByName(diagnoses.groupBy(F.col("cat3").alias("code")).agg(F.max("cat_label").alias("descr"))
                          .withColumn("dimension", F.lit("diagnosis"))))
    out = ((total.where(F.col("ranking") <= top) if top else total)
                .join(pct, ["dimension", "code"], "left")
                .join(descr, ["dimension", "code"], "left"))
    return out.select(
        "dimension", F.col("ranking").cast("bigint").alias("ranking"), "code",
        F.when(F.col("code") == "NI", F.lit("not informed"))
         .otherwise(F.coalesce("descr", F.lit("no description in reference table"))).alias("description"),
        F.col("n").cast("bigint").alias("events"),
        percent_half_up(F.col("n"), F.col("_tot"), 1).alias("pct_total"),
        percent_half_up(F.col("run"), F.col("_tot"), 1).alias("pct_cumulative"),
        F.coalesce(F.col(f"pct_{y0}"), F.lit(0.0)).alias(f"pct_{y0}"),
        F.coalesce(F.col(f"pct_{y1}"), F.lit(0.0)).alias(f"pct_{y1}"))


def not_informed_toggle(stacked: DataFrame, dimension: str, n: int, include_ni: bool = False) -> DataFrame:
    """One dimension of A8, optionally without 'NI', first n rows (positions kept)."""
    d = stacked.where(F.col("dimension") == dimension)
    if not include_ni:
        d = d.where(F.col("code") != "NI")
    return d.orderBy("ranking").limit(n)


def headline_rows(stacked: DataFrame) -> DataFrame:
    """SL7: per dimension the first row that is not 'not informed'."""
    first = stacked.where(F.col("code") != "NI").groupBy("dimension") \
        .agg(F.min_by(F.struct(*stacked.columns), "ranking").alias("r"))
    return first.select("r.*")


def pareto_cut(stacked: DataFrame, listed: int | None = 30) -> DataFrame:
    """Per dimension, the smallest rank reaching 50 % / 80 % cumulative share
    ('more than N' when the ``listed`` rows never reach it; over all rows, with
    ``listed=None``, the rank itself), and the alternative formula
    count(cumulative < 50) + 1 (K20)."""
    def cut(p: float) -> Column:
        r = F.min(F.when(F.col("pct_cumulative") >= p, F.col("ranking")))
        r = r.cast("string")
        return F.coalesce(r, F.lit(f"more than {listed}")) if listed else r
    return stacked.groupBy("dimension").agg(
        cut(50.0).alias("items_to_50"), cut(80.0).alias("items_to_80"),
        (F.count_if(F.col("pct_cumulative") < 50.0) + 1).cast("bigint").alias("items_below_50_plus_one"))


def biggest_mover(shown: DataFrame, s: Study) -> DataFrame:
    """Largest gain and largest loss of share among the shown rows (first in rank on ties)."""
    y0, y1 = s.compare_years
    ch = (F.round(F.col(f"pct_{y1}") * 10) - F.round(F.col(f"pct_{y0}") * 10)).cast("bigint")
    d = shown.select("code", "description", "ranking", ch.alias("_c10"))
    best = d.groupBy().agg(F.max_by(F.struct("code", "description", "_c10"),
                                    F.struct("_c10", -F.col("ranking"))).alias("g"),
                           F.max_by(F.struct("code", "description", "_c10"),
                                    F.struct(-F.col("_c10"), -F.col("ranking"))).alias("l"))
    g = best.select(F.lit("gain").alias("direction"), "g.code", "g.description",
                    (F.col("g._c10").cast("double") / 10.0).alias("change_pp"))
    lo = best.select(F.lit("loss").alias("direction"), "l.code", "l.description",
                     (F.col("l._c10").cast("double") / 10.0).alias("change_pp"))
    return g.unionByName(lo)


def status_share(notices: DataFrame, s: Study) -> DataFrame:
    """Notifications per status group in the period, count and %."""
    g = (notices.where(_period(s))
                .groupBy(bucket(F.col("status"), s.status_groups, s.status_unknown).alias("group"))
                .agg(F.count(F.lit(1)).alias("notices")))
    return with_total(g, "notices", name="_tot").select(
        "group", "notices", percent_half_up(F.col("notices"), F.col("_tot"), 1).alias("pct"))


def followup_flag_share(notices: DataFrame, s: Study) -> DataFrame:
    """Within one status, counts per raw flag (NULL and unknown codes each a row, K5)."""
    labels = None
    for code, label in s.flag_labels:
        c = F.col("flag") == code
        labels = F.when(c, F.lit(label)) if labels is None else labels.when(c, F.lit(label))
    g = (notices.where(_period(s) & (F.col("status") == s.flag_status))
                .groupBy("flag").agg(F.count(F.lit(1)).alias("notices")))
    return with_total(g, "notices", name="_tot").select(
        labels.otherwise(F.lit(s.flag_unknown)).alias("flag_label"), "notices",
        percent_half_up(F.col("notices"), F.col("_tot"), 1).alias("pct"))


def no_followup_share(flag_share: DataFrame, labels: list[str]) -> DataFrame:
    """Sum of the % of the given labels; a missing label counts 0."""
    return flag_share.agg(F.coalesce(F.sum(F.when(F.col("flag_label").isin(labels), F.col("pct"))),
                                     F.lit(0.0)).alias("pct_without_followup"))


def _kind_counts(s: Study) -> list[Column]:
    k = F.btrim(F.col("kind"))
    return [F.count_if(k.ilike(s.kind_typical_like)).alias("typical"),
            F.count_if(k.ilike(s.kind_commute)).alias("commute"),
            F.count_if(k.ilike(s.kind_disease_like)).alias("disease")]


def sector_counts_by_type(events: DataFrame, sectors: DataFrame, s: Study, n: int = 15) -> DataFrame:
    """Events per sector (inner join, K10), % of the matched total, three kinds."""
    per = (events.where(_period(s)).groupBy(F.col("sector").alias("sector4"))
                 .agg(F.count(F.lit(1)).alias("events"), *_kind_counts(s)))
    j = per.join(sectors.select("sector4", "label").distinct(), "sector4")
    return (with_total(j, "events", name="_tot")
            .select(F.col("sector4").alias("sector"), "label", "events",
                    percent_half_up(F.col("events"), F.col("_tot"), 1).alias("pct_total"),
                    "typical", "commute", "disease")
            .orderBy(F.col("events").desc(), F.col("sector").asc()).limit(n))


def _comparable_base(spark: SparkSession, events: DataFrame, s: Study, keys: dict[str, Column]) -> DataFrame:
    base = _month_base(events, s, keys)
    comp_m = _comparables(spark, base, s)
    y0, y1 = s.compare_years
    return _is_comparable(base.where(F.year("month").isin(y0, y1)), comp_m, s).where("comparable")


def type_by_year(spark: SparkSession, events: DataFrame, s: Study) -> DataFrame:
    """Kind × year in the comparable months, % within year, deaths."""
    keys = {"kind_t": F.btrim("kind"), "dead": F.btrim("death").ilike(s.death_value)}
    b = _comparable_base(spark, events, s, keys)
    g = (b.groupBy(F.year("month").alias("year"), F.col("kind_t").alias("kind"))
          .agg(F.sum("n").cast("bigint").alias("events"),
               F.coalesce(F.sum(F.when(F.col("dead"), F.col("n"))), F.lit(0)).cast("bigint").alias("deaths")))
    return with_total(g, "events", ["year"], "_ytot").select(
        "year", "kind", "events", percent_half_up(F.col("events"), F.col("_ytot"), 1).alias("pct_in_year"), "deaths")


def exposure_by_area(exposure: DataFrame, year: int, n: int = 15) -> DataFrame:
    """Exposure per 5-char postcode prefix in one year, %, active establishments."""
    g = (exposure.where(F.col("year") == year)
                 .groupBy(F.substring("postcode", 1, 5).alias("area"))
                 .agg(F.sum("jobs").cast("bigint").alias("jobs"),
                      F.count_if(F.col("active_jobs") > 0).alias("active_units")))
    return (with_total(g, "jobs", name="_tot")
            .select("area", "jobs", percent_half_up(F.col("jobs"), F.col("_tot"), 1).alias("pct_total"), "active_units")
            .orderBy(F.col("jobs").desc(), F.col("area").asc()).limit(n))


def residence_share(notices: DataFrame, places: DataFrame, s: Study) -> DataFrame:
    """Named places, everything else bucketed, count and %."""
    per = notices.where(_period(s)).groupBy("residence").agg(F.count(F.lit(1)).alias("n"))
    j = per.join(places, per.residence == places.code, "left")
    g = j.groupBy(F.coalesce("name", F.lit(s.other_places)).alias("place")).agg(F.sum("n").cast("bigint").alias("notices"))
    return with_total(g, "notices", name="_tot").select(
        "place", "notices", percent_half_up(F.col("notices"), F.col("_tot"), 1).alias("pct"))


def age_band(age: Column, birth_year: Column) -> Column:
    """SF18/K15: bands with '<' cut-offs; NULL birth year has its own label."""
    return (F.when(birth_year.isNull(), F.lit("no information"))
             .when(age < 25, F.lit("up to 24")).when(age < 35, F.lit("25 to 34"))
             .when(age < 45, F.lit("35 to 44")).when(age < 55, F.lit("45 to 54"))
             .otherwise(F.lit("55 or more")))


def profile_sex_age(spark: SparkSession, events: DataFrame, s: Study) -> DataFrame:
    """Sex × age band × year in the comparable months, % within year."""
    sx = F.btrim("sex")
    sex = (F.when(sx.ilike(s.male_value), F.lit(s.male_value))
            .when(sx.ilike(s.female_value), F.lit(s.female_value)).otherwise(F.lit("not informed")))
    band = age_band(F.year("event_date") - F.col("birth_year"), F.col("birth_year"))
    b = _comparable_base(spark, events, s, {"sex_g": sex, "band": band})
    g = (b.groupBy(F.year("month").alias("year"), F.col("sex_g").alias("sex"), F.col("band").alias("age_band"))
          .agg(F.sum("n").cast("bigint").alias("events")))
    return with_total(g, "events", ["year"], "_ytot").select(
        "year", "sex", "age_band", "events", percent_half_up(F.col("events"), F.col("_ytot"), 1).alias("pct_in_year"))


def _at_place(df: DataFrame, place_col: str | None, place: str | None) -> DataFrame:
    """K7: only the rows of one place, compared as text; all rows without a column."""
    return geo_filter(df, place_col, place, "cast") if place_col else df


def status_by_year(notices: DataFrame, s: Study, years, place_col: str | None = None,
                   place: str | None = None) -> DataFrame:
    """Second status mapping × report year, % within year (2 decimals), for all or one place."""
    g = (_at_place(notices, place_col, place).where(F.col("report_year").isin(list(years)))
                .groupBy(F.col("report_year").alias("year"),
                         bucket(F.col("status"), s.status_groups_yearly, s.status_unknown_yearly).alias("group"))
                .agg(F.count(F.lit(1)).alias("notices")))
    return with_total(g, "notices", ["year"], "_ytot").select(
        "year", "group", "notices", percent_half_up(F.col("notices"), F.col("_ytot"), 2).alias("pct_in_year"))


def diagnosis_by_status(events: DataFrame, diagnoses: DataFrame, s: Study, years, n: int = 20,
                        place_col: str | None = None, place: str | None = None) -> DataFrame:
    """Year × coarse status × diagnosis code with OR-join labels, % in year, for all or one place."""
    agg = (_at_place(events, place_col, place).where(F.year("event_date").isin(list(years)))
                 .groupBy(F.year("event_date").alias("year"),
                          bucket(F.col("status"), s.status_groups_coarse, s.status_unknown_coarse).alias("group"),
                          F.col("diag_code").alias("code"))
                 .agg(F.count(F.lit(1)).alias("n")))
    lab = or_join_labels(agg, diagnoses)
    g = (lab.groupBy("year", "group", "code", "sub_label", "cat_label").agg(F.sum("n").cast("bigint").alias("cases")))
    g = with_total(g, "cases", ["year"], "_ytot")
    return (g.select("year", "group", F.coalesce("code", F.lit("N/I")).alias("code"),
                     F.coalesce("sub_label", "cat_label", F.lit("not found")).alias("diagnosis"),
                     "cases", percent_half_up(F.col("cases"), F.col("_ytot"), 2).alias("pct_in_year"),
                     F.col("cat_label").alias("_cl"))
             .orderBy(F.col("cases").desc(), "year", "group", "code", "diagnosis", F.col("_cl").asc_nulls_last())
             .limit(n).drop("_cl"))


def event_summary(events: DataFrame, s: Study) -> DataFrame:
    """One row of totals in the period (K13: the three kind spellings)."""
    k = F.btrim(F.col("kind"))
    return events.where(_period(s)).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(k.ilike(s.kind_typical_one)).alias("typical"),
        F.count_if(k == s.kind_commute).alias("commute"),
        F.count_if(k.ilike(s.kind_disease_like)).alias("disease"),
        F.count_if(F.col("death") == s.death_value).alias("deaths"),
        F.count_if(F.col("sex") == s.male_value).alias("men"),
        F.count_if(F.col("sex") == s.female_value).alias("women"))


def summary_shares(summary: DataFrame) -> DataFrame:
    """% of each A22 component (deaths with 2 decimals)."""
    t = F.col("total")
    return summary.select(
        "total",
        percent_half_up(F.col("typical"), t, 1).alias("pct_typical"),
        percent_half_up(F.col("commute"), t, 1).alias("pct_commute"),
        percent_half_up(F.col("disease"), t, 1).alias("pct_disease"),
        percent_half_up(F.col("men"), t, 1).alias("pct_men"),
        percent_half_up(F.col("deaths"), t, 2).alias("pct_deaths"))


def counts_by_section(events: DataFrame, sectors: DataFrame, s: Study, names: dict[str, str],
                      n: int = 8) -> DataFrame:
    """Events per top-level section with its display name (JN15), %, top n."""
    per = events.where(_period(s)).groupBy(F.col("sector").alias("sector4")).agg(F.count(F.lit(1)).alias("n"))
    g = (per.join(sectors.select("sector4", "section").distinct(), "sector4")
            .groupBy("section").agg(F.sum("n").cast("bigint").alias("events")))
    m = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv])
    return (with_total(g, "events", name="_tot")
            .select("section", F.coalesce(F.try_element_at(m, F.col("section")), F.col("section")).alias("section_name"),
                    "events", percent_half_up(F.col("events"), F.col("_tot"), 1).alias("pct"))
            .orderBy(F.col("events").desc(), F.col("section").asc()).limit(n))


def two_source_monthly(spark: SparkSession, events: DataFrame, notices: DataFrame, s: Study) -> DataFrame:
    """Per month both counts, the adequate flag, and the ratio only in adequate months."""
    monthly = events.select(F.trunc("event_date", "month").alias("month")).groupBy("month") \
                    .agg(F.count(F.lit(1)).alias("n"))
    cov = coverage_from_counts(spark, monthly, s.calendar_start, s.calendar_end, s.adequate_fraction)
    sec = (notices.where(_period(s)).groupBy(F.trunc("event_date", "month").alias("month"))
                  .agg(F.count(F.lit(1)).alias("m")))
    j = cov.join(sec, "month", "left").withColumn("m", F.coalesce("m", F.lit(0)).cast("bigint"))
    return j.select(F.date_format("month", "yyyy-MM").alias("month"), F.col("n").alias("events"),
                    F.col("m").alias("notices"), F.col("ok").alias("adequate"),
                    F.when(F.col("ok"), ratio_half_up(F.col("m"), F.col("n"), 2)).alias("notices_per_event"))


def two_source_correlation(spark: SparkSession, events: DataFrame, notices: DataFrame, s: Study) -> DataFrame:
    """Months used and Pearson r of the two monthly series over adequate months."""
    m = two_source_monthly(spark, events, notices, s).where("adequate")
    return m.agg(F.count(F.lit(1)).alias("months_used"),
                 round_double_half_up(pearson_of_counts(F.col("events"), F.col("notices")), 2)
                 .alias("correlation"))
