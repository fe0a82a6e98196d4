"""Registered queries: each binds the fixture tables to one operator.

Every entry takes ``(spark, data_dir)`` and returns an uncollected DataFrame
computed over the whole tables of ``data_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.plans import coverage as cv
from ratewise.plans import rates as rt
from ratewise.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
S = fx.Study()


def _cov(spark, d):
    return cv.coverage(spark, fx.events_fact(spark, d), S.calendar_start, S.calendar_end,
                       S.adequate_fraction)


def q_coverage_monthly(spark, d):
    return cv.coverage_monthly(spark, fx.events_fact(spark, d), S.calendar_start,
                               S.calendar_end, S.adequate_fraction)


def q_adequate_months_per_year(spark, d):
    return cv.adequate_months_per_year(_cov(spark, d))


def q_comparable_months(spark, d):
    return cv.comparable_months(_cov(spark, d), *S.compare_years)


def q_coverage_summary(spark, d):
    return cv.coverage_summary(_cov(spark, d))


def q_sector_rate_ranking(spark, d):
    return rt.sector_rate_ranking(spark, fx.events_fact(spark, d), fx.exposure(spark, d),
                                  fx.sectors(spark, d), S)


def q_overall_rate_by_year(spark, d):
    return rt.overall_rate_by_year(spark, fx.events_fact(spark, d), fx.exposure(spark, d), S)


def q_ratio_to_overall(spark, d):
    return rt.ratio_to_overall(spark, fx.events_fact(spark, d), fx.exposure(spark, d),
                               fx.sectors(spark, d), S)


def q_rose_count(spark, d):
    return rt.rose_count(q_sector_rate_ranking(spark, d), S)


def q_ranking_search(spark, d):
    return rt.ranking_search(spark, fx.events_fact(spark, d), fx.exposure(spark, d),
                             fx.sectors(spark, d), S, term="nation_1", year=S.rate_years[1], n=10)


def q_unmatched_event_share(spark, d):
    return rt.unmatched_event_share(fx.events_fact(spark, d), fx.exposure(spark, d),
                                    fx.sectors(spark, d), S)


def q_expected_vs_observed(spark, d):
    return rt.expected_vs_observed(fx.events_fact(spark, d), fx.exposure(spark, d),
                                   fx.sectors(spark, d), S)


def q_gap_filtered(spark, d):
    return rt.gap_filtered(fx.events_fact(spark, d), fx.exposure(spark, d), fx.sectors(spark, d),
                           S, fx.section_names(), exclude=["Section B"], n=15)


QUERIES: dict[str, Query] = {
    "coverage_monthly": q_coverage_monthly,
    "adequate_months_per_year": q_adequate_months_per_year,
    "comparable_months": q_comparable_months,
    "coverage_summary": q_coverage_summary,
    "sector_rate_ranking": q_sector_rate_ranking,
    "overall_rate_by_year": q_overall_rate_by_year,
    "ratio_to_overall": q_ratio_to_overall,
    "rose_count": q_rose_count,
    "ranking_search": q_ranking_search,
    "unmatched_event_share": q_unmatched_event_share,
    "expected_vs_observed": q_expected_vs_observed,
    "gap_filtered": q_gap_filtered,
}


# ---------------------------------------------------------------- shares
from ratewise.plans import shares as sh  # noqa: E402


def q_occupation_share(spark, d):
    return sh.composition_share(spark, fx.events_fact(spark, d), F.col("occupation"),
                                fx.occupations(spark, d), S, "(code outside the occupation table)")


def q_diagnosis_share(spark, d):
    return sh.composition_share(spark, fx.events_fact(spark, d), sh.diagnosis_category_sql(),
                                sh.diagnosis_categories(fx.diagnoses(spark, d)), S,
                                "(code outside the diagnosis table)")


def _stacked(spark, d):
    return sh.composition_stacked_all(spark, fx.events_fact(spark, d), fx.occupations(spark, d),
                                      fx.diagnoses(spark, d), S, top=30)


def q_composition_stacked(spark, d):
    return _stacked(spark, d)


def q_not_informed_toggle(spark, d):
    return sh.not_informed_toggle(_stacked(spark, d), "occupation", 15)


def _stacked_whole(spark, d):
    return sh.composition_stacked_all(spark, fx.events_fact(spark, d), fx.occupations(spark, d),
                                      fx.diagnoses(spark, d), S, top=None)


def q_headline_rows(spark, d):
    return sh.headline_rows(_stacked(spark, d))


def q_pareto_exact(spark, d):
    """The ranks that reach 50 % and 80 %, over all codes."""
    return sh.pareto_cut(_stacked_whole(spark, d), None)


def q_sector_rate_table(spark, d):
    """A4 whole: all qualifying sectors."""
    return rt.sector_rate_table(spark, fx.events_fact(spark, d), fx.exposure(spark, d), fx.sectors(spark, d), S)


def q_expected_vs_observed_table(spark, d):
    """A10 whole: all sectors with enough job-years."""
    return rt.expected_vs_observed_table(fx.events_fact(spark, d), fx.exposure(spark, d), fx.sectors(spark, d), S)


def q_pareto_cut(spark, d):
    return sh.pareto_cut(_stacked(spark, d), 30)


def q_biggest_mover(spark, d):
    return sh.biggest_mover(sh.not_informed_toggle(_stacked(spark, d), "diagnosis", 15, include_ni=True), S)


def q_status_share(spark, d):
    return sh.status_share(fx.notices(spark, d), S)


def q_followup_flag_share(spark, d):
    return sh.followup_flag_share(fx.notices(spark, d), S)


def q_no_followup_share(spark, d):
    return sh.no_followup_share(q_followup_flag_share(spark, d), ["not issued", S.flag_unknown])


def q_sector_counts_by_type(spark, d):
    return sh.sector_counts_by_type(fx.events_fact(spark, d), fx.sectors(spark, d), S, 15)


def q_type_by_year(spark, d):
    return sh.type_by_year(spark, fx.events_fact(spark, d), S)


def q_exposure_by_area(spark, d):
    return sh.exposure_by_area(fx.exposure(spark, d), max(S.rate_years), 15)


def q_residence_share(spark, d):
    return sh.residence_share(fx.notices(spark, d), fx.named_places(spark, d), S)


def q_profile_sex_age(spark, d):
    return sh.profile_sex_age(spark, fx.events_fact(spark, d), S)


def q_status_by_year(spark, d):
    return sh.status_by_year(fx.notices(spark, d), S, S.rate_years)


def q_diagnosis_by_status(spark, d):
    return sh.diagnosis_by_status(fx.events_fact(spark, d), fx.diagnoses(spark, d), S, S.rate_years, 20)


def q_status_by_year_place(spark, d):
    """K7: report year and one place."""
    return sh.status_by_year(fx.notices(spark, d), S, S.rate_years, "residence", "3")


def q_diagnosis_by_status_place(spark, d):
    return sh.diagnosis_by_status(fx.events_fact(spark, d), fx.diagnoses(spark, d), S, S.rate_years, 20, "sector", "3")


def q_event_summary(spark, d):
    return sh.event_summary(fx.events_fact(spark, d), S)


def q_summary_shares(spark, d):
    return sh.summary_shares(q_event_summary(spark, d))


def q_counts_by_section(spark, d):
    return sh.counts_by_section(fx.events_fact(spark, d), fx.sectors(spark, d), S, fx.section_names(), 8)


def q_two_source_monthly(spark, d):
    return sh.two_source_monthly(spark, fx.events_fact(spark, d), fx.notices(spark, d), S)


def q_two_source_correlation(spark, d):
    return sh.two_source_correlation(spark, fx.events_fact(spark, d), fx.notices(spark, d), S)


QUERIES.update({
    "occupation_share": q_occupation_share,
    "diagnosis_share": q_diagnosis_share,
    "composition_stacked": q_composition_stacked,
    "not_informed_toggle": q_not_informed_toggle,
    "pareto_cut": q_pareto_cut,
    "pareto_exact": q_pareto_exact,
    "headline_rows": q_headline_rows,
    "sector_rate_table": q_sector_rate_table,
    "expected_vs_observed_table": q_expected_vs_observed_table,
    "status_by_year_place": q_status_by_year_place,
    "diagnosis_by_status_place": q_diagnosis_by_status_place,
    "biggest_mover": q_biggest_mover,
    "status_share": q_status_share,
    "followup_flag_share": q_followup_flag_share,
    "no_followup_share": q_no_followup_share,
    "sector_counts_by_type": q_sector_counts_by_type,
    "type_by_year": q_type_by_year,
    "exposure_by_area": q_exposure_by_area,
    "residence_share": q_residence_share,
    "profile_sex_age": q_profile_sex_age,
    "status_by_year": q_status_by_year,
    "diagnosis_by_status": q_diagnosis_by_status,
    "event_summary": q_event_summary,
    "summary_shares": q_summary_shares,
    "counts_by_section": q_counts_by_section,
    "two_source_monthly": q_two_source_monthly,
    "two_source_correlation": q_two_source_correlation,
})


# ---------------------------------------------------------------- cleansing and checks
from ratewise.functions import text as tx  # noqa: E402
from ratewise.operators import clean as cl  # noqa: E402
from ratewise.operators import joins as jn  # noqa: E402
from ratewise.operators import quality as dq  # noqa: E402
from ratewise.operators import windows as wn  # noqa: E402
from ratewise.sources import tables as tb  # noqa: E402

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
ALL_TABLES = ("region nation customer supplier part orders lineitem events documents "
              "embeddings pages benchmark labels conversations").split()

# EAV dictionary of the decode query (fixed values: column, key, label); 'view' appears twice
# on purpose (JN12) and 'signup' is left undecoded.  Columns a to o decode keys 0 to 6.
EVENT_DICTIONARY = [
    ("event_type", "click", "Click"),
    ("event_type", "view", "Page view"),
    ("event_type", "view", "Page view (dup)"),
    ("event_type", "purchase", "Purchase"),
    ("event_type", "error", "Error"),
]
CODE_COLUMNS = [f"code_{c}" for c in "abcdefghijklmno"]


def q_strip_text(spark, d):
    """Texts with white space of several kinds put around them, stripped again."""
    docs = tb.scan_table(spark, d, "documents").select("lang", F.col("text").alias("inner"), F.concat(
        F.lit("\t\u00a0"), F.col("text"), F.lit("\u2003\n")).alias("text"))
    s = cl.strip_text(docs.withColumn("padded", F.col("text")), ["text"])
    return s.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"),
                                 F.count_if(F.col("text") != F.col("padded")).alias("changed"),
                                 F.count_if(F.col("text") != F.col("inner")).alias("beyond"),
                                 F.sum(F.length("text")).cast("bigint").alias("chars_after"))


def q_dedup_keep_last(spark, d):
    return wn.dedup_keep_last(tb.scan_table(spark, d, "lineitem"), LINE_KEY, LINE_ORDER)


def q_dedup_rate(spark, d):
    li = tb.scan_table(spark, d, "lineitem")
    return wn.dedup_rate(li, wn.dedup_keep_last(li, LINE_KEY, LINE_ORDER))


def q_fill_forward(spark, d):
    ev = tb.scan_table(spark, d, "events").select(
        "event_id", "user_id", "event_type",
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase_value"))
    return wn.fill_forward(ev, ["user_id"], "event_id", ["last_purchase_value"], chunk=1000)


def q_decode_dictionary(spark, d):
    """Sixteen columns of the event fact through one dictionary."""
    entries = EVENT_DICTIONARY + [(c, str(k), f"{c[-1]}:{k}") for c in CODE_COLUMNS for k in range(7)]
    values = ", ".join(f"('{c}', '{k}', '{v}')" for c, k, v in entries)
    dic = spark.sql(f"SELECT * FROM VALUES {values} AS d(column_name, key, value)")
    ev = tb.scan_table(spark, d, "events").select("event_type", *[
        F.expr(f"(event_id div {k + 1}) % 9").alias(c) for k, c in enumerate(CODE_COLUMNS)])
    names = ["event_type", *CODE_COLUMNS]
    out = jn.decode_dictionary(ev, dic, {c: c for c in names})
    return out.groupBy("event_type", *[f"{c}_label" for c in names]).agg(F.count(F.lit(1)).alias("events"))


def q_conform_codes(spark, d):
    o = tb.scan_table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    o = (o.withColumn("priority_code", F.col("o_orderpriority"))
          .withColumn("status_dotted", F.concat("o_orderstatus", F.lit("..")))
          .withColumn("key_text", F.concat_ws(".", F.substring(F.col("o_orderkey").cast("string"), 1, 2),
                                              F.expr("substring(cast(o_orderkey as string), 3)"))))
    o = cl.code_prefix(o, "priority_code")
    o = cl.pad_code(o, "priority_code", 3)
    o = cl.strip_category_dot(o, "status_dotted")
    o = cl.normalise_diag(o.withColumn("prio4", F.lower("o_orderpriority")), "prio4")
    o = cl.hierarchy_keys(o, "key_text")
    o = cl.derive_class(o, "class5", "class3", 3)
    o = o.withColumn("status_dotted", F.when(F.col("status_dotted") == "P", cl.NOT_CLASSIFIED).otherwise(F.col("status_dotted")))
    o = cl.marker_to_null(o, ["status_dotted"])
    return o.groupBy("priority_code", "status_dotted", "prio4", "class3").agg(
        F.count(F.lit(1)).alias("orders"), F.count_distinct("class4").alias("class4_keys"))


def q_parse_dates(spark, d):
    o = tb.scan_table(spark, d, "orders").select("o_orderdate", "o_orderstatus")
    txt = F.when(F.col("o_orderstatus") == "P",
                 F.concat(F.lit("31/02/"), F.year("o_orderdate").cast("string"))) \
           .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    p = cl.parse_dates(o.withColumn("txt", txt).withColumn("birth", txt), ["txt"])
    p = cl.generalise_birth(p, "birth")
    return p.groupBy("birth_year").agg(F.count(F.lit(1)).alias("rows"),
                                       F.count_if(F.col("txt").isNull()).alias("invalid"),
                                       F.min("txt").alias("first_date"), F.max("txt").alias("last_date"))


def q_key_check(spark, d):
    return dq.key_check(tb.scan_table(spark, d, "lineitem"), LINE_KEY)


def q_orphan_check(spark, d):
    return dq.orphans(fx.events_fact(spark, d), "occupation", fx.occupations(spark, d), "code")


def q_width_check(spark, d):
    return dq.width_check(fx.events_fact(spark, d), {"diag_raw": 5, "occupation": 7})


def q_range_check(spark, d):
    return dq.range_check(tb.scan_table(spark, d, "lineitem"), "l_extendedprice", "decimal(7,2)")


def q_empty_columns(spark, d):
    """The second source with a column that nothing fills, its name with a dot."""
    return dq.empty_columns(fx.notices(spark, d).withColumn("never.filled", F.lit(None).cast("string")))


def q_one_to_one(spark, d):
    """Seven characters of a brand stand for several brands ('Brand#1' for 'Brand#1' and 'Brand#17')."""
    return dq.one_to_one(tb.scan_table(spark, d, "part").withColumn("prefix", F.substring("p_brand", 1, 7)), "prefix", "p_brand")


def q_table_counts(spark, d):
    return tb.table_counts(spark, d, ALL_TABLES)


QUERIES.update({
    "strip_text": q_strip_text,
    "dedup_keep_last": q_dedup_keep_last,
    "dedup_rate": q_dedup_rate,
    "fill_forward": q_fill_forward,
    "decode_dictionary": q_decode_dictionary,
    "conform_codes": q_conform_codes,
    "parse_dates": q_parse_dates,
    "key_check": q_key_check,
    "orphan_check": q_orphan_check,
    "width_check": q_width_check,
    "range_check": q_range_check,
    "empty_columns": q_empty_columns,
    "one_to_one": q_one_to_one,
    "table_counts": q_table_counts,
})


def q_not_null_check(spark, d):
    """DQ2: NULLs in required columns of the event fact (quarantine sizes)."""
    return dq.not_null_counts(fx.events_fact(spark, d), ["event_date", "sector", "occupation", "diag_code"])


def q_orphan_rows(spark, d):
    """DQ3 listing: events whose occupation code has no dimension row."""
    return dq.orphan_rows(fx.events_fact(spark, d).select("event_id", "occupation"), "occupation",
                          fx.occupations(spark, d), "code")


QUERIES.update({
    "not_null_check": q_not_null_check,
    "orphan_rows": q_orphan_rows,
})


# ---------------------------------------------------------------- files, places, dimensions, builders
from pyspark.sql import types as T  # noqa: E402

from ratewise.sources import silver as sv  # noqa: E402


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _as_csv(df, path: str) -> str:
    """Write a table as ';' CSV with doubled quotes, as the sources come."""
    df.write.option("header", "true").option("sep", ";").option("quote", '"').option("escape", '"') \
        .option("encoding", "UTF-8").option("quoteAll", "true").csv(path)
    return path


def q_csv_scan(spark, d):
    """SC1: documents written as CSV and read back, with line breaks, quotes and separators in fields."""
    docs = tb.scan_table(spark, d, "documents").select(
        "doc_id", F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("code"),
        F.concat(F.lit('say "'), "lang", F.lit('"; \n'), "source").alias("note"), "text")
    path = _as_csv(docs, tb.scratch_path(spark, "csv-scan"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *_strings("code", "note", "text").fields])
    back = tb.scan_csv(spark, path, schema, encoding="UTF-8", multi_line=True)
    return back.select("doc_id", "code", "note", F.md5(F.col("text").cast("binary")).alias("text_md5"), tb.CORRUPT)


def q_ordered_files(spark, d):
    """SC2: two folders with files of the same rows; the later path's copy of a row stands."""
    cust = tb.scan_table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    root = tb.scratch_path(spark, "ordered-files")
    _as_csv(cust.withColumn("segment", F.lit("OLD")), f"{root}/2001-01")
    _as_csv(cust.where("c_custkey % 2 = 0"), f"{root}/2001-02")
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), *_strings("segment").fields])
    both = tb.scan_many_ordered(spark, [f"{root}/2001-02", f"{root}/2001-01"], schema, encoding="UTF-8")
    return wn.dedup_keep_last(both, ["c_custkey"], ["_file", "_split", "_row"]).select("c_custkey", "segment")


def q_yearly_files(spark, d):
    """SC3: one folder per year, stacked with the year as a column."""
    orders = tb.scan_table(spark, d, "orders")
    root = tb.scratch_path(spark, "yearly-files")
    for y in S.rate_years:
        _as_csv(orders.where(F.year("o_orderdate") == y).select("o_orderkey", "o_orderstatus"), f"{root}/{y}")
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), *_strings("o_orderstatus").fields])
    back = tb.scan_years(spark, lambda y: f"{root}/{y}", S.rate_years, schema, encoding="UTF-8")
    return back.groupBy("year").agg(F.count(F.lit(1)).alias("orders"), F.min("o_orderkey").alias("first_key"),
                                    F.max("o_orderkey").alias("last_key"))


def q_land_tables(spark, d):
    """SK1: one source landed as CSV, as parquet and partitioned."""
    cust = tb.scan_table(spark, d, "customer")
    root = tb.scratch_path(spark, "landed")
    tb.land(cust, f"{root}/csv", "csv")
    tb.land(cust, f"{root}/parquet")
    tb.land(cust, f"{root}/partitioned", partition_by=["c_mktsegment"])
    forms = {"csv": spark.read.option("header", "true").csv(f"{root}/csv"),
             "parquet": spark.read.parquet(f"{root}/parquet"), "partitioned": spark.read.parquet(f"{root}/partitioned")}
    return tb.union_all([f.agg(F.lit(name).alias("form"), F.count(F.lit(1)).alias("rows"),
                               F.sum(F.col("c_custkey").cast("bigint")).alias("key_sum"),
                               F.count_distinct("c_name").alias("names")) for name, f in forms.items()])


def q_append_table(spark, d):
    """SK3: a table landed in two batches."""
    cust = tb.scan_table(spark, d, "customer")
    path = tb.scratch_path(spark, "appended")
    tb.land(cust.where("c_custkey % 3 = 0"), path)
    tb.append(cust.where("c_custkey % 3 <> 0"), path)
    return spark.read.parquet(path).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("rows"), F.min("c_custkey").alias("first_key"), F.max("c_custkey").alias("last_key"))


def q_publish_tables(spark, d):
    """SK2: refreshing a dimension rewrites the tables that depend on it, in order."""
    names = ("region", "nation", "customer", "orders")
    tables = {n: tb.scan_table(spark, d, n) for n in names}
    depends = {"customer": ["nation"], "orders": ["customer"]}
    path = tb.scratch_path(spark, "published")
    written = tb.publish(tables, path, depends, selected=["nation"])
    return tb.union_all([spark.read.parquet(f"{path}/{n}").agg(
        F.lit(k).alias("place"), F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows")) for k, n in enumerate(written)])


def q_silver_rate_ranking(spark, d):
    """A4 over the silver tables."""
    path = tb.scratch_path(spark, "silver")
    sv.publish_silver(spark, d, path)
    role = lambda n: sv.read_role(spark, path, n)
    return rt.sector_rate_ranking(spark, role("events_fact"), role("exposure"), role("sectors"), S)


def q_rename_columns(spark, d):
    """PF1, PF2: names by a map (blanks and dots allowed), lower-cased."""
    return cl.rename_snake(tb.scan_table(spark, d, "supplier"), {
        "s_suppkey": "SUPPLIER_ID", "s_name": "Supplier Name", "s_nationkey": "NATION", "s_acctbal": "Account.Balance"})


def q_place_filters(spark, d):
    """PF7, PF8, CL16: the three forms of a place filter."""
    cust = tb.scan_table(spark, d, "customer").withColumn("place.code", F.col("c_nationkey").cast("string"))
    forms = {"equal": cl.geo_filter(cust, "c_nationkey", 3), "prefix": cl.geo_filter(cust, "place.code", "1", "prefix"),
             "cast": cl.geo_filter(cust, "c_nationkey", "12", "cast")}
    return tb.union_all([f.agg(F.lit(n).alias("form"), F.count(F.lit(1)).alias("rows"),
                               F.min("c_custkey").alias("first_key")) for n, f in forms.items()])


def q_label_search(spark, d):
    """PF10: an accented label found by a term in lower case."""
    labels = tb.scan_table(spark, d, "nation").withColumn(
        "label", F.when(F.col("n_nationkey") % 5 == 2, "CONSTRU\u00c7\u00c3O CIVIL").otherwise("COM\u00c9RCIO"))
    return labels.where(tx.regex_contains_ci("label", "constru\u00e7\u00e3o")).agg(
        F.count(F.lit(1)).alias("labels"), F.min("n_nationkey").alias("first_key"))


def _sheet(spark, d):
    """A sheet from part: headers, an upper level on some rows only, rows without a leaf."""
    p = tb.scan_table(spark, d, "part")
    key = F.col("p_partkey")
    top = F.when(key % 37 == 0, "Header").when(key % 50 == 1, F.concat(F.lit("S"), F.expr("p_partkey div 50")))
    leaf = F.when(key % 11 > 0, F.concat(F.lpad((key % 90 + 10).cast("string"), 2, "0"), F.lit("."), key % 9 + 1,
                                         F.lit("1-"), key % 7))
    return p.select(key.alias("line"), top.alias("top"), leaf.alias("leaf"), F.col("p_name").alias("name"))


def q_fill_hierarchy(spark, d):
    """PF14, CL9: headers dropped, the upper level filled down, leaves kept."""
    return wn.fill_hierarchy(_sheet(spark, d), ["top"], "line", "top", "Header", "leaf", chunk=100)


def q_build_sector_dim(spark, d):
    return cl.build_sector_dim(_sheet(spark, d), ["top"], "line", "top", "Header", "leaf", "leaf", "name", "top",
                               unknown={"name": "not classified", "class5": "00000", "class4": "0000"})


def q_unknown_member(spark, d):
    """CL11, SO3, CL17 (occupations): the sentinel row."""
    raw = tb.scan_table(spark, d, "part").select("p_brand", F.lower("p_brand").alias("title")).distinct()
    return cl.build_occupations(raw, "p_brand", "title")


def q_stack_shapes(spark, d):
    """SO4: two tables of different shapes by column name."""
    cust = tb.scan_table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
                                                      F.col("c_mktsegment").alias("segment"))
    return tb.union_all([cust, tb.scan_table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))])


def q_drop_identifiers(spark, d):
    """CL8: identifiers go after the dedup that may need them."""
    return cl.drop_identifiers(tb.scan_table(spark, d, "customer"), ["c_name", "c_acctbal", "c_mktsegment"])


def q_parse_iso_dates(spark, d):
    """SF10: ISO dates with and without separators; what is no date is NULL."""
    o = tb.scan_table(spark, d, "orders")
    form = F.col("o_orderstatus")
    text = F.when(form == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).when(form == "O", F.date_format("o_orderdate", "yyyyMMdd")) \
        .otherwise(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-02-31")))
    p = cl.parse_dates(o.select(form.alias("form"), text.alias("day")), ["day"], fmt=None)
    return p.groupBy("form").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("day").isNull()).alias("invalid"),
                                 F.min("day").alias("first_date"), F.max("day").alias("last_date"))


def q_quarantine_split(spark, d):
    """DQ2: the rows that pass and those that don't, told apart in one pass."""
    judged = dq.with_verdict(fx.events_fact(spark, d), ["occupation", "diag_code"], "part")
    return judged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").cast("bigint").alias("key_sum"))


def q_build_events(spark, d):
    """CL17: the event fact from raw text columns, names with dots and blanks."""
    li = tb.scan_table(spark, d, "lineitem")
    raw = li.select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("_1"), F.col("l_partkey").alias("_2"),
        F.col("l_suppkey").alias("_3"), F.col("l_extendedprice").alias("_4"), F.col("l_quantity").alias("_5"),
        F.col("l_discount").alias("_6"), F.col("l_tax").alias("_7"), F.col("l_returnflag").alias("_8"),
        F.col("l_linestatus").alias("_9"),
        F.date_format("l_shipdate", "d/M/yyyy").alias("Event Date"),
        F.concat(F.lit(" "), F.lower("l_returnflag"), "l_linestatus", F.lit("1"), "l_linenumber", F.lit("xx\t")).alias("CID.10"),
        (F.col("l_partkey") % 1000).cast("string").alias("CNAE2.0"),
        F.concat((F.col("l_suppkey") % 30).cast("string"), F.lit("-Place")).alias("Place.1"),
        F.concat(F.lit("1/2/"), (F.lit(1940) + F.col("l_partkey") % 50).cast("string")).alias("Birth"),
        F.lit("secret").alias("Employer Id"))
    return cl.build_events(raw, ["l_orderkey", "l_linenumber"], [f"_{k}" for k in range(1, 10)], "CID.10", "Birth",
                           ["Event Date"], ["Employer Id"], "Place.1", sector_col="CNAE2.0",
                           rename={"Event Date": "event_date", "CID.10": "diagnosis", "CNAE2.0": "sector", "Place.1": "place"})


def _subclass(o):
    return o.select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"),
                    (F.col("o_custkey") % 10000).cast("string").alias("subclass"), F.lit("text").alias("description"))


def q_build_exposure(spark, d):
    return cl.build_exposure(_subclass(tb.scan_table(spark, d, "orders")), ["description", "status"], "subclass", "class")


def q_build_movements(spark, d):
    raw = _subclass(tb.scan_table(spark, d, "orders")).withColumn(
        "status", F.when(F.col("status") == "P", F.concat(F.lit(cl.NOT_CLASSIFIED), F.lit(" "))).otherwise(F.col("status")))
    return cl.build_movements(raw, ["description", "year"], "subclass", "class", ["status"])


def _notification(o):
    return o.select(F.col("o_orderkey").alias("O_ORDERKEY"), F.concat(F.substring("o_orderpriority", 1, 1), F.lit("A.")).alias("CODE"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("DAY"), F.col("o_orderstatus").alias("STATUS"),
                    F.lit(None).cast("string").alias("EMPTY"))


def q_build_notifications(spark, d):
    raw = _notification(tb.scan_table(spark, d, "orders"))
    raw = raw.withColumn("DAY", F.when(F.col("STATUS") == "P", "not a day").otherwise(F.col("DAY")))
    return cl.build_notifications(raw, ["code"], ["day"], ["EMPTY", "STATUS"])


def q_build_notifications_two(spark, d):
    return cl.build_notifications_two(_notification(tb.scan_table(spark, d, "orders")).drop("CODE"), ["day"], ["EMPTY", "STATUS"])


def q_build_diagnoses(spark, d):
    dim = fx.diagnoses(spark, d)
    raw = dim.select(F.concat("sub", F.lit(" ")).alias("SUB.CAT"), F.col("sub_label").alias("sub label"), "cat", "cat_label")
    return cl.build_diagnoses(raw, "SUB.CAT", "sub label", "cat", "cat_label")


QUERIES.update({f.__name__[2:]: f for f in (
    q_csv_scan, q_ordered_files, q_yearly_files, q_land_tables, q_append_table, q_publish_tables, q_silver_rate_ranking,
    q_rename_columns, q_place_filters, q_label_search, q_fill_hierarchy, q_build_sector_dim, q_unknown_member, q_stack_shapes,
    q_drop_identifiers, q_parse_iso_dates, q_quarantine_split, q_build_events, q_build_exposure, q_build_movements,
    q_build_notifications, q_build_notifications_two, q_build_diagnoses)})


# ---------------------------------------------------------------- line numbers, ranks, batches, checks in one pass, bound SQL
from ratewise.operators import ranks as rk  # noqa: E402
from ratewise.plans import bound_sql as bq  # noqa: E402
from ratewise.plans.shared import shared  # noqa: E402
from ratewise.streaming import upsert as up  # noqa: E402


def q_hierarchy_from_files(spark, d):
    """SC2, CL9: the sheet in several CSV files; dense line numbers in file order, then the fill over them."""
    root = tb.scratch_path(spark, "sheet")
    _as_csv(_sheet(spark, d).repartitionByRange(6, "line").sortWithinPartitions("line").drop("line"), f"{root}/files")
    sheet = tb.scan_many_ordered(spark, f"{root}/files", _strings("top", "leaf", "name"), encoding="UTF-8")
    tb.land(wn.number_lines(sheet.drop(tb.CORRUPT)), f"{root}/numbered")
    return wn.fill_hierarchy(spark.read.parquet(f"{root}/numbered"), ["top"], "line", "top", "Header", "leaf")


def q_running_total(spark, d):
    """WN3, WN5, WN6: quantity per supplier and day, summed up and numbered by day; a third of the suppliers are one NULL group."""
    li = tb.scan_table(spark, d, "lineitem").select(
        F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey")).alias("supplier"), F.col("l_shipdate").cast("date").alias("day"),
        F.col("l_quantity").cast("bigint").alias("quantity"))
    per = li.groupBy("supplier", "day").agg(F.sum("quantity").alias("quantity"))
    return wn.running_sum(shared(per), "quantity", ["day"], "so_far", ["supplier"], count="place", total="whole")


def q_keep_last_stream(spark, d):
    """ST1, CL2: three overlapping batches of lines taken in as they land; the latest version of every key."""
    li = tb.scan_table(spark, d, "lineitem")
    root = tb.scratch_path(spark, "upsert")
    for k in range(3):
        li.where(F.col("l_orderkey") % 3 != k).write.mode("append").parquet(f"{root}/landing")
        up.start_upsert(spark, f"{root}/landing", f"{root}/table", f"{root}/checkpoint", li.schema, LINE_KEY, LINE_ORDER).awaitTermination()
    return up.current(spark, f"{root}/table", li.schema)


def q_constraint_suite(spark, d):
    """DQ2, DQ4-DQ6, DQ8: all row rules of the event fact, checked while it is written."""
    ev = fx.events_fact(spark, d).withColumn("never.filled", F.lit(None).cast("string"))
    rules = [dq.has_rows(), dq.not_null("event_date"), dq.not_null("occupation"), dq.not_null("diag_code"), dq.filled("kind"),
             dq.filled("never.filled"), dq.max_width("diag_raw", 5), dq.max_width("occupation", 7), dq.fits("event_id", "smallint"),
             dq.one_of("sex", ["Male", "Female"]), dq.one_of("death", ["R", "N"])]
    return dq.write_checked(ev, rules, tb.scratch_path(spark, "checked"))


def q_quarantine_batches(spark, d):
    """DQ2, SK3: accepted and rejected rows landed together, batch by batch; the second batch is landed twice."""
    ev = dq.with_verdict(fx.events_fact(spark, d), ["occupation", "diag_code"])
    path = tb.scratch_path(spark, "quarantine")
    for batch in (0, 1, 1):
        tb.land_batch(ev.where(F.year("event_date") % 2 == batch), path, batch, ["verdict"])
    return spark.read.parquet(path).groupBy("batch", "verdict").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("event_id").cast("bigint").alias("key_sum"))


def q_group_median(spark, d):
    """AG8: the exact median price per supplier; a third of the suppliers are one group, a seventh of the prices NULL."""
    li = tb.scan_table(spark, d, "lineitem").select(
        F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey")).alias("supplier"),
        F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice")).alias("price"))
    return rk.group_median(li, ["supplier"], "price")


def q_catalog_counts(spark, d):
    """SC8, SO2, A34: the given tables as views, and the row count of whatever the catalog lists."""
    tb.register_tables(spark, d, "given_")
    return tb.catalog_counts(spark, "given_")


def q_overall_rate_sql(spark, d):
    """A5 as a text with bound parameters."""
    return bq.overall_rate_by_year(spark, fx.events_fact(spark, d), fx.exposure(spark, d), S)


def q_known_by_sector(spark, d):
    """PF16, PF17: an IN filter and an EXISTS flag."""
    return bq.known_by_sector(spark, fx.events_fact(spark, d), fx.occupations(spark, d), fx.sectors(spark, d), "B")


def q_csv_latin1(spark, d):
    """SC1 with its defaults: ISO-8859-1, ';', quoted, read in splits."""
    docs = tb.scan_table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("Constru\u00e7\u00e3o; \u00e9 \""), "lang", F.lit("\" \u00ff")).alias("label"),
        F.lpad(F.col("doc_id").cast("string"), 7, "0").alias("code"))
    path = tb.scratch_path(spark, "latin1")
    docs.write.option("header", "true").option("sep", ";").option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    return tb.scan_csv(spark, path, T.StructType([T.StructField("doc_id", T.LongType()), *_strings("label", "code").fields]))


QUERIES.update({f.__name__[2:]: f for f in (
    q_hierarchy_from_files, q_running_total, q_keep_last_stream, q_constraint_suite, q_quarantine_batches, q_group_median,
    q_catalog_counts, q_overall_rate_sql, q_known_by_sector, q_csv_latin1)})
