"""Binding of the driver's TPC-H-like tables to the analytic roles.

The operators in ``ratewise.plans`` are written against roles (an event fact
with a date, a sector, an occupation ...; an exposure fact; dimensions), never
against table names.  This module is the only place that knows which table
column plays which role.  The oracle SQL (``oracle/duckdb_sql.py``) repeats the
same definitions in DuckDB syntax.

Role                         view          source
event fact                   events_fact   lineitem ⋈ supplier ⋈ part
exposure fact                exposure      orders ⋈ customer
sector dimension             sectors       nation ⋈ region
second event source          notices       orders ⋈ customer
diagnosis dimension (2 lvl)  diagnoses     distinct (p_type, p_brand) of part
occupation dimension         occupations   distinct p_brand of part
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.sources.tables import scan_table


@dataclass(frozen=True)
class Study:
    """Parameters of one analysis.  Defaults fit the fixture data."""

    calendar_start: str = "1995-01-01"      # first month of the coverage calendar
    calendar_end: str = "2001-12-01"        # last month (any day inside it)
    period_start: str = "1995-01-01"        # event-date window for totals
    period_end: str = "2001-12-31"
    rate_years: tuple[int, ...] = (1998, 1999, 2000)   # years with exposure
    compare_years: tuple[int, int] = (1995, 2001)      # first vs last year
    adequate_fraction: float = 0.5          # month adequate if n >= f * median
    min_jobs_per_year: int = 2000           # A4: minimum exposure in every year
    min_events: int = 30                    # A4: minimum events in the period
    min_job_years: int = 3000               # A10: minimum summed exposure
    top_n: int = 20
    # event-kind predicates: three spellings on purpose
    kind_typical_like: str = "S%"           # ILIKE with %
    kind_typical_one: str = "S_ALL"         # ILIKE with _
    kind_commute: str = "PROMO"             # exact after btrim
    kind_disease_like: str = "E%"
    death_value: str = "R"
    male_value: str = "Male"
    female_value: str = "Female"
    # Fixed values (the status codes' groups, which results depend on; SURVEY K6):
    status_groups: tuple = field(default=(
        ("formal", (1, 4, 5)), ("unregistered", (2, 3, 10)),
        ("other", (6, 7, 8, 9, 11, 12))))
    status_unknown: str = "unknown"
    status_groups_yearly: tuple = field(default=(
        ("formal", (1,)), ("informal", (2, 3, 4)), ("other ties", (5, 6, 7))))
    status_unknown_yearly: str = "not informed"
    status_groups_coarse: tuple = field(default=(("formal", (1,)), ("informal", (2, 3, 4))))
    status_unknown_coarse: str = "other or not informed"
    # Flag labels; codes not listed and NULL both read 'no information'
    flag_status: int = 1
    flag_labels: tuple = (("F", "issued"), ("X", "not issued"), ("N/A", "not applicable"))
    flag_unknown: str = "no information"
    other_places: str = "other places"
    known_occupations_below: int = 20       # fixture: brands from this number on are orphans


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return scan_table(spark, root, name)


def events_fact(spark: SparkSession, root: str) -> DataFrame:
    """Event fact (one row per event)."""
    li = _read(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_returnflag", "l_linestatus", "l_shipdate")
    sup = _read(spark, root, "supplier").select("s_suppkey", "s_nationkey")
    part = _read(spark, root, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    ev_date = F.col("l_shipdate").cast("date")
    return (li.join(sup, li.l_suppkey == sup.s_suppkey)
              .join(part, li.l_partkey == part.p_partkey)
              .select(
                  (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event_id"),
                  ev_date.alias("event_date"),
                  F.col("s_nationkey").alias("sector"),
                  F.nullif(F.col("p_brand"), F.lit("Brand#7")).alias("occupation"),
                  F.concat(F.lower(F.substring("p_type", 1, 2)),
                           F.when(F.col("l_linenumber") == 1, F.lit(".")).otherwise(F.lit("")),
                           F.substring("p_type", 3, 1),
                           F.col("l_linenumber").cast("string"), F.lit(" ")).alias("diag_raw"),
                  F.concat(F.col("p_type"), F.lit(" ")).alias("kind"),
                  F.col("l_returnflag").alias("death"),
                  F.when(F.col("l_linestatus") == "O", F.lit("Male"))
                   .otherwise(F.lit("Female")).alias("sex"),
                  (F.year(ev_date) - (F.lit(18) + F.col("p_size"))).alias("birth_year"),
                  F.col("l_linenumber").alias("status"),
                  F.when(F.col("p_size") % 4 == 0, F.col("p_type"))
                   .when(F.col("p_size") % 4 == 1, F.lit(None).cast("string"))
                   .otherwise(F.concat_ws("/", "p_type", "p_brand")).alias("diag_code"),
              ))


def sector5(nation: F.Column, part: F.Column) -> F.Column:
    """The exposure fact's finer sector key: three of them in each sector, none equal to a sector4 key."""
    return (F.lit(1000) + nation * 3 + F.pmod(part, F.lit(3))).cast("int")


def exposure(spark: SparkSession, root: str) -> DataFrame:
    """Exposure fact (one row per establishment-year analogue)."""
    o = _read(spark, root, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    c = _read(spark, root, "customer").select("c_custkey", "c_nationkey", "c_name")
    # every twelfth nation from 5 on has no jobs, so some events find no exposure
    jobs = F.when(F.col("c_nationkey") % 12 == 5, F.lit(0)) \
            .otherwise(F.floor(F.col("o_totalprice") / 1000)).cast("bigint")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .select(F.year("o_orderdate").alias("year"),
                     sector5(F.col("c_nationkey"), F.col("o_custkey")).alias("sector5"),
                     jobs.alias("jobs"),
                     F.when(F.col("o_orderstatus") != "F", jobs).otherwise(F.lit(0).cast("bigint"))
                      .alias("active_jobs"),
                     F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"),
                              F.substring("c_name", -6, 6)).alias("postcode")))


def sectors(spark: SparkSession, root: str) -> DataFrame:
    """Sector dimension: both granularities (sector4 for events, sector5 for exposure)."""
    n = _read(spark, root, "nation")
    r = _read(spark, root, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
             .select(F.col("n_nationkey").alias("sector4"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("_part"),
                     F.col("n_name").alias("label"),
                     F.char(F.lit(65) + F.col("r_regionkey")).alias("section"))
             .select("sector4", sector5(F.col("sector4"), F.col("_part")).alias("sector5"), "label", "section"))


def section_names() -> dict[str, str]:
    """Section letter → display name (JN15); letters not listed keep themselves."""
    return {"A": "Section A", "B": "Section B", "C": "Section C"}


def notices(spark: SparkSession, root: str) -> DataFrame:
    """Second event source (health-network notifications)."""
    o = _read(spark, root, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    c = _read(spark, root, "customer").select("c_custkey", "c_nationkey")
    d = F.col("o_orderdate").cast("date")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .select(d.alias("event_date"),
                     F.year(d).alias("report_year"),
                     F.substring("o_orderpriority", 1, 1).cast("int").alias("status"),
                     F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("flag"),
                     F.col("c_nationkey").cast("string").alias("residence")))


def named_places(spark: SparkSession, root: str) -> DataFrame:
    """Places listed by name in A18 (others are bucketed): nations of region 1."""
    n = _read(spark, root, "nation")
    return (n.where(F.col("n_regionkey") == 1)
             .select(F.col("n_nationkey").cast("string").alias("code"),
                     F.col("n_name").alias("name")))


def diagnoses(spark: SparkSession, root: str) -> DataFrame:
    """Two-level diagnosis dimension: subcategory, category, 3-char category."""
    p = _read(spark, root, "part").select("p_type", "p_brand").distinct()
    return p.select(F.concat_ws("/", "p_type", "p_brand").alias("sub"),
                    F.col("p_type").alias("cat"),
                    F.upper(F.substring("p_type", 1, 3)).alias("cat3"),
                    F.concat(F.lit("sub "), F.lower("p_brand"), F.lit(" of "), F.lower("p_type")).alias("sub_label"),
                    F.concat(F.lit("category "), F.lower("p_type")).alias("cat_label"))


def occupations(spark: SparkSession, root: str, s: Study = Study()) -> DataFrame:
    """Occupation dimension: brands with a number below the study's limit (others are orphans)."""
    p = _read(spark, root, "part").select("p_brand").distinct()
    return (p.where(F.substring("p_brand", 7, 2).cast("int") < s.known_occupations_below)
             .select(F.col("p_brand").alias("code"),
                     F.concat(F.lit("occupation "), F.lower("p_brand")).alias("label")))

