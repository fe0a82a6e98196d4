"""DuckDB SQL for every registered query, written from the operator definitions.

The statements share nothing with the Spark code but the meaning of the test
tables: constants, the data binding and the rounding rule are stated here again.
Facts are reduced to one small table per purpose (events per month and sector,
events per month and code, jobs per year and sector), and the statements work on
those.  ``VIEWS`` holds the named pieces; ``sql`` puts in front of a statement
those it needs.
"""

from __future__ import annotations

import re

# Study constants.
CALENDAR = ("1995-01-01", "2001-12-01")
SPAN = "BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'"
RATE_YEARS = (1998, 1999, 2000)
FIRST, LAST = 1995, 2001
TOP = 20

# Fixed values (the status codes' groups, which results depend on).
GROUPS = {"formal": (1, 4, 5), "unregistered": (2, 3, 10), "other": (6, 7, 8, 9, 11, 12)}
GROUPS_YEARLY = {"formal": (1,), "informal": (2, 3, 4), "other ties": (5, 6, 7)}
GROUPS_COARSE = {"formal": (1,), "informal": (2, 3, 4)}

VIEWS: dict[str, str] = {}
QUERIES: dict[str, str] = {}


def sql(body: str) -> str:
    """``body`` behind the views it uses, directly or through others."""
    needed: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                need(VIEWS[name])
                needed.append(name)

    need(body)
    return ("WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed) + "\n" if needed else "") + body.strip()


def ratio(over: str, under: str, digits: int) -> str:
    """over / under rounded half away from zero in whole numbers; NULL unless under is positive."""
    a, b, unit = f"CAST(({over}) AS HUGEINT)", f"CAST(({under}) AS HUGEINT)", 10 ** digits
    return (f"CASE WHEN {b} > 0 THEN CAST(sign({a}) * ((abs({a}) * {2 * unit} + {b}) // ({b} * 2)) AS DOUBLE)"
            f" / {unit}.0 END")


def percent(part: str, whole: str, digits: int = 1) -> str:
    return ratio(f"100 * ({part})", whole, digits)


def grouped(column: str, groups: dict[str, tuple], other: str) -> str:
    arms = " ".join(f"WHEN {column} IN ({', '.join(map(str, codes))}) THEN '{label}'" for label, codes in groups.items())
    return f"CASE {arms} ELSE '{other}' END"


# ------------------------------------------------------------------ the roles of the test tables
VIEWS["ev"] = """
  SELECT l_orderkey * 8 + l_linenumber AS event_id, l_shipdate::DATE AS day,
    date_trunc('month', l_shipdate)::DATE AS month, year(l_shipdate)::INTEGER AS yr,
    l_shipdate::DATE """ + SPAN + """ AS inside,
    s_nationkey AS sector, CASE WHEN p_brand <> 'Brand#7' THEN p_brand END AS occupation,
    concat(lower(p_type[1:2]), CASE l_linenumber WHEN 1 THEN '.' ELSE '' END, p_type[3:3], l_linenumber, ' ') AS diagnosis,
    concat(p_type, ' ') AS kind, l_returnflag AS death, l_linenumber AS status,
    CASE l_linestatus WHEN 'O' THEN 'Male' ELSE 'Female' END AS sex,
    year(l_shipdate)::INTEGER - 18 - p_size AS birth_year,
    CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN NULL ELSE concat(p_type, '/', p_brand) END AS mixed_code
  FROM lineitem, supplier, part WHERE l_suppkey = s_suppkey AND l_partkey = p_partkey"""
VIEWS["ex"] = """
  SELECT year(o_orderdate)::INTEGER AS yr, 1000 + c_nationkey * 3 + o_custkey % 3 AS unit,
    CASE WHEN c_nationkey % 12 = 5 THEN 0 ELSE floor(o_totalprice / 1000)::BIGINT END AS jobs,
    o_orderstatus <> 'F' AS active,
    concat(lpad(c_nationkey::VARCHAR, 2, '0'), right(c_name, 6)) AS postcode
  FROM orders, customer WHERE o_custkey = c_custkey"""
VIEWS["sector"] = "SELECT n_nationkey AS sector, n_name AS label, chr(65 + n_regionkey) AS section FROM nation"
VIEWS["unit_sector"] = """
  SELECT 1000 + n_nationkey * 3 + k AS unit, n_nationkey AS sector FROM nation, (VALUES (0), (1), (2)) AS three(k)"""
VIEWS["note"] = """
  SELECT o_orderdate::DATE AS day, year(o_orderdate)::INTEGER AS yr, o_orderpriority[1:1]::INTEGER AS status,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS flag, c_nationkey::VARCHAR AS residence
  FROM orders, customer WHERE o_custkey = c_custkey"""
VIEWS["diag_dim"] = """
  SELECT concat(p_type, '/', p_brand) AS sub, p_type AS cat, upper(p_type[1:3]) AS cat3,
    concat('sub ', lower(p_brand), ' of ', lower(p_type)) AS sub_label, concat('category ', lower(p_type)) AS cat_label
  FROM part GROUP BY ALL"""
VIEWS["occ_dim"] = """
  SELECT p_brand AS code, concat('occupation ', lower(p_brand)) AS label FROM part
  WHERE p_brand[7:8]::INTEGER < 20 GROUP BY ALL"""

# ------------------------------------------------------------------ coverage
VIEWS["by_month"] = "SELECT month, count(*) AS n FROM ev GROUP BY month"
VIEWS["calendar"] = f"""
  SELECT unnest(generate_series(DATE '{CALENDAR[0]}', DATE '{CALENDAR[1]}', INTERVAL 1 MONTH))::DATE AS month"""
VIEWS["dense"] = """
  SELECT calendar.month, ifnull((SELECT n FROM by_month WHERE by_month.month = calendar.month), 0)::BIGINT AS n
  FROM calendar"""
VIEWS["cover"] = "SELECT month, n, 2 * n >= (SELECT median(n) FROM dense) AS good FROM dense"
#: Calendar months (1-12) that are good in both comparison years.
VIEWS["paired"] = f"""
  SELECT month(month) AS m FROM cover WHERE good AND year(month) IN ({FIRST}, {LAST}) GROUP BY 1 HAVING count(*) = 2"""

QUERIES["coverage_monthly"] = "SELECT strftime(month, '%Y-%m') AS month, n AS events, good AS adequate FROM cover"
QUERIES["adequate_months_per_year"] = """
SELECT year(month)::INTEGER AS year, count(*) FILTER (good) AS adequate_months FROM cover GROUP BY 1"""
QUERIES["comparable_months"] = "SELECT m::INTEGER AS month_of_year FROM paired"
QUERIES["coverage_summary"] = """
SELECT ifnull(year(month)::VARCHAR, 'all') AS scope, count(*) FILTER (good) AS adequate_months, count(*) AS months,
  count(*) FILTER (NOT good) AS inadequate_months
FROM cover GROUP BY GROUPING SETS ((year(month)), ())"""

# ------------------------------------------------------------------ rates
#: One row per sector: jobs of each rate year, events and diseases of its good months.
VIEWS["sector_jobs"] = "SELECT sector, " + ", ".join(
    f"sum(jobs) FILTER (yr = {y}) AS j{y}" for y in RATE_YEARS) + """
  FROM ex JOIN unit_sector USING (unit) GROUP BY sector"""
VIEWS["sector_events"] = "SELECT sector, " + ", ".join(
    f"count(*) FILTER (yr = {y}) AS e{y}, count(*) FILTER (yr = {y} AND trim(kind) ILIKE 'E%') AS d{y}" for y in RATE_YEARS) + """
  FROM ev SEMI JOIN (SELECT month FROM cover WHERE good) AS fine USING (month) GROUP BY sector"""
VIEWS["good_months"] = "SELECT " + ", ".join(
    f"count(*) FILTER (good AND year(month) = {y}) AS m{y}" for y in RATE_YEARS) + " FROM cover"
_A, _B, _C = RATE_YEARS


def _sum(prefix: str) -> str:
    return " + ".join(f"ifnull({prefix}{y}, 0)" for y in RATE_YEARS)


def _rate(y: int) -> str:
    return ratio(f"12000 * ifnull(e{y}, 0)::HUGEINT", f"j{y}::HUGEINT * m{y}", 1)


VIEWS["rate_table"] = f"""
  SELECT sector, label, j{_C}::BIGINT AS jobs_{_C}, ({_sum('e')})::BIGINT AS events, ({_sum('d')})::BIGINT AS diseases,
    {", ".join(f"{_rate(y)} AS rate_{y}" for y in RATE_YEARS)},
    {ratio(f"12000 * (ifnull(e{_C}, 0)::HUGEINT * j{_A} * m{_A} - ifnull(e{_A}, 0)::HUGEINT * j{_C} * m{_C})",
           f"j{_C}::HUGEINT * m{_C} * j{_A} * m{_A}", 1)} AS change_{_A}_{_C}
  FROM sector_jobs JOIN sector USING (sector) LEFT JOIN sector_events USING (sector), good_months
  WHERE least({", ".join(f"ifnull(j{y}, 0)" for y in RATE_YEARS)}) >= 2000 AND {_sum('e')} >= 30"""
VIEWS["rate_top"] = f"SELECT * FROM rate_table ORDER BY rate_{_C} DESC NULLS FIRST, sector LIMIT {TOP}"
VIEWS["city"] = f"""
  SELECT yr AS year, adequate_months, jobs, events,
    {ratio("12000 * events::HUGEINT", "jobs::HUGEINT * adequate_months", 1)} AS rate
  FROM (SELECT yr, sum(jobs)::BIGINT AS jobs FROM ex WHERE yr IN {RATE_YEARS} GROUP BY yr)
  JOIN (SELECT year(month)::INTEGER AS yr, count(*) FILTER (good) AS adequate_months,
          (sum(n) FILTER (good))::BIGINT AS events FROM cover GROUP BY 1) USING (yr)
  WHERE events IS NOT NULL"""

QUERIES["sector_rate_table"] = "SELECT * FROM rate_table"
QUERIES["sector_rate_ranking"] = "SELECT * FROM rate_top"
QUERIES["silver_rate_ranking"] = "SELECT * FROM rate_top"
QUERIES["overall_rate_by_year"] = "SELECT * FROM city"
QUERIES["rose_count"] = f"SELECT count(*) AS shown, count(*) FILTER (rate_{_C} > rate_{_A}) AS rose FROM rate_top"
QUERIES["ranking_search"] = f"""
SELECT *, rate_{_C} - rate_{_A} AS change FROM rate_table WHERE label ILIKE '%nation_1%' AND label LIKE '%\\_%' ESCAPE '\\'
ORDER BY rate_{_B} DESC NULLS LAST, sector LIMIT 10"""
QUERIES["ratio_to_overall"] = f"""
SELECT sector, label, rate_{_C} AS top_rate, late.rate AS city_rate,
  {ratio(f"round(rate_{_C} * 10)", "round(late.rate * 10)", 1)} AS times_city,
  (round(late.rate * 10)::BIGINT - round(early.rate * 10)::BIGINT) / 10.0::DOUBLE AS city_change
FROM (FROM rate_top ORDER BY rate_{_C} DESC NULLS FIRST, sector LIMIT 1), city AS late, city AS early
WHERE late.year = {_C} AND early.year = {_A}"""
QUERIES["unmatched_event_share"] = f"""
SELECT sum(n)::BIGINT AS events, ifnull(sum(n) FILTER (NOT working), 0)::BIGINT AS in_sector_without_jobs,
  {percent("ifnull(sum(n) FILTER (NOT working), 0)", "sum(n)", 2)} AS pct
FROM (SELECT count(*) AS n, ifnull(sector IN (
        SELECT unit_sector.sector FROM unit_sector JOIN ex USING (unit) WHERE yr IN {RATE_YEARS} AND jobs > 0), false) AS working
      FROM ev WHERE inside GROUP BY ev.sector)"""
VIEWS["job_years"] = "SELECT sector, (" + _sum("j") + ")::BIGINT AS jobs FROM sector_jobs WHERE " + \
    " OR ".join(f"j{y} IS NOT NULL" for y in RATE_YEARS)
VIEWS["sector_period"] = "SELECT sector, count(*) AS n FROM ev WHERE inside GROUP BY sector"
VIEWS["gap_table"] = f"""
  SELECT sector, label, section, jobs AS job_years, ifnull(n, 0)::BIGINT AS events,
    {ratio("1000 * ifnull(n, 0)", "jobs", 2)} AS per_thousand,
    {ratio("jobs::HUGEINT * all_n", "all_jobs", 0)} AS expected,
    {ratio("jobs::HUGEINT * all_n - ifnull(n, 0)::HUGEINT * all_jobs", "all_jobs", 0)} AS gap,
    {ratio("ifnull(n, 0)::HUGEINT * all_jobs", "jobs::HUGEINT * all_n", 2)} AS observed_over_expected
  FROM job_years JOIN sector USING (sector) LEFT JOIN sector_period USING (sector),
    (SELECT sum(jobs) AS all_jobs FROM job_years), (SELECT sum(n) AS all_n FROM sector_period)
  WHERE jobs >= 3000"""
QUERIES["expected_vs_observed_table"] = "SELECT * FROM gap_table"
QUERIES["expected_vs_observed"] = f"""
SELECT * EXCLUDE (section) FROM gap_table ORDER BY gap DESC NULLS FIRST, sector LIMIT {TOP}"""
QUERIES["gap_filtered"] = """
SELECT * EXCLUDE (section), CASE WHEN section IN ('A', 'B', 'C') THEN 'Section ' || section ELSE section END AS big_sector,
  CASE WHEN observed_over_expected < 0.5 THEN 'below half' WHEN observed_over_expected >= 0.5 THEN 'half or more' END AS "group"
FROM gap_table WHERE section IS DISTINCT FROM 'B' ORDER BY gap DESC NULLS LAST, sector LIMIT 15"""

# ------------------------------------------------------------------ shares
def _codes(name: str, code: str) -> None:
    """Per code: events of the period, and of the paired months of both comparison years."""
    VIEWS[name] = f"""
  SELECT {code} AS code, count(*) FILTER (inside) AS n,
    count(*) FILTER (yr = {FIRST} AND month(month) IN (FROM paired)) AS c0,
    count(*) FILTER (yr = {LAST} AND month(month) IN (FROM paired)) AS c1
  FROM ev GROUP BY 1"""


_codes("occ_counts", "occupation")
_codes("diag_counts", "upper(trim(diagnosis)[1:3])")
_codes("occ_filled", "ifnull(occupation, 'NI')")
_codes("diag_filled", "ifnull(upper(replace(trim(diagnosis), '.', '')[1:3]), 'NI')")


def _share(counts: str, names: str, outside: str) -> str:
    """Codes without a code keep their total and have no yearly share."""
    c0, c1 = ("CASE WHEN code IS NULL THEN 0 ELSE " + c + " END" for c in ("c0", "c1"))
    return f"""
SELECT code, ifnull((SELECT min(label) FROM ({names}) AS d WHERE d.code = c.code), '{outside}') AS label, n AS events,
  {percent("n", "every")} AS pct_total,
  {percent(f"(SELECT sum(o.n) FROM {counts} AS o WHERE o.n > c.n OR o.n = c.n AND (o.code <= c.code OR c.code IS NULL))", "every")} AS pct_cumulative,
  ifnull({percent(c0, "t0")}, 0.0) AS pct_{FIRST}, ifnull({percent(c1, "t1")}, 0.0) AS pct_{LAST},
  ifnull({ratio(f"100 * ({c1}::HUGEINT * t0 - {c0}::HUGEINT * t1)", "t0::HUGEINT * t1", 1)}, 0.0) AS change_pp
FROM {counts} AS c, (SELECT sum(n) AS every, sum(c0) AS t0, sum(c1) AS t1 FROM {counts})
WHERE n > 0 ORDER BY n DESC, code NULLS LAST LIMIT {TOP}"""


QUERIES["occupation_share"] = _share("occ_counts", "FROM occ_dim", "(code outside the occupation table)")
QUERIES["diagnosis_share"] = _share("diag_counts", "SELECT cat3 AS code, cat_label AS label FROM diag_dim",
                                    "(code outside the diagnosis table)")


def _stack(counts: str, dimension: str, names: str) -> str:
    """All codes of one dimension in rank order; paired months count inside the period only."""
    return f"""
  SELECT '{dimension}' AS dimension, row_number() OVER (ORDER BY n DESC, code) AS ranking, code,
    CASE code WHEN 'NI' THEN 'not informed' ELSE
      ifnull((SELECT max(label) FROM ({names}) AS d WHERE d.code = c.code), 'no description in reference table') END AS description,
    n AS events, {percent("n", "sum(n) OVER ()")} AS pct_total,
    sum(n) OVER (ORDER BY n DESC, code) AS run, sum(n) OVER () AS every,
    ifnull({percent("c0", "sum(c0) OVER ()")}, 0.0) AS pct_{FIRST}, ifnull({percent("c1", "sum(c1) OVER ()")}, 0.0) AS pct_{LAST}
  FROM {counts} AS c WHERE n > 0"""


VIEWS["stack_all"] = _stack("occ_filled", "occupation", "FROM occ_dim") + "\n  UNION ALL" + \
    _stack("diag_filled", "diagnosis", "SELECT cat3 AS code, cat_label AS label FROM diag_dim")
VIEWS["stack"] = f"""
  SELECT dimension, ranking, code, description, events, pct_total, {percent("run", "every")} AS pct_cumulative,
    pct_{FIRST}, pct_{LAST} FROM stack_all"""
VIEWS["stack_30"] = "SELECT * FROM stack WHERE ranking <= 30"
QUERIES["composition_stacked"] = "SELECT * FROM stack_30"
QUERIES["not_informed_toggle"] = """
SELECT * FROM stack_30 WHERE dimension = 'occupation' AND code <> 'NI' ORDER BY ranking LIMIT 15"""
QUERIES["headline_rows"] = """
SELECT stack_30.* FROM stack_30 JOIN (SELECT dimension, min(ranking) AS ranking FROM stack_30 WHERE code <> 'NI' GROUP BY 1)
USING (dimension, ranking)"""
_reach = lambda rows, p: f"(SELECT min(ranking) FROM {rows} AS r WHERE r.dimension = x.dimension AND r.pct_cumulative >= {p})"
QUERIES["pareto_cut"] = f"""
SELECT dimension, ifnull({_reach("stack_30", 50)}::VARCHAR, 'more than 30') AS items_to_50,
  ifnull({_reach("stack_30", 80)}::VARCHAR, 'more than 30') AS items_to_80,
  (SELECT count(*) + 1 FROM stack_30 AS r WHERE r.dimension = x.dimension AND pct_cumulative < 50) AS items_below_50_plus_one
FROM (SELECT DISTINCT dimension FROM stack_30) AS x"""
QUERIES["pareto_exact"] = f"""
SELECT dimension, {_reach("stack", 50)}::VARCHAR AS items_to_50, {_reach("stack", 80)}::VARCHAR AS items_to_80,
  (SELECT count(*) + 1 FROM stack AS r WHERE r.dimension = x.dimension AND pct_cumulative < 50) AS items_below_50_plus_one
FROM (SELECT DISTINCT dimension FROM stack) AS x"""
VIEWS["moves"] = f"""
  SELECT code, description, ranking, round(pct_{LAST} * 10)::BIGINT - round(pct_{FIRST} * 10)::BIGINT AS tenths
  FROM stack WHERE dimension = 'diagnosis' AND ranking <= 15"""
QUERIES["biggest_mover"] = """
(SELECT 'gain' AS direction, code, description, tenths / 10.0::DOUBLE AS change_pp FROM moves ORDER BY tenths DESC, ranking LIMIT 1)
UNION ALL
(SELECT 'loss', code, description, tenths / 10.0::DOUBLE FROM moves ORDER BY tenths, ranking LIMIT 1)"""


def _parts(table: str, group: str, alias: str, measure: str, by: str = "", digits: int = 1, pct: str = "pct") -> str:
    """Rows per group and their share of the whole, or of each ``by``."""
    first = f"{by}, " if by else ""
    over = f"PARTITION BY {by.split(' AS ')[-1]}" if by else ""
    return f"""
SELECT * , {percent(measure, f"sum({measure}) OVER ({over})", digits)} AS {pct}
FROM (SELECT {first}{group} AS {alias}, count(*) AS {measure} FROM {table} GROUP BY ALL)"""


VIEWS["note_period"] = f"SELECT * FROM note WHERE day {SPAN}"
QUERIES["status_share"] = _parts("note_period", grouped("status", GROUPS, "unknown"), '"group"', "notices")
VIEWS["flags"] = f"""
  SELECT CASE flag WHEN 'F' THEN 'issued' WHEN 'X' THEN 'not issued' WHEN 'N/A' THEN 'not applicable'
      ELSE 'no information' END AS flag_label, notices, {percent("notices", "sum(notices) OVER ()")} AS pct
  FROM (SELECT flag, count(*) AS notices FROM note_period WHERE status = 1 GROUP BY flag)"""
QUERIES["followup_flag_share"] = "SELECT * FROM flags"
QUERIES["no_followup_share"] = """
SELECT ifnull(sum(pct) FILTER (flag_label IN ('not issued', 'no information')), 0.0) AS pct_without_followup FROM flags"""
VIEWS["kinds"] = """
  SELECT sector, label, count(*) AS events, count(*) FILTER (trim(kind) ILIKE 'S%') AS typical,
    count(*) FILTER (trim(kind) ILIKE 'PROMO') AS commute, count(*) FILTER (trim(kind) ILIKE 'E%') AS disease
  FROM ev JOIN sector USING (sector) WHERE inside GROUP BY ALL"""
QUERIES["sector_counts_by_type"] = f"""
SELECT *, {percent("events", "(SELECT sum(events) FROM kinds)")} AS pct_total FROM kinds ORDER BY events DESC, sector LIMIT 15"""
VIEWS["paired_events"] = f"SELECT * FROM ev WHERE yr IN ({FIRST}, {LAST}) AND month(month) IN (FROM paired)"
QUERIES["type_by_year"] = f"""
SELECT *, {percent("events", "sum(events) OVER (PARTITION BY year)")} AS pct_in_year
FROM (SELECT yr AS year, trim(kind) AS kind, count(*) AS events, count(*) FILTER (trim(death) ILIKE 'R') AS deaths
      FROM paired_events GROUP BY ALL)"""
QUERIES["exposure_by_area"] = f"""
SELECT *, {percent("jobs", "sum(jobs) OVER ()")} AS pct_total
FROM (SELECT postcode[1:5] AS area, sum(jobs)::BIGINT AS jobs, count(*) FILTER (active AND jobs > 0) AS active_units
      FROM ex WHERE yr = {_C} GROUP BY 1) ORDER BY jobs DESC, area LIMIT 15"""
QUERIES["residence_share"] = _parts(
    "note_period LEFT JOIN (SELECT n_nationkey::VARCHAR AS residence, n_name FROM nation WHERE n_regionkey = 1) USING (residence)",
    "ifnull(n_name, 'other places')", "place", "notices")
QUERIES["profile_sex_age"] = f"""
SELECT *, {percent("events", "sum(events) OVER (PARTITION BY year)")} AS pct_in_year
FROM (SELECT yr AS year, sex, CASE WHEN birth_year IS NULL THEN 'no information' ELSE
        ['up to 24', '25 to 34', '35 to 44', '45 to 54', '55 or more'][
          1 + (yr - birth_year >= 25)::INT + (yr - birth_year >= 35)::INT + (yr - birth_year >= 45)::INT
          + (yr - birth_year >= 55)::INT] END AS age_band, count(*) AS events
      FROM paired_events GROUP BY ALL)"""
VIEWS["note_rate_years"] = f"SELECT * FROM note WHERE yr IN {RATE_YEARS}"
VIEWS["note_place"] = "SELECT * FROM note_rate_years WHERE residence = '3'"
_yearly = grouped("status", GROUPS_YEARLY, "not informed")
QUERIES["status_by_year"] = _parts("note_rate_years", _yearly, '"group"', "notices", "yr AS year", 2, "pct_in_year")
QUERIES["status_by_year_place"] = _parts("note_place", _yearly, '"group"', "notices", "yr AS year", 2, "pct_in_year")


def _by_status(place: str) -> str:
    return f"""
SELECT year, "group", ifnull(code, 'N/I') AS code, ifnull(ifnull(sub_label, cat_label), 'not found') AS diagnosis, cases,
  {percent("cases", "sum(cases) OVER (PARTITION BY year)", 2)} AS pct_in_year
FROM (SELECT yr AS year, {grouped("status", GROUPS_COARSE, "other or not informed")} AS "group", mixed_code AS code,
        sub_label, cat_label, count(*) AS cases
      FROM ev LEFT JOIN diag_dim ON mixed_code IN (sub, cat) WHERE yr IN {RATE_YEARS} {place} GROUP BY ALL)
ORDER BY cases DESC, year, "group", code, diagnosis, cat_label NULLS LAST LIMIT 20"""


QUERIES["diagnosis_by_status"] = _by_status("")
QUERIES["diagnosis_by_status_place"] = _by_status("AND sector = 3")
VIEWS["totals"] = """
  SELECT count(*) AS total, count(*) FILTER (trim(kind) ILIKE 'S_ALL') AS typical,
    count(*) FILTER (trim(kind) = 'PROMO') AS commute, count(*) FILTER (trim(kind) ILIKE 'E%') AS disease,
    count(*) FILTER (death = 'R') AS deaths, count(*) FILTER (sex = 'Male') AS men, count(*) FILTER (sex = 'Female') AS women
  FROM ev WHERE inside"""
QUERIES["event_summary"] = "SELECT * FROM totals"
QUERIES["summary_shares"] = "SELECT total, " + ", ".join(
    f"{percent(c, 'total', 2 if c == 'deaths' else 1)} AS pct_{c}" for c in ("typical", "commute", "disease", "men", "deaths")) + \
    " FROM totals"
QUERIES["counts_by_section"] = _parts(
    "ev JOIN sector USING (sector) WHERE inside", "section", "section", "events") \
    .replace("SELECT * ,", "SELECT *, CASE WHEN section IN ('A', 'B', 'C') THEN 'Section ' || section ELSE section END AS section_name,") \
    + " ORDER BY events DESC, section LIMIT 8"
VIEWS["both_sources"] = """
  SELECT month, n, good, (SELECT count(*) FROM note_period WHERE date_trunc('month', day) = cover.month) AS m FROM cover"""
QUERIES["two_source_monthly"] = f"""
SELECT strftime(month, '%Y-%m') AS month, n AS events, m AS notices, good AS adequate,
  CASE WHEN good THEN {ratio("m", "n", 2)} END AS notices_per_event FROM both_sources"""
QUERIES["two_source_correlation"] = """
SELECT count(*) AS months_used, round(corr(n, m), 2) AS correlation FROM both_sources WHERE good"""

# ------------------------------------------------------------------ cleansing and checks
#: White space at the ends of a text, by code point.
_EDGE = "[" + "".join(f"\\x{{{c:X}}}" for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                                0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) + "]"
QUERIES["strip_text"] = f"""
SELECT lang, count(*) AS docs, count(*) FILTER (inner_text <> padded) AS changed, count(*) FILTER (inner_text <> text) AS beyond,
  sum(length(inner_text))::BIGINT AS chars_after
FROM (SELECT lang, text, padded, regexp_replace(regexp_replace(padded, '^{_EDGE}+', ''), '{_EDGE}+$', '') AS inner_text
      FROM (SELECT lang, text, concat(chr(9), chr(160), text, chr(8195), chr(10)) AS padded FROM documents))
GROUP BY lang"""
VIEWS["last_lines"] = """
  SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem
  ORDER BY l_orderkey, l_linenumber, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC,
    l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC"""
QUERIES["dedup_keep_last"] = "SELECT * FROM last_lines"
QUERIES["dedup_rate"] = f"""
SELECT rows_before, rows_after, rows_before - rows_after AS removed, {percent("rows_before - rows_after", "rows_before")} AS pct_removed
FROM (SELECT count(*) AS rows_before, count(DISTINCT (l_orderkey, l_linenumber)) AS rows_after FROM lineitem)"""
QUERIES["fill_forward"] = """
SELECT event_id, user_id, event_type, (SELECT arg_max(p.value, p.event_id) FROM events AS p
  WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.event_id <= e.event_id) AS last_purchase_value
FROM events AS e"""
#: Codes a to o of the decode query: label 'a:3' for key 3 of column a, keys 7 and 8 without a label.
QUERIES["decode_dictionary"] = "SELECT " + ", ".join(
    f"CASE WHEN code_{c} < 7 THEN '{c}:' || code_{c} END AS code_{c}_label" for c in "abcdefghijklmno") + """, event_type,
  CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'Page view' WHEN 'purchase' THEN 'Purchase' WHEN 'error' THEN 'Error'
  END AS event_type_label, count(*) AS events
FROM (SELECT event_type, """ + ", ".join(f"(event_id // {k + 1}) % 9 AS code_{c}" for k, c in enumerate("abcdefghijklmno")) + """ FROM events)
GROUP BY ALL"""
QUERIES["conform_codes"] = """
SELECT lpad(o_orderpriority[1:1], 3, '0') AS priority_code,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status_dotted,
  upper(o_orderpriority[1:4]) AS prio4, digits[1:3] AS class3, count(*) AS orders, count(DISTINCT digits[1:4]) AS class4_keys
FROM (SELECT *, o_orderkey::VARCHAR AS digits FROM orders) GROUP BY ALL"""
QUERIES["parse_dates"] = """
SELECT CASE o_orderstatus WHEN 'P' THEN NULL ELSE year(o_orderdate)::INTEGER END AS birth_year, count(*) AS rows,
  count(*) FILTER (o_orderstatus = 'P') AS invalid, min(o_orderdate::DATE) FILTER (o_orderstatus <> 'P') AS first_date,
  max(o_orderdate::DATE) FILTER (o_orderstatus <> 'P') AS last_date
FROM orders GROUP BY 1"""
QUERIES["parse_iso_dates"] = """
SELECT o_orderstatus AS form, count(*) AS rows, count(*) FILTER (o_orderstatus = 'P') AS invalid,
  min(o_orderdate::DATE) FILTER (o_orderstatus <> 'P') AS first_date, max(o_orderdate::DATE) FILTER (o_orderstatus <> 'P') AS last_date
FROM orders GROUP BY 1"""
VIEWS["line_keys"] = "SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber"
QUERIES["key_check"] = """
SELECT sum(n)::BIGINT AS rows, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS duplicated_keys,
  (sum(n) - count(*))::BIGINT AS surplus_rows FROM line_keys"""
VIEWS["orphan_events"] = "SELECT event_id, occupation FROM ev WHERE occupation NOT IN (SELECT code FROM occ_dim)"
QUERIES["orphan_check"] = f"""
SELECT rows, orphan_rows, orphan_keys, {percent("orphan_rows", "rows", 2)} AS pct_orphan
FROM (SELECT count(*) AS rows FROM ev),
  (SELECT count(*) AS orphan_rows, count(DISTINCT occupation) AS orphan_keys FROM orphan_events)"""
QUERIES["orphan_rows"] = "SELECT * FROM orphan_events"
QUERIES["width_check"] = """
SELECT count(*) FILTER (length(diagnosis) >= 6) AS diag_raw_too_long, count(*) FILTER (length(occupation) >= 8) AS occupation_too_long
FROM ev"""
QUERIES["range_check"] = """
SELECT count(*) AS non_null, count(*) FILTER (round(l_extendedprice, 2) >= 100000) AS out_of_range FROM lineitem"""
QUERIES["empty_columns"] = """
UNPIVOT (SELECT count(day) AS event_date, count(yr) AS report_year, count(status) AS status, count(flag) AS flag,
  count(residence) AS residence, 0::BIGINT AS "never.filled" FROM note)
ON COLUMNS(*) INTO NAME column_name VALUE non_null"""
QUERIES["empty_columns"] = f"SELECT *, non_null = 0 AS all_null FROM ({QUERIES['empty_columns'].strip()})"
QUERIES["one_to_one"] = """
SELECT count(*) AS short_keys, count(*) FILTER (brands > 1) AS ambiguous_keys
FROM (SELECT count(DISTINCT p_brand) AS brands FROM part GROUP BY p_brand[1:7])"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")
QUERIES["table_counts"] = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES)
QUERIES["not_null_check"] = """
SELECT count(*) - count(day) AS event_date_nulls, count(*) - count(sector) AS sector_nulls,
  count(*) - count(occupation) AS occupation_nulls, count(*) - count(mixed_code) AS diag_code_nulls FROM ev"""
QUERIES["quarantine_split"] = """
SELECT CASE WHEN occupation IS NULL OR mixed_code IS NULL THEN 'rejected' ELSE 'accepted' END AS part, count(*) AS rows,
  sum(event_id)::BIGINT AS key_sum FROM ev GROUP BY 1"""

# ------------------------------------------------------------------ files, places, dimensions, builders
QUERIES["csv_scan"] = """
SELECT doc_id, lpad(doc_id::VARCHAR, 8, '0') AS code, concat('say "', lang, '"; ', chr(10), source) AS note, md5(text) AS text_md5,
  NULL::VARCHAR AS _corrupt_record FROM documents"""
QUERIES["ordered_files"] = """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'OLD' END AS segment FROM customer"""
QUERIES["yearly_files"] = """
SELECT year(o_orderdate)::INTEGER AS year, count(*) AS orders, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
FROM orders WHERE year(o_orderdate) IN (1998, 1999, 2000) GROUP BY 1"""
QUERIES["land_tables"] = """
SELECT form, count(*) AS rows, sum(c_custkey)::BIGINT AS key_sum, count(DISTINCT c_name) AS names
FROM customer, (VALUES ('csv'), ('parquet'), ('partitioned')) AS f(form) GROUP BY form"""
QUERIES["append_table"] = """
SELECT c_mktsegment, count(*) AS rows, min(c_custkey) AS first_key, max(c_custkey) AS last_key FROM customer GROUP BY 1"""
QUERIES["publish_tables"] = """
SELECT 0 AS place, 'nation' AS table_name, count(*) AS rows FROM nation UNION ALL SELECT 1, 'customer', count(*) FROM customer
UNION ALL SELECT 2, 'orders', count(*) FROM orders"""
QUERIES["rename_columns"] = """
SELECT s_suppkey AS supplier_id, s_name AS "supplier name", s_nationkey AS nation, s_acctbal AS "account.balance" FROM supplier"""
QUERIES["place_filters"] = """
SELECT 'equal' AS form, count(*) AS rows, min(c_custkey) AS first_key FROM customer WHERE c_nationkey = 3
UNION ALL SELECT 'prefix', count(*), min(c_custkey) FROM customer WHERE c_nationkey::VARCHAR LIKE '1%'
UNION ALL SELECT 'cast', count(*), min(c_custkey) FROM customer WHERE c_nationkey::VARCHAR = '12'"""
QUERIES["label_search"] = """
SELECT count(*) AS labels, min(n_nationkey) AS first_key FROM nation WHERE n_nationkey % 5 = 2"""
#: A sheet from part: a header every 37 rows, the upper level on every 50th row only, no leaf every 11 rows.
VIEWS["sheet"] = """
  SELECT p_partkey AS line, CASE WHEN p_partkey % 37 = 0 THEN 'Header' WHEN p_partkey % 50 = 1 THEN concat('S', p_partkey // 50) END AS top,
    CASE WHEN p_partkey % 11 > 0 THEN concat(lpad((p_partkey % 90 + 10)::VARCHAR, 2, '0'), '.', p_partkey % 9 + 1, '1-', p_partkey % 7) END AS leaf,
    p_name AS name FROM part"""
VIEWS["filled_sheet"] = """
  SELECT line, (SELECT arg_max(u.top, u.line) FROM sheet AS u WHERE u.line <= s.line AND u.top <> 'Header') AS top, leaf, name
  FROM sheet AS s WHERE top IS DISTINCT FROM 'Header' AND leaf IS NOT NULL"""
QUERIES["fill_hierarchy"] = "SELECT * FROM filled_sheet"
QUERIES["build_sector_dim"] = """
SELECT line, top, leaf, name, replace(replace(leaf, '.', ''), '-', '')[1:5] AS class5,
  replace(replace(leaf, '.', ''), '-', '')[1:4] AS class4 FROM filled_sheet
UNION ALL SELECT NULL, NULL, NULL, 'not classified', '00000', '0000'"""
QUERIES["unknown_member"] = """
SELECT p_brand AS code, lower(p_brand) AS label FROM part GROUP BY 1 UNION ALL SELECT '999999', 'not classified'"""
QUERIES["stack_shapes"] = """
SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier"""
QUERIES["drop_identifiers"] = "SELECT c_custkey, c_nationkey FROM customer"
QUERIES["build_events"] = """
SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS event_date, concat(upper(l_returnflag), l_linestatus, '1', l_linenumber) AS diagnosis,
  lpad((l_partkey % 1000)::VARCHAR, 4, '0') AS sector, (l_suppkey % 30)::VARCHAR AS place, 1940 + (l_partkey % 50)::INTEGER AS birth_year
FROM last_lines"""
QUERIES["build_exposure"] = """
SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, lpad((o_custkey % 10000)::VARCHAR, 7, '0') AS subclass,
  lpad((o_custkey % 10000)::VARCHAR, 7, '0')[1:5] AS class FROM orders"""
QUERIES["build_movements"] = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status,
  lpad((o_custkey % 10000)::VARCHAR, 7, '0') AS subclass, lpad((o_custkey % 10000)::VARCHAR, 7, '0')[1:5] AS class FROM orders"""
QUERIES["build_notifications"] = """
SELECT o_orderkey, o_orderpriority[1:1] || 'A' AS code, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS day FROM orders"""
QUERIES["build_notifications_two"] = """
SELECT o_orderkey, o_orderdate::DATE AS day FROM orders"""
QUERIES["build_diagnoses"] = """
SELECT sub, sub_label, cat, cat_label, cat3 FROM diag_dim"""


# ------------------------------------------------------------------ line numbers, ranks, batches, checks, bound SQL
#: The sheet's rows in the order of its key, numbered from 1.
VIEWS["numbered_sheet"] = "SELECT row_number() OVER (ORDER BY line) AS line, top, leaf, name FROM sheet"
QUERIES["hierarchy_from_files"] = """
SELECT s.line, (SELECT arg_max(u.top, u.line) FROM numbered_sheet AS u WHERE u.line <= s.line AND u.top <> 'Header') AS top, leaf, name
FROM numbered_sheet AS s WHERE top IS DISTINCT FROM 'Header' AND leaf IS NOT NULL"""
QUERIES["running_total"] = """
SELECT supplier, day, quantity, (sum(quantity) OVER w)::BIGINT AS so_far, row_number() OVER w AS place,
  (sum(quantity) OVER (PARTITION BY supplier))::BIGINT AS whole
FROM (SELECT CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey END AS supplier, l_shipdate::DATE AS day,
        sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem GROUP BY 1, 2)
WINDOW w AS (PARTITION BY supplier ORDER BY day ROWS UNBOUNDED PRECEDING)"""
QUERIES["keep_last_stream"] = "SELECT * FROM last_lines"
_RULES = {
    ("rows_1", "*"): "CASE WHEN count(*) < 1 THEN 1 ELSE 0 END", ("not_null", "event_date"): "count(*) - count(day)",
    ("not_null", "occupation"): "count(*) - count(occupation)", ("not_null", "diag_code"): "count(*) - count(mixed_code)",
    ("filled", "kind"): "CASE WHEN count(kind) < 1 THEN 1 ELSE 0 END", ("filled", "never.filled"): "1",
    ("max_width_5", "diag_raw"): "count(*) FILTER (length(diagnosis) > 5)",
    ("max_width_7", "occupation"): "count(*) FILTER (length(occupation) > 7)",
    ("fits_smallint", "event_id"): "count(*) FILTER (event_id > 32767)",
    ("one_of", "sex"): "count(*) FILTER (sex NOT IN ('Male', 'Female'))", ("one_of", "death"): "count(*) FILTER (death NOT IN ('R', 'N'))"}
QUERIES["constraint_suite"] = "SELECT *, violations = 0 AS passed FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS \"constraint\", '{c}' AS column_name, count(*) AS rows, ({e})::BIGINT AS violations FROM ev"
    for (n, c), e in _RULES.items()) + ")"
QUERIES["quarantine_batches"] = """
SELECT (year(day) % 2)::INTEGER AS batch, CASE WHEN occupation IS NULL OR mixed_code IS NULL THEN 'rejected' ELSE 'accepted' END AS verdict,
  count(*) AS rows, sum(event_id)::BIGINT AS key_sum FROM ev GROUP BY 1, 2"""
QUERIES["group_median"] = """
SELECT CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey END AS supplier, count(l_extendedprice) FILTER (l_linenumber < 7) AS rows,
  median(l_extendedprice) FILTER (l_linenumber < 7) AS median FROM lineitem GROUP BY 1"""
QUERIES["catalog_counts"] = QUERIES["table_counts"]
QUERIES["overall_rate_sql"] = QUERIES["overall_rate_by_year"]
QUERIES["known_by_sector"] = """
SELECT sector, occupation IS NOT NULL AND occupation IN (SELECT code FROM occ_dim) AS known, count(*) AS events
FROM ev WHERE sector IN (SELECT n_nationkey FROM nation WHERE n_regionkey <= 1) GROUP BY 1, 2"""
QUERIES["csv_latin1"] = """
SELECT doc_id, concat('Construção; é "', lang, '" ÿ') AS label, lpad(doc_id::VARCHAR, 7, '0') AS code, NULL::VARCHAR AS _corrupt_record
FROM documents"""


def oracle_queries() -> dict[str, str]:
    """Name → SQL."""
    return {name: sql(body) for name, body in QUERIES.items()}
