"""Analyses as SQL text with bound parameters.

A text names its tables as ``{events}`` and its values as ``:name``.  Tables are
DataFrames, values travel beside the text and never become part of it.  The
coverage rule is a text that other texts are put behind.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ratewise.sources.fixtures import Study


def bound(spark: SparkSession, text: str, args: dict, **tables: DataFrame) -> DataFrame:
    """``text`` over ``tables`` with the values ``args``."""
    return spark.sql(text, args=args, **tables)


def coverage_text(events: str = "{events}", date: str = "event_date") -> str:
    """The coverage rule as common table expressions ending in ``coverage (month, n, ok)``.

    Values: ``calendar_start``, ``calendar_end`` (dates) and ``fraction``.
    """
    return f"""
by_month AS (SELECT trunc({date}, 'MM') AS month, count(*) AS n FROM {events} GROUP BY 1),
dense AS (
  SELECT month, coalesce(n, 0) AS n
  FROM (SELECT explode(sequence(trunc(:calendar_start, 'MM'), trunc(:calendar_end, 'MM'), INTERVAL 1 MONTH)) AS month)
    LEFT JOIN by_month USING (month)),
coverage AS (SELECT month, n, n >= :fraction * (SELECT percentile(n, 0.5) FROM dense) AS ok FROM dense)"""


def coverage_args(s: Study) -> dict:
    return {"calendar_start": dt.date.fromisoformat(s.calendar_start),
            "calendar_end": dt.date.fromisoformat(s.calendar_end), "fraction": s.adequate_fraction}


#: A5: events, jobs and the annualised rate per thousand of each year, over its adequate months.
OVERALL_RATE = "WITH" + coverage_text() + """,
yearly AS (
  SELECT year(month) AS year, count(*) AS adequate_months, sum(n) AS events FROM coverage WHERE ok GROUP BY 1),
base AS (
  SELECT year, sum(jobs) AS jobs FROM {exposure} WHERE year BETWEEN :first_year AND :last_year GROUP BY 1),
whole AS (
  SELECT year, adequate_months, jobs, events, CAST(12000 AS DECIMAL(38,0)) * events AS over,
    CAST(jobs AS DECIMAL(38,0)) * adequate_months AS under
  FROM base JOIN yearly USING (year))
SELECT year, adequate_months, jobs, events,
  CASE WHEN under > 0 THEN CAST((20 * over + under - (20 * over + under) % (2 * under)) / (2 * under) AS DOUBLE) / 10 END AS rate
FROM whole"""


def overall_rate_by_year(spark: SparkSession, events: DataFrame, exposure: DataFrame, s: Study) -> DataFrame:
    """A5 from the text; the twin of ``rates.overall_rate_by_year``."""
    args = coverage_args(s) | {"first_year": min(s.rate_years), "last_year": max(s.rate_years)}
    return bound(spark, OVERALL_RATE, args, events=events, exposure=exposure)


#: PF16 as a filter (a semi join) and PF17 as a flag (an existence join): rows without a match stay, flagged false.
KNOWN_BY_SECTOR = """
SELECT sector, known, count(*) AS events
FROM (SELECT sector, EXISTS (SELECT 1 FROM {occupations} AS o WHERE o.code = e.occupation) AS known
      FROM {events} AS e
      WHERE sector IN (SELECT sector4 FROM {sectors} WHERE section <= :last_section))
GROUP BY sector, known"""


def known_by_sector(spark: SparkSession, events: DataFrame, occupations: DataFrame, sectors: DataFrame,
                    last_section: str) -> DataFrame:
    """Events of some sections per sector, and whether their occupation is in the reference (NULL isn't)."""
    return bound(spark, KNOWN_BY_SECTOR, {"last_section": last_section}, events=events, occupations=occupations,
                 sectors=sectors)
