"""Reuse of one reduced fact inside a plan.

Several operators read one aggregate of a large fact from several branches
(coverage, totals, comparison-year shares).  Catalyst pushes a different filter
and another column set into each branch, so the branches no longer match and
exchange reuse does not happen: each branch would scan and join the fact again.
``shared`` puts an expression between the aggregate and its readers that neither
filters nor column pruning pass: each row becomes an array of one struct that is
taken apart again.  Below it the branches stay equal, the planner finds the
equal exchanges and runs one of them, and the fact is read once.

Nothing is cached: a plan reads the files that its own scans list, nothing
outlives the query and nothing has to be released.  ``reduced`` must be an
aggregate (its exchange is what is reused); on a bare scan there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.functions.text import quoted


def shared(reduced: DataFrame) -> DataFrame:
    """``reduced`` for several branches of one plan, computed once when it runs."""
    return reduced.select(F.inline(F.array(F.struct(*[F.col(quoted(c)) for c in reduced.columns]))))
