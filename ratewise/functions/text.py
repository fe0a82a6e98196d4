"""Scalar text functions.  All are JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every Unicode whitespace; SQL btrim/Spark trim
# remove only U+0020.  SF1 and SF2 are therefore two different functions.
# The whitespace set is derived by rule (every code point Python calls space).
WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def quoted(name: str) -> str:
    """A column's exact name for ``F.col``: dots and spaces are part of it."""
    return "`" + name.replace("`", "``") + "`"


def _c(c) -> Column:
    return F.col(quoted(c)) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """SF2: remove all leading/trailing whitespace (Python ``strip``).

    ``btrim(str, set)`` removes any character of the set from both ends and
    only looks at the edges, so whole documents cost O(edge), not O(length)
    as an anchored regex scan would.
    """
    return F.btrim(_c(c), F.lit(WHITESPACE))


def left(c, n: int) -> Column:
    """SF3: first n characters."""
    return F.substring(_c(c), 1, n)


def remove_chars(c, chars: str) -> Column:
    """SF5: delete every occurrence of the given characters."""
    return F.translate(_c(c), chars, "")


def rstrip_char(c, ch: str) -> Column:
    """SF6: remove a trailing run of one character (``"V89."`` → ``"V89"``)."""
    return F.regexp_replace(_c(c), "(" + _escape(ch) + ")+$", "")


def _escape(ch: str) -> str:
    return "".join("\\" + x if not x.isalnum() else x for x in ch)


def zero_pad(c, n: int) -> Column:
    """SF7: left-pad with zeros to width n, never truncating longer values."""
    c = _c(c)
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def before_sep(c, sep: str = "-") -> Column:
    """SF8: text before the first separator, stripped (``"410001-Name"`` → ``"410001"``)."""
    return strip_ws(F.substring_index(_c(c), sep, 1))


def marker_to_null(c, marker: str) -> Column:
    """CL13: a textual 'not classified' marker becomes NULL."""
    return F.nullif(_c(c), F.lit(marker))


def regex_contains_ci(c, term: str) -> Column:
    """PF10: regex search that ignores case, accented letters' too; NULL counts as no match."""
    return F.coalesce(_c(c).rlike("(?iu)" + term), F.lit(False))
