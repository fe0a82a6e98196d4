"""Cleansing / conforming operators.

Pure DataFrame → DataFrame functions over built-in expressions.  Order
matters and is kept as the reference applies it (K21): strip text, then
dedup, then normalise codes, then drop identifiers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewise.functions import text as tx
from ratewise.operators.windows import dedup_keep_last, fill_hierarchy

# Fixed values (must equal the source data's conventions):
# the text a source writes in a coded field that was not classified.
NOT_CLASSIFIED = "{ñ class}"


def strip_text(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """CL1: strip all edge whitespace (SF2) in every string column (or ``cols``)."""
    targets = set(cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    return df.select(*[tx.strip_ws(c).alias(c) if c in targets else F.col(tx.quoted(c)) for c in df.columns])


def normalise_diag(df: DataFrame, col: str, width: int = 4) -> DataFrame:
    """CL3: first ``width`` characters, upper case (drops a 2-letter suffix)."""
    return df.withColumn(col, F.upper(tx.left(col, width)))


def code_prefix(df: DataFrame, col: str, sep: str = "-") -> DataFrame:
    """CL4: ``"410001-Name"`` → ``"410001"``."""
    return df.withColumn(col, tx.before_sep(col, sep))


def pad_code(df: DataFrame, col: str, width: int) -> DataFrame:
    """CL5: zero-pad to ``width`` without truncating longer codes."""
    return df.withColumn(col, tx.zero_pad(col, width))


def _to_date(col: str, fmt: str | None) -> F.Column:
    """Text → date, NULL for anything that is no date.

    With ``fmt`` one-digit days and months are read too (a pattern letter takes
    one digit or more); without, ISO text with or without separators.
    """
    text = F.nullif(F.btrim(F.col(tx.quoted(col))), F.lit(""))
    if fmt:
        return F.try_to_date(text, fmt.replace("dd", "d").replace("MM", "M"))
    compact = F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
    return F.coalesce(compact, F.try_to_date(text))


def parse_dates(df: DataFrame, cols: list[str], fmt: str | None = "dd/MM/yyyy") -> DataFrame:
    """CL6: text → date, invalid or empty → NULL (never an error)."""
    return df.select(*[_to_date(c, fmt).alias(c) if c in cols else F.col(tx.quoted(c)) for c in df.columns])


def generalise_birth(df: DataFrame, col: str, out: str = "birth_year", fmt: str = "dd/MM/yyyy") -> DataFrame:
    """CL7: keep only the year of a birth date; the exact date is dropped."""
    return df.withColumn(out, F.year(_to_date(col, fmt))).drop(col)


def drop_identifiers(df: DataFrame, cols: list[str]) -> DataFrame:
    """CL8: remove direct identifiers (run after dedup, which may use them)."""
    return df.drop(*cols)


def hierarchy_keys(df: DataFrame, col: str, out5: str = "class5", out4: str = "class4") -> DataFrame:
    """CL10: remove '.' and '-' then derive 5- and 4-character keys."""
    clean = tx.remove_chars(col, ".-")
    return df.withColumn(out5, tx.left(clean, 5)).withColumn(out4, tx.left(clean, 4))


def add_unknown_member(dim: DataFrame, row: dict) -> DataFrame:
    """CL11/SO3: append a sentinel 'not classified' row so foreign keys hold."""
    spark = dim.sparkSession
    lit = spark.createDataFrame([tuple(row.get(f.name) for f in dim.schema.fields)], dim.schema)
    return dim.unionByName(lit)


def strip_category_dot(df: DataFrame, col: str) -> DataFrame:
    """CL12: ``"V89."`` → ``"V89"`` (trailing dots only)."""
    return df.withColumn(col, tx.rstrip_char(col, "."))


def marker_to_null(df: DataFrame, cols: list[str], marker: str = NOT_CLASSIFIED) -> DataFrame:
    """CL13 (opt-in): a 'not classified' marker becomes NULL."""
    return df.select(*[tx.marker_to_null(c, marker).alias(c) if c in cols else F.col(tx.quoted(c))
                       for c in df.columns])


def derive_class(df: DataFrame, col: str, out: str, width: int = 5) -> DataFrame:
    """CL14: coarser class from the first characters of a subclass code."""
    return df.withColumn(out, tx.left(col, width))


def geo_filter(df: DataFrame, col: str, code: str, how: str = "equal") -> DataFrame:
    """CL16: place filter; ``equal``, ``prefix`` (NULL drops) or ``cast`` (compare as text)."""
    c = F.col(tx.quoted(col))
    if how == "prefix":
        return df.where(c.startswith(code))
    if how == "cast":
        return df.where(c.cast("string") == code)
    return df.where(c == code)


def rename_snake(df: DataFrame, mapping: dict[str, str] | None = None, lower: bool = True) -> DataFrame:
    """PF1/PF2: rename by map, then lower-case every name."""
    if mapping:
        df = df.withColumnsRenamed(mapping)
    return df.toDF(*[c.lower() for c in df.columns]) if lower else df


def build_events(raw: DataFrame, key: list[str], order: list[str], diag_col: str,
                 birth_col: str | None, date_cols: list[str], identifiers: list[str],
                 place_col: str | None = None, normalise_first: bool = False,
                 sector_col: str | None = None, sector_width: int = 4,
                 rename: dict[str, str] | None = None) -> DataFrame:
    """CL17 (event fact): strip → dedup keep-last → normalise diagnosis →
    zero-pad the sector code → parse dates → generalise birth date → drop
    identifiers → rename.

    Column arguments are the raw names (dots and spaces allowed); ``rename``
    maps raw to final names.  ``normalise_first=True`` is the alternative that
    normalises the diagnosis before dedup, so rows differing only in case or
    suffix collapse (K21).
    """
    df = strip_text(raw)
    if normalise_first:
        df = normalise_diag(df, diag_col)
    df = dedup_keep_last(df, key, order)
    if not normalise_first:
        df = normalise_diag(df, diag_col)
    if place_col:
        df = code_prefix(df, place_col)
    if sector_col:
        df = pad_code(df, sector_col, sector_width)
    df = parse_dates(df, date_cols)
    if birth_col:
        df = generalise_birth(df, birth_col)
    df = drop_identifiers(df, identifiers + [c for c in order if c.startswith("_")])
    return df.withColumnsRenamed(rename or {})


def build_sector_dim(sheet: DataFrame, levels: list[str], order: str, header_col: str,
                     header_value: str, leaf_col: str, code_col: str, name_col: str,
                     top_col: str, pad_col: str | None = None, dotted_col: str | None = None,
                     unknown: dict | None = None) -> DataFrame:
    """CL17 (sector dimension) from a paginated hierarchy sheet.

    Drops repeated header rows and title rows (text in ``top_col`` but no
    ``name_col``) *before* the fill-down, so a title never leaks into the rows
    below it; forward-fills ``levels`` in sheet order; keeps the leaf rows;
    zero-pads ``pad_col`` to 2, removes dots from ``dotted_col``; derives the
    5- and 4-character keys from ``code_col``; appends the unknown member.
    """
    body = sheet.where(F.col(name_col).isNotNull() | F.col(top_col).isNull())
    leaves = fill_hierarchy(body, levels, order, header_col, header_value, leaf_col)
    if pad_col:
        leaves = pad_code(leaves, pad_col, 2)
    if dotted_col:
        leaves = leaves.withColumn(dotted_col, tx.remove_chars(dotted_col, "."))
    out = hierarchy_keys(leaves, code_col)
    return add_unknown_member(out, unknown) if unknown else out


def build_occupations(raw: DataFrame, code_col: str, label_col: str,
                      unknown_code: str = "999999", unknown_label: str = "not classified") -> DataFrame:
    """CL17 (occupation dimension): rename to (code, label) and add the unknown member."""
    dim = raw.select(F.col(code_col).alias("code"), F.col(label_col).alias("label"))
    return add_unknown_member(dim, {"code": unknown_code, "label": unknown_label})


def build_diagnoses(raw: DataFrame, sub: str, sub_label: str, cat: str, cat_label: str) -> DataFrame:
    """CL17 (diagnosis dimension): the two levels with their labels, and the 3-character category."""
    cols = {"sub": sub, "sub_label": sub_label, "cat": cat, "cat_label": cat_label}
    out = strip_text(raw).select(*[F.col(tx.quoted(c)).alias(n) for n, c in cols.items()])
    return out.withColumn("cat3", F.upper(tx.left("cat", 3)))


def build_exposure(raw: DataFrame, drop: list[str], subclass_col: str, class_col: str,
                   width: int = 7) -> DataFrame:
    """CL17 (exposure): drop the description columns, zero-pad the subclass, derive the 5-char class."""
    return derive_class(pad_code(raw.drop(*drop), subclass_col, width), subclass_col, class_col, 5)


def build_movements(raw: DataFrame, drop: list[str], subclass_col: str, class_col: str,
                    coded_cols: list[str], marker: str = NOT_CLASSIFIED, width: int = 7) -> DataFrame:
    """CL17 (movements): as the exposure, with the 'not classified' marker as NULL in the coded columns."""
    return build_exposure(marker_to_null(strip_text(raw), coded_cols, marker), drop, subclass_col, class_col, width)


def build_notifications(raw: DataFrame, category_cols: list[str], date_cols: list[str],
                        drop: list[str] | None = None) -> DataFrame:
    """CL17 (notifications): lower-case names, drop empty columns, strip the
    trailing dot of category-level codes, parse ISO dates (bad → NULL)."""
    df = rename_snake(raw)
    if drop:
        df = df.drop(*[c.lower() for c in drop])
    for c in category_cols:
        df = strip_category_dot(df, c)
    return parse_dates(df, date_cols, fmt=None)


def build_notifications_two(raw: DataFrame, date_cols: list[str], drop: list[str]) -> DataFrame:
    """CL17 (second notification set): lower-case names, its two unused columns dropped, ISO dates."""
    return build_notifications(raw, [], date_cols, drop)
