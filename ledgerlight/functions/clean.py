"""Columns that clean raw values."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The date formats in the order they are tried, the texts that mean yes, the first day of day counts.
DATE_FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "yyyyMMdd", "ddMMMyyyy", "dd-MMM-yyyy", "yyyy/MM/dd")
YES = ("1", "Y", "YES", "T", "TRUE")
ORIGIN = "2000-01-01"


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def is_date(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def account_key(c: Column) -> Column:
    """Text without surrounding spaces and leading zeros; nothing left is "0"; null stays null."""
    bare = F.ltrim(F.trim(c.cast("string")), F.lit("0"))
    return F.when(bare == "", "0").otherwise(bare)


def parse_date(c: Column, kind: T.DataType | None = None, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that fits; numbers are yyyymmdd; what fits none is null."""
    if kind is not None and is_date(kind):
        return c.cast("date")
    if kind is not None and is_numeric(kind):
        return F.try_to_date(c.cast("long").cast("string"), "yyyyMMdd")
    return F.coalesce(*(F.try_to_date(F.trim(c), f) for f in formats))


def number(c: Column) -> Column:
    """A number, also from text; null where there is none, NaN included."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def to_flag(c: Column, kind: T.DataType) -> Column:
    """1 for true, positive or a text that means yes; else 0, null included."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c.cast("int"), F.lit(0))
    if isinstance(kind, T.NumericType):
        return (F.coalesce(c.cast("double"), F.lit(0.0)) > 0).cast("int")
    return F.coalesce(F.upper(F.trim(c)).isin(*YES), F.lit(False)).cast("int")


def days(c: Column, origin: str = ORIGIN) -> Column:
    """Days since the origin, with their fraction."""
    return (F.unix_micros(c.cast("timestamp")) - F.unix_micros(F.lit(origin).cast("timestamp"))) / F.lit(86400e6)


def whole_days_between(later: Column, earlier: Column) -> Column:
    """Floor of the time between, in days."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86400e6))


def null_flag(c: Column) -> Column:
    return c.isNull().cast("int")


def null_count(*columns: str) -> Column:
    return reduce(add, (null_flag(F.col(c)) for c in columns))


def band(c: Column, edges: tuple[float, ...]) -> Column:
    """Number of the interval (edge, next edge] that holds c; null outside."""
    out = F.lit(None).cast("int")
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        out = F.when((c > a) & (c <= b), k).otherwise(out)
    return out


def tokens(c: Column, delimiter: str = "|", lower: bool = False, nulls: tuple[str, ...] = ("", "nan", "none", "null")) -> Column:
    """Trimmed parts of a delimited text without those that mean nothing; null gives no tokens."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "\\Q" + delimiter + "\\E"), lambda x: F.trim(F.lower(x) if lower else x))
    return F.filter(parts, lambda x: ~F.lower(x).isin(*nulls))
