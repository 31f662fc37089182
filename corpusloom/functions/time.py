"""Times stored as seconds since 2001-01-01 UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2001-01-01 UTC in Unix seconds, and the range a month is given for (1970 to 9999).
EPOCH_2001 = 978_307_200
FIRST, LAST = -978_307_200.0, 252_423_993_599.0


def in_range(c: Column) -> Column:
    """Whether a stored time is a number that falls between 1970 and 9999."""
    return c.isNotNull() & ~F.isnan(c) & c.between(FIRST, LAST)


def to_timestamp(c: Column) -> Column:
    """Timestamp (UTC session) of a stored time; NULL for NULL, NaN and values out of range."""
    return F.when(in_range(c), F.timestamp_seconds(c + F.lit(float(EPOCH_2001))))


def month(c: Column) -> Column:
    """'yyyy-MM' of a stored time, 'unknown' where it has none."""
    return F.coalesce(F.date_format(to_timestamp(c), "yyyy-MM"), F.lit("unknown"))


def iso_week(ts: Column) -> Column:
    """ISO year and week, 'YYYY-Www': the year is that of the week's Thursday."""
    thursday = F.date_add(F.date_trunc("week", ts).cast("date"), 3)
    return F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def week_start(ts: Column) -> Column:
    """The Monday of a time's week, as a date."""
    return F.date_trunc("week", ts).cast("date")
