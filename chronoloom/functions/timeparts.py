"""Time helpers that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-less timestamp, as a long."""
    days = F.datediff(F.to_date(ts), F.to_date(F.lit("1970-01-01"))).cast("long")
    clock = F.hour(ts).cast("long") * F.lit(3_600_000_000) + F.minute(ts).cast("long") * F.lit(60_000_000)
    seconds = (F.extract(F.lit("SECOND"), ts) * F.lit(1_000_000)).cast("long")
    return days * F.lit(_DAY) + clock + seconds


def date_micros(d: Column) -> Column:
    """Microseconds of a date's midnight since 1970-01-01, as a long."""
    return F.datediff(d, F.to_date(F.lit("1970-01-01"))).cast("long") * F.lit(_DAY)


def clean_key(c: Column) -> Column:
    """A ticker as it is compared: trimmed and in upper case."""
    return F.upper(F.trim(c))
