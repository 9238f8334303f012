"""Dates in names, offsets and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month labels.
MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")


def date_in_name(name: Column) -> Column:
    """The date that a file name carries: the messenger's form, then dashed, then eight digits on their own.

    A messenger name with an impossible date has none; years are 1990 to 2099.
    """
    year, month, day = "((?:19[9]|20[0-9])[0-9])", "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])"
    messenger = F.regexp_extract(name, r"(?i)^(?:IMG|VID|AUD|PTT)-([0-9]{8})-WA", 1)
    dashed = F.regexp_extract(name, rf"(?<![0-9]){year}-{month}-{day}(?![0-9])", 0)
    packed = F.regexp_extract(name, rf"(?<![0-9]){year}{month}{day}(?![0-9])", 0)
    return F.when(messenger != "", F.try_to_date(messenger, "yyyyMMdd")).otherwise(F.coalesce(F.try_to_date(F.nullif(dashed, F.lit("")), "yyyy-MM-dd"), F.try_to_date(F.nullif(packed, F.lit("")), "yyyyMMdd")))


def month_label(at: Column) -> Column:
    return F.concat(F.get(F.array(*map(F.lit, MONTHS)), F.month(at) - 1), F.lit("."), F.year(at).cast("string"))


def offset_seconds(text: Column) -> Column:
    """'+HH:MM' as seconds; null beyond 14 hours or 59 minutes."""
    form = r"^([+-])([0-9]{2}):([0-9]{2})$"
    hours, minutes = F.regexp_extract(text, form, 2).try_cast("int"), F.regexp_extract(text, form, 3).try_cast("int")
    sign = F.when(F.regexp_extract(text, form, 1) == "-", -1).otherwise(1)
    return F.when((hours <= 14) & (minutes <= 59), sign * (hours * 3600 + minutes * 60))


def any_date(text: Column) -> Column:
    """A timestamp in any of the forms that metadata uses; fractions and zones are dropped."""
    bare = F.regexp_replace(F.trim(text), r"(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?$", "")
    forms = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy:MM:dd HH:mm", "yyyy-MM-dd", "yyyy:MM:dd")
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)).cast("timestamp_ntz") for f in forms))


def plausible(at: Column, as_of: Column) -> Column:
    """at, unless it lies more than a day after as_of."""
    return F.when(at <= as_of + F.expr("INTERVAL 1 DAY"), at)
