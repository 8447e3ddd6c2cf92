"""Dates: texts to month indexes, days in a zone, calendar pages, passes that run out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyroom.functions.text import let

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
NOW_WORDS = ("present", "now", "today", "current")


def parse_month(text: Column, now: Column | None = None, names: tuple = MONTHS) -> Column:
    """Month index (year * 12 + month - 1) of 2019-07, 07.2019, 07/2019, "July 2019" or 2019 (January); else null.

    names: the first letters of the months.  Years outside 1900 to 2100 and months outside 1 to 12 are null; a word
    for the present is ``now``.
    """
    iso, dotted, word, year = "^([0-9]{4})[-./]([0-9]{1,2})(?:[-./][0-9]{1,2})?$", "^([0-9]{1,2})[-./]([0-9]{4})$", "^([a-z]+)[.,]? +([0-9]{4})$", "^([0-9]{4})$"

    def of(t: Column) -> Column:
        def part(pattern: str, k: int) -> Column:
            return F.nullif(F.regexp_extract(t, pattern, k), F.lit("")).cast("int")

        named = F.array_position(F.array(*[F.lit(n) for n in names]), F.substring(F.regexp_extract(t, word, 1), 1, 3)).cast("int")
        y = F.coalesce(part(iso, 1), part(dotted, 2), part(word, 2), part(year, 1))
        m = F.coalesce(part(iso, 2), part(dotted, 1), F.when(part(word, 2).isNotNull(), named), F.when(part(year, 1).isNotNull(), 1))
        found = let(F.struct(y.alias("y"), m.alias("m")), lambda p: F.when(p["y"].between(1900, 2100) & p["m"].between(1, 12), p["y"] * 12 + p["m"] - 1))
        return found if now is None else F.when(t.isin(*NOW_WORDS), now).otherwise(found)

    return let(F.lower(F.trim(text)), of)


def day_in_zone(instant: Column, zone: str) -> Column:
    """yyyy-MM-dd of an instant as people in the zone write it."""
    return F.date_format(F.from_utc_timestamp(instant, zone), "yyyy-MM-dd")


def month_page(day: Column) -> Column:
    """The 42 dates of a calendar page: six weeks from the Monday at or before the month's first day."""
    first = F.to_date(F.date_trunc("week", F.trunc(day, "month")))
    return F.transform(F.sequence(F.lit(0), F.lit(41)), lambda i: F.date_add(first, i))


def shift_month(day: Column, n: int) -> Column:
    """The same day n months on; a day that the month lacks becomes its last."""
    return F.add_months(day, n)


def pass_expiry(current: Column, now: Column, days: int) -> Column:
    """A pass that still runs is prolonged from its end, another from now; in the unit of one second."""
    return F.greatest(F.coalesce(current, F.lit(0)), now) + days * 86400


def valid_employment(start: Column, end: Column, now: Column) -> Column:
    """Months in order, and no start more than a month ahead of ``now``; a null start is not valid, a null end is open."""
    return start.isNotNull() & (F.coalesce(end, now) >= start) & (start <= now + 1)
