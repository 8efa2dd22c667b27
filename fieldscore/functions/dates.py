"""Printed dates to ISO dates: day before month, never guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms that are tried, in this order.
FORMS = ("yyyy-M-d", "d-MMM-yyyy", "d MMM yyyy", "d-MMMM-yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy/M/d")
NAMED = ("d-MMM-yyyy", "d-MMMM-yyyy")


def iso_date(c: Column, forms: tuple[str, ...] = FORMS) -> Column:
    """The date of the first form that fits the whole trimmed text as yyyy-MM-dd; null where none does.

    Month names are read in any case; a year has four digits.
    """
    s = F.initcap(F.lower(F.trim(F.regexp_replace(c, r"-", " - "))))
    s = F.regexp_replace(s, " - ", "-")
    tried = [F.date_format(F.try_to_timestamp(s, F.lit(f)), "yyyy-MM-dd") for f in forms]
    return F.when(s.rlike(r"(?<!\d)\d{4}(?!\d)"), F.coalesce(*tried))
