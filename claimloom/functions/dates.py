"""Printed dates to dates, with a reason for every null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.text import clean_text, let
from claimloom.types import NOT_APPLICABLE

#: Two-digit years up to this one belong to 2000 and later.
PIVOT = 69
FIRST_YEAR, LAST_YEAR = 1900, 2100
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def expand_year(c: Column) -> Column:
    y = c.cast("int")
    return F.when(y >= 100, y).when(y <= PIVOT, y + 2000).otherwise(y + 1900)


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0"))


def parse_date(c: Column, order: Column | None = None) -> Column:
    """A struct (value date, reason). order: "mdy", "dmy" or null, where a date that either could explain stays ambiguous."""
    order = F.lit(None).cast("string") if order is None else order
    #: Each form's pattern and the groups that hold year, month and day; a month's name is read by its first letters.
    forms = [
        (r"^([a-z]{3,9})\.? (\d{1,2}),? (\d{2,4})$", 3, 1, 2), (r"^(\d{1,2})[ -]([a-z]{3,9})\.?[ -](\d{2,4})$", 3, 2, 1),
        (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", 1, 2, 3), (r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3),
    ]
    either = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2}|\d{4})$"

    def read(t):
        out = F.when(t.rlike(either), F.struct(F.regexp_extract(t, either, 3).alias("y"), F.regexp_extract(t, either, 1).alias("a"), F.regexp_extract(t, either, 2).alias("b"), F.lit(True).alias("either")))
        for pattern, y, m, d in forms:
            out = out.when(t.rlike(pattern), F.struct(F.regexp_extract(t, pattern, y).alias("y"), F.regexp_extract(t, pattern, m).alias("a"), F.regexp_extract(t, pattern, d).alias("b"), F.lit(False).alias("either")))
        return let(out, lambda x: typed(t, x))

    def typed(t, x):
        name = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(x["a"], 1, 3)).cast("int")
        a = F.when(x["a"].rlike("^[a-z]"), name).otherwise(x["a"].try_cast("int"))
        year = F.when(F.length(x["y"]) <= 2, expand_year(x["y"].try_cast("int"))).otherwise(x["y"].try_cast("int"))
        return let(F.struct(year.alias("y"), a.alias("a"), x["b"].try_cast("int").alias("b"), x["either"].alias("either")), lambda v: settled(t, v))

    def settled(t, v):
        a, b = v["a"], v["b"]
        which = F.when(~v["either"], "mdy").when(a > 12, "dmy").when(b > 12, "mdy").when(a == b, "mdy").otherwise(order)
        return let(F.struct(which.alias("order"), F.when(which == "dmy", b).otherwise(a).alias("m"), F.when(which == "dmy", a).otherwise(b).alias("d")), lambda w: built(t, v, w))

    def built(t, v, w):
        return let(F.try_to_date(_iso(v["y"], w["m"], w["d"]), "yyyy-MM-dd"), lambda value: answer(t, v, w, value))

    def answer(t, v, w, value):
        reason = (
            F.when(t == "", "EMPTY").when(F.upper(t).isin(NOT_APPLICABLE), "NOT_APPLICABLE").when(v["y"].isNull() | (w["m"] == 0), "UNPARSEABLE").when(w["order"].isNull(), "AMBIGUOUS_DATE_ORDER")
            .when(~v["y"].between(FIRST_YEAR, LAST_YEAR), "OUT_OF_RANGE").when(value.isNull(), "INVALID_DATE")
        )
        return F.struct(F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))

    return let(F.lower(F.regexp_replace(clean_text(c), r"[T ]\d{1,2}:\d{2}.*$", "")), read)


def parse_day(c: Column, order: Column | None = None) -> Column:
    """parse_date, with the steps left out for texts that are read in one way: 2024-03-04 and Mar 4, 2024."""
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(c, 1, 3)))
    named = F.concat(F.right(c, F.lit(4)), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(F.regexp_extract(c, " ([0-9]+),", 1), 2, "0"))
    iso = F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), c).when(c.rlike(r"^[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}\z"), named)
    plain = lambda day: F.struct(day.alias("value"), F.lit(None).cast("string").alias("reason"))
    return let(F.try_to_date(iso, "yyyy-MM-dd"), lambda day: F.when(F.year(day).between(FIRST_YEAR, LAST_YEAR), plain(day)).otherwise(parse_date(c, order)))
