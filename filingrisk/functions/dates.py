"""Day-grain date helpers; unreadable dates are NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_month_year(col: Column) -> Column:
    return F.try_to_date(col, "d-M-yyyy")


def month_start(col: Column) -> Column:
    """`M-yyyy` to the first day of that month."""
    return F.try_to_date(F.concat(F.lit("1-"), col), "d-M-yyyy")


def month_end(col: Column) -> Column:
    return F.last_day(month_start(col))


def any_date(col: Column) -> Column:
    """ISO first, day-month-year as fallback."""
    text = col.cast("string")
    return F.coalesce(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), day_month_year(text))


def fiscal_start(reporting_date: Column) -> Column:
    """First day of the fiscal year that ends on the reporting date."""
    return F.date_add(F.add_months(reporting_date, -12), 1)


def firm_year_id(cik: Column, reporting_date: Column) -> Column:
    return F.concat_ws("_", cik.cast("string"), F.date_format(reporting_date, "yyyy-MM-dd"))
