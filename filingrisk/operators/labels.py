"""Misconduct and default labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingrisk.functions.dates import fiscal_start
from filingrisk.operators.events import bankruptcy_dates
from filingrisk.operators.pointintime import as_of


def attach_fraud_labels(
    firm_years: DataFrame,
    windows: DataFrame,
    *,
    require_fsf: bool = True,
    drop_revoked: bool = True,
    label_col: str = "label",
) -> DataFrame:
    """Label 1 where the fiscal year overlaps any enforcement window of the firm.

    A window that starts by the reporting date overlaps exactly if it ends on
    or after the fiscal start; so the latest end among those decides, and firm
    years never meet windows pair by pair.
    """
    if drop_revoked:
        windows = windows.where("revoked <> 1")
    if require_fsf:
        windows = windows.where("fsf = 1")
    windows = windows.where("fraud_start IS NOT NULL AND fraud_end IS NOT NULL")
    with_end = as_of(
        firm_years,
        windows,
        key="cik",
        at=F.col("reporting_date"),
        when="fraud_start",
        measures={"_latest_end": ("max", F.col("fraud_end"))},
    )
    hit = F.col("_latest_end") >= fiscal_start(F.col("reporting_date"))
    return with_end.withColumn(label_col, F.coalesce(hit, F.lit(False)).cast("int")).drop(
        "_latest_end"
    )


def default_hit(reporting_date: Column, bankruptcy_date: Column, horizon_months: int) -> Column:
    """1 where reporting < bankruptcy <= reporting + horizon, else 0."""
    inside = (reporting_date < bankruptcy_date) & (
        bankruptcy_date <= F.add_months(reporting_date, horizon_months)
    )
    return F.coalesce(inside, F.lit(False)).cast("int")


def annotate_default_labels(
    df: DataFrame,
    events: DataFrame,
    *,
    horizon_months: int = 12,
    label_col: str = "label_default",
    **marking,
) -> DataFrame:
    """Default label and bankruptcy date; every row is kept."""
    dated = df.drop("bankruptcy_date").join(bankruptcy_dates(events, **marking), "cik", "left")
    if "reporting_date" not in df.columns:
        dated = dated.withColumn("reporting_date", F.lit(None).cast("date"))
    hit = default_hit(F.col("reporting_date"), F.col("bankruptcy_date"), horizon_months)
    return dated.withColumn(label_col, hit)


def attach_default_labels(
    df: DataFrame,
    events: DataFrame,
    *,
    horizon_months: int = 12,
    drop_censored: bool = True,
    drop_post_bankruptcy: bool = True,
    label_col: str = "label_default",
    **marking,
) -> DataFrame:
    """Default label for training.

    Rows without a reporting date go; so do rows at or after the bankruptcy and
    zeros whose horizon ends after the last observed event.
    """
    out = annotate_default_labels(
        df.where("reporting_date IS NOT NULL"),
        events,
        horizon_months=horizon_months,
        label_col=label_col,
        **marking,
    )
    if drop_post_bankruptcy:
        out = out.where("bankruptcy_date IS NULL OR reporting_date < bankruptcy_date")
    if drop_censored:
        # A one-value subquery; without any event nothing counts as censored.
        observed_to = events.agg(F.max("filing_date_8k")).scalar()
        covered = F.add_months("reporting_date", horizon_months) <= observed_to
        out = out.where((F.col(label_col) == 1) | F.coalesce(covered, F.lit(True)))
    return out.drop("bankruptcy_date")
