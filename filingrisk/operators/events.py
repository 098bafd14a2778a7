"""Event filings: item codes, concept flags and look-back counts."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingrisk.operators.pointintime import as_of
from filingrisk.policy import FEATURE_CONCEPTS, ITEM_CODES, REGIME_SWITCH

Codes = Mapping[str, tuple[str, str | None]]


def item_codes(items: Column) -> Column:
    """The distinct codes of a comma list, blanks dropped."""
    parts = F.transform(
        F.split(F.coalesce(items, F.lit("")), ","),
        lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""),
    )
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def has_concept(
    codes: Column,
    filed: Column,
    concept: str,
    *,
    trust_legacy_regime: bool = True,
    switch: date = REGIME_SWITCH,
    table: Codes = ITEM_CODES,
) -> Column:
    """Whether the code list names the concept under the numbering of its date.

    Codes match whole, so `3` is not found in `3.01`. Undated rows never match.
    """
    current, legacy = table[concept]
    hit = F.when(filed >= F.lit(switch), F.array_contains(codes, current))
    if trust_legacy_regime and legacy is not None:
        hit = hit.when(filed < F.lit(switch), F.array_contains(codes, legacy))
    return F.coalesce(hit, F.lit(False))


def mark_concepts(
    events: DataFrame,
    *,
    trust_legacy_regime: bool = False,
    switch: date = REGIME_SWITCH,
    table: Codes = ITEM_CODES,
) -> DataFrame:
    """Adds one boolean `is_<concept>` per concept."""
    coded = events.withColumn("_codes", item_codes(F.col("items")))
    flags = {
        f"is_{c}": has_concept(
            F.col("_codes"),
            F.col("filing_date_8k"),
            c,
            trust_legacy_regime=trust_legacy_regime,
            switch=switch,
            table=table,
        )
        for c in table
    }
    return coded.withColumns(flags).drop("_codes")


def bankruptcy_dates(events: DataFrame, **marking) -> DataFrame:
    """(cik, bankruptcy_date): the first bankruptcy filing per firm."""
    return (
        mark_concepts(events, **marking)
        .where("is_bankruptcy")
        .groupBy("cik")
        .agg(F.min("filing_date_8k").alias("bankruptcy_date"))
    )


def item_coverage(events: DataFrame) -> DataFrame:
    """Per decade: filings and the share that carries item codes."""
    decade = (F.floor(F.year("filing_date_8k") / 10) * 10).cast("int")
    has_items = F.length(F.trim("items")) > 0
    return events.groupBy(decade.alias("decade")).agg(
        F.count("*").alias("n_filings"),
        F.avg(has_items.cast("double")).alias("share_with_items"),
    )


def event_feature_names(prefix: str = "evt_", *, include_restatement: bool = False) -> list[str]:
    concepts = [*FEATURE_CONCEPTS, *(["restatement"] if include_restatement else [])]
    return [f"{prefix}n_8k", *[f"{prefix}n_{c}" for c in concepts]]


def add_event_features(
    df: DataFrame,
    events: DataFrame,
    *,
    window_days: int = 365,
    prefix: str = "evt_",
    include_restatement: bool = False,
    **marking,
) -> tuple[DataFrame, list[str]]:
    """Event counts in the window that ends on the filing day.

    The window is (filing_date - window_days, filing_date]; reporting_date
    stands in for a missing filing_date. No event means 0. Bankruptcy is the
    target and never counted on its own.
    """
    names = event_feature_names(prefix, include_restatement=include_restatement)
    measures = {names[0]: ("sum", F.lit(1))}
    for name in names[1:]:
        concept = name.removeprefix(f"{prefix}n_")
        measures[name] = ("sum", F.col(f"is_{concept}").cast("int"))
    known = [F.col(c) for c in ("filing_date", "reporting_date") if c in df.columns]
    upper = F.coalesce(*known) if known else F.lit(None).cast("date")
    counted = as_of(
        df.drop(*names),
        mark_concepts(events, **marking),
        key="cik",
        at=upper,
        when="filing_date_8k",
        measures=measures,
        days=window_days,
    )
    return counted.fillna(0, subset=names), names
