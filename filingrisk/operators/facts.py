"""Annual concept values as first reported."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingrisk.operators.ordered import keep_first
from filingrisk.policy import ANNUAL_FORMS, CONCEPT_TAGS


def first_filed(
    facts: DataFrame,
    *,
    tags: Mapping[str, Sequence[str]] = CONCEPT_TAGS,
    forms: Sequence[str] = ANNUAL_FORMS,
    coalesce_tags: bool = False,
    latest_period: bool = False,
) -> DataFrame:
    """(cik, fyear, concept, val): the earliest filed annual value.

    Per firm and concept the best tag with any annual value supplies all years;
    with `coalesce_tags` later tags fill the years it lacks. Equal filing dates
    go by position, or with `latest_period` by the newest period end first.
    Later amendments never replace the first reported value.
    """
    ranked = [
        (tag, concept, rank) for concept, names in tags.items() for rank, tag in enumerate(names)
    ]
    # The tag list is a constant of a few dozen entries, kept in the expression.
    lookup = F.create_map(
        *[
            x
            for tag in dict.fromkeys(t for t, _, _ in ranked)
            for x in (
                F.lit(tag),
                F.array(
                    *[
                        F.struct(F.lit(c).alias("concept"), F.lit(r).alias("rank"))
                        for t, c, r in ranked
                        if t == tag
                    ]
                ),
            )
        ]
    )
    annual = (
        facts.where(F.col("tag").isin(*[t for t, _, _ in ranked]))
        .where((F.col("unit") == "USD") & (F.col("fp") == "FY") & F.col("form").isin(*forms))
        .where("fy IS NOT NULL AND val IS NOT NULL")
        .withColumn("_c", F.explode(F.element_at(lookup, F.col("tag"))))
    )
    never = F.lit("9999-12-31").cast("date")
    first = [F.coalesce("filed", never)]
    if latest_period and "end" in facts.columns:
        first.append(F.coalesce(-F.unix_date("end"), F.lit(2**31 - 1)))
    first.append(F.col("pos"))
    earliest = annual.groupBy(
        "cik", F.col("_c.concept").alias("concept"), F.col("_c.rank").alias("rank"), F.col("fy").alias("fyear")
    ).agg(F.min_by(F.col("val").cast("double"), F.struct(*first)).alias("val"))
    # From here on one row per firm, concept, tag and year.
    if coalesce_tags:
        best = Window.partitionBy("cik", "concept", "fyear")
    else:
        best = Window.partitionBy("cik", "concept")
    return (
        earliest.withColumn("_best", F.min("rank").over(best))
        .where("rank = _best")
        .select("cik", "fyear", "concept", "val")
    )


def pivot_panel(values: DataFrame, concepts: Sequence[str] = tuple(CONCEPT_TAGS)) -> DataFrame:
    """One row per (cik, fyear) with one column per concept."""
    return values.groupBy("cik", "fyear").pivot("concept", list(concepts)).agg(F.first("val"))


def annual_panel(facts: DataFrame, **options) -> DataFrame:
    """The financial panel of long facts."""
    return pivot_panel(first_filed(facts, **options))


def first_panel_rows(panel: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per (cik, fyear), the first in `order`."""
    return keep_first(panel, ["cik", "fyear"], list(order))
