"""Point-in-time lookups: dated facts summarised as of a probe date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def as_of(
    df: DataFrame,
    facts: DataFrame,
    *,
    key: str,
    at: Column,
    when: str,
    measures: dict[str, tuple[str, Column]],
    days: int | None = None,
) -> DataFrame:
    """Left-join summaries of the facts dated in (at - days, at], or up to `at`.

    `measures` maps a new column to (sum | max | min, fact column). Facts are
    first reduced to one row per key and day and probes to distinct key and
    day, so what a key's window holds is bounded by the calendar and no
    row-times-fact pairs are ever formed. Rows without a match get NULL.
    """
    facts_by_day = (
        facts.where(F.col(key).isNotNull() & F.col(when).isNotNull())
        .select(
            F.col(key),
            F.col(when).alias("_day"),
            *[c.alias(name) for name, (_, c) in measures.items()],
        )
        .groupBy(key, "_day")
        .agg(*[_AGGREGATES[how](name).alias(name) for name, (how, _) in measures.items()])
        .withColumn("_probe", F.lit(False))
    )
    probed = df.withColumn("_day", at)
    probes = (
        probed.where(F.col(key).isNotNull() & F.col("_day").isNotNull())
        .select(key, "_day")
        .distinct()
        .withColumn("_probe", F.lit(True))
    )
    window = Window.partitionBy(key).orderBy(F.unix_date("_day"))
    # A range frame, so facts of the probe's own day count.
    frame = window.rangeBetween(Window.unboundedPreceding if days is None else -(days - 1), 0)
    summaries = (
        facts_by_day.unionByName(probes, allowMissingColumns=True)
        .select(
            key,
            "_day",
            "_probe",
            *[_AGGREGATES[how](name).over(frame).alias(name) for name, (how, _) in measures.items()],
        )
        .where("_probe")
        .drop("_probe")
    )
    return probed.join(summaries, [key, "_day"], "left").select(*df.columns, *measures)
