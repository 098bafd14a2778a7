"""Company facts: nested JSON with dynamic tag and unit keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingrisk.schemas import COMPANY_FACTS


def flatten_facts(nested: DataFrame, *, unit: str = "USD") -> DataFrame:
    """One row per reported value: cik, tag, unit, position, fy, fp, form, filed, end, val."""
    by_tag = nested.select("cik", F.explode(F.col("facts.`us-gaap`")).alias("tag", "body"))
    entries = by_tag.select(
        "cik", "tag", F.posexplode(F.col("body.units")[unit]).alias("pos", "entry")
    )
    return entries.select(
        "cik",
        "tag",
        F.lit(unit).alias("unit"),
        "pos",
        "entry.fy",
        "entry.fp",
        "entry.form",
        F.try_to_date("entry.filed", "yyyy-MM-dd").alias("filed"),
        F.try_to_date("entry.end", "yyyy-MM-dd").alias("end"),
        "entry.val",
    )


def read_facts(spark: SparkSession, path: str, *, unit: str = "USD") -> DataFrame:
    """Long facts of files that hold one company object each."""
    return flatten_facts(spark.read.schema(COMPANY_FACTS).option("multiLine", True).json(path), unit=unit)


def read_fact_lines(spark: SparkSession, path: str, *, unit: str = "USD") -> DataFrame:
    """Long facts of JSON Lines files, one company per line; large files are split."""
    return flatten_facts(spark.read.schema(COMPANY_FACTS).json(path), unit=unit)
