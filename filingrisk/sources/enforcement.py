"""Enforcement releases with misconduct windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingrisk.functions import dates
from filingrisk.sources.tables import read_csv


def tidy_enforcement(raw: DataFrame) -> DataFrame:
    """Window months to first and last day, flags to 0/1, incomplete rows dropped."""

    def flag(name: str):
        if name not in raw.columns:
            return F.lit(0)
        return F.coalesce(F.col(name).try_cast("double").cast("int"), F.lit(0))

    return raw.withColumns(
        {
            "cik": F.col("cik").try_cast("double").cast("long"),
            "fraud_start": dates.month_start(F.col("fraud_start")),
            "fraud_end": dates.month_end(F.col("fraud_end")),
            "revoked": flag("revoked"),
            "fsf": flag("fsf"),
        }
    ).where("cik IS NOT NULL AND fraud_start IS NOT NULL AND fraud_end IS NOT NULL")


def read_enforcement(spark: SparkSession, path: str) -> DataFrame:
    return tidy_enforcement(read_csv(spark, path, sep=";"))
