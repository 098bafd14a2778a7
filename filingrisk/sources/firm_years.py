"""Firm-year filings kept as one JSON object per line inside a JSON array."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingrisk.functions import dates
from filingrisk.operators.ordered import keep_first
from filingrisk.policy import MIN_TEXT_CHARS
from filingrisk.schemas import FIRM_YEAR_RAW
from filingrisk.sources import json_arrays

FILE_ORDER = json_arrays.PLACE


def parse_lines(lines: DataFrame, contains: str | None = None) -> DataFrame:
    """Parse lines or texts of records to the raw schema; for those that are no object `parsed` is false.

    `contains` is a cheap text test made before the JSON is parsed.
    """
    body = F.regexp_replace(F.btrim("value", F.lit(" \t\r\n")), r",\s*$", "")
    records = lines.withColumn("_body", body).where(~F.col("_body").isin("", "[", "]"))
    if contains is not None:
        records = records.where(F.col("_body").contains(contains))
    # A corrupt-record field tells a bad line from an object of NULLs.
    fields = ", ".join(f"{f.name} string" for f in FIRM_YEAR_RAW) + ", _bad string"
    parsed = F.from_json(
        "_body", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    good = F.col("_rec").isNotNull() & F.col("_rec._bad").isNull() & F.col("_body").startswith("{")
    return records.withColumn("_rec", parsed).select(
        *[F.when(good, F.col(f"_rec.{f.name}")).alias(f.name) for f in FIRM_YEAR_RAW],
        good.alias("parsed"),
        F.when(~good, F.col("_body")).alias("unread"),
        *FILE_ORDER,
    )


def firm_year_records(spark: SparkSession, path: str, *, contains: str | None = None) -> DataFrame:
    """Raw firm-years of JSON arrays, with a record per line or not; `parsed` is false for what could not be read.

    Each file is read as its head says (see json_arrays.file_modes). A bad line,
    or damage in a whole array, costs the record it is in; its text stands in
    `unread`.
    """
    modes = json_arrays.file_modes(spark, path)
    made = []
    # Files are named one by one only where both kinds stand together: listing many by name is slow.
    named = modes if all(modes.values()) else dict.fromkeys(modes, path)
    if modes[json_arrays.LINES] or not modes[json_arrays.WHOLE]:
        made.append(parse_lines(json_arrays.read_lines(spark, named[json_arrays.LINES]), contains))
    if modes[json_arrays.WHOLE]:
        made.append(parse_lines(json_arrays.array_records(spark, named[json_arrays.WHOLE]), contains))
    return reduce(DataFrame.unionByName, made)


def read_firm_years(spark: SparkSession, path: str, *, contains: str | None = None) -> DataFrame:
    """Raw firm-years of JSON arrays, with a record per line or not; bad records are dropped."""
    return firm_year_records(spark, path, contains=contains).where("parsed").drop("parsed", "unread")


def count_bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """How many records were read, on lines or in whole arrays, and how many could not be parsed."""
    return firm_year_records(spark, path).agg(F.count("*").alias("n_lines"), F.count_if(~F.col("parsed")).alias("n_bad"))


def read_json_array(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw firm-years of files that are one JSON array (not line-wise)."""
    return parse_lines(json_arrays.array_records(spark, path)).where("parsed").drop("parsed", "unread")


def tidy_firm_years(
    raw: DataFrame,
    *,
    text_col: str = "mda",
    min_text_chars: int = MIN_TEXT_CHARS,
    text_chars: int | None = None,
    order: tuple[str, ...] = FILE_ORDER,
) -> DataFrame:
    """Typed firm-years, one per doc_id (the first in `order`).

    Texts shorter than `min_text_chars` are dropped. `text_chars` cuts the text
    to its first characters, as the frozen samples did; by default it is whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = text if text_chars is None else F.substring(text, 1, text_chars)
    typed = raw.where(F.length(text) >= min_text_chars).select(
        F.col("cik").try_cast("double").cast("long").alias("cik"),
        "name",
        "sic",
        "filing_type",
        dates.day_month_year(F.col("filing_date")).alias("filing_date"),
        dates.day_month_year(F.col("reporting_date")).alias("reporting_date"),
        kept.alias(text_col),
        F.length(kept).alias("text_chars"),
        *order,
    )
    keyed = add_firm_year_keys(typed.where("cik IS NOT NULL AND reporting_date IS NOT NULL"))
    return keep_first(keyed, ["doc_id"], order).drop(*order)


def add_firm_year_keys(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "fyear": F.year("reporting_date"),
            "doc_id": dates.firm_year_id(F.col("cik"), F.col("reporting_date")),
        }
    )


def firm_years_of(
    labelled: DataFrame, raw: DataFrame, cik: int, *, text_chars: int | None = None, min_text_chars: int = MIN_TEXT_CHARS
) -> DataFrame:
    """One firm's years from the labelled set, else from the raw filings.

    Pass `raw` read with `contains=str(cik)` so other lines are never parsed.
    """
    known = labelled.where(F.col("cik") == cik)
    others = tidy_firm_years(
        raw.where(F.col("cik").try_cast("double").cast("long") == cik), text_chars=text_chars, min_text_chars=min_text_chars
    ).withColumn("label", F.lit(0))
    fallback = others.join(known.select("cik").distinct(), "cik", "left_anti")
    return known.withColumn("source", F.lit("labelled")).unionByName(
        fallback.withColumn("source", F.lit("raw")), allowMissingColumns=True
    )
