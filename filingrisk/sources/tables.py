"""Tabular sources and sinks: Parquet, CSV, gzipped CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingrisk.functions.numeric import finite
from filingrisk.policy import CONCEPTS
from filingrisk.session import materialise
from filingrisk.sources import json_arrays
from filingrisk.sources.csv_records import read_quoted_csv


def normal_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def read_csv(
    spark: SparkSession, path: str, *, sep: str = ",", multi_line: bool = False
) -> DataFrame:
    """A CSV with a header; every column a string.

    `multi_line` allows line breaks inside quoted fields; files are split then
    too, at the price of shuffling their lines (see csv_records).
    """
    if multi_line:
        return normal_headers(read_quoted_csv(spark, path, sep))
    raw = spark.read.options(
        header=True, sep=sep, quote='"', escape='"'
    ).csv(path)
    return normal_headers(raw)


def read_dataset(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """The modelling dataset from `.parquet`, `.csv` or `.csv.gz`.

    If its CSV form holds filing text with line breaks, ask for `multi_line`,
    see `read_csv`.
    """
    name = path.rstrip("/").lower()
    if name.endswith(".json"):
        raise ValueError("raw JSON must be converted first: see plans.build_dataset")
    if name.endswith((".csv", ".csv.gz", ".gz")):
        return type_dataset(read_csv(spark, path, multi_line=multi_line))
    return normal_headers(spark.read.parquet(path))


def type_dataset(df: DataFrame) -> DataFrame:
    """Cast the known columns of an all-string dataset; others stay strings."""
    kinds = {
        **dict.fromkeys(("cik", "text_chars"), "long"),
        **dict.fromkeys(("fyear", "label", "label_default"), "int"),
        **dict.fromkeys(("filing_date", "reporting_date"), "date"),
        **dict.fromkeys(CONCEPTS, "double"),
    }
    typed = {}
    for name in df.columns:
        kind = kinds.get(name)
        if kind == "double":
            typed[name] = finite(F.col(name))
        elif kind == "date":
            typed[name] = F.try_to_date(F.substring(name, 1, 10), "yyyy-MM-dd")
        elif kind:
            typed[name] = F.col(name).try_cast("double").cast(kind)
    return df.withColumns(typed) if typed else df


def read_scoring_rows(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Firm rows to be scored: as read_dataset, or `.json` files of a list or a single object.

    A list of any size is split into its records, which are stored once: their
    columns come from all of them.
    """
    if not path.rstrip("/").lower().endswith(".json"):
        return read_dataset(spark, path, multi_line=multi_line)
    texts = materialise(json_arrays.array_records(spark, path).select("value"))
    as_text = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return normal_headers(DataFrame(spark.read._jreader.json(as_text), spark))


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """The (cik, fyear) financial panel from CSV or Parquet."""
    if path.rstrip("/").lower().endswith((".csv", ".csv.gz", ".gz")):
        return type_dataset(read_csv(spark, path))
    return normal_headers(spark.read.parquet(path))


def read_cik_names(spark: SparkSession, path: str) -> DataFrame:
    """Only the (cik, name) columns of a dataset."""
    return read_dataset(spark, path).select("cik", "name")


def write_table(df: DataFrame, path: str, *, partition_by: list[str] | None = None) -> None:
    """Write Parquet, or gzipped CSV where the path says so.

    Arrays have no CSV form and are written as JSON text there.
    """
    if path.rstrip("/").lower().endswith((".csv", ".csv.gz", ".gz")):
        arrays = {
            f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, T.ArrayType)
        }
        flat = df.withColumns(arrays) if arrays else df
        codec = "gzip" if path.endswith(".gz") else "none"
        flat.write.mode("overwrite").options(
            header=True, compression=codec, quote='"', escape='"'
        ).csv(path)
        return
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
