"""CSV files with line breaks in quoted fields, read by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingrisk.sources.records import SPLIT, assemble, placed


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """value (the text of a record) and place of every record, headers included.

    A record goes on over a line end while a quote is open. Whether one is open
    at a line follows from the number of quotes before it: counted per split, one
    small row each, and then line by line within the split. (A quote inside a
    field is doubled, so it does not count.)
    """
    lines = placed(spark.read.option("lineSep", "\n").text(path))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.withColumn("flips", quotes % 2)
    before = Window.unboundedPreceding, -1
    splits = lines.groupBy(*SPLIT).agg((F.sum("flips") % 2).alias("s_flips"))
    by_file = Window.partitionBy("_file").orderBy("_offset").rowsBetween(*before)
    state = F.coalesce(F.sum("s_flips").over(by_file), F.lit(0)) % 2
    splits = splits.select(F.col("_file").alias("s_file"), F.col("_offset").alias("s_offset"), state.alias("state"))
    known = lines.join(splits, (F.col("_file") == F.col("s_file")) & (F.col("_offset") == F.col("s_offset")))
    in_split = Window.partitionBy(*SPLIT).orderBy("_row").rowsBetween(*before)
    known = known.withColumn("open", (F.col("state") + F.coalesce(F.sum("flips").over(in_split), F.lit(0))) % 2)
    made = assemble(known, F.col("open") == 0, "\n")
    return made.withColumn("value", F.regexp_replace(F.regexp_replace("value", r"\r$", ""), "\r\n", "\n"))


def read_quoted_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as strings, as Spark's multi-line CSV reader gives them, but with files of any size split.

    Each file starts with a header; the columns are those of the first file.
    """
    options = {"sep": sep, "quote": '"', "escape": '"'}
    names = spark.read.options(header=True, multiLine=True, **options).csv(path).columns
    records = csv_records(spark, path)
    heads = records.where("_offset = 0").groupBy(F.col("_file").alias("h_file")).agg(F.min("_row").alias("h_row"))
    head = (F.col("_file") == F.col("h_file")) & (F.col("_row") == F.col("h_row")) & (F.col("_offset") == 0)
    rows = records.join(heads, head, "left_anti").where("value <> ''")
    ddl = ", ".join(f"`_{i}` string" for i in range(len(names)))
    parsed = rows.select(F.from_csv("value", ddl, options).alias("r"))
    return parsed.select("r.*").toDF(*names)
