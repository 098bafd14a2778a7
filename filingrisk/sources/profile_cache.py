"""Text-profile cache: one Parquet table keyed by namespace and text hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingrisk.functions import text
from filingrisk.operators.ordered import keep_first
from filingrisk.schemas import PROFILE


def read_cache(spark: SparkSession, path: str, namespace: str) -> DataFrame:
    """The newest valid profile per text hash; an unusable entry counts as a miss."""
    rows = spark.read.parquet(path).where(F.col("namespace") == namespace)
    valid = rows.where(text.profile_is_valid(F.col("profile")))
    # Of profiles written at one time the first by its text stands.
    newest = [F.col("written_at").desc(), F.to_json("profile")]
    return keep_first(valid, ["text_hash"], newest).select(
        "text_hash", "profile"
    )


def has_cache(spark: SparkSession, path: str) -> bool:
    """Whether anything has been written to a cache path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def append_cache(profiles: DataFrame, path: str, namespace: str) -> None:
    """Append (text_hash, profile) rows; re-scored hashes win by their later time."""
    profiles.select(
        "text_hash",
        F.col("profile").cast(PROFILE).alias("profile"),
        F.current_timestamp().alias("written_at"),
        F.lit(namespace).alias("namespace"),
    ).write.mode("append").partitionBy("namespace").parquet(path)


def parse_entries(entries: DataFrame, json_col: str = "json") -> DataFrame:
    """Profile JSON texts (text_hash, json) to cache rows; unusable ones dropped."""
    parsed = entries.withColumn("profile", F.from_json(json_col, PROFILE))
    return parsed.where(text.profile_is_valid(F.col("profile"))).select("text_hash", "profile")


def read_entry_files(spark: SparkSession, path: str) -> DataFrame:
    """Cache rows from a folder of `<text hash>.json` files."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9a-f]+)\.json$", 1).alias("text_hash"),
        F.col("value").alias("json"),
    )
    return parse_entries(files.where("text_hash <> ''"))


def split_by_cache(hashes: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct text hashes split into (hits, misses)."""
    distinct = hashes.select("text_hash").distinct()
    known = cache.select("text_hash")
    return (
        distinct.join(known, "text_hash", "left_semi"),
        distinct.join(known, "text_hash", "left_anti"),
    )


def cache_counts(hashes: DataFrame, cache: DataFrame) -> DataFrame:
    """n_hits and n_misses over distinct texts."""
    known = cache.select("text_hash", F.lit(True).alias("_hit"))
    return (
        hashes.select("text_hash")
        .distinct()
        .join(known, "text_hash", "left")
        .agg(
            F.count("_hit").alias("n_hits"),
            F.count_if(F.col("_hit").isNull()).alias("n_misses"),
        )
    )
