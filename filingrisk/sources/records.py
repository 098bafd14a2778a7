"""Records of text files that go over several of the pieces Spark cuts a file into.

Spark's text reader cuts files into pieces at a separator and files of any size
into splits of pieces. A record is a run of pieces, and may go on in later splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where a piece stands: file, offset of its split, row. Rows rise within a split.
PLACE = ("_file", "_offset", "_row")
SPLIT = PLACE[:2]


def placed(df: DataFrame, *more: str) -> DataFrame:
    """The value column of read text (and `more`) with its place in the input."""
    return df.select(
        "value",
        *more,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_offset"),
        F.monotonically_increasing_id().alias("_row"),
    )


def assemble(pieces: DataFrame, begins: Column, joiner: str, *more: str) -> DataFrame:
    """value, more and place of each record: its pieces in order, joined by `joiner`.

    `begins` says of a piece whether a record begins with it; `more` names
    columns that all pieces of a record share. Records that lie within a split
    are put together there. Only the first and the last of each split may go on
    elsewhere; these are matched by one small row each and then joined.
    """
    ordered = Window.partitionBy(*SPLIT).orderBy("_row")
    known = pieces.withColumn("rec", F.last(F.when(begins, F.col("_row")), ignorenulls=True).over(ordered))
    known = known.withColumn("newest", F.max("rec").over(Window.partitionBy(*SPLIT)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "value"))), lambda p: p["value"]), joiner)
    runs = known.groupBy(*SPLIT, "rec").agg(body.alias("value"), F.first("newest").alias("newest"), *(F.first(c).alias(c) for c in more))
    whole = runs.where("rec < newest").select("value", *more, *SPLIT, F.col("rec").alias("_row"))
    loose = runs.where("rec is null or rec >= newest")
    keys = loose.select(*SPLIT, "rec").withColumn("own", F.when(F.col("rec").isNotNull(), F.struct("_offset", F.col("rec").alias("_row"))))
    in_order = Window.partitionBy("_file").orderBy("_offset", F.col("rec").asc_nulls_first())
    keys = keys.withColumn("record", F.last("own", ignorenulls=True).over(in_order))
    keys = keys.select(F.col("_file").alias("kf"), F.col("_offset").alias("ko"), F.col("rec").alias("kr"), "record")
    joined = loose.join(keys, (F.col("_file") == F.col("kf")) & (F.col("_offset") == F.col("ko")) & F.col("rec").eqNullSafe(F.col("kr")))
    parts = F.array_sort(F.collect_list(F.struct("_offset", "rec", "value")))
    together = joined.groupBy("_file", "record").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), joiner).alias("value"), *(F.first(c).alias(c) for c in more)
    )
    place = F.coalesce("record._offset", F.lit(0)).alias("_offset"), F.coalesce("record._row", F.lit(-1)).alias("_row")
    return whole.unionByName(together.select("value", *more, "_file", *place))
