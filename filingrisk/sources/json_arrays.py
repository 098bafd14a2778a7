"""JSON arrays whose records need not stand on lines of their own, read by many tasks.

A file is cut at every closing brace by Spark's own text reader, which splits
files of any size. Which braces end a record depends on the quotes and braces
before them; each split sums these up for both states it may start in, and one
small row per split carries the state from split to split.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingrisk.sources.records import PLACE, SPLIT, assemble, placed

LINES, WHOLE = "lines", "whole"

#: Bytes up to which files share tasks when their heads are read.
SMALL_FILE = 4 << 20

#: How a record begins: a brace and a key. Inside a string its quote would be escaped.
_HEAD = r'\{\s*"[^"\\]*"\s*:'


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines with their place in the input: file, split offset, row in split."""
    return placed(spark.read.text(path))


def file_modes(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """Files with a record per line and files that are one array over any line breaks, by the head of each.

    The first two lines that are not blank decide: `[` and something else on the
    first, or a bare `{` as the first or behind a first `[`, make a whole array.
    Of a file larger than SMALL_FILE a task stops reading at the second line;
    smaller ones are read through, many by one task. One row per file comes back.
    """

    def heads(batches, alone):
        seen: dict[str, list[str]] = {}
        for batch in batches:
            for value, file, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if offset:
                    if alone:
                        return
                    continue
                lines = seen.setdefault(file, [])
                if len(lines) < 2 and value:
                    lines.append(value)
            if alone and len(seen) == 1 and len(lines) == 2:
                break
        if seen:
            files = list(seen)
            firsts, seconds = ([(seen[f] + ["", ""])[i] for f in files] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(firsts), pa.array(seconds)], names=["file", "one", "two"])

    def read(chosen, alone):
        lines = spark.read.text(path).where(chosen).select(F.substring(F.trim("value"), 1, 64), "_metadata.file_path", "_metadata.file_block_start")
        return lines.mapInArrow(lambda batches: heads(batches, alone), "file string, one string, two string").collect()

    size = F.col("_metadata.file_size")
    rows = read(size <= SMALL_FILE, False)
    # Each large file in tasks of its own, so that none has to be read for the next one's sake.
    changed = {
        "spark.sql.files.openCostInBytes": spark.conf.get("spark.sql.files.maxPartitionBytes"),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "8",
    }
    before = {key: spark.conf.get(key) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        rows += read(size > SMALL_FILE, True)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    modes: dict[str, list[str]] = {LINES: [], WHOLE: []}
    for row in rows:
        whole = (row.one.startswith("[") and row.one != "[") or row.one == "{" or (row.one == "[" and row.two == "{")
        modes[WHOLE if whole else LINES].append(as_path(row.file))
    return {mode: sorted(files) for mode, files in modes.items()}


def as_path(uri: str) -> str:
    """A file's URI as a path for Spark's readers, which take some characters for patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def array_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value (the JSON text of a record), sound, and its place, of every record of whole arrays.

    Records are the outermost objects; what separates them is left out. A file
    whose quotes or braces do not match is not sound: there every text that
    begins like a record (a brace and a key behind a separator) is taken for one
    without objects in it, and what stands before it is a row of its own. So
    damage costs the record that it is in.
    """
    cut = spark.read.option("lineSep", "}").text(paths)
    text = placed(cut.withColumn("_size", F.col("_metadata.file_size")), "_size")
    clean = F.regexp_replace("value", r"(?s)\\.", "")
    outside = lambda c: F.regexp_replace(c, r'"[^"]*("|\z)', "")
    count = lambda c, mark: F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))
    parts = text.withColumn("_clean", clean).select(
        "value",
        "_size",
        *PLACE,
        (count(F.col("_clean"), '"') % 2).alias("flips"),
        count(outside(F.col("_clean")), "{").alias("open0"),
        count(outside(F.concat(F.lit('"'), "_clean")), "{").alias("open1"),
        F.col("value").rlike(r"^[\s,\[]*\{|[,\[\n]\s*" + _HEAD).alias("shaped"),
        F.col("value").rlike(r"^[\s,\]]*$").alias("closing"),
    )
    ordered = Window.partitionBy(*SPLIT).orderBy("_row")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # In a string or not before each part, for a split that starts outside one (0) or inside (1).
    parts = parts.withColumn("_in", F.coalesce(F.sum("flips").over(earlier), F.lit(0)) % 2)
    for h in (0, 1):
        inside = (F.col("_in") + h) % 2
        opened = F.when(inside == 0, F.col("open0")).otherwise(F.col("open1"))
        step = opened - F.when((inside + F.col("flips")) % 2 == 0, 1).otherwise(0)
        parts = parts.withColumn(f"step{h}", step).withColumn(f"depth{h}", F.sum(f"step{h}").over(ordered))
    parts = parts.withColumn("_last", F.lead("_row").over(ordered).isNull())

    # One row per split, and from these the state in which each split starts.
    over_last = lambda c: F.max(F.when(F.col("_last"), F.col(c)))
    sums = parts.groupBy(*SPLIT).agg(
        (F.sum("flips") % 2).alias("s_flips"),
        F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.first("_size").alias("size"),
        over_last("closing").alias("s_closing"),
        *(F.sum(f"step{h}").alias(f"sum{h}") for h in (0, 1)),
        *(F.min(f"depth{h}").alias(f"low{h}") for h in (0, 1)),
        *(F.min(F.when(~F.col("_last"), F.col(f"depth{h}"))).alias(f"but{h}") for h in (0, 1)),
    )
    by_file = Window.partitionBy("_file").orderBy("_offset")
    so_far, all_ = by_file.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_file")
    either = lambda c: F.when(F.col("state") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    sums = sums.withColumn("state", F.coalesce(F.sum("s_flips").over(so_far), F.lit(0)) % 2)
    sums = sums.withColumn("start", F.coalesce(F.sum(either("sum")).over(so_far), F.lit(0)))
    end = F.lead("_offset").over(by_file).isNull()
    # Nothing but text behind the last brace may lie below the outermost level. Its size tells whether a
    # file ends with a brace; that of a compressed file does not, then either end will do.
    sums = sums.withColumn("final", F.when(end, F.col("start") + either("sum")))
    tail = (F.col("final") == -1) & F.col("s_closing")
    sums = sums.withColumn("lowest", F.col("start") + F.when(tail, either("but")).otherwise(either("low")))
    good = (F.min("lowest").over(all_) >= 0) | F.min("lowest").over(all_).isNull()
    beyond = F.sum("bytes").over(all_) - F.col("size")
    ends = F.when(beyond == 0, F.col("final") == 0).when(beyond == 1, tail).otherwise((F.col("final") == 0) | tail)
    sums = sums.withColumn("ends", ends)
    ends_well = F.max("ends").over(all_) & (F.sum("s_flips").over(all_) % 2 == 0)
    sums = sums.select(*(F.col(c).alias(f"s{c}") for c in SPLIT), "state", "start", F.coalesce(good & ends_well, F.lit(False)).alias("sound"))

    known = parts.join(sums, (F.col("_file") == F.col("s_file")) & (F.col("_offset") == F.col("s_offset")))
    depth_before = F.col("start") + either("depth") - either("step")
    begins = F.when(F.col("sound"), depth_before == 0).otherwise(F.col("shaped"))
    found = assemble(known, begins, "}", "sound").withColumn("value", F.regexp_replace(F.concat("value", F.lit("}")), r"^[\s,\[]+", ""))
    # In a damaged file the last beginning in a text is a record, what stands before it is not.
    parted = rf"(?s)^(.*[,\[\n]\s*|)({_HEAD}.*)$"
    head, record = F.regexp_extract("value", parted, 1), F.regexp_extract("value", parted, 2)
    cut = F.when(F.col("sound") | (record == ""), F.array("value")).otherwise(F.array(head, record))
    rows = found.select(F.explode(cut).alias("value"), "sound", *PLACE)
    return rows.where(~F.col("value").rlike(r"^[\s,\[\]}]*$"))
