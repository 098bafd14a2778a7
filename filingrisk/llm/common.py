"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from filingrisk.session import configure, ship_package  # noqa: F401

#: Rows in one Arrow batch; keeps a batch of very long texts within a worker's memory.
BATCH_ROWS = 512
#: Bytes in one Arrow batch, into a worker and out of it, about.
BATCH_BYTES = 4 << 20


def prepare_session(spark: SparkSession) -> None:
    """Runtime options that the operators rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    prepare_session(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def arrow_schema(ddl: str | StructType) -> pa.Schema:
    """The Arrow form of a schema or a DDL string such as 'doc_id bigint, text string'."""
    return to_arrow_schema(StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl)


def free_name(name: str, *frames: DataFrame) -> str:
    """The name, or one made of it, that no column of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def add_columns(df: DataFrame, read: list[str], make: Callable[[], Callable[..., tuple]], ddl: str) -> DataFrame:
    """df with the columns of `ddl`, a tuple per row from the columns `read` (texts).

    `make` runs once per task. All columns of df, of whatever types, pass
    through as they are; the new names must be free.
    """
    ship_package(df.sparkSession)
    made = StructType.fromDDL(ddl)
    schema = StructType([*df.schema.fields, *made.fields])
    out_schema, own_schema = arrow_schema(schema), arrow_schema(made)
    n, at = len(df.columns), [free_name(f"text_{i}", df) for i in range(len(read))]

    def run(batches):
        produce = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                columns = [part.column(i).cast(out_schema.field(i).type) for i in range(n)]
                rows = [produce(*row) for row in zip(*(part.column(i).to_pylist() for i in range(n, part.num_columns)), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *pack(rows, own_schema).columns], schema=out_schema)

    texts = [F.col(c).cast("string").alias(name) for c, name in zip(read, at, strict=True)]
    return df.select("*", *texts).mapInArrow(run, schema)


def flat_map(df: DataFrame, make: Callable[[], Callable[..., Iterator[tuple]]], ddl: str) -> DataFrame:
    """Rows of `ddl` that a function yields for each row of df.

    `make` runs once per task and returns that function; it takes the columns of
    df in order. Output is sent on in batches of bounded rows and bytes, so a
    task holds one batch only.
    """
    ship_package(df.sparkSession)
    schema = arrow_schema(ddl)

    def run(batches):
        produce = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            out, held = [], 0
            for row in rows_of(batch):
                for made in produce(*row):
                    out.append(made)
                    for value in made:
                        if isinstance(value, str | bytes | list):
                            held += len(value)
                    if held >= BATCH_BYTES or len(out) >= 4 * BATCH_ROWS:
                        yield pack(out, schema)
                        out, held = [], 0
            if out:
                yield pack(out, schema)

    return df.mapInArrow(run, ddl)


def rows_of(batch: pa.RecordBatch, at_once: int = 64) -> Iterator[tuple]:
    """The rows of a batch as Python values, a few at a time."""
    for start in range(0, batch.num_rows, at_once):
        part = batch.slice(start, at_once)
        yield from zip(*(column.to_pylist() for column in part.columns), strict=True)


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each run of equal leading columns; the caller bounds a run, which is held whole."""
    current, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        changes = np.zeros(batch.num_rows - 1, dtype=bool)
        for m in marks:
            changes |= m[1:] != m[:-1]
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            key = tuple(m[start] for m in marks)
            if key != current and held:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(start, end - start))
    if held:
        yield current, pa.Table.from_batches(held)


def pack(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
