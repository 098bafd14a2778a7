"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from zipfile import ZipFile

from pyspark.sql import DataFrame, SparkSession

_RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    # Splits the many-row side of a lookup join when one key is hot, even if
    # that costs one more exchange further up the plan.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A union of tables that each are one task stays as many tasks.
    "spark.sql.unionOutputPartitioning": "false",
}

_SHIPPED: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options that keep hot keys, or unions, from pinning one task."""
    for key, value in _RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="filingrisk-code-")) / "filingrisk.zip"
    with ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; in local mode a new one where none is named."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="filingrisk-ckpt-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind; otherwise these stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame) -> DataFrame:
    """The table written once to the shared checkpoint folder and read back.

    For a derived table that later steps read more than once: it is computed
    once, its lineage ends at the files, and each step scans only its columns.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/filingrisk/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._stored_at = path
    return made


def discard(table: DataFrame) -> None:
    """Delete the files of a table that `materialise` made and nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
