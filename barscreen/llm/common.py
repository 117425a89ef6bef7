"""What several operators of this subpackage share: table reads, written intermediate tables, column names."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barscreen.sources.shared import shared_folder

#: Rows per Arrow batch for whole texts: a batch of very long texts then still fits a Python worker.
ROWS_PER_BATCH = 512
#: Spark's setting by which the shuffle files of a query go when it ends, not when the driver next collects its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later stages read it again instead of computing it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `written` has made and that nothing reads any more, through the file system that holds them."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Inside, each table that `written` makes (or count) gives its shuffle files back at once; nothing reads them again."""
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small in this session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns of a caller's table can't clash with an operator's own."""
    return df.select(*[F.col(f"`{x}`") for x in names])


def packed(df: DataFrame) -> Column:
    """A whole row as one struct column: a caller's other columns then can't clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(row: str, columns: list[str], *replaced: str) -> list[Column]:
    """The columns of a packed row again, without those that an operator sets itself."""
    gone = {c.lower() for c in replaced}
    return [F.col(row)[c].alias(c) for c in columns if c.lower() not in gone]
