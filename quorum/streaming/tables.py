"""Folder tables written by ``foreachBatch`` handlers.

``write_batch`` writes a micro-batch under ``<table>/batch_id=<n>`` with overwrite, so a
replayed batch (at-least-once delivery after a failure) replaces its own output;
such tables are read by batch jobs, which see the union of all batches.

``append_once`` is for tables that a running stream reads: files must not change
under it.  A batch is written to a staging folder first and marked complete; then
its files are moved, each at once, into the table.  A replay finds the mark and
moves what is left, so that no file comes twice and none is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quorum.session import file_system


def ensure_dir(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.mkdirs(p)


def write_batch(df: DataFrame, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch_id={batch_id}")


def append_once(df: DataFrame, table: str, batch_id: int) -> None:
    """Add ``df`` to ``table`` as the rows of ``batch_id``, exactly once."""
    spark, table = df.sparkSession, table.rstrip("/")
    staged = f"{table}_staged/batch_id={batch_id}"
    fs, mark = file_system(spark, f"{staged}/_COMPLETE")
    if not fs.exists(mark):
        df.write.mode("overwrite").parquet(staged)
        fs.create(mark).close()
    ensure_dir(spark, table)
    for f in fs.listStatus(file_system(spark, staged)[1]):
        name = f.getPath().getName()
        if not name.startswith(("_", ".")):
            target = file_system(spark, f"{table}/batch-{batch_id:012d}-{name}")[1]
            if not fs.rename(f.getPath(), target):
                raise OSError(f"cannot move {f.getPath()} to {target}")


def read_table(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """All batches of a folder table (explicit schema: an empty table is an
    empty DataFrame)."""
    ensure_dir(spark, table)
    full = T.StructType(schema.fields + [T.StructField("batch_id", T.LongType())])
    return spark.read.schema(full).option("basePath", table).parquet(table).drop("batch_id")


def read_batch(spark: SparkSession, table: str, schema: T.StructType, batch_id: int) -> DataFrame:
    path = f"{table.rstrip('/')}/batch_id={batch_id}"
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
