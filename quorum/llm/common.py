"""Helpers the operators share: written tables in the shared folder, batch maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quorum.session import checkpoint_root, ship_package

# bytes that Python's bytes.split() and the contracts call white space
WHITE = " \t\n\x0b\x0c\r"
SPACE_PATTERN = "[ \\t-\\r]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the session's checkpoint folder and read again:
    cuts the lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: what may stand above a file scan whose rows are known by file and place
_ROWWISE = {"LogicalRelation", "Project", "Filter", "SubqueryAlias", "View"}


def _rowwise(plan) -> bool:
    """Whether each row of a plan is a row of the one file scan below it."""
    name, below = plan.nodeName().split(" ")[0], plan.children()
    return ((name in _ROWWISE or name.startswith("Relation")) and below.size() <= 1
            and all(_rowwise(below.apply(i)) for i in range(below.size())))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a row number in ``name`` that is the same in each pass.

    Rows read straight from Parquet files are known by their file and their
    place in it, however the files are split; other frames are written first."""
    plan = docs._jdf.queryExecution().analyzed()
    if "_metadata" not in docs.columns and plan.deterministic() and _rowwise(plan):
        path, at, no = (fresh_name(docs, c) for c in ("file_path_", "row_index_", "file_no_"))
        try:
            rows = docs.select("*", F.col("_metadata.file_path").alias(path),
                               F.col("_metadata.row_index").alias(at))
        except AnalysisException:
            rows = None                              # no file scan, or not of Parquet
        if rows is not None:
            files = sorted(r[0] for r in rows.select(path).distinct().collect())
            numbers = docs.sparkSession.createDataFrame(
                list(enumerate(files)), f"{no} long, {path} string")
            return rows.join(F.broadcast(numbers), path).select(
                *[F.col(f"`{c}`") for c in docs.columns],
                (F.shiftleft(no, 40) + F.col(at)).alias(name))
    return saved(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def block_keys(hits: DataFrame, keys: list[str], min_docs: int, min_contexts: float,
               max_shared: float = 0.5) -> DataFrame:
    """The ``keys`` of lines that recur as parts of blocks around which texts differ.

    ``hits`` has a row for each recurring line of a document: rid, at (its
    place), words, total (the document's words), before and after (hashes of
    the lines beside it) and the keys.  Recurring lines in a row are one block.
    In copies and near copies they are most of the document, in a menu or
    footer the lesser part: a key passes if at least half of its documents, and
    ``min_docs``, have less than ``max_shared`` of their words in recurring
    lines, and if the lines before and after its blocks differ in
    ``min_contexts`` of those."""
    whole, ordered = Window.partitionBy("rid"), Window.partitionBy("rid").orderBy("at")
    block = Window.partitionBy("rid", "block").orderBy("at").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    per_line = (hits.withColumn("block", F.col("at") - F.row_number().over(ordered))
                .withColumn("minor", F.sum("words").over(whole) < F.col("total") * max_shared)
                .withColumn("context", F.xxhash64(F.first("before").over(block), F.last("after").over(block))))
    per_doc = per_line.groupBy("rid", *keys).agg(F.min("context").alias("context"), F.max("minor").alias("minor"))
    by_context = per_doc.groupBy(*keys, "context").agg(
        F.count("*").alias("n"), F.count_if("minor").alias("minor"))
    return by_context.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("minor").alias("minor"), F.count_if(F.col("minor") > 0).alias("contexts")).where(
        (F.col("minor") >= min_docs) & (2 * F.col("minor") >= F.col("n"))
        & (F.col("contexts") >= F.col("minor") * min_contexts)).select(*keys)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with the package available to the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
