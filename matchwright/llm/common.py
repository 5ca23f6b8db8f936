"""Things that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import dropped, shared_dir, stored

__all__ = ["ASCII_LOWER", "ASCII_UPPER", "dropped", "numbered", "shared_dir", "small_batches", "stored", "table", "temp_name"]

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB and 2,000 rows from here on in this session, so
    that texts in flight between the JVM and Python stay bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def temp_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a long column ``name`` that numbers the rows from 0, file by file in
    the order of the files' names and as they stand in them: Spark itself reads larger
    files first. ``docs`` must be Parquet files as read, of one folder; rows that come
    from no file are numbered as they stand now, with gaps, and stored."""
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:
        return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    sizes = rows.groupBy("__file").agg(F.count("*").alias("n"))
    # Part numbers beyond five digits make a name longer.
    earlier = F.sum("n").over(Window.orderBy(F.length("__file"), "__file")) - F.col("n")
    starts = sizes.select(F.col("__file").alias("__of"), earlier.alias("__start"))
    placed = rows.join(F.broadcast(starts), F.col("__file") == F.col("__of"))
    return placed.withColumn(name, F.col("__start") + F.col("__at")).drop("__file", "__at", "__of", "__start")
