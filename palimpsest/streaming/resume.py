"""A stream that can be stopped anywhere and goes on: a named checkpoint, and a sink in which a repeated batch replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run(rows: DataFrame, path: str, after: Callable[[int], None] | None = None) -> None:
    """Runs the stream over all that is there, from where the last run under ``path`` stopped.

    A batch is written to a folder of its own number, which is replaced if the batch is run again, so a run that ended between the writing and the
    commit of a batch leaves no row twice. ``after`` is called with the number of every written batch before it is committed."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        if after:
            after(number)

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()


def written(spark: SparkSession, path: str, schema) -> DataFrame:
    """What the runs under ``path`` wrote, with the number of the batch."""
    return spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows/batch=*").withColumn("batch", F.col("batch").cast("long")) if exists(spark, f"{path}/rows") else spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(batch): the batches under ``path`` that are done."""
    if not exists(spark, f"{path}/progress/commits"):
        return spark.createDataFrame([], "batch long")
    names = spark.read.text(f"{path}/progress/commits/[0-9]*").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name")).distinct()
    return names.where(F.col("name").rlike("^[0-9]+$")).select(F.col("name").cast("long").alias("batch"))


def status(spark: SparkSession, path: str, source: DataFrame, key: list[str]) -> DataFrame:
    """The keys of ``source`` with their status: ``pending`` until the batch that has them is committed, then ``done``."""
    done = written(spark, path, source.select(*key).schema).join(committed(spark, path), "batch", "left_semi").select(*key).distinct().withColumn("status", F.lit("done"))
    return source.select(*key).join(done, key, "left").fillna({"status": "pending"})


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder, asked of the file system that Spark uses for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
