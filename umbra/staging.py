"""Intermediate tables in the folder that driver and executors share, so that lineage stays short and survives lost
executors; and numbering of rows that no task could hold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a session on one machine gets one of its own; on
    a cluster that is an error, since executors wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="umbra-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Folders that this session has written.
WRITTEN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    WRITTEN.append(f"{shared_dir(spark)}/umbra-{name}-{uuid.uuid4().hex}")
    return WRITTEN[-1]


def dropped(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Deletes folders of a range of WRITTEN; for when what was read from them is done with."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in WRITTEN[since:until]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    del WRITTEN[since:until]


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, order: list[str], parts: int, name: str) -> DataFrame:
    """The rows, written to the shared folder, with ``part``: ranges of ``order`` of like size, ascending. Narrow rows
    only, and best read from a table: bounds are sampled from them first. Rows equal in all of ``order`` share a part."""
    return saved(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), name)


def numbered(rows: DataFrame, group: list[str], order: list[str], parts: int, name: str) -> DataFrame:
    """rows with ``at``, the place (from 1) within the group, and ``of``, the group's rows. No task holds a group: rows are
    dealt by ranges of group and order, counted by range, and numbered within each range."""
    found = dealt(rows, [*group, *order], parts, name)
    whole = Window.partitionBy(*group)
    counts = found.groupBy(*group, "part").agg(F.count("*").alias("_n"))
    counts = counts.select(*group, "part", F.sum("_n").over(whole).alias("of"), (F.sum("_n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*group, "part").orderBy(*order))
    out = found.withColumn("at", within).join(counts, [*group, "part"])
    return out.withColumn("at", F.col("_before") + F.col("at")).drop("_before", "part")
