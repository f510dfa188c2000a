"""Tables in the folder that the driver and the executors share, and rows dealt over their cores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session on one machine that has none uses its warehouse directory.

    On a cluster a folder of one machine is no shared folder, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/") + "/_checkpoints"


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read again; the table goes when the application ends.

    The table cuts the lineage, so a lost executor costs only the step at hand,
    and the plan of a loop stays as long as one round.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quirelake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: Tasks for each core, so that a slow one holds up few others.
TASKS_A_CORE = 4


def spread(df: DataFrame, *columns: str, tasks: int | None = None) -> DataFrame:
    """The rows of ``df`` dealt by columns over all cores.

    For rows of few bytes that cost much work each: a file of them is read by one task or two, and a shuffle is
    merged into few tasks, since Spark counts bytes.
    """
    return df.repartition(tasks or TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, *columns)


def tasks_for(df: DataFrame, rows_a_task: int) -> int:
    """Tasks for ``spread``: as many as it takes, or more where a task would have more rows, so that what it sorts stays in memory.  It counts the rows."""
    return max(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_a_task))
