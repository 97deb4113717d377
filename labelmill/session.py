"""Session helpers shared by the bench, the tests and the registered queries."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "labelmill", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (all are ordinary Spark settings)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a private one only where that is unset.

    On a cluster the setting names storage every executor can reach, so a lost executor
    costs no recomputation past the checkpoint.  Only a local master falls back to a
    folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="labelmill-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and cut the lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


SCAN_TASKS = "labelmill.scanTasks"
TASK_ROWS = 10_000       # rows that a scan task may hold without being dealt out
CORE_SHARES, WAVES = 1.5, 4


def spread(df: DataFrame) -> DataFrame:
    """A scan whose rows lie in too few tasks, dealt to all cores; any other as it is, and then nothing is shuffled.

    Spark cannot split a row group, and it packs small files into few tasks, so a narrow table of many rows may be one task
    whatever the cluster.  Rows are counted per task without reading a column.  A scan is dealt when its fullest task has more than
    ``TASK_ROWS`` rows and more than ``CORE_SHARES`` cores' even share, to ``WAVES`` tasks a core, or fewer when they would
    have less than ``TASK_ROWS`` rows.  The session's ``labelmill.scanTasks`` sets the number of tasks instead, whatever the rows.
    """
    spark = df.sparkSession
    tasks = spark.conf.get(SCAN_TASKS, None)
    if tasks:
        return df.repartition(int(tasks))
    held = df.select(F.spark_partition_id().alias("task")).groupBy("task").agg(F.count("*").alias("n"))
    total, fullest, scans = held.agg(F.sum("n"), F.max("n"), F.max("task") + 1).head()
    cores = spark.sparkContext.defaultParallelism
    if not total or fullest <= TASK_ROWS or fullest * cores <= CORE_SHARES * total:
        return df
    return df.repartition(min(-(-total // TASK_ROWS), max(scans, WAVES * cores)))


def values(spark: SparkSession, items: Iterable[str], name: str) -> DataFrame:
    """A short fixed list as a one-column table whose size Spark knows, so that it may be broadcast."""
    listed = F.array(*[F.lit(x) for x in items]).cast("array<string>")
    return spark.range(1).select(F.explode(listed).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
