"""Session defaults, the shared checkpoint folder and staged tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidemark", cores: str | int = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """Local session with the defaults the library expects (UTC, ANSI, AQE).

    On a cluster the session comes from spark-submit; only the time zone has to be UTC there.
    """
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Rows join per-key statistics and are grouped by the same key; a hot key must be split even
        # though the grouping then needs its own shuffle.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Call-site capture costs more than the calls themselves when plans have hundreds of columns.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
    )
    n = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    spark = b.config("spark.sql.shuffle.partitions", str(n)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset a local session gets its own temporary folder; on a cluster that would lose
    data with the machine, so it is an error there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named is None and current is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):  # executors of local-cluster are processes that can be lost
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if current is None:
        sc.setCheckpointDir(named)
    return named or current


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds more than one later pass. Unlike a cache it survives the loss of
    executors, and the readers still prune columns and push filters.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
