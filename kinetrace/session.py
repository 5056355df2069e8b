"""Session and shared-storage helpers used by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the library expects (UTC, ANSI, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and make sure there is a checkpoint folder.

    ``spark.checkpoint.dir`` is used where it is set. Only an unset one of a local master (tests, a laptop) gets a
    temporary folder; on a cluster, where driver and executors share no local folder, an unset one is an error.
    """
    sc = spark.sparkContext
    known = sc.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kinetrace-"))
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the checkpoint folder, which driver and executors share."""
    import uuid

    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the cluster asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges(df: DataFrame, target: int = 32 << 20) -> int:
    """A number of ranges for a sort: the cluster's shuffle partitions, or more where Spark's estimate of the bytes asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = partitions(df.sparkSession)
    return max(least, min(size // target, 100 * least))


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder, removed with its last reference."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)
