"""Session helpers: a test session and the one way this library cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docustrata")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder; only a local session (tests) that names none gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
        return
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
    folder = tempfile.mkdtemp(prefix="docustrata-checkpoint-")
    atexit.register(shutil.rmtree, folder, True)
    sc.setCheckpointDir(folder)


def durable(df: DataFrame) -> DataFrame:
    """Materialize ``df`` once in the shared checkpoint folder, so later reads survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written state beside the checkpoints, where every executor reaches it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def target_partitions(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Enough partitions that none holds many more than ``per_partition`` rows, and at least two for each core."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // per_partition), 1)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan to all cores where it comes in fewer parts, as one small file does; larger scans pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def kept(shared: Any, name: str, make: Callable[[dict], Any]) -> Any:
    """What ``make`` builds of a broadcast dictionary, once in each worker: it is kept beside the fields, which outlive a task."""
    fields = shared.value
    if name not in fields:
        fields[name] = make(fields)
    return fields[name]
