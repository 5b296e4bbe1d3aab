"""What the library needs from a Spark session: its own code on the executors, and a shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_attached: set[str] = set()


def attach(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application.  Functions are then imported there, so
    per-worker caches (cipher tables) outlive a task."""
    context = spark.sparkContext
    if context.applicationId not in _attached:
        package = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="cloakframe-")) / "cloakframe.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _attached.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for tables that cut lineage.  A cluster must name one in
    ``spark.checkpoint.dir``; a session in one process gets a temporary one, removed when the process ends."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="cloakframe-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def spread(df: DataFrame, by: str) -> DataFrame:
    """Give a scan of fewer files than there are cores as many partitions as cores before heavy column work;
    one of more files is returned as it is, so large inputs are not shuffled.  Only file names are looked at."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, by) if 0 < len(df.inputFiles()) < cores else df


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.  Lineage ends there, a lost
    executor costs nothing, both readers of the result see the same rows, and Catalyst knows its true
    size when it decides on a broadcast."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
