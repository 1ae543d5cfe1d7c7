"""Session helpers that every part of the library shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder; any file system Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of the files of a table: another text once the table is written again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return ""
    return "|".join(sorted(f"{x.getPath().getName()} {x.getLen()} {x.getModificationTime()}" for x in fs.listStatus(place)))


def removed(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a context's own. Where neither is set, a local master gets
    a temporary folder; on a cluster that is an error, as executors wouldn't see each other's files."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or _local_folder())
    return named or sc._jsc.sc().getCheckpointDir().get()


def _local_folder() -> str:
    """A folder for intermediate tables of a local session, gone when the process ends."""
    path = tempfile.mkdtemp(prefix="folioscope-checkpoint-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder; lineage ends there, so lost executors cost nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver found it by its working directory only."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join(x for x in [root, *known] if x)
