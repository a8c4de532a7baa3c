"""What workers and driver share: the package, and a folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: The shared folder where driver and executors are one process and none is named.
LOCAL = "/tmp/checkpoints/docketry"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. On a cluster it must be named: ValueError."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL).rstrip("/")


def ship(spark: SparkSession | None = None) -> None:
    """Add this package's folder to the path that workers of the session get."""
    spark = spark or SparkSession.getActiveSession()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
