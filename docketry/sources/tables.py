"""Tables that are replaced as a whole: every write is a new version, read once it is complete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

KEPT = 2


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, ascending; none where there is no table."""
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return []
    found = []
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and _exists(spark, f"{path}/{name}/_SUCCESS"):
            found.append(int(name[1:]))
    return sorted(found)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def exists(spark: SparkSession, path: str) -> bool:
    return bool(versions(spark, path))


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version, or None."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/v{found[-1]:06d}") if found else None


def write(df: DataFrame, path: str, partition_by: Sequence[str] = (), options: dict[str, str] | None = None) -> None:
    """A new version; readers see the one before until this one is complete. Old ones beyond KEPT go."""
    spark = df.sparkSession
    old = versions(spark, path)
    df.write.mode("overwrite").options(**options or {}).partitionBy(*partition_by).parquet(f"{path}/v{(old[-1] if old else 0) + 1:06d}")
    for n in old[: len(old) + 1 - KEPT]:
        fs, at = _files(spark, f"{path}/v{n:06d}")
        fs.delete(at, True)


def drop(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at, True)
