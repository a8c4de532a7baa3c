"""Helpers that the operators of this subpackage share: tables, shared storage, prefix sums."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Where intermediate tables go if the session names no shared folder (tests, a laptop).
LOCAL_SHARED = "/tmp/checkpoints/docketry"
#: A queue bucket has about so many rows, and there are so many buckets at least and at most.
BUCKET_ROWS, LEAST_BUCKET_BITS, MOST_BUCKET_BITS = 1 << 16, 8, 24
#: Rows and bytes of an Arrow batch; a worker holds about two, one text more where texts are longer.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: Rows of a table of keys (sources, hot fingerprints) up to which it is broadcast.
BROADCAST_ROWS = 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even where it is not installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    env.setdefault("OMP_NUM_THREADS", "1")
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) if spark.conf.get(key) > "0" else 0
        if not 0 < now <= most:
            spark.conf.set(key, most)


_left: dict = {}


def only(operator: str, clear=None) -> None:
    """In a Python worker: drop what another operator's tasks have left, and say how to drop one's own."""
    for name in [n for n in _left if n != operator]:
        _left.pop(name)()
    if clear:
        _left[operator] = clear


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; the cluster names it in spark.checkpoint.dir.

    Only where driver and executors are one process may it be missing; LOCAL_SHARED is set then.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", LOCAL_SHARED)
        found = LOCAL_SHARED
    return found.rstrip("/")


_stashed: dict[str, SparkSession] = {}


def stash(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here.

    The table outlives lost executors. It is removed by release(), and at the driver's exit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _stashed:
        atexit.register(release)
    df.write.option("compression", compression).parquet(path)
    _stashed[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove the folders of stashed tables that nothing reads any more; without tables, of all."""
    for path in [t.stashed for t in tables] if tables else list(_stashed):
        spark = _stashed.pop(path)
        if spark.sparkContext._jsc is not None:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bucket_bits(rows: int) -> int:
    """Leading bits of a 32-bit shuffle hash that make buckets of about BUCKET_ROWS rows."""
    return min(MOST_BUCKET_BITS, max(LEAST_BUCKET_BITS, (rows // BUCKET_ROWS).bit_length()))


def small(table: DataFrame) -> DataFrame:
    """table, to be broadcast if it has at most BROADCAST_ROWS rows; else left to the optimizer."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def unique(df: DataFrame, id_col: str) -> bool:
    """Whether no value of id_col is null or repeated."""
    return not df.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull()).take(1)


def with_row_key(df: DataFrame, id_col: str, text_col: str, name: str = "keyed") -> DataFrame:
    """Add a unique long ``_key`` that ascends with id_col.

    Where id_col is unique and not null it is the key. Otherwise rows are range-sorted by
    (id, hash of the text, text), nulls first, numbered in that order and written to the shared
    folder, so that every later read sees the same numbers.
    """
    if unique(df, id_col):
        return df.withColumn("_key", F.col(id_col).cast("long"))
    by = [F.col(id_col).asc_nulls_first(), F.col("_h"), F.col(text_col)]
    ordered = (
        df.withColumn("_h", F.xxhash64(text_col))
        .repartitionByRange(*by[:2])
        .sortWithinPartitions(*by)
        .withColumn("_key", F.monotonically_increasing_id())
        .drop("_h")
    )
    return stash(ordered, name)


def shuffle_hash(*parts: Column) -> Column:
    """A 32-bit shuffle position that SQL engines agree on: leading digits of an MD5."""
    joined = F.concat_ws(":", F.lit("mix"), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def before(df: DataFrame, groups: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that stand before this one.

    ``bucket`` must ascend with ``order``. Only bucket totals (as many rows as buckets) pass
    through one window per group; rows are summed inside their own bucket, so a group that holds
    a third of all rows is spread over all its buckets.
    """
    totals = df.groupBy(*groups, bucket).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, bucket, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(offsets, [*groups, bucket]).withColumn(out, F.col("_offset") + F.col("_inside")).drop("_offset", "_inside")
