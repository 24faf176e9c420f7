"""Session settings and tables written between steps.

Steps that iterate (closures, list ranking, peeling) cut their lineage by writing a Parquet table to the
folder of ``spark.checkpoint.dir``, which all executors share, so a lost executor costs a re-read and no
recomputation of the loop.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Where checkpoints go in local mode, when the session names no folder.
_local_dir: str | None = None


def local_session(cores: str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster's session is used as it comes."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("factweave")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.autoBroadcastJoinThreshold", "16m")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in local mode a temporary folder where that is unset."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        made = tempfile.TemporaryDirectory(prefix="factweave-")
        atexit.register(made.cleanup)
        _local_dir = f"file://{made.name}"
    return _local_dir


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write df once and return a scan of it. ``release`` deletes it; else the end of the process does."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factweave/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._factweave_path = path
    atexit.register(_quietly, spark, path)
    return out


class Appended:
    """A written table that grows by partitions of one column; all of them are read as one scan."""

    def __init__(self, spark: SparkSession, tag: str, schema: StructType, column: str) -> None:
        self.spark, self.column = spark, column
        self.path = f"{shared_dir(spark)}/factweave/{tag}-{uuid.uuid4().hex}"
        self.schema = StructType([*schema.fields, StructField(column, IntegerType())])
        self.parts: list[int] = []
        atexit.register(_quietly, spark, self.path)

    def add(self, df: DataFrame, part: int) -> bool:
        """Write df as a partition; whether it has any rows."""
        path = f"{self.path}/{self.column}={part}"
        df.write.option("compression", "zstd").parquet(path)
        self.parts.append(part)
        return not self.spark.read.schema(df.schema).parquet(path).isEmpty()

    def read(self) -> DataFrame:
        out = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*[f"{self.path}/{self.column}={p}" for p in self.parts])
        out._factweave_path = self.path
        return out


def _quietly(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session may be gone already
        pass


def release(*dfs: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote, when nothing reads it any more."""
    for df in dfs:
        path = getattr(df, "_factweave_path", None)
        if path:
            _delete(df.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_dense_id(df: DataFrame, order: list, name: str, tag: str = "numbered") -> DataFrame:
    """Sort by ``order`` and number the rows 0, 1, 2, ... in a materialized table.

    The sort is by range over all tasks, so no single task sees the whole table; only one row count per
    partition goes to the driver. ``order`` should tell rows apart: rows equal in all of it stay together.
    Empty input gives an empty table.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    numbered = materialize(
        ranged.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), tag
    )
    offsets, start = [], 0
    for part, count in sorted((r[0], r[1]) for r in numbered.groupBy("__part").count().collect()):
        offsets.append((part, start))
        start += count
    at = spark.createDataFrame(offsets or [(0, 0)], "__part int, __start long")
    out = numbered.join(F.broadcast(at), "__part").withColumn(
        name, F.col("__start") + F.col("__row") - F.shiftleft(F.col("__part").cast("long"), 33)
    )
    out = out.drop("__part", "__row", "__start")
    out._factweave_path = numbered._factweave_path
    return out


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores, for work whose cost its few bytes don't show.

    A scan that already has that many splits is left as it is; a small file is dealt out row by row.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
