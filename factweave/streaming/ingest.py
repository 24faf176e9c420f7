"""Snapshots that arrive as a stream: facts landing in a folder are re-derived batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factweave.runtime import _delete as delete
from factweave.runtime import materialize, release
from factweave.sources.tables import SCHEMAS


def fact_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files of a fact table as they land in the folder."""
    return spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def late_aware_counts(facts: DataFrame, key: str, delay: str = "14 days", window: str = "1 day") -> DataFrame:
    """(window, key, n): rows per key and loading window; rows later than ``delay`` behind the newest are dropped by
    the watermark, those within it correct their window."""
    timed = facts.withColumn("__t", F.col("loaded_at").cast("timestamp")).withWatermark("__t", delay)
    return timed.groupBy(F.window("__t", window).alias("window"), F.col(key)).agg(F.count(F.lit(1)).alias("n"))


def rederive(stream: DataFrame, assemblies: str, derive: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Derive the assemblies that a batch holds from all their facts that have landed so far, and write them partitioned
    by assembly, replacing what was derived before. An assembly's facts may lie in any number of batches.

    Landed facts are kept by assembly and batch below the checkpoint, so a batch that is run again after a failure
    writes the same partitions again, and a new checkpoint starts without facts. The query processes what is there and
    ends.
    """
    landed = f"{checkpoint}/landed"

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # null and '' share a partition of the output
        kept = batch.withColumn("__key", F.concat(F.lit("="), F.coalesce(F.col(assemblies).cast("string"), F.lit("")))).withColumn("__batch", F.lit(number).cast("long"))
        dynamic = lambda df, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
        dynamic(kept, "__key", "__batch").parquet(landed)
        facts = spark.read.schema(kept.schema).parquet(landed).where(F.col("__batch") <= number)
        touched = facts.where(F.col("__batch") == number).select("__key").distinct()
        made = materialize(derive(facts.join(touched, "__key", "left_semi").drop("__key", "__batch")), "derived")
        dynamic(made, assemblies).parquet(out)
        has = made.select(F.concat(F.lit("="), F.coalesce(F.col(assemblies).cast("string"), F.lit(""))).alias("__key")).distinct()
        for r in touched.join(has, "__key", "left_anti").toLocalIterator():  # nothing is derived of these any more
            folder = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(assemblies, r[0][1:])
            delete(spark, f"{out}/{folder}")
        release(made)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
