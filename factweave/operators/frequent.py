"""Most frequent values of a column with very many distinct ones, in memory of a fixed size.

First pass: every value falls into one bucket under each of several hashes, and rows per bucket are counted
exactly. A value that reaches the threshold makes all its buckets reach it, so a value with a bucket below
the threshold is out. At most 1/share buckets per hash can reach the threshold, so what the driver gets is
bounded by that. Second pass: the values whose buckets all reach the threshold are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counts are whole, shares aren't: a product that comes out a hair above a whole number is that number.
SLACK = 1e-6


def frequent_values(
    df: DataFrame, columns: list[str], share: float, hashes: int = 4, buckets: int = 4096
) -> DataFrame:
    """(field_name, field_value, n, n_field): the values of each column that reach ``share`` of its rows.

    Rows where the column is null or '' neither count nor come out. ``n`` is the exact count, ``n_field`` the
    number of rows counted for the column. No value at or above the threshold is missed. Repeated rows count
    as delivered; ties are all kept; an empty table gives no rows. Memory: ``hashes * buckets`` counters per
    column and task; to the driver at most ``hashes / share`` bucket numbers per column.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("f"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)
    ])).alias("x")).select("x.f", "x.v").where("v is not null and v <> ''")

    def bucket(i: int):
        return F.pmod(F.xxhash64(F.lit(i), F.col("v")), F.lit(buckets)).cast("int")

    counted = (
        values.select("f", F.explode(F.array(*[F.lit(i) * buckets + bucket(i) for i in range(hashes)])).alias("b"))
        .groupBy("f", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # every row has one bucket under hash 0: their sum is the number of rows
    total = counted.where(F.col("b") < buckets).groupBy("f").agg(F.sum("n").alias("n_field"))
    totals = {r.f: r.n_field for r in total.collect()}
    if not totals:
        return df.sparkSession.createDataFrame([], "field_name string, field_value string, n long, n_field long")
    reach = F.lit(False)
    for f, n in totals.items():
        reach = reach | ((F.col("f") == f) & (F.col("n") >= share * n - SLACK))
    heavy: dict[tuple[int, int], list[int]] = {}
    for r in counted.where(reach).select("f", "b").collect():
        heavy.setdefault((r.f, r.b // buckets), []).append(r.b % buckets)
    keep = F.lit(False)
    for f in totals:
        every = F.col("f") == f
        for i in range(hashes):
            every = every & bucket(i).isin(heavy.get((f, i), []) or [-1])
        keep = keep | every
    survivors = values.where(keep).groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
    pick = lambda of: F.coalesce(*[F.when(F.col("f") == k, F.lit(x)) for k, x in of.items()])
    return (
        survivors.withColumn("n_field", pick(totals).cast("long"))
        .where(F.col("n") >= share * F.col("n_field") - SLACK)
        .select(pick(dict(enumerate(columns))).alias("field_name"), F.col("v").alias("field_value"), "n", "n_field")
    )
