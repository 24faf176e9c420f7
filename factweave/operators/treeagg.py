"""Per-key results where a few keys hold most rows: aggregation in a tree of rounds.

Input splits are the chunks (their size is ``spark.sql.files.maxPartitionBytes``). Every task combines its
chunk locally; then each round merges the states of ``fan_in`` neighbouring chunks per key, until one state
per key is left. A reducer gets at most ``fan_in`` states of a key in any round, however many rows the key
has and however many tasks read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How two states of an aggregate merge.
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _first(kind: str, value: Column | None) -> Column:
    if kind == "count":
        return F.count(F.lit(1) if value is None else value)
    return MERGE[kind](value)


def rounds_for(chunks: int, fan_in: int) -> int:
    """Rounds until ``chunks`` states of a key are one."""
    n = 1
    while chunks > fan_in:
        chunks, n = -(-chunks // fan_in), n + 1
    return n


def tree_aggregate(
    df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, Column | None]], fan_in: int = 16
) -> DataFrame:
    """One row per distinct combination of ``keys``: the keys and each aggregate of ``aggs``.

    ``aggs`` maps an output name to (kind, column); kinds are count, sum, min and max; column None with count
    counts rows. A null key is a group of its own, as in SQL. Nulls in a value column are skipped, and a group
    of nulls only has a null sum, min and max. Repeated rows count as often as they come. An empty table gives
    no rows. Columns that are neither keys nor values are pruned, whatever they are called.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    unknown = {kind for kind, _ in aggs.values()} - set(MERGE)
    if unknown:
        raise ValueError(f"no such aggregate: {sorted(unknown)}")
    chunks = max(1, df.rdd.getNumPartitions())
    level = "__chunk"
    state = (
        df.select(
            *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
            *[
                (F.lit(1) if v is None else v).alias(f"__v{i}")
                for i, (_, v) in enumerate(aggs.values())
            ],
            F.spark_partition_id().alias(level),
        )
    )
    by = [f"__k{i}" for i in range(len(keys))]
    for n in range(rounds_for(chunks, fan_in)):
        last = n == rounds_for(chunks, fan_in) - 1
        group = by if last else [*by, F.floor(F.col(level) / fan_in).alias(level)]
        state = state.groupBy(*group).agg(
            *[
                (_first(kind, F.col(f"__v{i}")) if n == 0 else MERGE[kind](f"__v{i}")).alias(f"__v{i}")
                for i, (kind, _) in enumerate(aggs.values())
            ]
        )
    return state.select(
        *[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)],
        *[F.col(f"__v{i}").alias(name) for i, name in enumerate(aggs)],
    )
