"""What changed between consecutive full snapshots of a table.

Per key, the snapshots in which it occurs with the same row hash form islands; each island is a validity
interval [first snapshot, last snapshot]. A start with no neighbour before it is an addition, an end with no
neighbour after it a removal, and two adjacent intervals are a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def instant_nanos(text: Column) -> Column:
    """Nanoseconds since the epoch of an ISO-8601 time with any offset and fraction length; null if malformed.

    Text order is not time order: '10:00+02:00' is before '09:00Z'. A missing offset means UTC.
    """
    pattern = r"^\s*(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(?:[.,](\d+))?\s*(Z|z|[+-]\d\d:?\d\d)?\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    seconds = F.unix_timestamp(
        F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    )
    zone = F.regexp_replace(part(4), "[Zz:]", "")
    offset = F.when(zone == "", F.lit(0)).otherwise(
        F.when(zone.startswith("-"), -1).otherwise(1)
        * (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 4, 2).try_cast("int") * 60)
    )
    nanos = F.rpad(F.substring(part(3), 1, 9), 9, "0").try_cast("long")
    return (seconds - offset) * 1_000_000_000 + F.coalesce(nanos, F.lit(0))


def validity_intervals(states: DataFrame, series: str, key: str, seq: str, row_hash: str) -> DataFrame:
    """(series, key, first_seq, last_seq, row_hash): the maximal runs of consecutive ``seq`` with an equal hash.

    ``states`` has at most one row per (series, key, seq), ``seq`` counting the series' snapshots without gaps.
    Null hashes equal each other here: the record is there, its content unknown.
    """
    along = W.partitionBy(series, key).orderBy(seq)
    begins = ~(
        (F.lag(seq).over(along) == F.col(seq) - 1) & F.lag(row_hash).over(along).eqNullSafe(F.col(row_hash))
    )
    marked = states.select(series, key, seq, row_hash, F.coalesce(begins, F.lit(True)).cast("int").alias("__b"))
    return (
        marked.withColumn("__island", F.sum("__b").over(along))
        .groupBy(series, key, "__island")
        .agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.first(row_hash).alias(row_hash))
        .drop("__island")
    )


def change_events(intervals: DataFrame, series: str, key: str, row_hash: str, last: DataFrame) -> DataFrame:
    """(series, seq, key, change_type) from validity intervals; ``last`` has (series, n_seq) of every series.

    seq is the later snapshot of the pair. An interval that starts at seq 1 or ends at the newest snapshot is
    no event. Adjacent intervals are a change only where both hashes are known.
    """
    along = W.partitionBy(series, key).orderBy("first_seq")
    near = intervals.select(
        series,
        key,
        "first_seq",
        "last_seq",
        row_hash,
        F.lag("last_seq").over(along).alias("__before_end"),
        F.lag(row_hash).over(along).alias("__before_hash"),
        F.lead("first_seq").over(along).alias("__after"),
    ).join(last, series)
    touches = F.coalesce(F.col("__before_end") == F.col("first_seq") - 1, F.lit(False))
    start = F.when(
        F.col("first_seq") > 1,
        F.when(~touches, "added").when(F.col(row_hash).isNotNull() & F.col("__before_hash").isNotNull(), "changed"),
    )
    ends = (F.col("last_seq") < F.col("n_seq")) & ~F.coalesce(F.col("__after") == F.col("last_seq") + 1, F.lit(False))
    event = F.array(
        F.struct(F.col("first_seq").alias("seq"), start.alias("change_type")),
        F.struct((F.col("last_seq") + 1).alias("seq"), F.when(ends, "removed").alias("change_type")),
    )
    return (
        near.select(series, key, F.explode(event).alias("__e"))
        .select(series, F.col("__e.seq").alias("seq"), key, F.col("__e.change_type").alias("change_type"))
        .where("change_type is not null")
    )


def symbol_records(symbols: DataFrame) -> DataFrame:
    """(run_id, symbol_id, body_hash): each symbol's record in each run, the row with the greatest fact_index.

    Hashes compare without case; null and '' are both no hash. Rows without a run or symbol id are dropped.
    """
    hashed = F.nullif(F.lower("body_hash"), F.lit(""))
    return (
        symbols.where("run_id is not null and symbol_id is not null")
        .groupBy("run_id", "symbol_id")
        .agg(F.max(F.struct("fact_index", hashed.alias("h"))).alias("r"))
        .select("run_id", "symbol_id", F.col("r.h").alias("body_hash"))
    )


def full_runs(runs: DataFrame, run_ids: DataFrame) -> DataFrame:
    """(run_id, solution_path, seq, n_seq): the full runs of every solution in the order of their instants.

    A full run has no source_project_path and is among ``run_ids``. A run delivered twice counts once; equal
    instants are ordered by id.
    """
    once = (
        runs.where("source_project_path is null and id is not null and solution_path is not null")
        .groupBy(F.col("id").alias("run_id"))
        .agg(F.min(F.struct("created_at_utc_text", "solution_path")).alias("r"))
        .select("run_id", "r.solution_path", instant_nanos(F.col("r.created_at_utc_text")).alias("at"))
    )
    per = W.partitionBy("solution_path")
    return (
        once.join(run_ids.select("run_id").distinct(), "run_id", "left_semi")
        .withColumn("seq", F.row_number().over(per.orderBy("at", "run_id")))
        .withColumn("n_seq", F.count(F.lit(1)).over(per))
        .drop("at")
    )


def symbol_intervals(runs: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(intervals of every symbol of every solution, its full runs)."""
    ordered = full_runs(runs, symbols)
    states = symbol_records(symbols).join(ordered.select("run_id", "solution_path", "seq"), "run_id")
    return validity_intervals(states, "solution_path", "symbol_id", "seq", "body_hash"), ordered


def symbol_changes(runs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(run_id, symbol_id, change_type) between every two consecutive full runs of a solution.

    Nulls: runs without an id or solution, and symbols without a run or symbol id, are left out; a null or ''
    body_hash never makes a change. Exact copies and repeated deliveries count once. Empty tables give no rows.
    """
    intervals, ordered = symbol_intervals(runs, symbols)
    last = ordered.select("solution_path", "n_seq").distinct()
    events = change_events(intervals, "solution_path", "symbol_id", "body_hash", last)
    return events.join(ordered.select("run_id", "solution_path", "seq"), ["solution_path", "seq"]).select(
        "run_id", "symbol_id", "change_type"
    )
