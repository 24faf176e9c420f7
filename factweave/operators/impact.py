"""What a change does: set differences, footprints, reach and structure between two sides of a program."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import docid
from factweave.operators import closure

#: Share of data-shaped members in a stem's change from which its cause is a record's shape.
RECORD_SHARE = 0.8


def set_diff(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): keys in head only are added, in base only removed. Null keys equal each other; copies count once."""
    b = base.select(*keys).distinct().withColumn("__b", F.lit(1)).withColumn("__h", F.lit(0))
    h = head.select(*keys).distinct().withColumn("__b", F.lit(0)).withColumn("__h", F.lit(1))
    both = b.unionByName(h).groupBy(*keys).agg(F.max("__b").alias("__b"), F.max("__h").alias("__h")).where("__b <> __h")
    return both.select(*keys, F.when(F.col("__h") == 1, "added").otherwise("removed").alias("change"))


def body_changes(base: DataFrame, head: DataFrame, within: list[str] | None = None) -> DataFrame:
    """(symbol_id): symbols (symbol_id, body_hash) whose hash differs or is on one side only.

    With ``within``, as the solution, a symbol is compared in each by itself, and comes out once if any of them differs.

    null and '' are no hash, case means nothing. If a side has no hashes at all, there are no changes: it can't tell.
    """
    keys = [*(within or []), "symbol_id"]
    norm = lambda df: df.select(*keys, F.nullif(F.lower("body_hash"), F.lit("")).alias("h"))
    b, h = norm(base), norm(head)
    if b.where("h is not null").isEmpty() or h.where("h is not null").isEmpty():
        return base.sparkSession.createDataFrame([], "symbol_id string")
    b, h = (x.where("h is not null").groupBy(*keys).agg(F.min("h").alias(n)) for x, n in ((b, "b"), (h, "x")))
    return b.join(h, keys, "full_outer").where("not (b <=> x)").select("symbol_id").distinct()


def footprints(edges: DataFrame, entry_points: DataFrame, effects: DataFrame) -> DataFrame:
    """(entry, provider, operation, resource, enclosing, n_nodes, in_loop): what each entry point (entry, node) does.

    enclosing has no parameters; n_nodes counts the distinct producing methods, in_loop says whether any lies in a
    loop. All entry points are followed in one closure.
    """
    seen = closure.reach_each(edges, entry_points.select(F.col("entry").alias("seed"), "node").distinct()).select(F.col("seed").alias("entry"), "node")
    e = effects.groupBy(F.col("enclosing_symbol_id").alias("node"), "provider", "operation", "resource").agg(F.max(F.col("enclosing_loop_kind").isNotNull()).alias("in_loop"))
    return seen.join(e, "node").groupBy("entry", "provider", "operation", "resource", docid.param_free_name("node").alias("enclosing")).agg(
        F.countDistinct("node").alias("n_nodes"), F.max("in_loop").alias("in_loop")
    )


FOOTPRINT = ["entry", "provider", "operation", "resource", "enclosing"]


def footprint_diff(base: DataFrame, head: DataFrame, shared_mutation: str = "shared_state:mutate") -> DataFrame:
    """(FOOTPRINT, change, shared_mutation): effects added and removed per entry point, and those amplified: there on
    both sides, but by more nodes, or newly in a loop."""
    side = lambda df, x, y: df.select(*FOOTPRINT, *[(F.col(c) if z == x else F.lit(None).cast(t)).alias(z + n) for z in (x, y) for c, n, t in (("n_nodes", "n", "long"), ("in_loop", "l", "boolean"))])
    both = side(base, "b", "h").unionByName(side(head, "h", "b"))
    joined = both.groupBy(*FOOTPRINT).agg(*[F.max(c).alias(c) for c in ("bn", "bl", "hn", "hl")])
    change = F.when(F.col("bn").isNull(), "added").when(F.col("hn").isNull(), "removed").when((F.col("hn") > F.col("bn")) | (F.col("hl") & ~F.col("bl")), "amplified")
    return joined.withColumn("change", change).where("change is not null").select(*FOOTPRINT, "change", (F.concat_ws(":", "provider", "operation") == shared_mutation).alias("shared_mutation"))


def reach_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(entry, stem, kind): changes of what entry points reach (entry, node), by names without parameters.

    A stem with ids gained and lost is a signature change, else added or removed.
    """
    d = set_diff(base, head, ["entry", "node"]).withColumn("stem", docid.param_free_name("node"))
    g = d.groupBy("entry", "stem").agg(F.max(F.col("change") == "added").alias("a"), F.max(F.col("change") == "removed").alias("r"))
    return g.select("entry", "stem", F.when(F.col("a") & F.col("r"), "signature").when(F.col("a"), "added").otherwise("removed").alias("kind"))


def body_edits_in_reach(base: DataFrame, head: DataFrame, changed: DataFrame) -> DataFrame:
    """(entry, node): symbols with a changed body (symbol_id) that an entry point reaches on both sides."""
    shared = base.select("entry", "node").distinct().join(head.select("entry", "node").distinct(), ["entry", "node"])
    return shared.join(changed.select(F.col("symbol_id").alias("node")), "node", "left_semi").select("entry", "node")


def structural_cause(diff: DataFrame, in_place: DataFrame | None = None) -> DataFrame:
    """(entry, cause, stems) of ``reach_diff`` rows and of entry points with edits in place (``in_place``: entry).

    constructor where all changed stems are constructors; else record_shape where at least RECORD_SHARE of them look
    like data (``R:`` nodes, getters, setters, constructors), else other; in_place where edited bodies are all there is.
    """
    ctor = F.col("stem").endswith(".#ctor")
    data = F.col("stem").startswith("R:") | F.col("stem").contains(".get_") | F.col("stem").contains(".set_") | ctor
    g = diff.groupBy("entry").agg(F.count(F.lit(1)).alias("stems"), F.sum(data.cast("int")).alias("d"), F.sum(ctor.cast("int")).alias("c"))
    cause = F.when(F.col("c") == F.col("stems"), "constructor").when(F.col("d") >= RECORD_SHARE * F.col("stems"), "record_shape").otherwise("other")
    moved = g.select("entry", cause.alias("cause"), "stems")
    if in_place is None:
        return moved
    only = in_place.select("entry").distinct().join(moved, "entry", "left_anti")
    return moved.unionAll(only.select("entry", F.lit("in_place"), F.lit(0).cast("long")))


def guard_delta(diff: DataFrame, head: DataFrame, locks: list[str] = ("lock", "async_lock"), mutation: str = "shared_state:mutate") -> DataFrame:
    """(entry, provider, change): lock effects gained or lost by entry points that still change shared state."""
    mutating = head.where(F.concat_ws(":", "provider", "operation") == mutation).select("entry").distinct()
    return diff.where(F.col("provider").isin(list(locks)) & F.col("change").isin("added", "removed")).join(mutating, "entry", "left_semi").select("entry", "provider", "change").distinct()


def gate_count(diff: DataFrame) -> DataFrame:
    """(entries): entry points with any effect added, removed or amplified."""
    return diff.agg(F.countDistinct("entry").alias("entries"))


def with_field_access(reached: DataFrame, refs: DataFrame) -> DataFrame:
    """(entry, node): what is reached, and ``R:`` and the target of each first-party read or write of reached methods."""
    access = refs.where(F.col("ref_kind").isin("read", "write") & F.col("target_in_source") & F.col("target_symbol_id").isNotNull()).select(F.col("enclosing_symbol_id").alias("node"), F.concat(F.lit("R:"), "target_symbol_id").alias("r")).distinct()
    more = reached.select("entry", "node").join(access, "node").select("entry", F.col("r").alias("node"))
    return reached.select("entry", "node").unionAll(more).distinct()


def effect_set_diff(edges: DataFrame, effects: DataFrame, left: DataFrame, right: DataFrame, only: list[str] = (), suffixes: list[str] = ()) -> DataFrame:
    """(resource_key, direction, categories): resources that only one of two entry points' reaches touches.

    ``left`` and ``right`` have node. Keys are normalised by the suffixes; categories are the sorted provider:operation
    of the present side, as many as there are rules. direction is left_only or right_only.
    """
    token = F.concat_ws(":", "provider", "operation")
    e = effects.where(token.isin(list(only))) if only else effects
    keyed = e.select(F.col("enclosing_symbol_id").alias("node"), docid.resource_key("resource", list(suffixes)).alias("resource_key"), token.alias("token")).distinct()
    sides = left.select(F.lit("left_only").alias("seed"), "node").unionAll(right.select(F.lit("right_only").alias("seed"), "node"))
    touched = closure.reach_each(edges, sides).select("seed", "node").join(keyed, "node").select("seed", "resource_key", "token").distinct()
    sided = touched.groupBy("resource_key").agg(F.countDistinct("seed").alias("n"), F.min("seed").alias("direction"), F.array_sort(F.collect_set("token")).alias("categories"))
    return sided.where("n = 1 and resource_key is not null").select("resource_key", "direction", F.array_join("categories", ",").alias("categories"))
