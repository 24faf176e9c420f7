"""Call trees as flat pre-order rows. A tree is a view for readers: its size is bounded by a node budget."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import docid
from factweave.operators import closure

SCHEMA = "ord int, depth int, node string, parent string, call_sites int, truncated string"


def call_tree(edges: DataFrame, root: str, max_depth: int = 20, budget: int = 50_000) -> DataFrame:
    """The depth-first pre-order tree below ``root``: ord, depth, node, parent, call_sites, truncated.

    ``edges`` has from_sym, to_sym, line. Calls of one caller to one callee are one child with their number, in the
    order of their first line. A symbol is expanded where it comes first; later places say already_expanded, nodes at
    max_depth with children depth_capped, and what no longer fits the budget budget_capped, in this order of causes.
    The executors bound the subgraph by reach; the driver fetches children in bulk, nearest callers first, without those
    of callers that have a budget's worth. Callers whose children it didn't fetch are budget_capped.
    """
    spark = edges.sparkSession
    e = edges.where("from_sym is not null and to_sym is not null")
    seeds = spark.createDataFrame([(root,)], "node string")
    within = closure.reach(closure.edge_list(e), seeds, max_depth).select(F.col("node").alias("from_sym"), F.col("depth").alias("at"))
    pairs = e.groupBy("from_sym", "to_sym").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
    # a caller with ``budget`` children can't be expanded
    fits = pairs.groupBy("from_sym").agg(F.count(F.lit(1)).alias("fan")).where(F.col("fan") < budget).join(within, "from_sym")
    children: dict[str, list[tuple[int, str, int]]] = defaultdict(list)
    last = None
    for r in pairs.join(fits, "from_sym").orderBy("at", "from_sym", "line", "to_sym").limit(20 * budget).toLocalIterator():
        children[r.from_sym].append((r.line, r.to_sym, r.n))
        last = r
    if last and len(children[last.from_sym]) < last.fan:  # the limit fell within this caller
        del children[last.from_sym]
    rows, expanded = [], set()
    stack = [(root, None, 0, 1)]
    while stack and len(rows) < budget:
        node, parent, depth, sites = stack.pop()
        below = sorted(children.get(node, ()))
        cause = None
        if node in expanded and below:
            cause = "already_expanded"
        elif depth >= max_depth and below:
            cause = "depth_capped"
        elif below and len(rows) + len(stack) + len(below) >= budget:
            cause = "budget_capped"
        else:
            expanded.add(node)
            stack += [(c, node, depth + 1, n) for _, c, n in reversed(below)]
        rows.append((len(rows), depth, node, parent, sites, cause))
    leaves = [(x,) for x in {r[2] for r in rows} - set(children)]
    if leaves:
        called = spark.createDataFrame(leaves, "from_sym string").join(e.select("from_sym"), "from_sym", "left_semi")
        left = {r.from_sym for r in called.collect()}
        rows = [(*r[:5], "depth_capped" if r[1] >= max_depth else "budget_capped") if r[2] in left else r for r in rows]
    return spark.createDataFrame(rows, SCHEMA)


def effects_on_tree(tree: DataFrame, effects: DataFrame) -> DataFrame:
    """Tree rows with ``effects``: the sorted provider:operation of the node, joined by commas; null without any."""
    e = effects.groupBy(F.col("enclosing_symbol_id").alias("node")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "provider", "operation"))), ",").alias("effects"))
    return tree.join(e, "node", "left")


def effect_view(tree: DataFrame, effects: DataFrame) -> DataFrame:
    """Effectful nodes of a tree, each at its first place: node, ord, effects."""
    return effects_on_tree(tree, effects).where("effects is not null").groupBy("node", "effects").agg(F.min("ord").alias("ord"))


def full_leaves(tree: DataFrame, effects: DataFrame, refs: DataFrame) -> DataFrame:
    """(node, line, leaf, is_effect): effects of the tree's methods and their library calls that are no effects' sites."""
    nodes = tree.select(F.col("node").alias("enclosing_symbol_id")).distinct()
    own = effects.join(nodes, "enclosing_symbol_id", "left_semi").select(F.col("enclosing_symbol_id").alias("node"), "line", F.concat_ws(":", "provider", "operation", "resource").alias("leaf"), F.lit(True).alias("is_effect")).distinct()
    calls = refs.where("ref_kind = 'invocation' and not target_in_source and target_symbol_id is not null").join(nodes, "enclosing_symbol_id", "left_semi")
    lib = calls.select(F.col("enclosing_symbol_id").alias("node"), "line", F.col("target_symbol_id").alias("leaf")).distinct().join(own.select("node", "line").distinct(), ["node", "line"], "left_anti").withColumn("is_effect", F.lit(False))
    return own.unionByName(lib)


def summary_rows(tree: DataFrame, effects: DataFrame) -> DataFrame:
    """Tree rows for a short listing: lambdas and constructors are left out, their effects count for the nearest shown
    caller: ord, depth, name, effects."""
    hidden = F.col("node").contains("~λ") | docid.method_name("node").eqNullSafe(F.lit("#ctor"))
    shown = tree.where(~hidden)
    owner = tree.where(hidden).select("node", F.coalesce(docid.lambda_container("node"), F.col("parent")).alias("owner"))
    rolled = effects.join(owner.withColumnRenamed("node", "enclosing_symbol_id"), "enclosing_symbol_id", "left").withColumn("enclosing_symbol_id", F.coalesce("owner", "enclosing_symbol_id"))
    out = effects_on_tree(shown, rolled.select("enclosing_symbol_id", "provider", "operation"))
    return out.select("ord", "depth", docid.short_name("node").alias("name"), "effects")


def seam_resources(edges: DataFrame, seams: DataFrame, effects: DataFrame) -> DataFrame:
    """(seed, provider, operation, resources): distinct resources below each seam (seed, node)."""
    below = closure.reach_each(edges, seams).select("seed", "node")
    e = effects.select(F.col("enclosing_symbol_id").alias("node"), "provider", "operation", "resource").distinct()
    return below.join(e, "node").groupBy("seed", "provider", "operation").agg(F.countDistinct("resource").alias("resources"))


def effect_groups(effects: DataFrame) -> DataFrame:
    """(enclosing_symbol_id, label): effects of a method for display: an acquire and a release of a resource are one
    'held' entry, repeats are one with ×n."""
    g = effects.groupBy("enclosing_symbol_id", "provider", "resource").agg(
        F.sum((F.col("operation") == "acquire").cast("int")).alias("a"), F.sum((F.col("operation") == "release").cast("int")).alias("r"),
    )
    held = g.where("a > 0 and r > 0").select("enclosing_symbol_id", F.concat_ws(":", "provider", F.lit("held"), "resource").alias("label"))
    rest = effects.join(g.where("a > 0 and r > 0").select("enclosing_symbol_id", "provider", "resource").withColumn("h", F.lit(True)), ["enclosing_symbol_id", "provider", "resource"], "left")
    rest = rest.where(~(F.coalesce("h", F.lit(False)) & F.col("operation").isin("acquire", "release")))
    counted = rest.groupBy("enclosing_symbol_id", F.concat_ws(":", "provider", "operation", "resource").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    return held.unionByName(counted.select("enclosing_symbol_id", F.when(F.col("n") > 1, F.concat("l", F.lit(" ×"), F.col("n").cast("string"))).otherwise(F.col("l")).alias("label")))


def dead_code(edges: DataFrame, methods: DataFrame, roots: DataFrame, visible_are_roots: bool = True, dispatch_members: bool = False) -> DataFrame:
    """(symbol_id, tier, reason, callers, file_path, line): methods that no root reaches.

    ``edges`` has src and dst, one row per call, ``methods`` symbol_id, name, modifiers, is_override, file_path, line. The
    tier goes by visibility: private high, public or protected low, else medium; reason says whether the method is
    uncalled or called by dead code only, callers counts its calls. Constructors, finalizers, accessors, operators,
    abstract and generated members are never candidates, virtual ones and overrides only with ``dispatch_members``;
    externally visible members are roots unless told otherwise. Of a method delivered more than once its least row counts.
    """
    token = lambda t: F.array_contains(F.split(F.coalesce("modifiers", F.lit("")), " "), t)
    name = F.coalesce("name", F.lit(""))
    skip = name.isin(".ctor", ".cctor", "Finalize") | name.rlike("^(get_|set_|add_|remove_|op_)") | token("abstract") | F.coalesce(docid.is_generated_path("file_path"), F.lit(False))
    if not dispatch_members:
        skip = skip | F.coalesce("is_override", F.lit(False)) | token("virtual")
    starts = roots.select("node")
    if visible_are_roots:
        starts = starts.unionAll(methods.where(token("public") | token("protected")).select(F.col("symbol_id").alias("node")))
    alive = closure.reach(edges, starts.distinct()).select(F.col("node").alias("symbol_id"))
    callers = edges.groupBy(F.col("dst").alias("symbol_id")).agg(F.count(F.lit(1)).alias("callers"))
    least = F.min(F.struct("file_path", "line", "modifiers", "name", "is_override")).alias("m")
    m = methods.groupBy("symbol_id").agg(least).select("symbol_id", "m.*").where(~skip)
    dead = m.join(alive, "symbol_id", "left_anti").join(callers, "symbol_id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    tier = F.when(token("private"), "high").when(token("public") | token("protected"), "low").otherwise("medium")
    reason = F.when(F.col("callers") == 0, "uncalled").otherwise("only reached by dead code")
    return dead.select("symbol_id", tier.alias("tier"), reason.alias("reason"), "callers", "file_path", "line")
