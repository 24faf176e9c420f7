"""Parent-child rows to full hierarchies: cycles, paths, depth, root and Euler-tour intervals.

1. Rows are sorted and numbered, so ids are dense, siblings are neighbours and a tree lies mostly within one
   block of ids.
2. Leaves are peeled, 1, 2, 4, ... layers a round, by squaring the parent function: its image after m steps is
   what m peels leave. When the image no longer shrinks, it is exactly the symbols on cycles.
3. The forest's Euler tours are linked lists over enter(v) = 2 v and exit(v) = 2 v + 1, ranked in parallel:
   every block contracts its stretch of the lists by pointer jumping, the few elements at which a list enters
   a block are ranked by jumping over all blocks, and the blocks add that up. Depth is a second weight on the
   same lists; paths are the same contraction over parent pointers with names as weights.

A block holds ``block_rows`` nodes at most, whatever the trees look like: no task gets a whole tree, and a tree
with a third of all rows is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.runtime import materialize, release, with_dense_id

#: Separates the names of a path: the ASCII unit separator occurs in no symbol id.
PATH_SEPARATOR = "\x1f"


def number_nodes(rows: DataFrame, group: str, node: str, parent: str) -> DataFrame:
    """(id, group, node, parent, parent_id) with dense ids in the order of (group, parent, node).

    ``rows`` has one row per (group, node). parent_id is null where the parent is null or no node of the group.
    """
    cols = [F.col(group).alias("grp"), F.col(node).alias("node"), F.col(parent).alias("parent")]
    nodes = with_dense_id(rows.select(*cols), ["grp", "parent", "node"], "id", "nodes")
    parents = nodes.select("grp", F.col("node").alias("parent"), F.col("id").alias("parent_id"))
    # a parent with a third of all rows as children is a skewed join key; adaptive execution splits it
    linked = materialize(nodes.join(parents, ["grp", "parent"], "left"), "linked")
    release(nodes)
    return linked


def peel(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids on cycles, ids on or below cycles) of the parent function, each one column ``id``."""
    spark = nodes.sparkSession
    none = spark.createDataFrame([], "id long")
    jump = materialize(nodes.where("parent_id is not null").select("id", F.col("parent_id").alias("to")), "jump")
    before = None
    while True:
        left = jump.select("to").distinct().count()
        if left == 0:
            release(jump)
            return none, none
        if left == before:
            return jump.select(F.col("to").alias("id")).distinct(), jump.select("id")
        before = left
        ahead = jump.select(F.col("id").alias("to"), F.col("to").alias("further"))
        squared = materialize(jump.join(ahead, "to").select("id", F.col("further").alias("to")), "jump")
        release(jump)
        jump = squared


def _contract(nxt: np.ndarray, ids: np.ndarray, add: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Follow ``nxt`` (-1 ends) from every element of a block until it leaves the block.

    ids are sorted. Gives where each ends up (-1, or an id outside) and the sums of the weights on the way,
    the element's own included. Weights may be numbers or strings; sums run from the element onwards.
    """
    at = np.searchsorted(ids, nxt)
    at[at == len(ids)] = 0
    inside = (nxt >= 0) & (ids[at] == nxt)
    at = np.where(inside, at, -1)
    out, sums = nxt.copy(), [a.copy() for a in add]
    live = np.flatnonzero(at >= 0)
    while len(live):
        to = at[live]
        step = [s[to] for s in sums]
        further, where = at[to], out[to]
        for s, x in zip(sums, step, strict=True):
            s[live] = s[live] + x
        out[live], at[live] = where, further
        live = live[further >= 0]
    return out, sums


def rank_lists(elements: DataFrame, weights: dict[str, str], block_rows: int, tag: str = "rank") -> DataFrame:
    """Sums along linked structures: for each element, its weights added up to the end of its list.

    ``elements`` has id, nxt (null ends the list; several elements may share a nxt; no cycles) and the columns
    of ``weights`` (name to type: int, long or string; strings are concatenated). Gives id, last (the list's
    last element) and the sums under the same names. Rows of a block of ``block_rows`` ids meet in one task.
    """
    names = list(weights)
    fields = ", ".join(f"{n} {t}" for n, t in weights.items())

    def contract(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id", kind="stable", ignore_index=True)
        ids = block["id"].to_numpy()
        out, sums = _contract(
            block["nxt"].fillna(-1).to_numpy().astype(np.int64),
            ids,
            [ids_weight(block[n], weights[n]) for n in names],
        )
        # the end within the block: the same contraction with the element's own id as the only news of the last
        ends = _ends(block["nxt"].fillna(-1).to_numpy().astype(np.int64), ids)
        return pd.DataFrame({"id": ids, "stop": np.where(out < 0, None, out), "last": ends, **dict(zip(names, sums, strict=True))})

    block = elements.withColumn("__block", F.expr(f"id div {int(block_rows)}"))
    local = materialize(
        block.groupBy("__block").applyInPandas(contract, f"id long, stop long, last long, {fields}"), tag
    )
    hops = local.where("stop is not null")
    entered = hops.select(F.col("stop").alias("id")).distinct()
    # where lists enter a block; in trees that fit a block there are none
    chain = materialize(local.join(entered, "id", "left_semi"), tag)
    while not chain.where("stop is not null").isEmpty():
        ahead = chain.select(
            F.col("id").alias("stop"), F.col("stop").alias("__stop"), F.col("last").alias("__last"),
            *[F.col(n).alias(f"__{n}") for n in names],
        )
        jumped = materialize(_hop(chain, ahead, weights, keep_stop=True), tag)
        release(chain)
        chain = jumped
    ahead = chain.select(F.col("id").alias("stop"), F.lit(None).cast("long").alias("__stop"), F.col("last").alias("__last"), *[F.col(n).alias(f"__{n}") for n in names])
    whole = local.where("stop is null").select("id", "last", *names)
    return whole.unionByName(_hop(hops, ahead, weights, keep_stop=False))


def ids_weight(column: pd.Series, kind: str) -> np.ndarray:
    return column.to_numpy(dtype=object) if kind == "string" else column.to_numpy().astype(np.int64)


def _ends(nxt: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The last element of each element's list within the block, by pointer jumping."""
    at = np.searchsorted(ids, nxt)
    at[at == len(ids)] = 0
    to = np.where((nxt >= 0) & (ids[at] == nxt), at, np.arange(len(ids)))
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return ids[to]
        to = further


def _hop(rows: DataFrame, ahead: DataFrame, weights: dict[str, str], keep_stop: bool) -> DataFrame:
    plus: Callable = lambda n: (
        F.concat(F.col(n), F.coalesce(F.col(f"__{n}"), F.lit("")))
        if weights[n] == "string"
        else (F.col(n) + F.coalesce(F.col(f"__{n}"), F.lit(0))).cast(weights[n])
    )
    joined = rows.join(ahead, "stop", "left")
    return joined.select(
        "id", *([F.col("__stop").alias("stop")] if keep_stop else []),
        F.coalesce("__last", "last").alias("last"), *[plus(n).alias(n) for n in weights],
    )


def euler_elements(forest: DataFrame) -> DataFrame:
    """(id, nxt, pos, level): the Euler tours of the forest (id, parent_id) as linked lists.

    Children follow in the order of their ids, and siblings have neighbouring ids, so the aggregate of first and
    last child per parent is all that is needed: no window over the children of one parent.
    """
    kids = forest.where("parent_id is not null").groupBy("parent_id").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    down = kids.select(F.col("parent_id").alias("id"), "first")
    up = kids.select(F.col("last").alias("id"), F.col("parent_id").alias("up"))
    linked = forest.join(down, "id", "left").join(up, "id", "left")
    enter = F.struct(
        (F.col("id") * 2).alias("id"),
        F.coalesce(F.col("first") * 2, F.col("id") * 2 + 1).alias("nxt"),
        F.lit(1).cast("long").alias("pos"),
        F.lit(1).cast("long").alias("level"),
    )
    leave = F.struct(
        (F.col("id") * 2 + 1).alias("id"),
        F.when(F.col("parent_id").isNull(), None).otherwise(F.coalesce(F.col("up") * 2 + 1, (F.col("id") + 1) * 2)).alias("nxt"),
        F.lit(1).cast("long").alias("pos"),
        F.lit(-1).cast("long").alias("level"),
    )
    return linked.select(F.explode(F.array(enter, leave)).alias("e")).select("e.*")


def hierarchies(rows: DataFrame, group: str, node: str, parent: str, block_rows: int = 50_000) -> DataFrame:
    """One row per (group, node): group, node, parent, status, root, depth, path, entry, exit, n_below.

    status is ``tree``, ``cycle`` (on a circle of parents, a node that is its own parent included) or
    ``below_cycle``; the latter two have null root, depth, path and interval. A null parent, and a parent that is
    no node of the group, make a root of depth 0; path joins the nodes from the root down with PATH_SEPARATOR.
    a is an ancestor of b exactly if both have the same group and root and a.entry < b.entry and b.exit < a.exit;
    positions count from the tour's end and are negative. n_below is the number of descendants.

    ``rows`` must have one row per (group, node), neither null. Siblings come in the order of their ids. An empty
    table gives no rows; other columns of ``rows`` are ignored.
    """
    nodes = number_nodes(rows, group, node, parent)
    on_cycle, lost = peel(nodes)
    marked = materialize(
        nodes.join(on_cycle.withColumn("__on", F.lit(True)), "id", "left")
        .join(lost.withColumn("__lost", F.lit(True)), "id", "left")
        .withColumn("status", F.expr("case when __on then 'cycle' when __lost then 'below_cycle' else 'tree' end"))
        .drop("__on", "__lost"),
        "marked",
    )
    release(nodes)
    forest = marked.where("status = 'tree'")
    tour = rank_lists(euler_elements(forest.select("id", "parent_id")), {"pos": "long", "level": "long"}, 2 * block_rows, "tour")
    spans = (
        tour.withColumn("node_id", F.expr("id div 2"))
        .groupBy("node_id")
        .agg(
            F.max(F.when(F.col("id") % 2 == 0, -F.col("pos"))).alias("entry"),
            F.max(F.when(F.col("id") % 2 == 1, -F.col("pos"))).alias("exit"),
            F.max(F.when(F.col("id") % 2 == 0, -F.col("level"))).cast("int").alias("depth"),
        )
        .withColumnRenamed("node_id", "id")
    )
    # upwards: each element adds its name; the names come out from the node to the root
    up = forest.select("id", F.col("parent_id").alias("nxt"), F.concat(F.col("node"), F.lit(PATH_SEPARATOR)).alias("names"))
    paths = rank_lists(up, {"names": "string"}, block_rows, "paths").select("id", "names")
    names = F.reverse(F.split(F.expr(f"left(names, length(names) - 1)"), PATH_SEPARATOR))
    placed = spans.join(paths, "id").withColumn("__names", names)
    return (
        marked.join(placed, "id", "left")
        .select(
            F.col("grp").alias(group),
            F.col("node").alias(node),
            F.col("parent").alias(parent),
            "status",
            F.col("__names")[0].alias("root"),
            "depth",
            F.array_join("__names", PATH_SEPARATOR).alias("path"),
            "entry",
            "exit",
            F.expr("(exit - entry - 1) div 2").alias("n_below"),
        )
    )


def cyclic_nodes(rows: DataFrame, group: str, node: str, parent: str) -> DataFrame:
    """(group, node) of the nodes on circles: numbering and peeling alone."""
    nodes = number_nodes(rows, group, node, parent)
    on_cycle, _ = peel(nodes)
    return nodes.join(on_cycle, "id", "left_semi").select(F.col("grp").alias(group), F.col("node").alias(node))


def below(tree: DataFrame, group: str, node: str) -> DataFrame:
    """(group, node, below, distance): every symbol below every symbol, from the paths of ``hierarchies``.

    The result has as many rows as the depths add up to; nodes on or below a cycle are left out.
    """
    names = tree.where("status = 'tree' and depth > 0").select(
        F.col(group), F.col(node).alias("below"), "depth", F.posexplode(F.split("path", PATH_SEPARATOR)).alias("__at", node)
    )
    return names.where(F.col("__at") < F.col("depth")).select(group, node, "below", (F.col("depth") - F.col("__at")).alias("distance"))


def symbol_parents(symbols: DataFrame) -> DataFrame:
    """(run_id, symbol_id, containing_symbol_id) of each symbol's record in each run; '' is no parent."""
    return (
        symbols.where("run_id is not null and symbol_id is not null")
        .groupBy("run_id", "symbol_id")
        .agg(F.max(F.struct("fact_index", F.nullif("containing_symbol_id", F.lit("")).alias("p"))).alias("r"))
        .select("run_id", "symbol_id", F.col("r.p").alias("containing_symbol_id"))
    )
