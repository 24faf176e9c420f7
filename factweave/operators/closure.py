"""Transitive closure, shortest depth, paths and strongly connected components over edge tables.

All loops are semi-naive: each round joins only what the last one found with the edges, and a round's result is a
written table. A graph of measured, bounded size is searched in memory instead, with the same result. Edges have the
columns src and dst.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.runtime import Appended, materialize, release, shuffle_partitions, with_dense_id


def edge_list(edges: DataFrame, src: str = "from_sym", dst: str = "to_sym") -> DataFrame:
    """Distinct (src, dst) without nulls."""
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): what the seeds (node) reach, themselves at depth 0, with the least number of edges.

    Cycles are safe; seeds that occur in no edge reach themselves. No seeds, no rows. max_depth None is unbounded.
    A graph within the bounds of ``LocalGraph`` is searched by the driver, where a round costs no job; so are at most
    as many seeds.
    """
    links = materialize(_links(edges), "edges")
    starts = seeds.select("node").where("node is not null").distinct()
    graph = LocalGraph.of(links)
    found = starts.limit(MOST_EDGES + 1).toArrow() if graph else None
    if graph is None or found.num_rows > MOST_EDGES:
        return _levels(links, starts, [], max_depth)
    release(links)
    names = found.column("node").combine_chunks()
    ids = graph.ids(names)
    at, depth = graph.search(np.unique(ids[ids >= 0]), max_depth)
    lone = names.filter(pa.array(ids < 0))
    node = pa.concat_arrays([graph.names.take(pa.array(at)), lone])
    table = pa.table({"node": node, "depth": pa.array(np.r_[depth, np.zeros(len(lone))].astype(np.int32))})
    return edges.sparkSession.createDataFrame(table)


def reach_each(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth): the reach of every seed by itself; ``seeds`` has seed and node, its starting points.

    A graph within the bounds of ``LocalGraph`` goes to every executor, and seeds are searched one by one without any
    shuffle but that of the seeds; else all are followed in one loop of joins.
    """
    links = materialize(_links(edges), "edges")
    starts = seeds.select("seed", "node").where("node is not null").distinct()
    graph = LocalGraph.of(links)
    if graph is None:
        return _levels(links, starts, ["seed"], max_depth)
    release(links)
    shared = edges.sparkSession.sparkContext.broadcast(graph)
    kind = starts.schema["seed"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, seed, held = shared.value, None, []

        def done() -> pa.RecordBatch:
            names = pa.array(held, pa.string())
            ids = g.ids(names)
            at, depth = g.search(np.unique(ids[ids >= 0]), max_depth)
            lone = names.filter(pa.array(ids < 0))
            node = pa.concat_arrays([g.names.take(pa.array(at)), lone])
            of = pa.array([seed], key.type).take(pa.array(np.zeros(len(node), np.int64)))
            return pa.RecordBatch.from_arrays([of, node, pa.array(np.r_[depth, np.zeros(len(lone))].astype(np.int32))], ["seed", "node", "depth"])

        first = True
        for b in batches:
            key = b.column(0)
            for x, node in zip(key.to_pylist(), b.column(1).to_pylist(), strict=True):
                if not first and x != seed:
                    yield done()
                    held = []
                seed, first = x, False
                held.append(node)
        if not first:
            yield done()

    # a seed costs a search, not bytes: as many tasks as pay off, whatever their size
    tasks = max(shuffle_partitions(edges.sparkSession), 2 * edges.sparkSession.sparkContext.defaultParallelism)
    found = starts.repartition(tasks, "seed").sortWithinPartitions("seed").mapInArrow(run, f"seed {kind}, node string, depth int")
    return materialize(found, "reach")  # callers join it with itself and others


def _links(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


#: Edges and bytes of names up to which a graph is held in one process: what a task or the driver gets at most.
MOST_EDGES, MOST_BYTES = 2_000_000, 256 << 20


@dataclass
class LocalGraph:
    """A graph as arrays: names in order, and for each node where its successors lie."""

    names: pa.Array
    first: np.ndarray
    next: np.ndarray

    @classmethod
    def of(cls, links: DataFrame) -> LocalGraph | None:
        """The graph of distinct (src, dst) if it is within MOST_EDGES and MOST_BYTES, which is measured first."""
        size = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("src") + F.octet_length("dst")).alias("b")).first()
        if size.n > MOST_EDGES or (size.b or 0) > MOST_BYTES:
            return None
        t = links.toArrow()
        src, dst = (t.column(c).combine_chunks().cast(pa.string()) for c in ("src", "dst"))
        names = pc.unique(pa.concat_arrays([src, dst]))
        names = names.take(pc.sort_indices(names))
        a, b = (pc.index_in(x, names).to_numpy(zero_copy_only=False).astype(np.int64) for x in (src, dst))
        order = np.argsort(a, kind="stable")
        return cls(names, np.r_[0, np.cumsum(np.bincount(a, minlength=len(names)))], b[order].astype(np.int32))

    def ids(self, names: pa.Array) -> np.ndarray:
        """The number of each name; -1 for names that are no node."""
        return pc.fill_null(pc.index_in(names.cast(pa.string()), self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def search(self, starts: np.ndarray, max_depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(node, depth) by breadth from the starts."""
        seen = np.zeros(len(self.names), dtype=bool)
        seen[starts] = True
        level, found, depth = starts, [starts], [np.zeros(len(starts), np.int32)]
        while len(level) and (max_depth is None or len(found) <= max_depth):
            begin, n = self.first[level], self.first[level + 1] - self.first[level]
            total = int(n.sum())
            at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(total)
            new = self.next[at]
            level = np.unique(new[~seen[new]]).astype(np.int64)
            seen[level] = True
            if len(level):
                found.append(level)
                depth.append(np.full(len(level), len(depth), np.int32))
        return np.concatenate(found).astype(np.int64), np.concatenate(depth)

    def path(self, starts: np.ndarray, targets: np.ndarray, max_depth: int | None = None) -> list[int]:
        """A shortest path of at least one edge, the least target and the least parents winning; empty without one."""
        wanted = np.zeros(len(self.names), dtype=bool)
        wanted[targets] = True
        parent = np.full(len(self.names), -1, dtype=np.int64)
        seen = np.zeros(len(self.names), dtype=bool)
        seen[starts] = True
        level, steps = np.unique(starts), 0
        while len(level) and (max_depth is None or steps < max_depth):
            steps += 1
            begin, n = self.first[level], self.first[level + 1] - self.first[level]
            new = self.next[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].astype(np.int64)
            new, at = np.unique(new, return_index=True)  # the first to come is the least parent: levels are in order
            by = np.repeat(level, n)[at]
            if (hit := np.flatnonzero(wanted[new])).size:
                out, v = [int(new[hit[0]])], int(by[hit[0]])
                for _ in range(steps):
                    out.append(v)
                    v = int(parent[v])
                return out[::-1]
            fresh = ~seen[new]
            parent[new[fresh]] = by[fresh]
            seen[new] = True
            level = new[fresh]
        return []

    def components(self) -> np.ndarray:
        """For each node the least node of its strongly connected component (nodes are in order of their names)."""
        n = len(self.names)
        first, nxt = self.first.tolist(), self.next.tolist()
        low, order, on, out = [0] * n, [0] * n, bytearray(n), list(range(n))
        stack, count = [], 0
        for root in range(n):
            if order[root]:
                continue
            work = [(root, first[root])]
            count += 1
            order[root] = low[root] = count
            stack.append(root)
            on[root] = 1
            while work:
                v, i = work.pop()
                if i < first[v + 1]:
                    work.append((v, i + 1))
                    w = nxt[i]
                    if not order[w]:
                        count += 1
                        order[w] = low[w] = count
                        stack.append(w)
                        on[w] = 1
                        work.append((w, first[w]))
                    elif on[w]:
                        low[v] = min(low[v], order[w])
                    continue
                if work:
                    u = work[-1][0]
                    low[u] = min(low[u], low[v])
                if low[v] == order[v]:
                    at = len(stack) - 1
                    while stack[at] != v:
                        at -= 1
                    members = stack[at:]
                    del stack[at:]
                    least = min(members)
                    for m in members:
                        out[m], on[m] = least, 0
        return np.array(out, dtype=np.int64)


def _levels(links: DataFrame, seeds: DataFrame, keys: list[str], max_depth: int | None) -> DataFrame:
    """The search as joins: a level joins only what the last one found, and is a partition of one table that all levels
    before are read from as one scan."""
    spark = links.sparkSession
    table = Appended(spark, "levels", seeds.schema, "depth")
    more = table.add(seeds, 0)
    depth = 0
    while more and (max_depth is None or depth < max_depth):
        last = table.read().where(F.col("depth") == depth)
        new = last.join(links, F.col("node") == F.col("src")).select(*keys, F.col("dst").alias("node")).distinct()
        # a null seed is a seed as well, so keys are compared null-safe
        same = (F.col("n.node") == F.col("t.node")) if not keys else (F.col("n.node") == F.col("t.node")) & F.col("n.seed").eqNullSafe(F.col("t.seed"))
        more = table.add(new.alias("n").join(table.read().alias("t"), same, "left_anti"), depth + 1)
        depth += 1
    release(links)
    return table.read().select(*keys, "node", "depth")


def groups_reaching(edges: DataFrame, groups: DataFrame, targets: DataFrame) -> DataFrame:
    """(seed, reaches): for each group of starting points (seed, node), whether it reaches one of the targets (node)."""
    hit = reach_each(edges, groups).join(targets.select("node").distinct(), "node", "left_semi").select("seed").distinct().withColumn("hit", F.lit(True))
    return groups.select("seed").distinct().join(hit, "seed", "left").select("seed", F.coalesce("hit", F.lit(False)).alias("reaches"))


def shortest_path(edges: DataFrame, starts: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(step, node): a shortest path from a start to a target (node), of at least one edge; no rows without one.

    Of several, parents least by name win, going back from the least target. The walk back reads one row a step.
    """
    spark = edges.sparkSession
    links = materialize(edges.select("src", "dst").distinct(), "edges")
    wanted = targets.select("node").distinct()
    if (graph := LocalGraph.of(links)) is not None:
        ends = [wanted.limit(MOST_EDGES + 1).toArrow(), starts.select("node").distinct().limit(MOST_EDGES + 1).toArrow()]
        if max(t.num_rows for t in ends) <= MOST_EDGES:
            release(links)
            to, at = (graph.ids(t.column("node").combine_chunks()) for t in ends)
            names = graph.names.take(pa.array(graph.path(at[at >= 0], to[to >= 0], max_depth), pa.int64())).to_pylist()
            return spark.createDataFrame(list(enumerate(names)), "step int, node string")
    level = materialize(starts.select("node").distinct().withColumn("parent", F.lit(None).cast("string")), "path")
    levels = [level]
    for _ in itertools.count() if max_depth is None else range(max_depth):
        new = levels[-1].select(F.col("node").alias("src")).join(links, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        arrived = new.join(wanted, "node", "left_semi").orderBy("node").limit(1).collect()
        if arrived:
            path, at = [arrived[0].node, arrived[0].parent], arrived[0].parent
            for back in levels[:0:-1]:
                at = back.where(F.col("node") == at).select("parent").first()[0]
                path.append(at)
            return spark.createDataFrame(list(enumerate(reversed(path))), "step int, node string")
        seen = reduce(DataFrame.unionAll, [x.select("node") for x in levels])
        found = materialize(new.join(seen, "node", "left_anti"), "path")
        if found.isEmpty():
            break
        levels.append(found)
    return spark.createDataFrame([], "step int, node string")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the strongly connected component of every node of the edges, named by its least node.

    Nodes that can lie on no cycle are peeled off; the rest is coloured with the least label that reaches each node;
    what goes back to a colour's source within the colour is its component; and so on with what is left.
    """
    links = materialize(_links(edges), "scc")
    graph = LocalGraph.of(links)
    if graph is not None:
        release(links)
        least = graph.names.take(pa.array(graph.components()))
        return edges.sparkSession.createDataFrame(pa.table({"node": graph.names, "component": least}))
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    done: list[DataFrame] = []
    core = links
    while True:
        core = _peel(core)
        if core.isEmpty():
            break
        colour = _least_label(core)
        same = (
            core.join(colour.select(F.col("node").alias("src"), F.col("label").alias("ls")), "src")
            .join(colour.select(F.col("node").alias("dst"), F.col("label").alias("ld")), "dst")
            .where("ls = ld")
            .select("src", "dst")
        )
        sources = colour.where("node = label").select("node")
        back = reach_each(reverse(same), sources.select(F.col("node").alias("seed"), "node"))
        found = materialize(back.select("node", F.col("seed").alias("component")).distinct(), "component")
        done.append(found)
        gone = found.select("node")
        rest = core.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        smaller = materialize(rest.select("src", "dst"), "scc")
        core = smaller
    if not done:
        return nodes.select("node", F.col("node").alias("component"))
    named = reduce(DataFrame.unionAll, done)
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _peel(links: DataFrame) -> DataFrame:
    before = links.count()
    while True:
        kept = links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(
            links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"
        )
        links = materialize(kept.select("src", "dst"), "scc")
        after = links.count()
        if after in (before, 0):
            return links
        before = after


def _least_label(links: DataFrame) -> DataFrame:
    """(node, label): the least node that reaches each node, itself included."""
    label = materialize(links.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("label", F.col("node")), "label")
    news = label
    while True:
        offered = news.join(links, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("offer"))
        better = materialize(offered.join(label, "node").where("offer < label").select("node", F.col("offer").alias("label")), "label")
        if better.isEmpty():
            return label
        label = materialize(
            label.join(better.select("node", F.col("label").alias("new")), "node", "left").select("node", F.coalesce("new", "label").alias("label")), "label"
        )
        news = better


def reach_with_payload(edges: DataFrame, seeds: DataFrame, max_depth: int | None = 20, max_nodes: int | None = None) -> DataFrame:
    """Reach in breadth-first order with what was met on the way.

    ``edges`` has from_sym, to_sym, kind, line, receiver_type, loop_kind, loop_detail, handoff_dispatcher and, for
    dispatch edges, basis and degree (null for real calls). Gives node, depth, loop_nesting, nearest_loop_kind,
    nearest_loop_detail, dispatch_via, dispatch_degree, handoff_via, heuristic and parent. Per hop: depth and, in a
    loop, loop_nesting grow by one; the nearest loop, the dispatch (only of a fan above one) and the handoff are the
    edge's, else inherited; heuristic sticks. The first arrival at a node wins: by the parent's place in the order,
    real calls before dispatch, then line, callee, kind and receiver. Every level is numbered by a distributed sort.
    Levels stop being added when ``max_nodes`` are reached; max_depth None is unbounded.
    """
    e = materialize(edges.select("from_sym", "to_sym", "kind", "line", "receiver_type", "loop_kind", "loop_detail", "handoff_dispatcher", "basis", "degree").distinct(), "payload")
    start = seeds.select("node").distinct().select(
        "node", F.lit(0).alias("depth"), F.lit(0).alias("loop_nesting"), *[F.lit(None).cast("string").alias(c) for c in ("nearest_loop_kind", "nearest_loop_detail", "dispatch_via")],
        F.lit(None).cast("int").alias("dispatch_degree"), F.lit(None).cast("string").alias("handoff_via"), F.lit(False).alias("heuristic"), F.lit(None).cast("string").alias("parent"),
    )
    level = with_dense_id(start, ["node"], "rank", "payload")
    levels, total = [level], level.count()
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        if max_nodes is not None and total >= max_nodes:
            break
        p = levels[-1]
        fan = F.col("degree") > 1
        looped = F.col("loop_kind").isNotNull()
        cand = p.join(e, p.node == e.from_sym).select(
            F.col("to_sym").alias("node"),
            F.struct(
                F.col("rank"), F.col("basis").isNotNull().alias("dispatched"), F.col("line"), F.col("kind"), F.coalesce("receiver_type", F.lit("")).alias("receiver"),
                F.lit(depth).alias("depth"),
                (F.col("loop_nesting") + looped.cast("int")).alias("loop_nesting"),
                F.when(looped, F.col("loop_kind")).otherwise(F.col("nearest_loop_kind")).alias("nearest_loop_kind"),
                F.when(looped, F.col("loop_detail")).otherwise(F.col("nearest_loop_detail")).alias("nearest_loop_detail"),
                F.when(fan, F.col("from_sym")).otherwise(F.col("dispatch_via")).alias("dispatch_via"),
                F.when(fan, F.col("degree")).otherwise(F.col("dispatch_degree")).alias("dispatch_degree"),
                F.coalesce("handoff_dispatcher", "handoff_via").alias("handoff_via"),
                (F.col("heuristic") | F.coalesce(F.col("basis") == "heuristic", F.lit(False))).alias("heuristic"),
                F.col("from_sym").alias("parent"),
            ).alias("c"),
        )
        best = cand.groupBy("node").agg(F.min("c").alias("c"))
        seen = reduce(DataFrame.unionAll, [x.select("node") for x in levels])
        new = best.join(seen, "node", "left_anti")
        order = [F.col("c.rank"), F.col("c.dispatched"), F.col("c.line"), F.col("node")]
        ranked = with_dense_id(new.select("node", "c", *[o.alias(f"__o{i}") for i, o in enumerate(order)]), ["__o0", "__o1", "__o2", "__o3"], "place", "payload")
        found = ranked.select(
            "node", "c.depth", "c.loop_nesting", "c.nearest_loop_kind", "c.nearest_loop_detail", "c.dispatch_via", "c.dispatch_degree", "c.handoff_via", "c.heuristic", "c.parent",
            F.col("place").alias("rank"),
        )
        n = found.count()
        if n == 0:
            break
        levels.append(found)
        total += n
    return reduce(DataFrame.unionByName, levels).drop("rank")
