"""Generic code: which concrete types generic methods run with, and the call graph per instance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators import closure
from factweave.runtime import materialize, with_dense_id

#: Instances per method from which all of that method's are dropped, and in all.
PER_METHOD, IN_ALL = 50, 100_000
#: How an instance's node is named: base, this, the bindings, the end.
OPEN, CLOSE = "~mono⟨", "⟩"
#: Numbered edges, and bytes of bindings' bits, up to which the driver searches collapsed instances by itself.
MOST_LINKS, MOST_BITS = 1 << 24, 256 << 20


def decode_binding(column: str) -> Column:
    """array<struct<kind, value>> of a JSON list of tokens: C:type is concrete, T:n and M:n are the n-th argument of the
    caller's type or method, '?' is unknown. Null and malformed text give null."""
    tokens = F.from_json(F.col(column), "array<string>")
    return F.transform(tokens, lambda t: F.struct(F.substring_index(t, ":", 1).alias("kind"), F.when(t.contains(":"), F.substring(t, F.instr(t, ":") + 1, F.length(t))).alias("value")))


def resolve(tokens: Column, carried: Column) -> Column:
    """Type names of tokens, the forwarded ones taken from the caller's carried names; null if any stays open."""
    named = F.transform(tokens, lambda t: F.when(t["kind"] == "C", t["value"]).when(t["kind"].isin("M", "T"), F.get(carried, t["value"].try_cast("int"))))
    return F.when(~F.exists(named, lambda x: x.isNull()), named)


def instances(edges: DataFrame, per_method: int | None = PER_METHOD, in_all: int | None = IN_ALL) -> DataFrame:
    """(method, binding): the concrete bindings (array<string>) that reach each generic method, to a fixed point.

    ``edges`` has from_sym, to_sym and binding (JSON tokens; null for calls of methods that aren't generic). Concrete
    calls start; a method's instances pass their types on to the calls it forwards them to. A method with more than
    ``per_method`` instances loses all of them and passes none on. More than ``in_all`` in all is an error. Either is
    None for no such cap: the loop ends by itself, when no round finds a new instance.
    """
    e = materialize(edges.where("binding is not null").select("from_sym", "to_sym", decode_binding("binding").alias("tokens")).where("size(tokens) > 0").distinct(), "bindings")
    none = F.array().cast("array<string>")
    found = materialize(e.select(F.col("to_sym").alias("method"), resolve(F.col("tokens"), none).alias("binding")).where("binding is not null").distinct(), "instances")
    news = found
    while True:
        if in_all is not None and found.count() > in_all:
            raise ValueError(f"more than {in_all} instances")
        passed = _under(news, found, per_method).join(e, F.col("method") == F.col("from_sym")).select(F.col("to_sym").alias("m"), resolve(F.col("tokens"), F.col("binding")).alias("b"))
        fresh = passed.where("b is not null").select(F.col("m").alias("method"), F.col("b").alias("binding")).distinct()
        new = materialize(fresh.join(found, ["method", "binding"], "left_anti"), "instances")
        if new.isEmpty():
            break
        found, news = materialize(found.unionAll(new), "instances"), new
    return _under(found, found, per_method)


def _under(rows: DataFrame, found: DataFrame, per_method: int | None) -> DataFrame:
    """Rows of the methods that have at most ``per_method`` instances among those found; all rows without such a cap."""
    if per_method is None:
        return rows
    counts = found.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(counts.where(F.col("n") <= per_method).select("method"), "method", "left_semi")


def instance_node(method: str | Column, binding: str | Column) -> Column:
    m, b = (F.col(x) if isinstance(x, str) else x for x in (method, binding))
    return F.concat(m, F.lit(OPEN), F.array_join(b, ";"), F.lit(CLOSE))


def monomorphize(edges: DataFrame, inventory: DataFrame) -> DataFrame:
    """Edges with a copy of each generic method's outgoing edges per instance; columns as in ``edges``.

    A copied call goes to the callee's instance where its binding resolves to one in the inventory, else to the callee.
    A call with a wholly concrete binding goes to the instance. The generic methods' own edges stay.
    """
    cols = edges.columns
    known = inventory.select(F.col("method").alias("__m"), F.col("binding").alias("__b")).distinct().withColumn("__hit", F.lit(True))
    tokens = decode_binding("binding")

    def sent(df: DataFrame, carried: Column) -> DataFrame:
        r = df.withColumn("__bound", F.when(F.size(tokens) > 0, resolve(tokens, carried)))
        j = r.join(known, (F.col("to_sym") == F.col("__m")) & (F.col("__bound") == F.col("__b")), "left")
        return j.withColumn("to_sym", F.when(F.col("__hit"), instance_node("to_sym", "__bound")).otherwise(F.col("to_sym")))

    plain = sent(edges, F.array().cast("array<string>")).select(*cols)
    owner = F.coalesce(F.when(F.col("from_sym").contains("~λ"), F.substring_index("from_sym", "~λ", 1)), F.col("from_sym"))
    copies = edges.withColumn("__owner", owner).join(inventory.select(F.col("method").alias("__owner"), F.col("binding").alias("__carried")), "__owner")
    copied = sent(copies, F.col("__carried")).withColumn("from_sym", instance_node("from_sym", "__carried")).select(*cols)
    return plain.unionAll(copied).distinct()


def collapse(reached: DataFrame) -> DataFrame:
    """(node, depth) with instances folded onto their methods, the least depth of each."""
    base = F.regexp_replace("node", f"{OPEN}.*?{CLOSE}", "")
    return reached.groupBy(base.alias("node")).agg(F.min("depth").alias("depth"))


def collapsed_reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth): ``collapse`` of what the seeds (node) reach over all monomorphized edges, without making them.

    An instance's edges are copies of its method's, so it goes wherever its method goes, but for a lambda's instance,
    which has edges only if its outer method has the same binding. Bindings are therefore followed as sets of bits, and
    only where lambdas lie ahead; bindings that the same outer methods have are one bit. That holds for bindings of one
    token; others, and graphs beyond MOST_LINKS or MOST_BITS, are monomorphized and searched as edges.
    """
    e = edges.where("from_sym is not null and to_sym is not null").select("from_sym", "to_sym", decode_binding("binding").alias("tokens"))
    token = F.when(F.size("tokens") > 0, F.element_at("tokens", 1))
    forwards = token["kind"].isin("M", "T") & (token["value"].try_cast("int") == 0)
    links = materialize(e.select("from_sym", "to_sym", F.when(token["kind"] == "C", token["value"]).alias("bound"), F.coalesce(forwards, F.lit(False)).alias("forwards"), F.coalesce(F.size("tokens") > 1, F.lit(False)).alias("more")).distinct(), "links")
    named = F.max((F.col("more") | F.col("from_sym").contains(OPEN) | F.col("to_sym").contains(OPEN)).cast("int"))
    size = links.agg(F.count(F.lit(1)).alias("n"), F.coalesce(named, F.lit(0)).alias("other")).first()
    depth = None
    if size.n <= MOST_LINKS and not size.other:
        starts = seeds.select("node").where("node is not null").distinct()
        nodes = with_dense_id(links.select(F.explode(F.array("from_sym", "to_sym")).alias("node")).unionAll(starts).distinct(), ["node"], "id", "nodes")
        bounds = with_dense_id(links.select("bound").where("bound is not null").distinct(), ["bound"], "token", "bounds")
        of = lambda df, c, name: df.join(nodes.select(F.col("node").alias(c), F.col("id").cast("int").alias(name)), c)
        kind = F.coalesce(F.col("token").cast("int"), F.when(F.col("forwards"), FORWARDS).otherwise(PLAIN))
        t = of(of(links.join(bounds, "bound", "left"), "from_sym", "src"), "to_sym", "dst").select("src", "dst", kind.alias("token")).toArrow()
        inner = nodes.where(F.col("node").contains("~λ")).select(F.substring_index("node", "~λ", 1).alias("outer"), F.col("id").alias("inner"))
        own = inner.join(nodes.select(F.col("node").alias("outer"), F.col("id").alias("at")), "outer", "left").select("inner", F.coalesce("at", F.lit(NOWHERE)).alias("at")).toArrow()
        column = lambda table, c: table.column(c).to_numpy().astype(np.int64)
        outer = np.full(nodes.count(), PLAIN, dtype=np.int64)
        outer[column(own, "inner")] = column(own, "at")
        depth = _collapsed(outer, column(t, "src"), column(t, "dst"), column(t, "token"), column(of(starts, "node", "id").select("id").toArrow(), "id"))
    if depth is None:
        return collapse(closure.reach(closure.edge_list(monomorphize(edges, instances(edges, None, None))), seeds))
    at = np.flatnonzero(depth >= 0)
    found = edges.sparkSession.createDataFrame(pa.table({"id": pa.array(at), "depth": pa.array(depth[at].astype(np.int32))}))
    return nodes.join(found, "id").select("node", "depth")


# Among tokens: a call without a binding, and one that hands on the caller's. Among outer methods: no lambda, and a
# lambda of which none is a node.
PLAIN, FORWARDS, NOWHERE = -1, -2, -3


class _Out:
    """Edges by their source."""

    def __init__(self, n: int, src: np.ndarray, *to: np.ndarray) -> None:
        order = np.argsort(src, kind="stable")
        self.src, self.to = src[order], [x[order] for x in to]
        self.first = np.r_[0, np.cumsum(np.bincount(src, minlength=n))]

    def of(self, nodes: np.ndarray) -> list[np.ndarray]:
        """Sources and the other columns of the nodes' edges."""
        begin, n = self.first[nodes], self.first[nodes + 1] - self.first[nodes]
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return [self.src[at], *[x[at] for x in self.to]]


def _handed(bits: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct targets and what their sources' rows hold in all."""
    order = np.argsort(dst, kind="stable")
    to, start = np.unique(dst[order], return_index=True)
    return to, np.bitwise_or.reduceat(bits[src[order]], start, axis=0) if len(to) else np.zeros((0, bits.shape[1]), np.uint64)


def _ahead(n: int, src: np.ndarray, dst: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Which nodes lead to a target, the targets themselves among them."""
    back, seen, level = _Out(n, dst, src), np.zeros(n, dtype=bool), np.unique(targets)
    while len(level):
        seen[level] = True
        level = np.unique(back.of(level)[1])
        level = level[~seen[level]]
    return seen


def _alive(n: int, outers: np.ndarray, bound: tuple, forward: tuple, words: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(class of each token, bits of its outers by class): tokens are a class if the same ``outers`` have them as an
    instance. Tokens are independent of each other, so so many words of them at a time are followed to the end."""
    dst, token = bound
    tokens = int(token.max()) + 1 if len(token) else 0
    near = _ahead(n, *forward, outers)
    at = np.cumsum(near) - 1
    keep = near[forward[0]] & near[forward[1]]
    out = _Out(int(near.sum()), at[forward[0][keep]], at[forward[1][keep]])
    classes: dict[bytes, int] = {}
    of = np.zeros(tokens, dtype=np.int64)
    for low in range(0, tokens, 64 * words):
        here = (token >= low) & (token < low + 64 * words) & near[dst]
        bits = np.zeros((int(near.sum()), words), dtype=np.uint64)
        t = token[here] - low
        np.bitwise_or.at(bits, (at[dst[here]], t >> 6), np.uint64(1) << (t & 63).astype(np.uint64))
        new, changed = bits.copy(), np.flatnonzero(bits.any(axis=1))
        while len(changed):
            to, got = _handed(new, *out.of(changed))
            got &= ~bits[to]
            new[changed] = 0
            some = got.any(axis=1)
            changed = to[some]
            new[changed] = got[some]
            bits[changed] |= got[some]
        held = np.unpackbits(bits[at[outers]].view(np.uint8), axis=1, bitorder="little")
        for i, key in enumerate(np.packbits(held.T, axis=1)[: tokens - low]):
            of[low + i] = classes.setdefault(key.tobytes(), len(classes))
    rows = np.array([np.frombuffer(k, np.uint8) for k in classes], dtype=np.uint8).reshape(len(classes), -(-len(outers) // 8))
    by_outer = np.packbits(np.unpackbits(rows, axis=1, count=len(outers)).T, axis=1, bitorder="little")
    padded = np.zeros((len(outers), 8 * max(1, -(-len(classes) // 64))), dtype=np.uint8)
    padded[:, : by_outer.shape[1]] = by_outer
    return of, padded.view(np.uint64)


def _collapsed(outer: np.ndarray, src: np.ndarray, dst: np.ndarray, token: np.ndarray, seeds: np.ndarray) -> np.ndarray | None:
    """The least depth of every node in any state, -1 for those not reached; None if the bits would pass MOST_BITS."""
    n = len(outer)
    plain, bound, forward = ((src[k], dst[k], token[k]) for k in (token == PLAIN, token >= 0, token == FORWARDS))
    generic, leaves = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    generic[bound[1]] = generic[forward[1]] = leaves[src] = True
    lambdas = np.flatnonzero((outer != PLAIN) & generic & leaves)
    outers = np.unique(outer[lambdas][outer[lambdas] >= 0])
    kind, alive = _alive(n, outers, bound[1:], forward[:2])
    words = alive.shape[1]
    followed = _ahead(n, *forward[:2], lambdas) & generic
    row = np.where(followed, np.cumsum(followed) - 1, -1)
    rows = np.flatnonzero(followed)
    if 8 * words * (3 * len(rows) + len(lambdas)) > MOST_BITS:
        return None
    # what a row passes on: all, or, for a lambda, what its outer method has too
    has = outer[lambdas] >= 0
    mask = np.zeros((len(lambdas), words), dtype=np.uint64)
    mask[has] = alive[np.searchsorted(outers, outer[lambdas][has])]
    masked = np.full(len(rows), -1)
    masked[row[lambdas]] = np.arange(len(lambdas))
    by_plain, by_bound, by_forward = _Out(n, *plain[:2]), _Out(n, bound[0], bound[1], kind[bound[2]]), _Out(n, *forward[:2])
    depth = np.full(n, -1)
    asked, instance, live = (np.zeros(n, dtype=bool) for _ in range(3))
    seen, news = np.zeros((len(rows), words), np.uint64), np.zeros((len(rows), words), np.uint64)
    # of a level: nodes as they are, instances of no followed node, rows with new bits
    new_plain, new_instance, changed = np.unique(seeds), np.empty(0, np.int64), np.empty(0, np.int64)
    level = 0
    while len(new_plain) or len(new_instance) or len(changed):
        for x in (new_plain, new_instance, rows[changed]):
            depth[x[depth[x] < 0]] = level
        level += 1
        asked[new_plain] = instance[new_instance] = True
        cut = changed[masked[changed] >= 0]
        news[cut] &= mask[masked[cut]]
        changed = changed[news[changed].any(axis=1)]
        lively = np.unique(np.r_[new_plain, new_instance, rows[changed]])
        lively = lively[~live[lively]]
        live[lively] = True
        _, to, c = by_bound.of(lively)
        here = row[to] >= 0
        _, plainly = by_plain.of(lively)
        by, handed = by_forward.of(rows[changed])
        on = row[handed] >= 0
        targets, got = _handed(news, row[by[on]], row[handed[on]])
        arrived = np.zeros_like(seen)
        arrived[targets] = got
        np.bitwise_or.at(arrived, (row[to[here]], c[here] >> 6), np.uint64(1) << (c[here] & 63).astype(np.uint64))
        news = arrived & ~seen
        seen |= news
        instances_ = np.r_[to[~here], handed[~on], by_forward.of(new_instance)[1]]
        new_plain = np.unique(np.r_[plainly, by_forward.of(new_plain)[1]])
        new_plain = new_plain[~asked[new_plain]]
        new_instance = np.unique(instances_[~instance[instances_]])
        changed = np.flatnonzero(news.any(axis=1))
    return depth


def union_bindings(have: DataFrame, more: DataFrame, cap: int = 256) -> DataFrame:
    """(node, bindings): the bindings carried by each node, grown by what arrives, sorted, at most ``cap`` of them."""
    both = have.select("node", "bindings").unionAll(more.select("node", "bindings"))
    return both.select("node", F.explode("bindings").alias("b")).distinct().groupBy("node").agg(F.slice(F.array_sort(F.collect_set("b")), 1, cap).alias("bindings"))
