"""Virtual dispatch: which members a call may end up in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import docid
from factweave.operators import closure
from factweave.runtime import materialize

# The edge kinds that dispatch makes, by the kind of mined fact.
EDGE_KINDS = {"impl": "impl-dispatch", "override": "override-dispatch", "delegate_bind": "delegate-dispatch"}


def mined(dispatch: DataFrame) -> DataFrame:
    """(src, dst, kind): for each member all it dispatches to along override or impl facts, never mixing the kinds,
    and its delegate bindings, one hop."""
    out = None
    for kind in ("override", "impl"):
        facts = dispatch.where(F.col("kind") == kind).select(F.col("source_member").alias("src"), F.col("target_member").alias("dst"))
        starts = facts.select(F.col("src").alias("seed"), F.col("src").alias("node")).distinct()
        hops = closure.reach_each(facts, starts).where("depth > 0").select(F.col("seed").alias("src"), F.col("node").alias("dst"), F.lit(EDGE_KINDS[kind]).alias("kind"))
        out = hops if out is None else out.unionAll(hops)
    bound = dispatch.where("kind = 'delegate_bind'").select(F.col("source_member").alias("src"), F.col("target_member").alias("dst"), F.lit(EDGE_KINDS["delegate_bind"]).alias("kind"))
    return out.unionAll(bound).distinct()


def type_descendants(relations: DataFrame, kinds: list[str]) -> DataFrame:
    """(ancestor, type, depth): every type below every type along the relations of the kinds, itself at depth 0.

    Generic types are joined by their bare names.
    """
    r = relations.where(F.col("relation_kind").isin(kinds))
    edges = r.select(docid.strip_generic("related_symbol_id").alias("src"), docid.strip_generic("type_symbol_id").alias("dst"))
    all_types = edges.select(F.explode(F.array("src", "dst")).alias("seed")).distinct()
    return closure.reach_each(edges, all_types.select("seed", F.col("seed").alias("node"))).select(F.col("seed").alias("ancestor"), F.col("node").alias("type"), "depth")


def receiver_types(relations: DataFrame, bases: DataFrame) -> DataFrame:
    """(ancestor, type): every type itself, its descendants along base relations (``bases``, as ``type_descendants``
    gives them), and of an interface the implementing types with their descendants."""
    r = relations.select(docid.strip_generic("related_symbol_id").alias("ancestor"), docid.strip_generic("type_symbol_id").alias("type"), "relation_kind")
    own = r.select(F.explode(F.array("ancestor", "type")).alias("ancestor")).select("ancestor", F.col("ancestor").alias("type"))
    impl = r.where("relation_kind = 'interface'").select("ancestor", "type")
    below = impl.withColumnRenamed("type", "mid").join(bases.select(F.col("ancestor").alias("mid"), "type"), "mid").select("ancestor", "type")
    return own.unionAll(bases.select("ancestor", "type")).unionAll(impl).unionAll(below).distinct()


def type_closure(relations: DataFrame, roots: list[str], strict: bool = False) -> DataFrame:
    """(type): the types derived from the roots along base relations, the roots themselves unless ``strict``."""
    r = relations.where("relation_kind = 'base'")
    edges = r.select(docid.strip_generic("related_symbol_id").alias("src"), docid.strip_generic("type_symbol_id").alias("dst"))
    seeds = r.sparkSession.createDataFrame([(x.split("{")[0].split("`")[0],) for x in roots], "node string")
    found = closure.reach(edges, seeds)
    return found.where("depth > 0" if strict else "true").select(F.col("node").alias("type")).distinct()


def _members(methods: DataFrame) -> DataFrame:
    return methods.select("symbol_id", "is_override", "is_static").distinct().select(
        "symbol_id", "is_override", docid.strip_generic(docid.method_type("symbol_id")).alias("type"), docid.method_name("symbol_id").alias("name"), docid.param_arity("symbol_id").alias("arity")
    ).where("type is not null and name <> '#ctor'")


def hierarchy_fallback(methods: DataFrame, relations: DataFrame, covered: DataFrame) -> DataFrame:
    """(src, dst, kind): dispatch by name and number of parameters, for members without a mined edge.

    A member of an interface goes to the members of its implementing types, any other to the overriding members of
    its descendants. ``methods`` has symbol_id, is_override and is_static, ``covered`` (src) the members to leave out.
    """
    m = _members(methods)
    source = m.join(covered.select(F.col("src").alias("symbol_id")), "symbol_id", "left_anti").select(F.col("symbol_id").alias("src"), F.col("type").alias("ancestor"), "name", "arity")
    target = m.select(F.col("symbol_id").alias("dst"), "type", "name", "arity", "is_override")
    impl = relations.where("relation_kind = 'interface'").select(docid.strip_generic("related_symbol_id").alias("ancestor"), docid.strip_generic("type_symbol_id").alias("type")).distinct()
    below = type_descendants(relations, ["base"]).where("depth > 0").select("ancestor", "type")
    by_impl = source.join(impl, "ancestor").join(target, ["type", "name", "arity"]).select("src", "dst", F.lit("impl-dispatch").alias("kind"))
    by_over = source.join(below, "ancestor").join(target.where("is_override"), ["type", "name", "arity"]).select("src", "dst", F.lit("override-dispatch").alias("kind"))
    return by_impl.unionAll(by_over).where("src <> dst").distinct()


def error_type_recovery(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """(src, dst, kind): for callees of unresolved types (``!:``), the members of types with the same simple name,
    by member name and number of parameters of the calls into them."""
    unresolved = edges.where(F.col("to_sym").startswith("!:")).select("to_sym").distinct()
    name = F.substring_index(docid.param_free_name("to_sym"), ".", -1)
    owner = F.regexp_extract(F.substring_index(docid.param_free_name("to_sym"), ".", -2), r"^([^.`{]*)", 1)
    wanted = unresolved.select(F.col("to_sym").alias("src"), owner.alias("simple"), name.alias("name"), docid.param_arity("to_sym").alias("arity"))
    m = methods.select("symbol_id").distinct().select(F.col("symbol_id").alias("dst"), docid.simple_type_name(docid.method_type("symbol_id")).alias("simple"), docid.method_name("symbol_id").alias("name"), docid.param_arity("symbol_id").alias("arity"))
    return wanted.join(m, ["simple", "name", "arity"]).select("src", "dst", F.lit("impl-dispatch").alias("kind")).distinct()


def narrow_by_receiver(calls: DataFrame, fans: DataFrame, descendants: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """Fans narrowed by the receiver's static type: (hub, receiver, dst), computed once per distinct (hub, receiver).

    ``calls`` has hub and receiver (a type id or null), ``fans`` hub and dst, ``descendants`` ancestor, type, depth
    (itself at depth 0). A receiver that is unknown, equals the hub's own type, or is no descendant of it, narrows
    nothing. Else the targets within the receiver's subtree stay; if there are none, those of its nearest ancestor
    that has one; if there are none either, nothing. ``bases``, like ``descendants`` but along base relations only, is
    where ancestors are looked for when ``descendants`` holds implementers too.
    """
    pairs = materialize(calls.select("hub", "receiver").distinct().withColumn("own", docid.strip_generic(docid.method_type("hub"))), "pairs")
    d = descendants.select("ancestor", "type")
    useful = pairs.where("receiver is not null and receiver <> own").join(d.select(F.col("ancestor").alias("own"), F.col("type").alias("receiver")), ["own", "receiver"], "left_semi")
    useful = materialize(useful.select("hub", "receiver"), "useful")
    typed = fans.withColumn("type", docid.strip_generic(docid.method_type("dst")))
    full = pairs.join(useful.select("hub", "receiver"), (pairs.hub == useful.hub) & pairs.receiver.eqNullSafe(useful.receiver), "left_anti").join(fans, "hub").select("hub", "receiver", "dst")
    # a pair meets its hub's targets or its receiver's subtree, whichever are fewer: a hot hub's receivers each meet little
    fan = typed.groupBy("hub").agg(F.count(F.lit(1)).alias("fan"))
    below = d.groupBy(F.col("ancestor").alias("receiver")).agg(F.count(F.lit(1)).alias("below"))
    sized = materialize(useful.join(fan, "hub").join(below, "receiver").select("hub", "receiver", (F.col("fan") <= F.col("below")).alias("few")), "sized")
    tree = d.select(F.col("ancestor").alias("receiver"), "type")
    by_fan = sized.where("few").join(typed, "hub").join(tree, ["receiver", "type"], "left_semi")
    by_tree = sized.where("not few").join(tree.distinct(), "receiver").join(typed, ["hub", "type"])
    within = by_fan.select("hub", "receiver", "dst").unionAll(by_tree.select("hub", "receiver", "dst"))
    within = materialize(within, "within")
    none = useful.select("hub", "receiver").join(within, ["hub", "receiver"], "left_anti")
    line = descendants if bases is None else bases
    # a type has few ancestors, so they come before the targets
    up = none.join(line.select(F.col("ancestor").alias("type"), F.col("type").alias("receiver"), "depth"), "receiver").join(typed, ["hub", "type"])
    nearest = up.groupBy("hub", "receiver").agg(F.min("depth").alias("depth"))
    above = up.join(nearest, ["hub", "receiver", "depth"]).select("hub", "receiver", "dst")
    return full.unionAll(within).unionAll(above).distinct()


def narrow_or_keep(fans: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Fans (keys, dst) cut to the allowed (keys, dst); a fan that would become empty is kept whole.

    Serves the narrowing by context families and by carried type arguments.
    """
    kept = fans.join(allowed.select(*keys, "dst").distinct(), [*keys, "dst"], "left_semi")
    return kept.unionAll(fans.join(kept.select(*keys).distinct(), keys, "left_anti").select(*kept.columns))


def fan_report(calls: DataFrame, fans: DataFrame, narrowed: DataFrame, limit: int | None = None) -> DataFrame:
    """(hub, fan, edges, unknown_receiver, own_type, unhelpful, weight): hubs of a fan of two or more, by the calls
    whose receiver doesn't shrink it. Calls into a hub are counted per receiver before any join."""
    size = fans.groupBy("hub").agg(F.countDistinct("dst").alias("fan")).where("fan > 1")
    per = calls.groupBy("hub", "receiver").agg(F.count(F.lit(1)).alias("n"))
    got = narrowed.groupBy("hub", "receiver").agg(F.countDistinct("dst").alias("left"))
    p, g = per.alias("p"), got.alias("g")
    joined = p.join(size, "hub").join(g, (F.col("p.hub") == F.col("g.hub")) & F.col("p.receiver").eqNullSafe(F.col("g.receiver")), "left").where("left >= fan")
    own = docid.strip_generic(docid.method_type("p.hub"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    known = F.col("p.receiver").isNotNull()
    out = joined.groupBy(F.col("p.hub").alias("hub"), "fan").agg(
        F.sum("n").alias("edges"), n(~known).alias("unknown_receiver"), n(known & (F.col("p.receiver") == own)).alias("own_type"), n(known & (F.col("p.receiver") != own)).alias("unhelpful")
    ).withColumn("weight", F.col("fan") * F.col("edges"))
    return out.orderBy(F.desc("weight"), "hub").limit(limit) if limit else out


def one_hop(calls: DataFrame, dispatched: DataFrame) -> DataFrame:
    """Call edges joined with dispatch so that a dispatched member is not dispatched again: (src, dst, via).

    The real call comes as it is; unless it is non-virtual, its callee's dispatch targets follow, one hop.
    """
    real = calls.select("from_sym", "to_sym", "non_virtual").distinct()
    more = real.where("not non_virtual").join(dispatched.select(F.col("src").alias("to_sym"), "dst").distinct(), "to_sym").select(F.col("from_sym").alias("src"), "dst", F.col("to_sym").alias("via"))
    return real.select(F.col("from_sym").alias("src"), F.col("to_sym").alias("dst"), F.lit(None).cast("string").alias("via")).unionAll(more).distinct()


def propagate_receiver(steps: DataFrame, descendants: DataFrame) -> DataFrame:
    """(from_sym, to_sym, carried): the receiver type that each step hands on.

    ``steps`` has from_sym, to_sym, carried (type id or null), receiver (type id or null), self_call and dispatched. A
    call on the same object keeps what is carried; a dispatched step hands on the more derived of the carried and the
    target's declaring type; any other call hands on its own receiver. ``descendants`` as in ``narrow_by_receiver``.
    """
    own = docid.strip_generic(docid.method_type("to_sym"))
    lower = descendants.where("depth > 0").select(F.col("ancestor").alias("__own"), F.col("type").alias("carried"), F.lit(True).alias("__lower")).distinct()
    s = steps.withColumn("__own", own).join(lower, ["__own", "carried"], "left")
    value = F.when(F.col("dispatched"), F.when(F.col("__lower"), F.col("carried")).otherwise(F.col("__own"))).when(F.col("self_call"), F.col("carried")).otherwise(F.col("receiver"))
    return s.select("from_sym", "to_sym", value.alias("carried")).distinct()
