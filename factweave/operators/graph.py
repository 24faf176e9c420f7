"""Graph shaping: from references and rules to the call graph that traversals read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import docid
from factweave.runtime import materialize, shuffle_partitions, with_dense_id

# How far traversals follow handoffs, and the dispatcher of an event subscription.
MODES = ["sync_cut", "async_exact", "async_include"]
EVENT = "event"

#: Members on a side of a cell in which a delegate field's edges are met, and how many fields have a bit (of 63).
CELL, TOLD = 1024, 63


def gate_handoffs(edges: DataFrame, mode: str) -> DataFrame:
    """sync_cut leaves out every handoff edge, async_exact those delivered to several handlers, async_include none."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "sync_cut":
        return edges.where(~F.col("kind").eqNullSafe("handoff"))
    if mode == "async_exact":
        return edges.where(~(F.col("kind").eqNullSafe("handoff") & F.col("delivery_precision").eqNullSafe("fanout")))
    return edges


def cut(edges: DataFrame, patterns: list[str]) -> DataFrame:
    """Without the edges that leave a node matching one of the head patterns: such a node is a leaf forwards, and
    no predecessor backwards. No patterns, no cut."""
    for p in patterns:
        edges = edges.where(~docid.matches_head_glob("from_sym", p))
    return edges


def redirect(refs: DataFrame, rules: DataFrame) -> DataFrame:
    """References whose target is outside the source and whose id before '(' is a rule's method point to the rule's
    redirect_to instead, and count as in the source; ``rules`` (method, redirect_to) is rule data, small by nature."""
    r = rules.select("method", "redirect_to").distinct()
    joined = refs.withColumn("__head", docid.head("target_symbol_id")).join(r, F.col("__head") == F.col("method"), "left")
    moved = F.coalesce(~F.col("target_in_source") & (F.col("redirect_to") != F.col("target_symbol_id")), F.lit(False))
    # both columns are set from the row as it was
    return joined.withColumns({
        "target_symbol_id": F.when(moved, F.col("redirect_to")).otherwise(F.col("target_symbol_id")),
        "target_in_source": moved | F.col("target_in_source"),
    }).select(*refs.columns)


def classify_handoffs(edges: DataFrame, consumers: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """methodGroup edges whose site holds a call that matches a rule become handoffs of that rule.

    ``rules`` are (rule id, text): the first whose text occurs in a consumer's id (without arity marks, case counts)
    wins. ``consumers`` has the invocations and constructors by site: from_sym, file_path, line, consumer.
    Other edges stay as they are; edges keep all their columns, kind and handoff_dispatcher may change.
    """
    c = docid.strip_arity("consumer")
    rank = F.coalesce(*[F.when(c.contains(text), F.lit(i)) for i, (_, text) in enumerate(rules)], F.lit(None).cast("int"))
    site = ["from_sym", "file_path", "line"]
    best = consumers.withColumn("__r", rank).where("__r is not null").groupBy(*site).agg(F.min("__r").alias("__r"))
    joined = edges.join(best, site, "left")
    hit = (F.col("kind") == "methodGroup") & F.col("__r").isNotNull()
    name = F.element_at(F.array(*[F.lit(r) for r, _ in rules]), F.col("__r") + 1)
    return joined.withColumn("handoff_dispatcher", F.when(hit, name).otherwise(F.col("handoff_dispatcher"))).withColumn("kind", F.when(hit, "handoff").otherwise(F.col("kind"))).select(*edges.columns)


def mark_event_subscriptions(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """methodGroup edges at a site that also reads an event (``E:``) become handoffs of the event dispatcher."""
    site = ["from_sym", "file_path", "line"]
    events = (
        refs.where((F.col("ref_kind") == "read") & F.col("target_symbol_id").startswith("E:"))
        .select(F.col("enclosing_symbol_id").alias("from_sym"), "file_path", "line").where("from_sym is not null").distinct().withColumn("__e", F.lit(True))
    )
    joined = edges.join(events, site, "left")
    hit = (F.col("kind") == "methodGroup") & F.col("__e").isNotNull()
    return joined.withColumn("handoff_dispatcher", F.when(hit, EVENT).otherwise(F.col("handoff_dispatcher"))).withColumn("kind", F.when(hit, "handoff").otherwise(F.col("kind"))).select(*edges.columns)


def delegate_field_edges(dispatch: DataFrame) -> DataFrame:
    """Edges from where a delegate field is invoked to what is bound to it, unless the field escapes.

    ``dispatch`` (source_member, target_member, kind): delegate_field_bind has the field and the bound method,
    delegate_field_invoke the invoking method and the field, delegate_field_escape the field.

    A hot field has more edges than any table has rows, so they are met once, in cells of about CELL by CELL members,
    and not shuffled: of the TOLD fields with most edges each method has a bit, and an edge comes from the first field
    that its ends share. Only the edges of other fields go through a distinct.
    """
    of = lambda k: dispatch.where(F.col("kind") == k)
    bind = materialize(of("delegate_field_bind").select(F.col("source_member").alias("slot"), F.col("target_member").alias("to_sym")).where("slot is not null").distinct(), "bind")
    invoke = materialize(of("delegate_field_invoke").select(F.col("source_member").alias("from_sym"), F.col("target_member").alias("slot")).where("slot is not null").distinct(), "invoke")
    escaped = of("delegate_field_escape").select(F.col("source_member").alias("slot"))
    n = lambda df, name: df.groupBy("slot").agg(F.count(F.lit(1)).alias(name))
    slots = materialize(n(bind, "bound").join(n(invoke, "invoked"), "slot").join(escaped, "slot", "left_anti"), "slots")
    most = slots.orderBy(F.desc(F.col("bound") * F.col("invoked")), "slot").limit(TOLD).select("slot").collect()
    bits = slots.sparkSession.createDataFrame([(r.slot, 1 << i) for i, r in enumerate(most)], "slot string, bit long")
    # how many pieces either side of a field is cut into
    pieces = lambda c: F.ceil(F.col(c) / CELL).cast("int")
    cut_ = slots.join(F.broadcast(bits), "slot", "left").select("slot", F.coalesce("bit", F.lit(0)).alias("bit"), pieces("bound").alias("xs"), pieces("invoked").alias("ys"))

    def told(df: DataFrame, member: str, mask: str) -> DataFrame:
        rows = df.join(cut_, "slot")
        masks = rows.groupBy(F.col(member).alias("__m")).agg(F.bit_or("bit").alias(mask))
        return rows.join(masks, F.col(member).eqNullSafe(F.col("__m"))).drop("__m")

    spark = slots.sparkSession
    tasks = max(shuffle_partitions(spark), 4 * spark.sparkContext.defaultParallelism)
    cell = ["slot", "x", "y"]
    piece = lambda member, c: F.pmod(F.xxhash64(member), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    to = materialize(told(bind, "to_sym", "tm").select("to_sym", "slot", "bit", "tm", piece("to_sym", "xs").alias("x"), "ys"), "bound")
    by = materialize(told(invoke, "from_sym", "fm").select("from_sym", "slot", "fm", F.col("bit").alias("own"), piece("from_sym", "ys").alias("y"), "xs"), "invoked")

    def pairs(hot: bool) -> DataFrame:
        # a set number of tasks: the few bytes that come in say nothing about what goes out
        b = to.where((F.col("bit") != 0) == hot).select("*", every("ys").alias("y")).drop("ys").repartition(tasks, *cell)
        i = by.where((F.col("own") != 0) == hot).select("*", every("xs").alias("x")).drop("xs", "own").repartition(tasks, *cell)
        return i.join(b, cell)

    hot = pairs(True).where("(fm & tm & (bit - 1)) = 0").select("from_sym", "to_sym")
    rest = pairs(False).where("(fm & tm) = 0").select("from_sym", "to_sym").distinct()
    return hot.unionAll(rest).select("from_sym", "to_sym", F.lit("delegate-field").alias("kind"), F.lit("").alias("file_path"), F.lit(0).alias("line"))


def delivery_edges(producers: DataFrame, handlers: DataFrame) -> DataFrame:
    """Edges from producers to the handlers of their channel (tag, token), once per caller, handler and tag.

    ``producers`` has caller, file_path, line, tag, token, ``handlers`` handler, tag, token. A channel's only handler
    is reached exactly, several are a fan-out. Channels are counted before the join.
    """
    h = handlers.select("handler", "tag", "token").distinct()
    n = h.groupBy("tag", "token").agg(F.count(F.lit(1)).alias("n"))
    channel = h.join(n, ["tag", "token"])
    site = producers.groupBy("caller", "tag", "token").agg(F.min(F.struct("file_path", "line")).alias("s"))
    joined = site.join(channel, ["tag", "token"])
    return joined.groupBy(F.col("caller").alias("from_sym"), F.col("handler").alias("to_sym"), "tag").agg(
        F.min("s").alias("s"), F.min(F.when(F.col("n") == 1, "exact").otherwise("fanout")).alias("delivery_precision")
    ).select("from_sym", "to_sym", "tag", F.lit("handoff").alias("kind"), "s.file_path", "s.line", "delivery_precision")


def co_located(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """Edges at the same place (from_sym, file_path, line) as one of the sites."""
    return edges.join(sites.select("from_sym", "file_path", "line").distinct(), ["from_sym", "file_path", "line"], "left_semi")


def factory_rewrite(edges: DataFrame, methods: DataFrame, factory: str, argument: str, member: str) -> DataFrame:
    """Edges into a generic factory type lead to the overloads of ``member`` on the type it is asked for.

    ``argument`` names the column with the type arguments' display. A factory edge goes to the member's overloads of
    the factory method's number of parameters if there are any, else to all of them; without any it stays.
    """
    asked = docid.nth_type_argument(argument, 0)
    e = edges.withColumn("__t", F.when(docid.simple_type_name(docid.method_type("to_sym")) == factory, docid.strip_generic(asked))).withColumn("__n", docid.param_arity("to_sym")).withColumn("__row", F.monotonically_increasing_id())
    m = methods.select("symbol_id").distinct().select("symbol_id", docid.declaring_type("symbol_id").alias("__t"), docid.method_name("symbol_id").alias("__name"), docid.param_arity("symbol_id").alias("__arity")).where(F.col("__name") == member).drop("__name")
    joined = e.join(m, "__t", "left")
    fits = F.max((F.col("__arity") == F.col("__n")).cast("int"))
    keyed = joined.groupBy("__row").agg(fits.alias("__fits"))
    return (
        joined.join(keyed, "__row").where("symbol_id is null or __fits = 0 or __arity = __n")
        .withColumn("to_sym", F.coalesce("symbol_id", "to_sym")).select(*edges.columns)
    )


def ordered_adjacency(edges: DataFrame) -> DataFrame:
    """Edges in the order in which traversals take them: by caller, then line, callee, kind and receiver."""
    return edges.orderBy("from_sym", "line", "to_sym", "kind", F.coalesce("receiver_type", F.lit("")))


def adjacency_places(edges: DataFrame) -> DataFrame:
    """(from_sym, to_sym, kind, line, receiver_type, place): every distinct edge with its place, from 1, in the order of
    ``ordered_adjacency`` among its caller's edges. A receiver of null comes before an empty one.

    All edges are numbered by one range sort, so a hot caller is spread over tasks; its first number is subtracted.
    """
    e = edges.select("from_sym", "to_sym", "kind", "line", "receiver_type").distinct()
    keyed = e.withColumn("__receiver", F.coalesce("receiver_type", F.lit(""))).withColumn("__known", F.col("receiver_type").isNotNull())
    numbered = with_dense_id(keyed, ["from_sym", "line", "to_sym", "kind", "__receiver", "__known"], "__at", "adjacency")
    first = numbered.groupBy(F.col("from_sym").alias("__caller")).agg(F.min("__at").alias("__first"))
    joined = numbered.join(first, F.col("from_sym").eqNullSafe(F.col("__caller")))
    return joined.select("from_sym", "to_sym", "kind", "line", "receiver_type", (F.col("__at") - F.col("__first") + 1).alias("place"))
