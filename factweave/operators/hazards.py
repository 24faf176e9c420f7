"""Hazards: patterns over effects and the call graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import docid
from factweave.operators import closure

# The durable system that a write commits to, by provider:operation, or by provider where all it does writes.
SYSTEM_CLASSES = {
    "db_command:execute": "db", "efcore:commit": "db", "efcore:pending_write": "db", "efcore:raw_sql": "db", "repository:write": "db",
    "yessql:write": "db", "yessql:delete": "db", "llblgen:write": "db", "llblgen:delete": "db", "llblgen:tx_commit": "db",
    "rabbitmq:publish": "queue", "mediatr:publish": "queue", "actor:tell": "queue", "actor:ask": "queue", "echo_publish": "queue", "eventbus": "queue", "queue": "queue",
    "elasticsearch:write": "search", "elasticsearch:delete": "search", "elasticsearch:index_write": "search", "elasticsearch:index_delete": "search",
    "azure_search:write": "search", "azure_search:delete": "search", "azure_search:index_write": "search", "azure_search:index_delete": "search",
    "redis:write": "cache", "redis:delete": "cache", "inproc_cache:write": "cache", "inproc_cache:delete": "cache", "entity_cache:write": "cache",
    "http:POST": "http", "http:PUT": "http", "http:PATCH": "http", "http:DELETE": "http", "soap:invoke": "http", "soap:submit": "http",
    "aws_s3:write": "blob", "aws_s3:delete": "blob", "azure_blob:write": "blob", "azure_blob:delete": "blob",
    "object_store:write": "object_store", "smtp:send": "email",
}
# Names of cells that are set once.
INIT_CELLS = ["instance", "initialised", "initialized"]


def race_windows(reads: DataFrame, writes: DataFrame, transactions: DataFrame | None = None) -> DataFrame:
    """(enclosing_symbol_id, cell, read_line, write_line, confidence): writes of a shared cell with an earlier read of
    it in the same method; the earliest read counts, strictly before by line. Static constructors are safe.

    ``reads`` and ``writes`` have enclosing_symbol_id, cell, line. Confidence is high, or medium where both lie in a
    transaction (``transactions``: enclosing_symbol_id, line). Reads are reduced to one per method and cell first.
    """
    safe = F.col("enclosing_symbol_id").contains("#cctor")
    r = reads.where(~safe).groupBy("enclosing_symbol_id", "cell").agg(F.min("line").alias("read_line"))
    w = writes.where(~safe).select("enclosing_symbol_id", "cell", F.col("line").alias("write_line")).distinct()
    out = w.join(r, ["enclosing_symbol_id", "cell"]).where("read_line < write_line")
    if transactions is None:
        return out.withColumn("confidence", F.lit("high"))
    t = transactions.select("enclosing_symbol_id", "line").distinct()
    both = out.join(t.withColumnRenamed("line", "read_line").withColumn("__r", F.lit(True)), ["enclosing_symbol_id", "read_line"], "left").join(
        t.withColumnRenamed("line", "write_line").withColumn("__w", F.lit(True)), ["enclosing_symbol_id", "write_line"], "left"
    )
    return both.withColumn("confidence", F.when(F.col("__r") & F.col("__w"), "medium").otherwise("high")).select(*out.columns, "confidence")


def lazy_init_races(races: DataFrame, writes: DataFrame, locked: DataFrame, volatile: DataFrame, thread_static: DataFrame) -> DataFrame:
    """Race windows with ``hazard``: thread_local_context for per-thread cells, lazy_init_race for initialisation,
    race_window for the rest; the first two have low confidence.

    Initialisation is a getter (get_), a constructor, or a method with Init in its name, in any case; or the only write
    of the cell in its method, of a cell named as one of INIT_CELLS but for leading underscores, in any case. ``tier`` is
    'locked' where an initialising write lies under a lock (``locked``: enclosing_symbol_id, line), else 'open'. A locked
    initialisation of a volatile cell (cell) that no locked line of its method follows is the safe pattern and no hazard.
    """
    n = writes.groupBy("enclosing_symbol_id", "cell").agg(F.count(F.lit(1)).alias("n_writes"))
    held = locked.groupBy("enclosing_symbol_id").agg(F.max("line").alias("last_held"))
    at = locked.select("enclosing_symbol_id", F.col("line").alias("write_line"), F.lit(True).alias("__locked")).distinct()
    x = (
        races.join(n, ["enclosing_symbol_id", "cell"], "left").join(at, ["enclosing_symbol_id", "write_line"], "left").join(held, "enclosing_symbol_id", "left")
        .join(volatile.select("cell", F.lit(True).alias("__volatile")).distinct(), "cell", "left")
        .join(thread_static.select("cell", F.lit(True).alias("__own")).distinct(), "cell", "left")
    )
    name = docid.simple_member_name("enclosing_symbol_id")
    cell = F.lower(F.regexp_replace(docid.simple_member_name("cell"), "^_+", ""))
    init = name.startswith("get_") | name.isin("#ctor", "#cctor") | F.lower(name).contains("init") | ((F.coalesce("n_writes", F.lit(1)) == 1) & cell.isin(INIT_CELLS))
    hazard = F.when(F.col("__own"), "thread_local_context").when(F.coalesce(init, F.lit(False)), "lazy_init_race").otherwise("race_window")
    lazy = F.col("hazard") == "lazy_init_race"
    y = x.withColumn("hazard", hazard).withColumn("tier", F.when(lazy & F.col("__locked"), "locked").otherwise("open"))
    safe = lazy & F.col("__locked") & F.col("__volatile") & (F.col("write_line") >= F.col("last_held"))
    return y.where(~F.coalesce(safe, F.lit(False))).withColumn("confidence", F.when(F.col("hazard") == "race_window", F.col("confidence")).otherwise("low")).select(*races.columns, "hazard", "tier")


def system_class(classes: dict[str, str]) -> Column:
    """The class of an effect (provider, operation): that of provider:operation, else that of the provider; null for none."""
    precise = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    return F.coalesce(precise[F.concat_ws(":", "provider", "operation")], precise[F.col("provider")])


def dual_writes(effects: DataFrame, classes: dict[str, str] = SYSTEM_CLASSES) -> DataFrame:
    """(enclosing_symbol_id, context, sites, last_line, last_provider): methods that write to two or more systems.

    Only what ``classes`` lists counts: writes, never reads. context joins the distinct systems in order; the finding
    lies at the last write by line, the first by provider among equals; sites counts the writes, which
    ``dual_write_sites`` gives one by one. Only class names are gathered per method, as many as there are systems.
    """
    e = effects.withColumn("__c", system_class(classes)).where("__c is not null and enclosing_symbol_id is not null")
    g = e.groupBy("enclosing_symbol_id").agg(F.array_sort(F.collect_set("__c")).alias("c"), F.count(F.lit(1)).alias("sites"), F.min(F.struct((-F.col("line")).alias("n"), "provider")).alias("last"))
    return g.where(F.size("c") > 1).select("enclosing_symbol_id", F.array_join("c", "+").alias("context"), "sites", (-F.col("last.n")).alias("last_line"), F.col("last.provider").alias("last_provider"))


def dual_write_sites(effects: DataFrame, classes: dict[str, str] = SYSTEM_CLASSES) -> DataFrame:
    """(enclosing_symbol_id, system, provider, operation, file_path, line): every write of the ``dual_writes`` methods."""
    own = effects.withColumn("system", system_class(classes)).where("system is not null and enclosing_symbol_id is not null")
    return own.join(dual_writes(effects, classes).select("enclosing_symbol_id"), "enclosing_symbol_id", "left_semi").select("enclosing_symbol_id", "system", "provider", "operation", "file_path", "line")


def sync_over_async(effects: DataFrame, methods: DataFrame) -> DataFrame:
    """Effects of the provider ``async_block`` within methods (symbol_id, modifiers) that are async themselves."""
    asyncs = methods.where(F.array_contains(F.split("modifiers", r"\s+"), "async")).select(F.col("symbol_id").alias("enclosing_symbol_id")).distinct()
    return effects.where(F.col("provider") == "async_block").join(asyncs, "enclosing_symbol_id", "left_semi")


def missing_companions(effects: DataFrame, edges: DataFrame, anchor: str, companion: str, in_scope: DataFrame | None = None) -> DataFrame:
    """(enclosing_symbol_id, resource, certainty): anchor effects without a companion of the same resource in what
    their method reaches, itself included.

    ``anchor`` and ``companion`` are ``provider:operation``; edges have src and dst. ``in_scope`` (resource, certainty)
    limits the resources. All anchors are followed in one closure.
    """
    token = F.concat_ws(":", "provider", "operation")
    a = effects.where((token == anchor) & F.col("enclosing_symbol_id").isNotNull()).select("enclosing_symbol_id", "resource").distinct()
    a = a.withColumn("certainty", F.lit("high")) if in_scope is None else a.join(in_scope.select("resource", "certainty").distinct(), "resource")
    c = effects.where(token == companion).select(F.col("enclosing_symbol_id").alias("node"), "resource").distinct()
    starts = a.select(F.col("enclosing_symbol_id").alias("seed"), F.col("enclosing_symbol_id").alias("node")).distinct()
    kept = closure.reach_each(edges, starts).select("seed", "node").join(c, "node").select(F.col("seed").alias("enclosing_symbol_id"), "resource").distinct()
    return a.join(kept, ["enclosing_symbol_id", "resource"], "left_anti")


def static_init_captures(effects: DataFrame, symbols: DataFrame, texts: list[str]) -> DataFrame:
    """Effects whose resource holds one of the texts and whose enclosing symbol is a static field."""
    fields = symbols.where("kind = 'field'").where(F.col("modifiers").contains("static")).select(F.col("symbol_id").alias("enclosing_symbol_id")).distinct()
    hit = F.lit(False)
    for t in texts:
        hit = hit | F.col("resource").contains(t)
    return effects.where(hit).join(fields, "enclosing_symbol_id", "left_semi")


def rollup(findings: DataFrame, kind: str, method: str, confidence: str) -> DataFrame:
    """Counts per kind and method, by confidence: kind, method, sites, high, medium, low."""
    n = lambda c: F.sum(F.when(F.col(confidence) == c, 1).otherwise(0)).alias(c)
    return findings.groupBy(F.col(kind).alias("kind"), F.col(method).alias("method")).agg(F.count(F.lit(1)).alias("sites"), n("high"), n("medium"), n("low"))


def on_tree(findings: DataFrame, tree: DataFrame, kind: str, method: str, confidence: str) -> DataFrame:
    """(method, kind, confidence, sites): findings of the methods of a tree (node), with their highest confidence."""
    rank = F.when(F.col(confidence) == "high", 0).when(F.col(confidence) == "medium", 1).otherwise(2)
    inside = findings.join(tree.select(F.col("node").alias(method)).distinct(), method, "left_semi")
    g = inside.groupBy(F.col(method).alias("method"), F.col(kind).alias("kind")).agg(F.min(rank).alias("r"), F.count(F.lit(1)).alias("sites"))
    return g.select("method", "kind", F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("r") + 1).alias("confidence"), "sites")


def without_namespaces(findings: DataFrame, method: str, prefixes: list[str]) -> DataFrame:
    """Findings but for those of methods whose name starts with one of the prefixes, in any case."""
    for p in prefixes:
        findings = findings.where(~F.lower(docid.param_free_name(method)).startswith(p.lower()))
    return findings
