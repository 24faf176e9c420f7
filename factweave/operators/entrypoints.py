"""Entry points: where a program is entered from outside, by rules over types, attributes and handoffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import docid
from factweave.operators.relational import first_by

COLUMNS = ["kind", "method", "route", "file_path", "line"]


def pages(types: DataFrame, ctors: DataFrame, page_types: DataFrame, prefix: str, kind: str = "page") -> DataFrame:
    """Entry points of page types: not abstract, below a page base (``page_types``: type), under the namespace prefix.

    ``types`` has symbol_id, modifiers, file_path, line; ``ctors`` symbol_id, type, file_path, line. Each constructor
    is one, a type without any is one at its own line; a place (file_path, line) is entered once.
    """
    t = types.where(~F.array_contains(F.split("modifiers", r"\s+"), "abstract")).withColumn("bare", docid.strip_generic("symbol_id"))
    t = t.join(page_types.select(F.col("type").alias("bare")).distinct(), "bare", "left_semi")
    name = docid.param_free_name("symbol_id")
    t = t.where((name == prefix) | name.startswith(prefix + ".") | F.lit(prefix == "")).select(F.col("symbol_id").alias("type"), "file_path", "line")
    route = docid.type_route(docid.param_free_name("type"), prefix)
    by_ctor = ctors.select("type", F.col("symbol_id").alias("method"), F.col("file_path").alias("cf"), F.col("line").alias("cl"))
    rows = t.join(by_ctor, "type", "left").select(F.lit(kind).alias("kind"), F.coalesce("method", "type").alias("method"), route.alias("route"), F.coalesce("cf", "file_path").alias("file_path"), F.coalesce("cl", "line").alias("line"))
    return first_by(rows.distinct(), ["file_path", "line"], ["method"])


def actions(refs: DataFrame, attribute: str, controllers: DataFrame, prefix: str, kind: str = "action") -> DataFrame:
    """Entry points of members with an attribute (its constructor's id starts with ``attribute``) whose declaring type
    is a controller (``controllers``: type). One per place, whether or not a route can be built."""
    r = refs.where(F.col("target_symbol_id").startswith(attribute) & F.col("enclosing_symbol_id").isNotNull())
    r = r.withColumn("type", docid.strip_generic(docid.method_type("enclosing_symbol_id"))).join(controllers.select("type").distinct(), "type", "left_semi")
    one = first_by(r.select("file_path", "line", F.col("enclosing_symbol_id").alias("method")).distinct(), ["file_path", "line"], ["method"])
    owner = docid.param_free_name(docid.method_type("method"))
    route = F.concat(docid.type_route(owner, prefix), F.lit("/"), docid.strip_arity(docid.method_name("method")))
    return one.select(F.lit(kind).alias("kind"), "method", route.alias("route"), "file_path", "line").where("route is not null")


def inherited(methods: DataFrame, descendants: DataFrame, names: list[str], kind: str, overrides_only: bool = False, attributed: DataFrame | None = None, parameter_types: list[str] = ()) -> DataFrame:
    """Entry points of handler classes: methods of the types (``descendants``: type) with one of the names ('*' stands
    for any part), an override if asked for, with an attribute (``attributed``: method) and with parameters of all the
    named simple types, each once per place. ``methods`` has symbol_id, file_path, line, is_override."""
    own = docid.strip_arity(docid.method_name("symbol_id"))
    hit = F.lit(False)
    for n in names:
        hit = hit | own.like(n.replace("_", r"\_").replace("%", r"\%").replace("*", "%"))
    m = methods.where(hit & (own != "#ctor")).withColumn("type", docid.strip_generic(docid.method_type("symbol_id")))
    m = m.join(descendants.select("type").distinct(), "type", "left_semi")
    if overrides_only:
        m = m.where("is_override")
    if attributed is not None:
        m = m.join(attributed.select(F.col("method").alias("symbol_id")).distinct(), "symbol_id", "left_semi")
    if parameter_types:
        params = F.transform(docid.top_level_split(F.regexp_extract("symbol_id", r"\((.*)\)", 1), "{}()[]"), lambda p: F.substring_index(docid.strip_generic(p), ".", -1))
        for p in parameter_types:
            m = m.where(F.array_contains(params, p))
    rows = m.select(F.lit(kind).alias("kind"), F.col("symbol_id").alias("method"), F.concat(docid.short_name("symbol_id")).alias("route"), "file_path", "line").distinct()
    return first_by(rows, ["file_path", "line"], ["method"])


def handoffs(edges: DataFrame) -> DataFrame:
    """(target, registered_in, file_path, line, dispatcher): handoff and method group edges once per target and place;
    one that names its dispatcher wins over one that doesn't."""
    e = edges.where(F.col("kind").isin("handoff", "methodGroup"))
    return e.groupBy(F.col("to_sym").alias("target"), F.col("from_sym").alias("registered_in"), "file_path", "line").agg(F.min("handoff_dispatcher").alias("dispatcher"))


def promote(origins: DataFrame, existing: DataFrame) -> DataFrame:
    """Origins (COLUMNS) whose route no existing entry point has, one per route."""
    return first_by(origins.join(existing.select("route").where("route is not null"), "route", "left_anti"), ["route"], ["method", "file_path", "line"]).select(*origins.columns)


def listing(derived: DataFrame, promoted: DataFrame) -> DataFrame:
    """All entry points once per kind, route and place, with the least method; order by kind and route."""
    return first_by(derived.select(*COLUMNS).unionByName(promoted.select(*COLUMNS)).distinct(), ["kind", "route", "file_path", "line"], ["method"])


def active_in(entry_points: DataFrame, services: DataFrame) -> DataFrame:
    """(method, service): where an entry point is active: it asks for nothing (``requires`` null or empty), or shares
    something with what the service ``provides``. ``services`` (service, provides) is configuration, small by nature."""
    needs = entry_points.select("method", F.explode_outer(F.when(F.size("requires") > 0, F.col("requires"))).alias("need")).distinct()
    offers = services.select("service", F.explode("provides").alias("need")).distinct()
    asked = needs.where("need is not null").join(offers, "need").select("method", "service")
    every = services.select("service").distinct().withColumn("__any", F.lit(1))
    free = needs.where("need is null").select("method", F.lit(1).alias("__any")).join(F.broadcast(every), "__any").select("method", "service")
    return asked.unionAll(free).distinct()


def locate(entry_points: DataFrame, methods: DataFrame) -> DataFrame:
    """Entry points joined with the method at their place (file_path, line), the least id where there are several."""
    m = methods.groupBy("file_path", "line").agg(F.min("symbol_id").alias("located"))
    return entry_points.join(m, ["file_path", "line"], "left")
