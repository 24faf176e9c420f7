"""Queries over effects, entry points, observations and hazards."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import docid
from factweave.operators import closure as C
from factweave.operators import dispatch as D
from factweave.operators import effects as X
from factweave.operators import entrypoints as EP
from factweave.operators import graph as G
from factweave.operators import hazards as H
from factweave.operators import relational as R
from factweave.plans import projection as P
from factweave.plans._base import Book
from factweave.sources.tables import table as T

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL

#: Rules for the platform that the tables' programs call.
RULES = [
    X.EffectRule("http", "send", ("Collect", "Dispatch"), ("Corvane.Http",), resource="http_argument"),
    X.EffectRule("queue", "publish", ("Attach", "Dispatch", "Enqueue"), ("Corvane.Messaging",), resource="string_argument_or_receiver"),
    X.EffectRule("db", "write", ("Rebuild", "Archive", "Append"), ("Corvane.Collections", "Corvane.Text"), resource="receiver_type"),
    X.EffectRule("mail", "send", ("Export", "Archive", "Project", "Schedule", "Seal"), ("Corvane.Mail",), resource="declaring_type"),
    X.EffectRule("cache", "evict", ("Seal", "Project", "Schedule", "Archive", "Enqueue"), ("Corvane.Caching",), resource="declaring_type"),
    X.EffectRule("db", "write", ("Rebuild", "Append"), ("Corvane",), resource="declaring_type"),
    X.EffectRule("shared_state", "mutate", ("Export",), ("Corvane.Runtime",), resource="string_argument_or_receiver"),
]

_FACTS = "select distinct target_symbol_id, enclosing_symbol_id, file_path, line, receiver_type, first_argument_template, enclosing_loop_kind, enclosing_loop_detail, enclosing_guards from reference_facts where ref_kind = 'invocation' and target_symbol_id is not null"
_DECL = r"regexp_replace(regexp_extract(substr(split_part(target_symbol_id, '(', 1), 3), '^(.*)[.][^.]*$', 1), '`+\d*', '', 'g')"
_NAME = r"regexp_replace(regexp_extract(split_part(target_symbol_id, '(', 1), '[^.]*$'), '`+\d*', '', 'g')"
_BARE = "split_part(split_part(regexp_replace(receiver_type, '<.*>', ''), '{', 1), '`', 1)"
_RES = {
    "receiver_type": "receiver_type",
    "declaring_type": "decl",
    "string_argument_or_receiver": f"coalesce(nullif(first_argument_template, ''), nullif({_BARE}, ''), decl)",
    "http_argument": f"coalesce(nullif(regexp_replace(first_argument_template, '^/+', ''), ''), nullif({_BARE}, ''))",
}


def _rule_sql() -> str:
    """The rules as SQL: each rule's matches with its number, then the least number per fact."""
    parts = []
    for i, r in enumerate(RULES):
        names = ", ".join(f"'{m}'" for m in r.methods)
        gates = " or ".join(f"decl = '{g}' or starts_with(decl, '{g}.')" for g in r.declaring)
        parts.append(f"select *, {i} as ord, '{r.provider}' as provider, '{r.operation}' as operation, {_RES[r.resource]} as resource from f where name in ({names}) and ({gates})")
    return f"""f as (select *, {_DECL} as decl, {_NAME} as name from ({_FACTS}) where target_symbol_id like 'M:%'), hit as ({" union all ".join(parts)}),
      effects as (select * exclude (rn) from (select *, row_number() over (partition by target_symbol_id, enclosing_symbol_id, file_path, line, receiver_type, first_argument_template, enclosing_loop_kind, enclosing_loop_detail, enclosing_guards order by ord) as rn
        from hit where trim(resource) <> '') where rn = 1)"""


EFFECTS_SQL = _rule_sql()


def effects(spark, d):
    return X.invocation_effects(T(spark, d, "reference_facts"), RULES)


@book.query(f"with {EFFECTS_SQL} select provider, operation, resource, enclosing_symbol_id, file_path, line, target_symbol_id from effects")
def g1_invocation_effects(spark, d):
    return effects(spark, d).select(*X.EFFECT_COLUMNS)


@book.query(f"with {EFFECTS_SQL} select provider, operation, count(*) as n from effects group by 1, 2")
def i1_effect_counts(spark, d):
    return effects(spark, d).groupBy("provider", "operation").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@book.query(f"with {EFFECTS_SQL} select provider, operation, count(*) as n from effects where provider = 'db' or (provider = 'queue' and operation = 'publish') group by 1, 2")
def c7_effect_filter(spark, d):
    e = X.filter_effects(effects(spark, d), only=["DB", "queue:publish", "http"], exclude=["HTTP"])
    return e.groupBy("provider", "operation").agg(F.count(F.lit(1)).alias("n"))


@book.query(
    """with w as (select distinct enclosing_symbol_id as s from reference_facts where ref_kind = 'invocation' and contains(target_symbol_id, 'Corvane.Http') and enclosing_symbol_id is not null)
       select 'http' as provider, 'wrapped' as operation, regexp_replace(regexp_extract(substr(split_part(target_symbol_id, '(', 1), 3), '^(.*)[.][^.]*$', 1), '`+\\d*', '', 'g') as resource, enclosing_symbol_id, file_path, line, target_symbol_id
       from (select distinct enclosing_symbol_id, file_path, line, target_symbol_id from reference_facts where ref_kind = 'invocation' and target_symbol_id in (select s from w))"""
)
def g2_wrapper_effects(spark, d):
    return X.wrapper_effects(T(spark, d, "reference_facts"), [X.EffectRule("http", "wrapped", calls="Corvane.Http", resource="declaring_type")])


@book.query(
    rf"""select distinct 'log' as provider, 'open' as operation, {_DECL} as resource, enclosing_symbol_id, file_path, line, target_symbol_id from reference_facts
        where ref_kind = 'ctor' and target_symbol_id like 'M:%' and (starts_with({_DECL}, 'Corvane.Logging.') or starts_with({_DECL}, 'Corvane.Text.'))"""
)
def g3_constructor_effects(spark, d):
    return X.constructor_effects(T(spark, d, "reference_facts"), [X.EffectRule("log", "open", declaring=("Corvane.Logging", "Corvane.Text"))]).select(*X.EFFECT_COLUMNS).distinct()


@book.query(
    """select distinct 'throw' as provider, 'raise' as operation, regexp_extract(substr(split_part(target_symbol_id, '(', 1), 3), '^(.*)[.][^.]*$', 1) as resource, enclosing_symbol_id, file_path, line, target_symbol_id
       from reference_facts where ref_kind = 'throw' and target_symbol_id like 'M:Corvane.%'"""
)
def g4_throw_effects(spark, d):
    return X.throw_effects(T(spark, d, "reference_facts"), [X.EffectRule("throw", "raise", declaring=("Corvane",))]).select(*X.EFFECT_COLUMNS).distinct()


_W = """select file_path, line, target_symbol_id, min(enclosing_symbol_id) as enclosing_symbol_id from reference_facts where ref_kind = 'write' and enclosing_symbol_id is not null
        and target_symbol_id in (select symbol_id from symbol_facts where kind in ('field', 'property') and contains(modifiers, 'static')) group by 1, 2, 3"""


@book.query(f"select 'shared_state' as provider, 'mutate' as operation, target_symbol_id as resource, enclosing_symbol_id, file_path, line, target_symbol_id from ({_W})")
def g5_static_write_effects(spark, d):
    w = R.static_accesses(T(spark, d, "reference_facts"), T(spark, d, "symbol_facts"), "write")
    own = [r[0] for r in w.select(F.substring_index(docid.param_free_name("target_symbol_id"), ".", 1).alias("n")).distinct().collect()]
    return X.static_effects(w, [X.EffectRule("shared_state", "mutate", declaring=tuple(sorted(own)))])


@book.query(
    f"""with {EFFECTS_SQL} select provider, count(*) as effects, sum(case when enclosing_loop_kind is not null then 1 else 0 end)::bigint as looped,
        sum(case when enclosing_loop_kind = 'foreach' and regexp_extract(enclosing_loop_detail, '(\\S+)\\s+in\\s', 1) <> '' and list_contains(string_split_regex(coalesce(first_argument_template, ''), '[^a-zA-Z0-9_]+'), regexp_extract(enclosing_loop_detail, '(\\S+)\\s+in\\s', 1)) then 1 else 0 end)::bigint as n_plus_1 from effects group by 1"""
)
def h1_observations(spark, d):
    o = X.observations(effects(spark, d))
    n = lambda t: F.sum(F.exists("observations", lambda x: x["type"] == t).cast("int")).alias({"looped_effect": "looped"}.get(t, t))
    return o.groupBy("provider").agg(F.count(F.lit(1)).alias("effects"), n("looped_effect"), n("n_plus_1"))


@book.query(f"with {EFFECTS_SQL} select 'looped_effect' as type, count(*) as n from effects where enclosing_loop_kind is not null")
def i4_observation_counts(spark, d):
    o = X.observations(effects(spark, d), n_plus_1=False).select(F.explode("observations").alias("o"))
    return o.groupBy(F.col("o.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


_RACE = """r as (select enclosing_symbol_id, target_symbol_id as cell, min(line) as read_line from reference_facts where ref_kind = 'read' and enclosing_symbol_id is not null and target_symbol_id is not null and not contains(enclosing_symbol_id, '#cctor') group by 1, 2),
    w as (select distinct enclosing_symbol_id, target_symbol_id as cell, line as write_line from reference_facts where ref_kind = 'write' and enclosing_symbol_id is not null and target_symbol_id is not null and not contains(enclosing_symbol_id, '#cctor')),
    races as (select * from w join r using (enclosing_symbol_id, cell) where read_line < write_line)"""


def _cells(spark, d):
    r = T(spark, d, "reference_facts").where("enclosing_symbol_id is not null and target_symbol_id is not null").select("enclosing_symbol_id", F.col("target_symbol_id").alias("cell"), "line", "ref_kind")
    return r.where("ref_kind = 'read'").drop("ref_kind"), r.where("ref_kind = 'write'").drop("ref_kind")


@book.query(f"with {_RACE} select enclosing_symbol_id, cell, read_line, write_line, 'high' as confidence from races")
def h8_race_windows(spark, d):
    return H.race_windows(*_cells(spark, d))


_MEMBER = "regexp_extract(regexp_replace(split_part({c}, '(', 1), '^.:', ''), '[^.]*$')"
#: What the tables don't have: locked places, volatile cells and per-thread cells, projected from other columns.
_LOCKED = "locked as (select distinct enclosing_symbol_id, line from reference_facts where enclosing_guards is not null and enclosing_symbol_id is not null)"


@book.query(
    f"""with {_RACE}, {_LOCKED}, n as (select enclosing_symbol_id, target_symbol_id as cell, count(*) as n from reference_facts where ref_kind = 'write' and target_symbol_id is not null and enclosing_symbol_id is not null group by 1, 2),
        x as (select races.*, {_MEMBER.format(c='enclosing_symbol_id')} as member, lower(ltrim({_MEMBER.format(c='cell')}, '_')) as own, n, length(cell) % 7 = 0 as per_thread, length(cell) % 2 = 0 as volatile,
          (enclosing_symbol_id, write_line) in (select enclosing_symbol_id, line from locked) as held, (select max(line) from locked l where l.enclosing_symbol_id = races.enclosing_symbol_id) as last from races join n using (enclosing_symbol_id, cell)),
        y as (select *, case when per_thread then 'thread_local_context' when starts_with(member, 'get_') or member in ('#ctor', '#cctor') or contains(lower(member), 'init') or (n = 1 and own in ('instance', 'initialised', 'initialized')) then 'lazy_init_race' else 'race_window' end as hazard from x)
        select enclosing_symbol_id, cell, read_line, write_line, case hazard when 'race_window' then 'high' else 'low' end as confidence, hazard, case when hazard = 'lazy_init_race' and held then 'locked' else 'open' end as tier
        from y where not (hazard = 'lazy_init_race' and held and volatile and write_line >= last)"""
)
def h9_lazy_init_races(spark, d):
    reads, writes = _cells(spark, d)
    locked = T(spark, d, "reference_facts").where("enclosing_guards is not null and enclosing_symbol_id is not null").select("enclosing_symbol_id", "line").distinct()
    cells = writes.select("cell").distinct()
    return H.lazy_init_races(H.race_windows(reads, writes), writes, locked, cells.where("length(cell) % 2 = 0"), cells.where("length(cell) % 7 = 0"))


@book.query(
    f"""with {_RACE}, tx as (select distinct enclosing_symbol_id, line from reference_facts where line % 3 = 0 and enclosing_symbol_id is not null)
        select enclosing_symbol_id, cell, read_line, write_line, case when (enclosing_symbol_id, read_line) in (select enclosing_symbol_id, line from tx) and (enclosing_symbol_id, write_line) in (select enclosing_symbol_id, line from tx) then 'medium' else 'high' end as confidence from races"""
)
def h8_races_in_transactions(spark, d):
    tx = T(spark, d, "reference_facts").where("line % 3 = 0 and enclosing_symbol_id is not null").select("enclosing_symbol_id", "line")
    return H.race_windows(*_cells(spark, d), tx)


#: The systems that the effects of RULES commit to; what isn't listed is no durable write.
SYSTEMS = {"db:write": "db", "queue": "queue", "http:send": "http", "mail:send": "email"}
_CLASS = "case when provider = 'db' and operation = 'write' then 'db' when provider = 'queue' then 'queue' when provider = 'http' and operation = 'send' then 'http' when provider = 'mail' and operation = 'send' then 'email' end"


@book.query(
    f"""with {EFFECTS_SQL} select enclosing_symbol_id, array_to_string(list_sort(list_distinct(list({_CLASS}))), '+') as context, count(*) as sites, max(line) as last_line, min(case when line = ml then provider end) as last_provider
        from (select *, max(line) over (partition by enclosing_symbol_id) as ml from effects where {_CLASS} is not null and enclosing_symbol_id is not null) group by 1 having count(distinct {_CLASS}) > 1"""
)
def h11_dual_writes(spark, d):
    return H.dual_writes(effects(spark, d), SYSTEMS)


@book.query(
    f"""with {EFFECTS_SQL}, w as (select *, {_CLASS} as system from effects where {_CLASS} is not null and enclosing_symbol_id is not null) select enclosing_symbol_id, system, provider, operation, file_path, line
        from w where enclosing_symbol_id in (select enclosing_symbol_id from w group by 1 having count(distinct system) > 1)"""
)
def h11_dual_write_sites(spark, d):
    return H.dual_write_sites(effects(spark, d), SYSTEMS)


#: A rule for calls that wait for what is asynchronous.
BLOCKING = [X.EffectRule("async_block", "wait", ("Collect", "Dispatch", "Export"), ("Corvane.Http", "Corvane.Runtime"), resource="declaring_type")]


@book.query(
    rf"""select 'async_block' as provider, 'wait' as operation, {_DECL} as resource, enclosing_symbol_id, file_path, line, target_symbol_id from ({_FACTS})
        where target_symbol_id like 'M:%' and {_NAME} in ('Collect', 'Dispatch', 'Export') and (starts_with({_DECL}, 'Corvane.Http.') or starts_with({_DECL}, 'Corvane.Runtime.'))
          and enclosing_symbol_id in (select symbol_id from symbol_facts where list_contains(string_split(modifiers, ' '), 'async'))"""
)
def h12_sync_over_async(spark, d):
    return H.sync_over_async(X.invocation_effects(T(spark, d, "reference_facts"), BLOCKING), T(spark, d, "symbol_facts")).select(*X.EFFECT_COLUMNS)


_EDGES = "edges as (select distinct from_sym as src, to_sym as dst from call_edges where kind <> 'handoff')"


def _sync_edges(spark, d):
    return C.edge_list(G.gate_handoffs(T(spark, d, "call_edges"), "sync_cut"))


@book.query(
    f"""with recursive {_EDGES}, {EFFECTS_SQL}, a as (select distinct enclosing_symbol_id, resource from effects where provider = 'db' and enclosing_symbol_id is not null),
        c as (select distinct enclosing_symbol_id as node, resource from effects where provider = 'shared_state'), r(seed, node) as (select distinct enclosing_symbol_id, enclosing_symbol_id from a union select seed, dst from r join edges on src = node)
        select enclosing_symbol_id, resource, 'high' as certainty from a where (enclosing_symbol_id, resource) not in (select seed, resource from r join c using (node))"""
)
def h14_missing_companions(spark, d):
    return H.missing_companions(effects(spark, d), _sync_edges(spark, d), "db:write", "shared_state:mutate")


@book.query(f"with {_RACE} select 'race_window' as kind, enclosing_symbol_id as method, count(*) as sites, count(*) as high, 0::bigint as medium, 0::bigint as low from races group by 2")
def i5_hazard_rollup(spark, d):
    return H.rollup(H.race_windows(*_cells(spark, d)).withColumn("kind", F.lit("race_window")), "kind", "enclosing_symbol_id", "confidence")


@book.query(
    f"""with recursive {_EDGES}, {_RACE}, t(node) as (select distinct from_sym from call_edges where contains(lower(from_sym), 'controller.render') union select dst from t join edges on src = node)
        select enclosing_symbol_id as method, 'race_window' as kind, 'high' as confidence, count(*) as sites from races where enclosing_symbol_id in (select node from t) group by 1"""
)
def h17_hazards_on_tree(spark, d):
    seeds = R.match_nodes(T(spark, d, "call_edges").select(F.col("from_sym").alias("node")).distinct(), "node", "Controller.Render")
    tree = C.reach(_sync_edges(spark, d), seeds)
    return H.on_tree(H.race_windows(*_cells(spark, d)).withColumn("kind", F.lit("race_window")), tree, "kind", "enclosing_symbol_id", "confidence")


@book.query(f"with {_RACE} select enclosing_symbol_id, cell, write_line from races where not starts_with(lower(regexp_replace(split_part(enclosing_symbol_id, '(', 1), '^.:', '')), 'corvane')")
def c9_excluded_namespaces(spark, d):
    return H.without_namespaces(H.race_windows(*_cells(spark, d)), "enclosing_symbol_id", ["CORVANE"]).select("enclosing_symbol_id", "cell", "write_line")


@book.query(
    f"""with recursive {_EDGES}, {EFFECTS_SQL}, r(node, depth) using key (node) as (select distinct from_sym, 0 from call_edges where contains(lower(from_sym), 'controller.render') union select dst, min(depth) + 1 from r join edges on src = node where dst not in (select node from recurring.r) group by dst),
        m as (select node, depth from r) select provider, operation, min(depth)::int as nearest, count(*) as sites from effects join m on node = enclosing_symbol_id group by 1, 2"""
)
def j17_reaches(spark, d):
    return reaches(spark, d, "Controller.Render")


def reaches(spark, d, pattern):
    """(provider, operation, nearest, sites): the effects below the methods that a pattern matches, without handoffs."""
    seeds = R.match_nodes(T(spark, d, "call_edges").select(F.col("from_sym").alias("node")).distinct(), "node", pattern)
    m = C.reach(_sync_edges(spark, d), seeds)
    return effects(spark, d).join(m, F.col("node") == F.col("enclosing_symbol_id")).groupBy("provider", "operation").agg(F.min("depth").alias("nearest"), F.count(F.lit(1)).alias("sites"))


@book.query(
    f"""with recursive all_edges as (select distinct from_sym as src, to_sym as dst from call_edges), {_EDGES}, {EFFECTS_SQL},
        s(node) as (select distinct from_sym from call_edges where contains(lower(from_sym), 'controller.render')),
        direct(node) as (select node from s union select dst from direct join edges on src = node), every(node) as (select node from s union select dst from every join all_edges on src = node)
        select case when enclosing_symbol_id in (select node from direct) then 'direct' else 'scheduled' end as bucket, provider, count(*) as n from effects where enclosing_symbol_id in (select node from every) group by 1, 2"""
)
def i3_effect_buckets(spark, d):
    e = T(spark, d, "call_edges")
    seeds = R.match_nodes(e.select(F.col("from_sym").alias("node")).distinct(), "node", "Controller.Render")
    direct = C.reach(_sync_edges(spark, d), seeds).select(F.col("node").alias("enclosing_symbol_id"), F.lit(True).alias("__d"))
    every = C.reach(C.edge_list(e), seeds).select(F.col("node").alias("enclosing_symbol_id"))
    x = effects(spark, d).join(every, "enclosing_symbol_id", "left_semi").join(direct, "enclosing_symbol_id", "left")
    return x.groupBy(F.when(F.col("__d"), "direct").otherwise("scheduled").alias("bucket"), "provider").agg(F.count(F.lit(1)).alias("n"))


@book.query(
    """select handoff_dispatcher as dispatcher, delivery_precision as precision, count(*) as n, count(distinct to_sym) as targets from (select distinct * from call_edges) where kind = 'handoff' group by 1, 2"""
)
def i2_async_buckets(spark, d):
    e = T(spark, d, "call_edges").distinct().where("kind = 'handoff'")
    return e.groupBy(F.col("handoff_dispatcher").alias("dispatcher"), F.col("delivery_precision").alias("precision")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("to_sym").alias("targets"))


@book.query("select to_sym as target, from_sym as registered_in, file_path, line, min(handoff_dispatcher) as dispatcher from call_edges where kind in ('handoff', 'methodGroup') group by 1, 2, 3, 4")
def g13_handoff_entry_points(spark, d):
    return EP.handoffs(T(spark, d, "call_edges"))


_BELOW = "below(type) as (select symbol_id from types where k = 1 union select type_symbol_id from below join relations on related_symbol_id = type where relation_kind = 'base')"
_BARE_T = "split_part(split_part({c}, '{{', 1), '`', 1)"


@book.query(
    f"""with recursive {P.SQL_TYPES}, {_BELOW}, b as (select distinct {_BARE_T.format(c='type')} as type from below),
        m as (select distinct symbol_id, file_path, line from symbol_facts where kind = 'method' and containing_symbol_id like 'T:%'),
        x as (select *, regexp_replace(regexp_extract(split_part(symbol_id, '(', 1), '[^.]*$'), '`+\\d*', '', 'g') as own, 'T:' || {_BARE_T.format(c="regexp_extract(substr(split_part(symbol_id, '(', 1), 3), '^(.*)[.][^.]*$', 1)")} as t from m)
        select 'handler' as kind, min(symbol_id) as method, file_path, line from x where (own like 'Render%' or own like 'Apply%') and t in (select type from b) group by file_path, line"""
)
def g12_inherited_entry_points(spark, d):
    roots = [r.symbol_id for r in P.types(spark, d).where("k = 1").collect()]
    below = D.type_closure(P.type_relations(spark, d), roots)
    m = T(spark, d, "symbol_facts").where("kind = 'method' and containing_symbol_id like 'T:%'").select("symbol_id", "file_path", "line", "is_override")
    return EP.inherited(m, below, ["Render*", "Apply*"], "handler").select("kind", "method", "file_path", "line")


@book.query(
    f"""with recursive {P.SQL_TYPES}, {_BELOW}, b as (select distinct {_BARE_T.format(c='type')} as type from below),
        t as (select distinct symbol_id, file_path, line from symbol_facts where kind = 'type' and not list_contains(string_split(modifiers, ' '), 'abstract')),
        k as (select distinct symbol_id as method, containing_symbol_id as type, file_path, line from symbol_facts where name = '.ctor' and kind = 'method'),
        x as (select coalesce(k.method, t.symbol_id) as method, coalesce(k.file_path, t.file_path) as file_path, coalesce(k.line, t.line) as line from t left join k on k.type = t.symbol_id where {_BARE_T.format(c='t.symbol_id')} in (select type from b))
        select file_path, line, min(method) as method from x group by 1, 2"""
)
def g10_page_entry_points(spark, d):
    roots = [r.symbol_id for r in P.types(spark, d).where("k = 1").collect()]
    below = D.type_closure(P.type_relations(spark, d), roots)
    s = T(spark, d, "symbol_facts")
    types = s.where("kind = 'type'").select("symbol_id", "modifiers", "file_path", "line").distinct()
    ctors = s.where("name = '.ctor' and kind = 'method'").select("symbol_id", F.col("containing_symbol_id").alias("type"), "file_path", "line").distinct()
    return EP.pages(types, ctors, below, "").select("file_path", "line", "method")


@book.query(
    """with r as (select distinct file_path, line, enclosing_symbol_id as method, 'T:' || split_part(split_part(regexp_extract(substr(split_part(enclosing_symbol_id, '(', 1), 3), '^(.*)[.][^.]*$', 1), '{', 1), '`', 1) as type
         from reference_facts where starts_with(target_symbol_id, 'M:Corvane.Logging') and ref_kind = 'ctor' and enclosing_symbol_id is not null)
       select file_path, line, min(method) as method from r where contains(type, 'Controller') group by 1, 2"""
)
def g11_action_entry_points(spark, d):
    r = T(spark, d, "reference_facts").where("ref_kind = 'ctor'")
    controllers = r.where("enclosing_symbol_id is not null").select(docid.strip_generic(docid.method_type("enclosing_symbol_id")).alias("type")).where("type like '%Controller%'").distinct()
    return EP.actions(r, "M:Corvane.Logging", controllers, "").select("file_path", "line", "method")


def _listing(spark, d):
    a = g11_action_entry_points(spark, d).select(F.lit("action").alias("kind"), "method", docid.short_name("method").alias("route"), "file_path", "line")
    h = EP.handoffs(T(spark, d, "call_edges")).where("dispatcher is not null").select(F.lit("handoff").alias("kind"), F.col("target").alias("method"), docid.short_name("target").alias("route"), "file_path", "line")
    return EP.listing(a, EP.promote(h, a))


@book.query()
def g14_promoted_entry_points(spark, d):
    return _listing(spark, d)


@book.query()
def j20_entry_point_counts(spark, d):
    return _listing(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@book.query(
    """with services(service, need) as (values ('api', 'http'), ('api', 'db'), ('worker', 'queue')), e as (select distinct from_sym as method, case when kind = 'handoff' then 'queue' when kind = 'ctor' then 'db' end as need from call_edges where kind in ('handoff', 'ctor', 'delegate-field'))
       select distinct method, service from e join services using (need) union select method, service from (select method from e where need is null), (select distinct service from services)"""
)
def g15_active_in(spark, d):
    need = F.expr("case when kind = 'handoff' then array('queue') when kind = 'ctor' then array('db') end")
    e = T(spark, d, "call_edges").where("kind in ('handoff', 'ctor', 'delegate-field')").select(F.col("from_sym").alias("method"), need.alias("requires")).distinct()
    services = spark.createDataFrame([("api", ["http", "db"]), ("worker", ["queue"])], "service string, provides array<string>")
    return EP.active_in(e, services)
