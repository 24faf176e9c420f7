"""Queries over structure that the test tables lack: a fixed projection adds it to every reference.

What encloses a call, its type arguments and its argument lists follow from the line's number, so that every branch of
the rules has rows; both engines compute the same projection over the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import docid
from factweave.operators import bounded as B
from factweave.operators import closure as C
from factweave.operators import dispatch as D
from factweave.operators import effects as X
from factweave.operators import entrypoints as EP
from factweave.operators import generics as N
from factweave.operators import hazards as H
from factweave.operators import impact as I
from factweave.operators import relational as R
from factweave.operators import search as S
from factweave.plans import projection as P
from factweave.plans._base import Book
from factweave.plans.derive import _DECL, _NAME, EFFECTS_SQL, effects
from factweave.plans.graphs import _ARITY, MINED_SQL, _edges, _seeds
from factweave.plans.more import _BIND, _MONO, _bindings
from factweave.sources.tables import table as T

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL

_US, _RS = "chr(31)", "chr(30)"
#: SQL that both engines understand.
STRUCTURE = {
    "provider": "case line % 3 when 0 then 'db' when 1 then 'http' else 'queue' end",
    "enclosing_invocations": f"case line % 5 when 0 then concat('p', {_US}, 'Parallel', {_US}, 'ForEach') when 1 then concat('q', {_US}, 'My.RetryPolicy', {_US}, 'Execute', {_RS}, 'p', {_US}, 'Parallel', {_US}, 'Invoke')"
    f" when 2 then concat('a', {_US}, 'Parallel', {_US}, 'Invoke', {_RS}, 'b', {_US}, 'Parallel', {_US}, 'ForEach', {_RS}, 'c', {_US}, 'RetryAsync', {_US}, 'Run') when 3 then 'broken' end",
    "enclosing_catch_types": f"case line % 7 when 0 then 'DbConcurrencyException' when 1 then concat('IOException', {_RS}, 'ConcurrencyError') when 2 then 'IOException' end",
    "enclosing_scopes": f"case line % 4 when 0 then concat('using', {_US}, 'System.TransactionScope') when 1 then concat('lock', {_US}, '_gate', {_RS}, 'using', {_US}, 'TransactionScope') when 2 then concat('using', {_US}, 'Stream') end",
    "type_arguments": "case line % 6 when 0 then 'System.Dictionary<System.Int32,System.String>, System.Int64' when 1 then 'Corvane.Row' when 2 then 'Lang.Option<Corvane.Row>' when 3 then ' ' end",
    "argument_templates": "case line % 8 when 0 then '[\"/a/{id}\",\"second\"]' when 1 then '[null,\"only\"]' when 2 then '[]' when 3 then 'no json' end",
    "argument_names": "case line % 3 when 0 then '[\"key\",\"value\"]' when 1 then '[\" \"]' end",
    "first_argument_name": "case line % 2 when 0 then 'first' end",
    "first_argument_type": "case line % 5 when 0 then 'Corvane.Context' when 1 then '' end",
}
_COLS = "target_symbol_id, enclosing_symbol_id, file_path, line, receiver_type, first_argument_template, enclosing_loop_kind, enclosing_loop_detail, enclosing_guards"
_INV = f"inv as (select *, {', '.join(f'{v} as {k}' for k, v in STRUCTURE.items())} from (select distinct {_COLS} from reference_facts where ref_kind = 'invocation' and target_symbol_id is not null))"
_SITE = ["target_symbol_id", "enclosing_symbol_id", "file_path", "line"]


def structured(spark, d):
    """The distinct invocations with the projected structure."""
    r = T(spark, d, "reference_facts").where("ref_kind = 'invocation' and target_symbol_id is not null").select(*_COLS.split(", ")).distinct()
    return r.withColumns({k: F.expr(v.replace("chr(31)", "'\\u001f'").replace("chr(30)", "'\\u001e'")) for k, v in STRUCTURE.items()}).withColumn("operation", F.lit("call"))


def _observed(spark, d, kind, **rules):
    o = X.observations(structured(spark, d), n_plus_1=False, **rules).select(*_SITE, "provider", F.explode("observations").alias("o"))
    return o.where(F.col("o.type") == kind).select(*_SITE, "provider", "o.context", "o.detail", "o.confidence")


# the entries of a packed list that have n fields, innermost first
_LIST = "list_filter(list_transform(string_split(coalesce({c}, ''), chr(30)), lambda e: string_split(e, chr(31))), lambda e: len(e) = {n})"
_SITES = ", ".join(_SITE)


@book.query(
    f"""with {_INV}, x as (select *, list_filter({_LIST.format(c='enclosing_invocations', n=3)}, lambda e: e[2] = 'Parallel' and e[3] in ('ForEach', 'Invoke')) as hit from inv)
        select {_SITES}, provider, hit[1][2] as context, hit[1][3] as detail, 'high' as confidence from x where len(hit) > 0"""
)
def h2_parallel_fanout(spark, d):
    return _observed(spark, d, "parallel_fanout", fanout=[("Parallel", "ForEach"), ("Parallel", "Invoke")])


@book.query(
    f"""with {_INV}, x as (select *, list_filter({_LIST.format(c='enclosing_invocations', n=3)}, lambda e: e[3] = 'Run' and contains(e[2], 'Retry')) as a, list_filter({_LIST.format(c='enclosing_invocations', n=3)}, lambda e: e[3] = 'Execute' and contains(e[2], 'RetryPolicy')) as b from inv),
        y as (select *, case when len(a) > 0 then a else b end as hit from x) select {_SITES}, provider, hit[1][2] as context, hit[1][3] as detail, 'medium' as confidence from y where len(hit) > 0"""
)
def h3_resilience_retry(spark, d):
    return _observed(spark, d, "resilience_retry", retry=[("Run", "Retry"), ("Execute", "RetryPolicy")])


@book.query(
    f"""with {_INV}, x as (select *, {_NAME} as own, list_filter(string_split(enclosing_catch_types, chr(30)), lambda t: contains(t, 'Concurrency')) as hit from inv where target_symbol_id like 'M:%.%')
        select {_SITES}, provider, hit[1] as context, own as detail, 'high' as confidence from x where len(hit) > 0 and own in ('Append', 'Archive', 'Seal', 'Project', 'Export', 'Dispatch')"""
)
def h4_concurrency_handled(spark, d):
    return _observed(spark, d, "concurrency_handled", commits=["Append", "Archive", "Seal", "Project", "Export", "Dispatch"])


@book.query(
    f"""with {_INV}, x as (select *, {_LIST.format(c='enclosing_scopes', n=2)} as s from inv), y as (select *, list_filter(s, lambda e: e[1] = 'using' and contains(e[2], 'TransactionScope')) as t, list_filter(s, lambda e: e[1] = 'lock' and contains(e[2], '_')) as l from x)
        select {_SITES}, provider, 'transaction_spans_effect' as type, t[1][2] as detail from y where len(t) > 0 and provider <> 'db' union all select {_SITES}, provider, 'lock_held_across_effect', l[1][2] from y where len(l) > 0"""
)
def h5_resource_spans(spark, d):
    rules = [{"type": "transaction_spans_effect", "kind": "using", "text": "TransactionScope", "deny": ["db"]}, {"type": "lock_held_across_effect", "kind": "lock", "text": "_"}]
    o = X.observations(structured(spark, d), n_plus_1=False, spans=rules).select(*_SITE, "provider", F.explode("observations").alias("o"))
    return o.where("o.type in ('transaction_spans_effect', 'lock_held_across_effect')").select(*_SITE, "provider", "o.type", "o.detail")


_PAYLOAD = [{"texts": ["Option<", "Either<"], "providers": ["db", "queue"]}, {"texts": ["Dictionary<"]}]


@book.query(
    f"""with {_INV}, x as (select *, case when provider in ('db', 'queue') and contains(type_arguments, 'Option<') then 'Option<' when provider in ('db', 'queue') and contains(type_arguments, 'Either<') then 'Either<' when contains(type_arguments, 'Dictionary<') then 'Dictionary<' end as hit from inv)
        select {_SITES}, provider, hit as context, type_arguments as detail, 'high' as confidence from x where hit is not null"""
)
def h6_unserializable_payload(spark, d):
    return _observed(spark, d, "unserializable_payload", payload=_PAYLOAD)


@book.query(
    f"""with {_INV}, x as (select case when provider in ('db', 'queue') and contains(type_arguments, 'Option<') then 1 when contains(type_arguments, 'Dictionary<') then 1 end as payload, enclosing_loop_kind is not null as looped, list_filter({_LIST.format(c='enclosing_scopes', n=2)}, lambda e: e[1] = 'lock') as l from inv)
        select 'unserializable_payload' as type, true as is_hazard, count(payload) as n from x union all select 'looped_effect', false, count(*) from x where looped union all select 'lock_held_across_effect', false, count(*) from x where len(l) > 0"""
)
def h16_hazard_split(spark, d):
    o = X.observations(structured(spark, d), n_plus_1=False, payload=_PAYLOAD, spans=[{"type": "lock_held_across_effect", "kind": "lock", "text": ""}]).select(F.explode("observations.type").alias("type"))
    return o.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select("type", F.col("type").isin(X.HAZARD_TYPES).alias("is_hazard"), "n")


@book.query(f"with {_INV} select {_SITES}, 'unserializable_payload' as hazard, 'high' as confidence from inv where (provider in ('db', 'queue') and contains(type_arguments, 'Option<')) or contains(type_arguments, 'Dictionary<')")
def j23_flattened_hazards(spark, d):
    o = X.observations(structured(spark, d), n_plus_1=False, payload=_PAYLOAD, spans=[{"type": "lock_held_across_effect", "kind": "lock", "text": ""}])
    return X.flatten_hazards(o).select(*_SITE, "hazard", "confidence")


_ALLOC = f"select distinct enclosing_symbol_id, file_path, line, {_DECL} as resource_type, enclosing_loop_kind as loop_kind, enclosing_loop_detail as loop_detail, enclosing_guards as guards, case line % 3 when 0 then 'cached_first_use' end as cardinality, line * 8 as size from reference_facts where ref_kind = 'ctor' and target_symbol_id like 'M:%'"


def allocations(spark, d):
    r = T(spark, d, "reference_facts").where("ref_kind = 'ctor' and target_symbol_id like 'M:%'")
    return r.select(
        "enclosing_symbol_id", "file_path", "line", docid.declaring_type("target_symbol_id").alias("resource_type"), F.col("enclosing_loop_kind").alias("loop_kind"), F.col("enclosing_loop_detail").alias("loop_detail"),
        F.col("enclosing_guards").alias("guards"), F.expr("case line % 3 when 0 then 'cached_first_use' end").alias("cardinality"), (F.col("line") * 8).alias("shallow_size_bytes"),
    ).distinct().withColumns({"operation": F.lit("object"), "mechanism": F.lit("new"), "size_confidence": F.lit("high"), "size_basis": F.lit("fields")})


@book.query(f"select 'alloc' as provider, 'object' as operation, resource_type as resource, enclosing_symbol_id, file_path, line, case when cardinality is null then loop_kind end as enclosing_loop_kind, cardinality, size::bigint as size_bytes from ({_ALLOC})")
def g6_allocation_effects(spark, d):
    return X.allocation_effects(allocations(spark, d)).select("provider", "operation", "resource", "enclosing_symbol_id", "file_path", "line", "enclosing_loop_kind", "cardinality", "size_bytes")


_REACH = "edges as (select distinct from_sym as src, to_sym as dst from call_edges), r(node) as (select distinct from_sym from call_edges where contains(lower(from_sym), 'controller.render') union select dst from r join edges on src = node)"


@book.query(f"with recursive {_REACH} select resource_type, count(*) as n from ({_ALLOC}) where enclosing_symbol_id in (select node from r) group by 1")
def d2_allocations_within_reach(spark, d):
    reached = C.reach(_edges(spark, d), _seeds(spark, d)).select("node")
    return B.facts_within(allocations(spark, d), reached).groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"))


@book.query(
    f"""with recursive {_REACH}, near as (select distinct from_sym, to_sym, line from call_edges where from_sym in (select node from r)),
        f as (select enclosing_symbol_id as from_sym, target_symbol_id as to_sym, line, min(ref_kind) as ref_kind from reference_facts where enclosing_symbol_id is not null and target_symbol_id is not null and enclosing_symbol_id in (select node from r) group by 1, 2, 3)
        select 'edge' as part, coalesce(ref_kind, 'none') as kind, count(*) as n from near left join f using (from_sym, to_sym, line) group by 1, 2
        union all select 'reference', ref_kind, count(*) from reference_facts where enclosing_symbol_id in (select node from r) and ref_kind in ('invocation', 'ctor', 'throw') group by 1, 2
        union all select 'allocation', 'object', count(*) from ({_ALLOC}) where enclosing_symbol_id in (select node from r)
        union all select 'method', 'method', count(distinct symbol_id) from symbol_facts where kind = 'method' and symbol_id in (select node from r)"""
)
def e3_bounded_subgraph(spark, d):
    """The closure with handoffs, then all that a traversal of it reads: edges with their references, facts and methods."""
    reached = C.reach(_edges(spark, d), _seeds(spark, d)).select("node")
    refs = T(spark, d, "reference_facts")
    edges = B.edges_within(T(spark, d, "call_edges").select("from_sym", "to_sym", "line").distinct(), reached)
    bound = B.attach(edges, B.facts_within(refs, reached), ["ref_kind"])
    n = lambda df, part, kind: df.groupBy(F.lit(part).alias("part"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return (
        n(bound, "edge", F.coalesce("ref_kind", F.lit("none"))).unionAll(n(B.facts_within(refs, reached, ["invocation", "ctor", "throw"]), "reference", F.col("ref_kind")))
        .unionAll(n(B.facts_within(allocations(spark, d), reached), "allocation", F.lit("object")))
        .unionAll(n(B.methods_within(T(spark, d, "symbol_facts").where("kind = 'method'"), reached).select("symbol_id").distinct(), "method", F.lit("method")))
    )


_VERBS = ["Collect", "Dispatch", "Attach", "Enqueue", "Rebuild", "Archive", "Append", "Export", "Project", "Schedule", "Seal"]
_GATED = [
    X.EffectRule("derived", "x", tuple(_VERBS), base_types=("Corvane.Base",), resource="declaring_type"),
    X.EffectRule("receiver", "x", tuple(_VERBS), receivers=("Corvane.Mail", "Corvane.Options"), resource="declaring_type"),
    X.EffectRule("suffix", "x", tuple(_VERBS), declaring=("Corvane",), declaring_suffix="a", resource="declaring_type"),
    X.EffectRule("within", "x", tuple(_VERBS), containing_namespaces=("Corvane",), resource="declaring_type"),
    X.EffectRule("member", "x", tuple(_VERBS), containing_methods=("#ctor",), resource="declaring_type"),
]
_UNDER = "({c} = '{g}' or starts_with({c}, '{g}.'))"
_BARE = "split_part(split_part(regexp_replace(receiver_type, '<.*>', ''), '{', 1), '`', 1)"
_WITHIN = _DECL.replace("target_symbol_id", "enclosing_symbol_id")


@book.query(
    rf"""with f as (select *, {_DECL} as decl, {_BARE} as bare, case when enclosing_symbol_id like 'M:%.%' then regexp_extract({_WITHIN}, '^(.*)[.][^.]*$', 1) end as ns,
          case when enclosing_symbol_id like 'M:%.%' then regexp_replace(regexp_extract(split_part(enclosing_symbol_id, '(', 1), '[^.]*$'), '`+\d*', '', 'g') end as member
          from (select distinct {_COLS} from reference_facts where ref_kind = 'invocation' and target_symbol_id like 'M:%.%') where {_NAME} in ({', '.join(f"'{v}'" for v in _VERBS)})),
        g as (select *, case when contains(decl, '.Open') then 'derived'
          when {_UNDER.format(c='decl', g='Corvane.Mail')} or {_UNDER.format(c='decl', g='Corvane.Options')} or {_UNDER.format(c='bare', g='Corvane.Mail')} or {_UNDER.format(c='bare', g='Corvane.Options')} then 'receiver'
          when {_UNDER.format(c='decl', g='Corvane')} and ends_with(decl, 'a') then 'suffix' when {_UNDER.format(c='ns', g='Corvane')} then 'within' when member = '#ctor' then 'member' end as provider from f)
        select provider, decl as resource, {_SITES} from g where provider is not null and trim(decl) <> ''"""
)
def g7_gated_effects(spark, d):
    """Every gate of effect rules in turn: base types, receivers, a suffix, the enclosing namespace and member."""
    refs = T(spark, d, "reference_facts")
    below = refs.where("ref_kind = 'invocation'").select(F.concat(F.lit("T:"), docid.declaring_type("target_symbol_id")).alias("type")).where("type like '%.Open%'").distinct()
    return X.invocation_effects(refs, _GATED, below).select("provider", "resource", *_SITE)


_ARG = "nullif(trim(regexp_extract({c}, '^((?:[^<>,]|<[^<>]*>)*)(?:,((?:[^<>,]|<[^<>]*>)*))?', {n})), '')"
_STR = "nullif(trim(try_cast(argument_templates as json)->>{n}), '')"


def _blank(*c):
    return "coalesce(" + ", ".join(f"case when trim({x}) <> '' then {x} end" for x in c) + ")"


_ST0, _ST1 = (f"case when argument_templates like '[%' then argument_templates::json->>{n} end" for n in (0, 1))
_AN0, _AN1 = (f"argument_names::json->>{n}" for n in (0, 1))
_G = {
    "receiver_type": _blank("recv"), "type_argument_0": _blank(_ARG.format(c="type_arguments", n=1)), "type_argument_1": _blank(_ARG.format(c="type_arguments", n=2)),
    "argument_name_0": _blank(_AN0, "first_argument_name"), "argument_name_1": _blank(_AN1), "declaring_type": _blank(_DECL), "argument_type": _blank("first_argument_type"),
    "string_argument_0": _blank(_ST0, "first_argument_template"), "string_argument_1": _blank(_ST1),
    "ef_query_root": _blank(_ARG.format(c="type_arguments", n=1), _ARG.format(c="inner_", n=1), "bare"), "ef_context_receiver": _blank(_ARG.format(c="type_arguments", n=1), "first_argument_type", "bare"),
    "ef_dbset_receiver": _blank(_ARG.format(c="inner_", n=1), _ARG.format(c="type_arguments", n=1)), "ef_database_facade": "'database'",
}


@book.query(
    f"""with {_INV}, x as (select *, case when line % 4 = 0 then 'Corvane.DbSet<Corvane.Row, System.Int32>' else receiver_type end as recv from inv where target_symbol_id like 'M:%'),
        y as (select *, split_part(split_part(regexp_replace(recv, '<.*>', ''), '{{', 1), '`', 1) as bare, regexp_extract(recv, '<(.*)>', 1) as inner_ from x)
        select {_SITES}, {', '.join(f'{v} as {k}' for k, v in _G.items())} from y"""
)
def g9_resource_strategies(spark, d):
    e = structured(spark, d).where("target_symbol_id like 'M:%'").withColumn("receiver_type", F.expr("case when line % 4 = 0 then 'Corvane.DbSet<Corvane.Row, System.Int32>' else receiver_type end"))
    named = lambda k: X.resource_of(k.rsplit("_", 1)[0], int(k[-1])) if k[-1].isdigit() else X.resource_of(k)
    return e.select(*_SITE, *[named(k).alias(k) for k in _G])


@book.query(
    f"""with {_INV} select distinct type_arguments, argument_templates, {_ARG.format(c='type_arguments', n=1)} as first_type, {_ARG.format(c='type_arguments', n=2)} as second_type,
        {_ST0} as first_text, {_ST1} as second_text from inv"""
)
def k8_nested_arguments(spark, d):
    a = structured(spark, d).select("type_arguments", "argument_templates").distinct()
    return a.select(
        "type_arguments", "argument_templates", docid.nth_type_argument("type_arguments", 0).alias("first_type"), docid.nth_type_argument("type_arguments", 1).alias("second_type"),
        docid.nth_json_string("argument_templates", 0).alias("first_text"), docid.nth_json_string("argument_templates", 1).alias("second_text"),
    )


_BODY = r"regexp_replace(substr(split_part(symbol_id, '(', 1), 3), '`+\d*', '', 'g')"


@book.query(
    rf"""with m as (select distinct symbol_id, containing_symbol_id, {_BODY} as b from symbol_facts where symbol_id like 'M:%.%'), t as (select *, case when starts_with(b, 'Corvane.') then substr(b, 9) end as rest from m)
        select symbol_id, case when contains(rest, '.') then replace(regexp_extract(rest, '^(.*)[.][^.]*$', 1), '.', '/') || '.' || regexp_extract(rest, '[^.]*$') else rest end as action,
          case when containing_symbol_id like 'T:%' then regexp_replace(substr(containing_symbol_id, 3), '`+\d*', '', 'g') || '.' || regexp_extract(split_part(symbol_id, '(', 1), '[^.]*$') end as inherited from t"""
)
def k12_routes(spark, d):
    m = T(spark, d, "symbol_facts").where("symbol_id like 'M:%.%'").select("symbol_id", "containing_symbol_id").distinct()
    return m.select("symbol_id", docid.action_route("symbol_id", "Corvane.").alias("action"), docid.inheritance_route("containing_symbol_id", docid.method_name("symbol_id")).alias("inherited"))


@book.query(
    """with p as (select distinct unnest(string_split(replace(replace(replace(regexp_extract(symbol_id, '\\((.*)\\)', 1), '{', ','), '}', ','), '[]', ''), ',')) as t from symbol_facts), n as (select distinct replace(t, 'System.', '') as name from p where t <> '')
       select name, case name when 'int' then 'Int32' else name end as known, replace('K<T,TKey,T>', 'T,', name || ',') as filled from n where not contains(name, 'T') and not contains(name, '@')""".replace("replace('K<T,TKey,T>', 'T,', name || ',')", "'K<' || name || ',TKey,' || name || '>'")
)
def k15_substitution(spark, d):
    params = F.split(F.regexp_replace(F.regexp_replace(F.regexp_extract("symbol_id", r"\((.*)\)", 1), r"[{}]", ","), r"\[\]", ""), ",")
    n = T(spark, d, "symbol_facts").select(F.explode(params).alias("t")).where("t <> ''").select(F.regexp_replace("t", "System\\.", "").alias("name")).distinct().where("not contains(name, 'T') and not contains(name, '@')")
    return n.select("name", docid.framework_name("name").alias("known"), F.regexp_replace(docid.substitute_names(F.lit("K<T,TKey,T>"), {"T": "\u0002"}), "\u0002", F.col("name")).alias("filled"))


_FIELDS = "select symbol_id from symbol_facts where kind in ('field', 'property') and contains(modifiers, 'static') and (length(symbol_id) % 2 = 0 or not contains(modifiers, 'readonly'))"
_AT = "select file_path, line, target_symbol_id, min(enclosing_symbol_id) as enclosing_symbol_id from reference_facts where ref_kind = '{k}' and enclosing_symbol_id is not null and target_symbol_id in ({f}) group by 1, 2, 3"


def _writable(spark, d):
    """Symbols of which every second read-only field is writable."""
    open_ = F.when((F.length("symbol_id") % 2 == 0), F.regexp_replace("modifiers", " ?readonly", "")).otherwise(F.col("modifiers"))
    return T(spark, d, "symbol_facts").withColumn("modifiers", open_)


@book.query(_AT.format(k="read", f=_FIELDS))
def d6_reads_of_writable_statics(spark, d):
    return R.static_accesses(T(spark, d, "reference_facts"), _writable(spark, d), "read")


@book.query(f"select * from ({_AT.format(k='read', f=_FIELDS)}) where target_symbol_id in (select target_symbol_id from ({_AT.format(k='write', f=_FIELDS)}))")
def c14_paired_reads_of_statics(spark, d):
    refs, symbols = T(spark, d, "reference_facts"), _writable(spark, d)
    return R.static_accesses(refs, symbols, "read").join(R.static_accesses(refs, symbols, "write").select("target_symbol_id"), "target_symbol_id", "left_semi")


_BROKEN = r"""broken as (select distinct '!:' || regexp_extract(split_part(symbol_id, '(', 1), '[^.]*[.][^.]*$') || case when contains(symbol_id, '(') then substr(symbol_id, instr(symbol_id, '(')) else '' end as src from symbol_facts where kind = 'method' and symbol_id like 'M:%.%.%' and not contains(symbol_id, '~') and length(symbol_id) % 5 = 0)"""


@book.query(
    rf"""with {_BROKEN}, p as (select src, split_part(split_part(regexp_extract(substr(split_part(src, '(', 1), 3), '([^.]*)[.][^.]*$', 1), '`', 1), '{{', 1) as simple, regexp_extract(split_part(src, '(', 1), '[^.:]*$') as name, {_ARITY.replace('symbol_id', 'src')} as arity from broken),
        m as (select distinct symbol_id as dst, split_part(split_part(regexp_extract(substr(split_part(symbol_id, '(', 1), 3), '([^.]*)[.][^.]*$', 1), '`', 1), '{{', 1) as simple, regexp_extract(split_part(symbol_id, '(', 1), '[^.]*$') as name, {_ARITY} as arity from symbol_facts where kind = 'method')
        select src, dst, 'impl-dispatch' as kind from p join m using (simple, name, arity)"""
)
def f12_recovery_of_broken_calls(spark, d):
    """Calls whose types did not resolve, made of every fifth method by length: ``!:`` and the simple type's member."""
    m = T(spark, d, "symbol_facts").where("kind = 'method'")
    tail = F.when(F.col("symbol_id").contains("("), F.expr("substr(symbol_id, instr(symbol_id, '('))")).otherwise("")
    broken = m.where("symbol_id like 'M:%.%.%' and not contains(symbol_id, '~') and length(symbol_id) % 5 = 0").select(F.concat(F.lit("!:"), F.substring_index(docid.head("symbol_id"), ".", -2), tail).alias("to_sym"))
    return D.error_type_recovery(broken, m)


_RENAMED = f"""with recursive {P.SQL_TYPES}, {P.SQL_METHODS}, bare as (select split_part(split_part(related_symbol_id, '{{', 1), '`', 1) as up, split_part(split_part(type_symbol_id, '{{', 1), '`', 1) as down, relation_kind from relations),
        below(anc, type) as (select up, down from bare where relation_kind = 'base' union select anc, down from below join bare on up = type where relation_kind = 'base'),
        mm as (select distinct 'M:' || substr(type, 3) || '.Run' || i || '(System.Int32)' as id, split_part(split_part(type, '{{', 1), '`', 1) as type, i, is_override from methods where type not in (select type from methods where contains(type, '~'))),
        covered as (select id from mm where length(id) % 3 = 0)"""


def _renamed(spark, d):
    """Methods named by their place in their type, so that types share them."""
    m = P.methods(spark, d)
    return m.select(F.concat(F.lit("M:"), F.expr("substr(type, 3)"), F.lit(".Run"), F.col("i"), F.lit("(System.Int32)")).alias("symbol_id"), "is_override", "is_static")


@book.query(
    f"""{_RENAMED} select distinct a.id as src, b.id as dst, 'impl-dispatch' as kind from mm a join bare r on r.up = a.type and r.relation_kind = 'interface' join mm b on b.type = r.down and b.i = a.i where a.id <> b.id and a.id not in (select id from covered)
        union select a.id, b.id, 'override-dispatch' from mm a join below on anc = a.type join mm b on b.type = below.type and b.i = a.i where b.is_override and a.id <> b.id and a.id not in (select id from covered)"""
)
def f13_fallback_by_place(spark, d):
    m = _renamed(spark, d)
    return D.hierarchy_fallback(m, P.type_relations(spark, d), m.where("length(symbol_id) % 3 = 0").select(F.col("symbol_id").alias("src")))


@book.query(
    f"""with {EFFECTS_SQL}, one as (select min(symbol_id) as field from symbol_facts where kind = 'field' and contains(modifiers, 'static')), e as (select provider, resource, case when line % 2 = 0 then field else enclosing_symbol_id end as enclosing_symbol_id, line from effects, one)
        select provider, resource, enclosing_symbol_id, line from e where contains(resource, 'Corvane.Mail') and enclosing_symbol_id in (select symbol_id from symbol_facts where kind = 'field' and contains(modifiers, 'static'))"""
)
def h15_captures_of_statics(spark, d):
    """Static initialisers, to which every second effect is attributed."""
    s = T(spark, d, "symbol_facts")
    field = s.where("kind = 'field' and contains(modifiers, 'static')").agg(F.min("symbol_id")).first()[0]
    e = effects(spark, d).withColumn("enclosing_symbol_id", F.when(F.col("line") % 2 == 0, F.lit(field)).otherwise(F.col("enclosing_symbol_id")))
    return H.static_init_captures(e, s, ["Corvane.Mail"]).select("provider", "resource", "enclosing_symbol_id", "line")


@book.query(
    """select distinct symbol_id as service_type, containing_symbol_id as implementation_type, case length(symbol_id) % 3 when 0 then 'singleton' when 1 then 'scoped' else 'transient' end as lifetime, file_path, line
       from symbol_facts where kind = 'type' and type_kind = 'interface'"""
)
def a5_registrations(spark, d):
    t = T(spark, d, "symbol_facts").where("kind = 'type' and type_kind = 'interface'")
    life = F.expr("case length(symbol_id) % 3 when 0 then 'singleton' when 1 then 'scoped' else 'transient' end").alias("lifetime")
    none = [F.lit(None).cast("string").alias(c) for c in ("registration_kind", "confidence", "basis", "reason")]
    reg = t.select(F.col("symbol_id").alias("service_type"), F.col("containing_symbol_id").alias("implementation_type"), life, "file_path", "line", *none)
    return R.list_registrations(reg).select("service_type", "implementation_type", "lifetime", "file_path", "line")


@book.query("select ref_kind, target_symbol_id, count(*) as n from reference_facts where target_symbol_id in (select symbol_id from symbol_facts where kind = 'property' and contains(lower(name), 'a')) group by 1, 2")
def d8_references_to_matches(spark, d):
    s = T(spark, d, "symbol_facts").where("kind = 'property'")
    return S.references_to(T(spark, d, "reference_facts"), s.where(F.lower("name").contains("a"))).groupBy("ref_kind", "target_symbol_id").agg(F.count(F.lit(1)).alias("n"))


@book.query(
    r"""with m as (select distinct symbol_id, file_path, line, is_override from symbol_facts where kind = 'method' and containing_symbol_id like 'T:%' and symbol_id like 'M:%.%'),
        a as (select distinct enclosing_symbol_id as method from reference_facts where ref_kind in ('attributeUse', 'typeUse') and starts_with(target_symbol_id, 'T:Corvane')), x as (select *, regexp_replace(regexp_extract(split_part(symbol_id, '(', 1), '[^.]*$'), '`+\d*', '', 'g') as own from m)
        select min(symbol_id) as method, file_path, line from x where symbol_id in (select method from a) and own <> '#ctor' and contains(symbol_id, '(System.') group by 2, 3"""
)
def d16_attributed_entry_points(spark, d):
    """Handlers with an attribute: the place's least method that a reference to a platform type marks."""
    m = T(spark, d, "symbol_facts").where("kind = 'method' and containing_symbol_id like 'T:%' and symbol_id like 'M:%.%'").select("symbol_id", "file_path", "line", "is_override")
    a = T(spark, d, "reference_facts").where("ref_kind in ('attributeUse', 'typeUse') and target_symbol_id like 'T:Corvane%'").select(F.col("enclosing_symbol_id").alias("method"))
    types = m.select(docid.strip_generic(docid.method_type("symbol_id")).alias("type"))
    return EP.inherited(m.where("contains(symbol_id, '(System.')"), types, ["*"], "handler", attributed=a).select("method", "file_path", "line")


@book.query(
    f"""with recursive {_BIND}, {_MONO}, edges as (select from_sym as src, to_sym as dst from plain union select from_sym, to_sym from copies),
        r(node, depth) using key (node) as (select distinct from_sym, 0 from call_edges where contains(lower(from_sym), 'controller.render') union select dst, min(depth) + 1 from r join edges on src = node where dst not in (select node from recurring.r) group by dst)
        select regexp_replace(node, '~mono⟨.*?⟩', '', 'g') as node, min(depth) as depth from r group by 1"""
)
def e17_collapsed_reach(spark, d):
    return N.collapsed_reach(_bindings(spark, d), _seeds(spark, d))


@book.query(
    f"""with recursive {P.SQL_DISPATCH}, {MINED_SQL} select src, dst, 'override-dispatch' as kind from over_ where src <> dst union select src, dst, 'impl-dispatch' from impl_ where src <> dst
        union select source_member, target_member, 'delegate-dispatch' from (select distinct target_symbol_id as source_member, enclosing_symbol_id as target_member from reference_facts where target_symbol_id like 'F:%' and enclosing_symbol_id is not null and ref_kind = 'write')"""
)
def f11_with_delegates(spark, d):
    facts = P.dispatch_facts(spark, d).withColumn("kind", F.expr("case kind when 'delegate_field_bind' then 'delegate_bind' else kind end"))
    return D.mined(facts)


_LISTED = r"""ctl as (select distinct file_path, line, min(enclosing_symbol_id) over (partition by file_path, line) as method from (select distinct file_path, line, enclosing_symbol_id from reference_facts where ref_kind = 'ctor' and starts_with(target_symbol_id, 'M:Corvane.Logging') and enclosing_symbol_id like 'M:%.%'
      and contains(split_part(split_part(regexp_extract(substr(split_part(enclosing_symbol_id, '(', 1), 3), '^(.*)[.][^.]*$', 1), '{', 1), '`', 1), 'Controller')))"""


@book.query(f"with {_LISTED} select 'action' as kind, count(*) as n from ctl")
def j20_action_counts(spark, d):
    from factweave.plans.derive import g11_action_entry_points

    return g11_action_entry_points(spark, d).select(F.lit("action").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_SEEDS2 = {"left_only": "controller.", "right_only": "handler."}


@book.query(
    f"""with recursive edges as (select distinct from_sym as src, to_sym as dst from call_edges where kind in ('ctor', 'methodGroup')), {EFFECTS_SQL},
        s(seed, node) as (select distinct 'left_only', from_sym from call_edges where contains(lower(from_sym), 'controller.') union select distinct 'right_only', from_sym from call_edges where contains(lower(from_sym), 'handler.')),
        r(seed, node) as (select seed, node from s union select seed, dst from r join edges on src = node),
        k as (select distinct enclosing_symbol_id as node, regexp_extract(split_part(split_part(resource, '{{', 1), '`', 1), '[^.]*$') as resource_key, provider || ':' || operation as token from effects)
        select resource_key, min(seed) as direction, array_to_string(list_sort(list_distinct(list(token))), ',') as categories from r join k using (node) group by 1 having count(distinct seed) = 1"""
)
def j15_effects_of_two_sides(spark, d):
    e = T(spark, d, "call_edges")
    side = lambda text: e.where(F.lower("from_sym").contains(text)).select(F.col("from_sym").alias("node")).distinct()
    return I.effect_set_diff(C.edge_list(e.where("kind in ('ctor', 'methodGroup')")), effects(spark, d), side("controller."), side("handler."))


@book.query(
    r"""with u as (select symbol_id, run_id from symbol_facts where kind = 'method' and contains(symbol_id, 'Controller')), f as (select id as run_id, any_value(solution_path) as solution_path, any_value(cast(regexp_replace(created_at_utc_text, '[.][0-9]+', '') as timestamptz)) as tm, any_value(rpad(regexp_extract(created_at_utc_text, '[.]([0-9]+)', 1), 9, '0')) as frac from runs where source_project_path is null and id in (select run_id from symbol_facts) group by 1),
        q as (select *, row_number() over (partition by solution_path order by tm desc, frac desc, run_id desc) as back from f), s as (select distinct solution_path, back, 'action' as kind, replace(regexp_extract(regexp_replace(substr(split_part(symbol_id, '(', 1), 3), '`+\d*', '', 'g'), '^(.*)[.][^.]*$', 1), '.', '/') || '.' || regexp_extract(regexp_replace(substr(split_part(symbol_id, '(', 1), 3), '`+\d*', '', 'g'), '[^.]*$') as route
          from u join q using (run_id) where back <= 2 and solution_path in (select solution_path from q where back = 2))
        select solution_path, kind, route, 'removed' as change from (select solution_path, kind, route from s where back = 2 except select solution_path, kind, route from s where back = 1)
        union all select solution_path, kind, route, 'added' from (select solution_path, kind, route from s where back = 1 except select solution_path, kind, route from s where back = 2)"""
)
def j6_snapshot_entry_points(spark, d):
    """Entry points that came or went between the two newest full runs of each solution, by kind and route."""
    from factweave.plans.changes import _sides

    base, head = _sides(spark, d)
    both = base.select("solution_path").distinct()
    of = lambda side: side.where("symbol_id like 'M:%' and contains(symbol_id, 'Controller')").select("solution_path", F.lit("action").alias("kind"), docid.action_route("symbol_id", "").alias("route"))
    return I.set_diff(of(base), of(head.join(both, "solution_path", "left_semi")), ["solution_path", "kind", "route"])
