"""Queries over scans, filters, joins, scalar functions and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import decode, docid
from factweave.operators import relational as R
from factweave.operators import search as S
from factweave.plans._base import Book
from factweave.sources.tables import table as T

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL

_NS = "epoch_us(cast(regexp_replace(created_at_utc_text, '[.][0-9]+', '') as timestamptz)) * 1000 + cast(rpad(regexp_extract(created_at_utc_text, '[.]([0-9]+)', 1), 9, '0') as bigint)"
_FIRST = "ref_kind in ('invocation','methodGroup','ctor') and target_in_source and enclosing_symbol_id is not null and target_symbol_id is not null"
_FREE = "regexp_replace(split_part({c}, '(', 1), '^.:', '')"


@book.query(f"select distinct id, solution_path, {_NS} as instant from runs")
def a4_runs(spark, d):
    return R.list_runs(T(spark, d, "runs")).select("id", "solution_path", "instant").distinct().orderBy(F.desc("instant"), F.desc("id"))


@book.query("select distinct run_id, file_index, file_path, reason from source_files where status = 'skipped'")
def a6_skipped_files(spark, d):
    return T(spark, d, "source_files").where("status = 'skipped'").select("run_id", "file_index", "file_path", "reason").distinct()


@book.query(
    "select assembly, n_symbols, sha256(n_symbols || ':' || s) as content_hash from (select defining_assembly as assembly, count(*) as n_symbols, cast(sum(cast('0x' || substr(md5(symbol_id), 1, 12) as bigint)) as varchar) as s from (select distinct defining_assembly, symbol_id from symbol_facts) group by 1)"
)
def b2_assembly_registry(spark, d):
    return R.assembly_registry(T(spark, d, "symbol_facts"))


@book.query(
    f"select distinct enclosing_symbol_id as from_sym, target_symbol_id as to_sym, ref_kind as kind, file_path, line, enclosing_loop_kind as loop_kind, receiver_type from reference_facts where {_FIRST}"
)
def c1_first_party_edges(spark, d):
    return R.call_edges_of(T(spark, d, "reference_facts")).select("from_sym", "to_sym", "kind", "file_path", "line", "loop_kind", "receiver_type").distinct()


@book.query("select count(*) as edges, count(distinct from_sym) as callers from (select distinct * from call_edges)")
def c2_distinct_edges(spark, d):
    return T(spark, d, "call_edges").distinct().agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("from_sym").alias("callers"))


@book.query(
    """select symbol_id, file_path, line, name from (select *, row_number() over (partition by symbol_id order by file_path, line, name) as rn
       from symbol_facts where kind = 'method') where rn = 1"""
)
def c3_methods_first_wins(spark, d):
    m = T(spark, d, "symbol_facts").where("kind = 'method'").select("symbol_id", "file_path", "line", "name")
    return R.first_by(m, ["symbol_id"], ["file_path", "line", "name"])


@book.query(
    """with n as (select distinct from_sym as sym from call_edges union select distinct to_sym from call_edges),
       e as (select sym from n where lower(sym) = 'batch' or lower(regexp_replace(split_part(sym, '(', 1), '^.:', '')) = 'batch')
       select sym from e union all select sym from n where not exists (select 1 from e) and contains(lower(sym), 'batch')"""
)
def c4_node_match(spark, d):
    e = T(spark, d, "call_edges")
    nodes = R.node_universe([e], T(spark, d, "symbol_facts").where("false"))
    return R.match_nodes(nodes, "sym", "Batch")


@book.query("select sym from (select from_sym as sym from call_edges union select to_sym from call_edges) where contains(lower(sym), 'batch')")
def c5_like_seeds(spark, d):
    nodes = R.node_universe([T(spark, d, "call_edges")], T(spark, d, "symbol_facts").where("false"))
    return R.like_seeds(nodes, "sym", "Batch")


@book.query(
    """with m as (select distinct to_sym as s from call_edges where contains(lower(to_sym), 'store')),
       keep as (select s from m where not (contains(s, '~λ') and split_part(s, '~λ', 1) in (select s from m)))
       select distinct regexp_replace(split_part(s, '(', 1), '^.:', '') as name from keep"""
)
def c6_ambiguity(spark, d):
    m = T(spark, d, "call_edges").where(F.lower("to_sym").contains("store"))
    return R.ambiguous_names(m, "to_sym")


@book.query(
    r"""select distinct file_path from source_files where regexp_matches(file_path, '(?i)[.]cs$') and not regexp_matches(file_path, '(?i)(^|.*[/\\])[^/\\]*[.]Tests([/\\].*)$')"""
)
def c10_globs(spark, d):
    f = T(spark, d, "source_files").select("file_path").distinct()
    return f.where(F.col("file_path").rlike(docid.file_glob_regex("**/*.cs")) & ~F.col("file_path").rlike(docid.file_glob_regex("*.Tests/**")))


@book.query("select distinct symbol_id from symbol_facts where regexp_matches(split_part(symbol_id, '(', 1), '(?is)corvane.*factory')")
def c11_head_glob(spark, d):
    return T(spark, d, "symbol_facts").where(docid.matches_head_glob("symbol_id", "Corvane*Factory")).select("symbol_id").distinct()


@book.query(
    "select sum(case when contains(modifiers, 'static') then 1 else 0 end)::bigint as has_static, sum(case when list_contains(string_split(modifiers, ' '), 'abstract') then 1 else 0 end)::bigint as token_abstract, sum(case when is_override then 1 else 0 end)::bigint as overrides from symbol_facts"
)
def c12_modifiers(spark, d):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return T(spark, d, "symbol_facts").agg(
        n(F.col("modifiers").contains("static")).alias("has_static"),
        n(F.array_contains(F.split("modifiers", " "), "abstract")).alias("token_abstract"),
        n(F.col("is_override")).alias("overrides"),
    )


@book.query(r"select distinct file_path from source_files where contains(file_path, '<generated>') or regexp_matches(lower(file_path), '[.](g|g[.]i|designer|generated)[.]cs$')")
def c13_generated_paths(spark, d):
    return T(spark, d, "source_files").where(docid.is_generated_path("file_path")).select("file_path").distinct()


_STATIC = "select symbol_id from symbol_facts where kind in ('field', 'property') and contains(modifiers, 'static')"
_ACCESS = "select file_path, line, target_symbol_id, min(enclosing_symbol_id) as enclosing_symbol_id from reference_facts where ref_kind = '{k}' and enclosing_symbol_id is not null and target_symbol_id in ({s}) group by 1, 2, 3"
_READS = _ACCESS.format(k="read", s=_STATIC + " and not contains(modifiers, 'readonly')")
_WRITES = _ACCESS.format(k="write", s=_STATIC)


@book.query(_READS)
def d6_static_reads(spark, d):
    return R.static_accesses(T(spark, d, "reference_facts"), T(spark, d, "symbol_facts"), "read")


@book.query(_WRITES)
def d6_static_writes(spark, d):
    return R.static_accesses(T(spark, d, "reference_facts"), T(spark, d, "symbol_facts"), "write")


@book.query(f"with r as ({_READS}), w as ({_WRITES}) select * from r where target_symbol_id in (select target_symbol_id from w)")
def c14_write_paired_reads(spark, d):
    refs, symbols = T(spark, d, "reference_facts"), T(spark, d, "symbol_facts")
    return R.static_accesses(refs, symbols, "read").join(R.static_accesses(refs, symbols, "write").select("target_symbol_id"), "target_symbol_id", "left_semi")


@book.query("select sym from (select from_sym as sym from call_edges union select to_sym from call_edges) where sym not in (select to_sym from call_edges)")
def d7_roots(spark, d):
    e = T(spark, d, "call_edges")
    return R.roots_without_predecessor(R.node_universe([e], T(spark, d, "symbol_facts").where("false")), [e])


_ANY = "select enclosing_symbol_id, target_symbol_id, file_path, line from reference_facts where ref_kind = '{k}' and enclosing_symbol_id is not null and target_symbol_id is not null"


@book.query(
    f"""with r as (select enclosing_symbol_id, target_symbol_id, file_path, min(line) as read_line from ({_ANY.format(k='read')}) group by 1, 2, 3),
        w as (select distinct * from ({_ANY.format(k='write')})) select w.enclosing_symbol_id, w.target_symbol_id, w.file_path, w.line as write_line, read_line
        from w join r using (enclosing_symbol_id, target_symbol_id, file_path) where read_line < w.line"""
)
def d11_read_modify_write(spark, d):
    refs = T(spark, d, "reference_facts").where("enclosing_symbol_id is not null and target_symbol_id is not null").select("enclosing_symbol_id", "target_symbol_id", "file_path", "line", "ref_kind")
    return R.read_before_write(refs.where("ref_kind = 'read'").drop("ref_kind"), refs.where("ref_kind = 'write'").drop("ref_kind").distinct())


_DIR = r"regexp_replace(file_path, '[/\\][^/\\]*$', '')"


@book.query(
    f"""with f as (select distinct file_path from source_files), o as (select {_DIR} as owner from f group by 1 having count(*) >= 3)
        select file_path, arg_max(owner, (length(owner), owner)) as owner from f join o on starts_with(replace(file_path, chr(92), '/'), replace(owner, chr(92), '/') || '/') group by 1"""
)
def d17_owning_folder(spark, d):
    f = T(spark, d, "source_files").select("file_path").distinct()
    owners = f.groupBy(F.regexp_replace("file_path", r"[/\\][^/\\]*$", "").alias("owner")).count().where("count >= 3")
    return R.owning_folder(f, "file_path", owners, "owner")


_USAGE = """select a.from_assembly, r.target_assembly as to_assembly, count(*) as uses, count(distinct target_symbol_id) as symbols from reference_facts r
    join (select symbol_id, min(defining_assembly) as from_assembly from symbol_facts group by 1) a on a.symbol_id = r.enclosing_symbol_id
    where r.target_assembly <> '' and a.from_assembly <> r.target_assembly group by 1, 2"""


@book.query(_USAGE)
def d18_assembly_usage(spark, d):
    return R.assembly_usage(T(spark, d, "reference_facts"), T(spark, d, "symbol_facts"))


@book.query(
    f"""with u as ({_USAGE}), declared as (select distinct a.defining_assembly as from_assembly, b.defining_assembly as to_assembly from
        (select distinct run_id, defining_assembly from symbol_facts where kind = 'namespace') a join (select distinct run_id, defining_assembly from symbol_facts where kind = 'namespace') b using (run_id) where a.defining_assembly <> b.defining_assembly)
        select * from declared where (from_assembly, to_assembly) not in (select from_assembly, to_assembly from u)"""
)
def d19_declared_unused(spark, d):
    ns = T(spark, d, "symbol_facts").where("kind = 'namespace'").select("run_id", "defining_assembly").distinct()
    pairs = ns.withColumnRenamed("defining_assembly", "from_assembly").join(ns.withColumnRenamed("defining_assembly", "to_assembly"), "run_id")
    declared = pairs.where("from_assembly <> to_assembly").select("from_assembly", "to_assembly").distinct()
    return declared.join(d18_assembly_usage(spark, d), ["from_assembly", "to_assembly"], "left_anti")


@book.query("select kind, count(*) as n from symbol_facts group by kind")
def i11_kind_counts(spark, d):
    return T(spark, d, "symbol_facts").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@book.query("select to_sym, count(distinct from_sym) as callers from call_edges group by 1")
def i6_caller_counts(spark, d):
    return T(spark, d, "call_edges").groupBy("to_sym").agg(F.countDistinct("from_sym").alias("callers"))


@book.query(
    "select project_name, reason from (select project_name, reason, row_number() over (partition by project_name order by n desc, reason) as rn from (select project_name, reason, count(*) as n from source_files where reason is not null group by 1, 2)) where rn = 1"
)
def i8_modal_reason(spark, d):
    return R.modal_by(T(spark, d, "source_files"), "project_name", "reason")


@book.query("select to_sym, count(*) as n from call_edges group by 1 order by n desc, to_sym limit 20")
def i13_top_callees(spark, d):
    return T(spark, d, "call_edges").groupBy("to_sym").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "to_sym").limit(20)


@book.query("select symbol_id, min(name) as name, min(kind) as kind from symbol_facts where (contains(lower(symbol_id), 'canvas') or contains(lower(name), 'canvas')) and kind = 'type' group by 1")
def j1_symbol_search(spark, d):
    return S.search_symbols(T(spark, d, "symbol_facts"), "Canvas", "type")


@book.query("select distinct target_symbol_id, enclosing_symbol_id, ref_kind, file_path, line from reference_facts where contains(lower(target_symbol_id), 'policy') and target_in_source and ref_kind = 'invocation'")
def j2_reference_search(spark, d):
    return S.search_references(T(spark, d, "reference_facts"), "Policy", "invocation")


@book.query("select distinct symbol_id as value from symbol_facts where contains(lower(symbol_id), 'mapper.r')")
def j3_trigram_search(spark, d):
    return S.search_trigrams(S.trigrams(T(spark, d, "symbol_facts"), "symbol_id"), "Mapper.R")


@book.query(
    """with g as (select distinct lower(name) as t, unnest(range(1, length(name) - 1)) as i from symbol_facts where length(name) >= 3)
       select substr(t, i, 3) as gram, count(distinct t) as n from g group by 1"""
)
def j3_trigram_index(spark, d):
    return S.trigrams(T(spark, d, "symbol_facts").select(F.lower("name").alias("name")), "name").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@book.query(
    """select symbol_id, name, kind, case when lower(name) = 'slot' then 0 when starts_with(lower(name), 'slot') then 1 when contains(lower(name), 'slot') then 2 else 3 end as rank,
       case kind when 'type' then 0 when 'method' then 1 when 'property' then 2 else 3 end as kind_rank, length(symbol_id)::int as length
       from (select symbol_id, min(name) as name, min(kind) as kind from symbol_facts where contains(lower(symbol_id), 'slot') or contains(lower(name), 'slot') group by 1) where not contains(symbol_id, '~λ')"""
)
def j4_ranked_picker(spark, d):
    return S.pick_symbols(T(spark, d, "symbol_facts"), "Slot").orderBy("rank", "kind_rank", "length", "symbol_id")


@book.query("select target_symbol_id, ref_kind, count(*) as n from reference_facts where contains(lower(target_symbol_id), 'corvane.http') group by 1, 2")
def j5_usage(spark, d):
    return S.usage_of(T(spark, d, "reference_facts"), "Corvane.Http")


@book.query(
    "select distinct target_symbol_id, enclosing_symbol_id, line from reference_facts where ref_kind = 'invocation' and not target_in_source and target_symbol_id is not null and enclosing_symbol_id in (select from_sym from call_edges where kind = 'handoff')"
)
def j26_library_calls(spark, d):
    senders = T(spark, d, "call_edges").where("kind = 'handoff'").select(F.col("from_sym").alias("enclosing_symbol_id"))
    r = T(spark, d, "reference_facts").where("ref_kind = 'invocation' and not target_in_source and target_symbol_id is not null")
    return r.join(senders, "enclosing_symbol_id", "left_semi").select("target_symbol_id", "enclosing_symbol_id", "line").distinct()


_M = "select distinct symbol_id from symbol_facts where symbol_id like 'M:%'"
_BODY = "substr(split_part(symbol_id, '(', 1), 3)"
_LASTDOT = "regexp_extract({b}, '^(.*)[.][^.]*$', 1)"


@book.query(
    rf"""select symbol_id, 'T:' || {_LASTDOT.format(b=_BODY)} as type_id, regexp_extract({_BODY}, '[^.]*$') as name, regexp_replace({_LASTDOT.format(b=_BODY)}, '`+\d*', '', 'g') as declaring,
        case when not contains(symbol_id, '(') then 0 else len(regexp_replace(regexp_extract(symbol_id, '\((.*)\)', 1), '\{{[^{{}}]*\}}', '', 'g')) - len(replace(regexp_replace(regexp_extract(symbol_id, '\((.*)\)', 1), '\{{[^{{}}]*\}}', '', 'g'), ',', '')) + 1 end::int as arity from ({_M}) where contains({_BODY}, '.')"""
)
def k1_method_parts(spark, d):
    m = T(spark, d, "symbol_facts").where("symbol_id like 'M:%'").select("symbol_id").distinct()
    return m.select(
        "symbol_id", docid.method_type("symbol_id").alias("type_id"), docid.method_name("symbol_id").alias("name"),
        docid.declaring_type("symbol_id").alias("declaring"), docid.param_arity("symbol_id").alias("arity"),
    ).where("type_id is not null")


@book.query(
    r"""select symbol_id, split_part(split_part(symbol_id, '{', 1), '`', 1) as bare, regexp_replace(symbol_id, '`+\d*', '', 'g') as no_arity,
        regexp_replace(split_part(symbol_id, '(', 1), '^.:', '') as free, regexp_extract(regexp_replace(split_part(symbol_id, '(', 1), '^.:', ''), '[^.]*$') as member,
        split_part(regexp_extract(split_part(regexp_replace(split_part(symbol_id, '(', 1), '^.:', ''), '{', 1), '[^.]*$'), '`', 1) as simple_type,
        case when contains(symbol_id, '~λ') then split_part(symbol_id, '~λ', 1) end as container from (select distinct symbol_id from symbol_facts)"""
)
def k4_name_parts(spark, d):
    s = T(spark, d, "symbol_facts").select("symbol_id").distinct()
    return s.select(
        "symbol_id", docid.strip_generic("symbol_id").alias("bare"), docid.strip_arity("symbol_id").alias("no_arity"), docid.param_free_name("symbol_id").alias("free"),
        docid.simple_member_name("symbol_id").alias("member"), docid.simple_type_name("symbol_id").alias("simple_type"), docid.lambda_container("symbol_id").alias("container"),
    )


@book.query(
    r"""select receiver_type, case when regexp_matches(receiver_type, '^<|[?*\[ ]') or trim(receiver_type) = '' then null else 'T:' || split_part(split_part(regexp_replace(receiver_type, '<.*>', ''), '{', 1), '`', 1) end as type_id
        from (select distinct receiver_type from reference_facts where receiver_type is not null)"""
)
def k7_receiver_type(spark, d):
    r = T(spark, d, "reference_facts").where("receiver_type is not null").select("receiver_type").distinct()
    return r.select("receiver_type", docid.receiver_type_id("receiver_type").alias("type_id"))


@book.query(
    r"""select first_argument_template as url, case when contains(first_argument_template, '://') then regexp_replace(regexp_replace(first_argument_template, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '/+$', '') else regexp_replace(first_argument_template, '^/+', '') end as resource
        from (select distinct first_argument_template from reference_facts where first_argument_template is not null)"""
)
def k10_normalize_http(spark, d):
    u = T(spark, d, "reference_facts").where("first_argument_template is not null").select(F.col("first_argument_template").alias("url")).distinct()
    return u.select("url", docid.normalize_http("url").alias("resource"))


@book.query(
    r"""with t as (select distinct split_part(split_part(name, '{', 1), '`', 1) as n, symbol_id from symbol_facts where kind = 'type')
        select symbol_id, case when ends_with(s, 'Repository') and length(s) > 10 then left(s, length(s) - 10) when ends_with(s, 'Store') and length(s) > 5 then left(s, length(s) - 5) else s end as key
        from (select symbol_id, regexp_extract(n, '[^.]*$') as s from t)"""
)
def k11_resource_key(spark, d):
    t = T(spark, d, "symbol_facts").where("kind = 'type'").select("symbol_id", "name").distinct()
    return t.select("symbol_id", docid.resource_key("name", ["Store", "Repository"]).alias("key")).distinct()


@book.query(
    r"""select target_symbol_id, 'T:' || regexp_extract(b, '^(.*)[.][^.]*$', 1) as made from (select distinct target_symbol_id, regexp_replace(substr(split_part(target_symbol_id, '(', 1), 3), '`+\d*', '', 'g') as b from reference_facts where target_symbol_id like 'M:%' ) where regexp_extract(b, '[^.]*$') = '#ctor'"""
)
def k13_constructors(spark, d):
    t = T(spark, d, "reference_facts").select("target_symbol_id").distinct()
    return t.select("target_symbol_id", F.concat(F.lit("T:"), docid.constructor_type("target_symbol_id")).alias("made")).where("made is not null")


@book.query(
    "select target_symbol_id, regexp_extract(substr(target_symbol_id, 3), '^(.*)[.][^.]*$', 1) as type, regexp_extract(target_symbol_id, '[^.]*$') as name from (select distinct target_symbol_id from reference_facts where target_symbol_id like 'F:%.%' or target_symbol_id like 'P:%.%')"
)
def k14_field_slots(spark, d):
    t = T(spark, d, "reference_facts").select("target_symbol_id").distinct().withColumn("s", docid.field_slot("target_symbol_id"))
    return t.where("s is not null").select("target_symbol_id", "s.type", "s.name")


@book.query(
    """select predicate, when_true, count(*) as n from (select split_part(e, chr(31), 1) as predicate, split_part(e, chr(31), 2) = '1' as when_true from
       (select unnest(string_split(enclosing_guards, chr(30))) as e from reference_facts where enclosing_guards <> '') where len(string_split(e, chr(31))) = 2) group by 1, 2"""
)
def k_guards(spark, d):
    g = T(spark, d, "reference_facts").where("enclosing_guards is not null").select(F.explode(decode.guards("enclosing_guards")).alias("g"))
    return g.groupBy("g.predicate", "g.when_true").agg(F.count(F.lit(1)).alias("n"))
