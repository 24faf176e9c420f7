"""The queries p1_ to p5_ of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import frequent, hierarchy, snapshots, treeagg
from factweave.sources.tables import table

#: Share of a table's rows from which a key counts as hot in p1_found, and of a field's values in p3_found.
HOT_SHARE, FREQUENT_SHARE = 0.02, 0.005

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _keys(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "reference_facts").select(
        F.lit("reference_facts").alias("source_table"), F.col("target_symbol_id").alias("key_value")
    )
    edges = table(spark, d, "call_edges").select(
        F.lit("call_edges").alias("source_table"), F.col("from_sym").alias("key_value")
    )
    return refs.unionAll(edges)


@query(
    "p1_counts",
    """select 'reference_facts' as source_table, target_symbol_id as key_value, count(*) as n from reference_facts
       where target_symbol_id is not null group by 2
       union all select 'call_edges', from_sym, count(*) from call_edges where from_sym is not null group by 2""",
)
def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return treeagg.tree_aggregate(
        _keys(spark, d).where("key_value is not null"), ["source_table", "key_value"], {"n": ("count", None)}
    )


@query(
    "p1_found",
    """select 'reference_facts' as source_table, target_symbol_id as key_value from reference_facts
       where target_symbol_id is not null group by 2 having count(*) >= 0.02 * (select count(*) from reference_facts)
       union all select 'call_edges', from_sym from call_edges where from_sym is not null group by 2
       having count(*) >= 0.02 * (select count(*) from call_edges)""",
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    counts = treeagg.tree_aggregate(_keys(spark, d), ["source_table", "key_value"], {"n": ("count", None)})
    total = {t: table(spark, d, t).count() for t in ("reference_facts", "call_edges")}  # from the files' footers
    hot = F.lit(False)
    for t, n in total.items():
        hot = hot | ((F.col("source_table") == t) & (F.col("n") >= HOT_SHARE * n - frequent.SLACK))
    return counts.where(hot & F.col("key_value").isNotNull()).select("source_table", "key_value")


_RECORDS = """records as (select run_id, symbol_id, nullif(lower(arg_max(coalesce(body_hash, ''), fact_index)), '') as h,
    nullif(arg_max(coalesce(containing_symbol_id, ''), fact_index), '') as parent from symbol_facts group by 1, 2)"""
_FULL = """full_runs as (select run_id, solution_path, row_number() over (partition by solution_path order by tm, frac, run_id) as seq from
    (select id as run_id, any_value(solution_path) as solution_path,
     any_value(cast(regexp_replace(created_at_utc_text, '[.][0-9]+', '') as timestamptz)) as tm,
     any_value(rpad(regexp_extract(created_at_utc_text, '[.]([0-9]+)', 1), 9, '0')) as frac
     from runs where source_project_path is null and id in (select run_id from symbol_facts) group by 1))"""
_STATES = f"with {_RECORDS}, {_FULL}, states as (select solution_path, seq, run_id, symbol_id, h from records join full_runs using (run_id))"


@query(
    "p2_found",
    f"""{_STATES}
    select f.run_id, s.symbol_id, 'added' as change_type from states s join full_runs f using (solution_path, seq)
    where seq > 1 and not exists (select 1 from states p where p.solution_path = s.solution_path and p.symbol_id = s.symbol_id and p.seq = s.seq - 1)
    union all select f.run_id, p.symbol_id, 'removed' from states p join full_runs f on f.solution_path = p.solution_path and f.seq = p.seq + 1
    where not exists (select 1 from states s where p.solution_path = s.solution_path and p.symbol_id = s.symbol_id and p.seq = s.seq - 1)
    union all select s.run_id, s.symbol_id, 'changed' from states s join states p on p.solution_path = s.solution_path and p.symbol_id = s.symbol_id and p.seq = s.seq - 1
    where s.h <> p.h""",
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.symbol_changes(table(spark, d, "runs"), table(spark, d, "symbol_facts"))


@query(
    "p2_intervals",
    f"""{_STATES}, flagged as (select *, case when lag(seq) over w = seq - 1 and lag(h) over w is not distinct from h then 0 else 1 end as b
      from states window w as (partition by solution_path, symbol_id order by seq)),
    islands as (select *, sum(b) over (partition by solution_path, symbol_id order by seq) as island from flagged)
    select solution_path, symbol_id, min(seq) as first_seq, max(seq) as last_seq, any_value(h) as body_hash
    from islands group by solution_path, symbol_id, island""",
)
def p2_intervals(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.symbol_intervals(table(spark, d, "runs"), table(spark, d, "symbol_facts"))[0]


_P3 = """select '{c}' as field_name, {c} as field_value, count(*) as n from reference_facts where {c} <> '' group by {c}
    having count(*) >= 0.005 * (select count(*) from reference_facts where {c} <> '')"""
_P3_ALL = " union all ".join(_P3.format(c=c) for c in ("target_symbol_id", "target_assembly"))


@query("p3_counts", _P3_ALL)
def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return frequent.frequent_values(
        table(spark, d, "reference_facts"), ["target_symbol_id", "target_assembly"], FREQUENT_SHARE
    ).select("field_name", "field_value", "n")


@query("p3_found", f"select field_name, field_value from ({_P3_ALL})")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_counts(spark, d).select("field_name", "field_value")


_UP = f"""with recursive {_RECORDS},
    links as (select c.run_id, c.symbol_id, c.parent, p.symbol_id as known from records c left join records p on p.run_id = c.run_id and p.symbol_id = c.parent),
    """


@query(
    "p5_found",
    f"""{_UP} walk(run_id, origin, pos) as (select run_id, symbol_id, known from links where known is not null
      union select w.run_id, w.origin, l.known from walk w join links l on l.run_id = w.run_id and l.symbol_id = w.pos where l.known is not null)
    select run_id, origin as symbol_id from walk where origin = pos""",
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parents = hierarchy.symbol_parents(table(spark, d, "symbol_facts"))
    return hierarchy.cyclic_nodes(parents, "run_id", "symbol_id", "containing_symbol_id")


_TREE = f"""{_UP} tree(run_id, symbol_id, root, depth, path) as (select run_id, symbol_id, symbol_id, 0, symbol_id from links where known is null
      union all select l.run_id, l.symbol_id, t.root, t.depth + 1, t.path || chr(31) || l.symbol_id from tree t join links l on l.run_id = t.run_id and l.known = t.symbol_id)"""


@query(
    "p5_paths",
    f"{_TREE} select run_id, symbol_id, root, cast(depth as int) as depth, path from tree",
)
def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).where("status = 'tree'").select("run_id", "symbol_id", "root", "depth", "path")


def _tree(spark: SparkSession, d: str) -> DataFrame:
    parents = hierarchy.symbol_parents(table(spark, d, "symbol_facts"))
    return hierarchy.hierarchies(parents, "run_id", "symbol_id", "containing_symbol_id")


@query(
    "p5_intervals",
    f"""{_TREE}, pairs as (select run_id, unnest(string_split(path, chr(31))) as symbol_id from tree)
    select run_id, symbol_id, count(*) - 1 as n_below from pairs group by 1, 2""",
)
def p5_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).where("status = 'tree'").select("run_id", "symbol_id", "n_below")


@query(
    "p5_below",
    f"""{_TREE}, pairs as (select run_id, unnest(string_split(path, chr(31))) as symbol_id, generate_subscripts(string_split(path, chr(31)), 1) as lvl,
      symbol_id as below, depth from tree)
    select run_id, symbol_id, below, cast(depth + 1 - lvl as int) as distance from pairs where lvl <= depth""",
)
def p5_below(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.below(_tree(spark, d), "run_id", "symbol_id")
