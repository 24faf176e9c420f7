"""Type relations and dispatch facts for tables that carry none: a fixed projection of the symbols.

The n-th type (by id, from 0) derives from the n div 4-th and implements the interface of number n modulo their
count; the i-th method of a type is overridden by the i-th of each derived type, and implemented likewise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.runtime import materialize, with_dense_id
from factweave.sources.tables import table


def types(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "symbol_facts").where("kind = 'type'").groupBy("symbol_id").agg(F.max(F.col("type_kind") == "interface").alias("is_interface"))
    return with_dense_id(t, ["symbol_id"], "k", "types")


def type_relations(spark: SparkSession, d: str) -> DataFrame:
    """(type_symbol_id, related_symbol_id, relation_kind)."""
    t = types(spark, d)
    base = t.where("k > 0").select(F.col("symbol_id").alias("type_symbol_id"), F.expr("k div 4").alias("k")).join(t.select("k", F.col("symbol_id").alias("related_symbol_id")), "k")
    faces = with_dense_id(t.where("is_interface").select(F.col("symbol_id").alias("related_symbol_id")), ["related_symbol_id"], "i", "faces")
    n = faces.count()
    impl = t.where("not is_interface").select(F.col("symbol_id").alias("type_symbol_id"), F.expr(f"k % {max(n, 1)}").alias("i")).join(faces, "i")
    return materialize(
        base.select("type_symbol_id", "related_symbol_id", F.lit("base").alias("relation_kind")).unionAll(impl.select("type_symbol_id", "related_symbol_id", F.lit("interface").alias("relation_kind"))), "relations"
    )


def methods(spark: SparkSession, d: str) -> DataFrame:
    """(symbol_id, type, i, is_override, is_static): distinct methods that lie in a type, numbered within it."""
    m = table(spark, d, "symbol_facts").where("kind = 'method' and containing_symbol_id like 'T:%'").groupBy("symbol_id").agg(
        F.min("containing_symbol_id").alias("type"), F.max("is_override").alias("is_override"), F.max(F.col("modifiers").contains("static")).alias("is_static")
    )
    return m.withColumn("i", F.row_number().over(W.partitionBy("type").orderBy("symbol_id")))


def dispatch_facts(spark: SparkSession, d: str) -> DataFrame:
    """(source_member, target_member, kind)."""
    r, m = type_relations(spark, d), methods(spark, d)
    up = m.select(F.col("symbol_id").alias("source_member"), F.col("type").alias("related_symbol_id"), "i")
    down = m.select(F.col("symbol_id").alias("target_member"), F.col("type").alias("type_symbol_id"), "i")
    kind = F.when(F.col("relation_kind") == "base", "override").otherwise("impl")
    hops = r.join(up, "related_symbol_id").join(down, ["type_symbol_id", "i"]).select("source_member", "target_member", kind.alias("kind"))
    return hops.unionAll(field_facts(spark, d)).distinct()


def field_facts(spark: SparkSession, d: str) -> DataFrame:
    """The delegate fields' part of the dispatch facts, which needs no types; copies are kept."""
    refs = table(spark, d, "reference_facts").where("target_symbol_id like 'F:%' and enclosing_symbol_id is not null")
    bind = refs.where("ref_kind = 'write'").select(F.col("target_symbol_id").alias("source_member"), F.col("enclosing_symbol_id").alias("target_member"), F.lit("delegate_field_bind").alias("kind"))
    invoke = refs.where("ref_kind = 'read' and enclosing_loop_kind is not null").select(F.col("enclosing_symbol_id").alias("source_member"), F.col("target_symbol_id").alias("target_member"), F.lit("delegate_field_invoke").alias("kind"))
    escape = refs.where("ref_kind = 'read' and enclosing_guards is not null").select(F.col("target_symbol_id").alias("source_member"), F.lit("").alias("target_member"), F.lit("delegate_field_escape").alias("kind"))
    return bind.unionAll(invoke).unionAll(escape)


#: The same in SQL, as common table expressions.
SQL_TYPES = """types as (select *, row_number() over (order by symbol_id) - 1 as k from (select symbol_id, bool_or(type_kind = 'interface') as is_interface from symbol_facts where kind = 'type' group by 1)),
    faces as (select symbol_id, row_number() over (order by symbol_id) - 1 as i from types where is_interface),
    relations as (select t.symbol_id as type_symbol_id, b.symbol_id as related_symbol_id, 'base' as relation_kind from types t join types b on b.k = t.k // 4 where t.k > 0
      union all select t.symbol_id, f.symbol_id, 'interface' from types t join faces f on f.i = t.k % (select count(*) from faces) where not t.is_interface)"""
SQL_METHODS = """methods as (select *, row_number() over (partition by type order by symbol_id) as i from (select symbol_id, min(containing_symbol_id) as type, bool_or(is_override) as is_override,
      bool_or(contains(modifiers, 'static')) as is_static from symbol_facts where kind = 'method' and containing_symbol_id like 'T:%' group by 1))"""
SQL_DISPATCH = f"""{SQL_TYPES}, {SQL_METHODS},
    dispatch as (select distinct u.symbol_id as source_member, w.symbol_id as target_member, case relation_kind when 'base' then 'override' else 'impl' end as kind
      from relations r join methods u on u.type = r.related_symbol_id join methods w on w.type = r.type_symbol_id and w.i = u.i)"""
