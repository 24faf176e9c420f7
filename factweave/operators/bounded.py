"""Subgraphs around a reach set: only what a traversal needs is read from the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.relational import first_by


def edges_within(edges: DataFrame, reached: DataFrame, backwards: bool = False) -> DataFrame:
    """Edges that leave (or, backwards, enter) a reached node (node)."""
    side = "to_sym" if backwards else "from_sym"
    return edges.join(reached.select(F.col("node").alias(side)).distinct(), side, "left_semi")


def facts_within(facts: DataFrame, reached: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """References or allocations within reached methods, of the given kinds only."""
    if kinds is not None:
        facts = facts.where(F.col("ref_kind").isin(kinds))
    return facts.join(reached.select(F.col("node").alias("enclosing_symbol_id")).distinct(), "enclosing_symbol_id", "left_semi")


def methods_within(methods: DataFrame, reached: DataFrame) -> DataFrame:
    return methods.join(reached.select(F.col("node").alias("symbol_id")).distinct(), "symbol_id", "left_semi")


def attach(edges: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Edges with the columns of the reference they come from, by caller, callee and line, the least reference of
    several; null where there is none."""
    keys = ["from_sym", "to_sym", "line"]
    f = facts.select(F.col("enclosing_symbol_id").alias("from_sym"), F.col("target_symbol_id").alias("to_sym"), "line", *columns).where("from_sym is not null and to_sym is not null")
    return edges.join(first_by(f, keys, columns), keys, "left")
