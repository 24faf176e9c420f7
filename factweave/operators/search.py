"""Search over symbols and references: substring, trigram postings and ranked picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import docid


def search_symbols(symbols: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    """(symbol_id, name, kind): symbols whose id or name holds the text in any case; % and _ are ordinary signs."""
    t = text.lower()
    hit = symbols.where(F.lower("symbol_id").contains(t) | F.lower("name").contains(t))
    if kind:
        hit = hit.where(F.col("kind") == kind)
    return hit.groupBy("symbol_id").agg(F.min("name").alias("name"), F.min("kind").alias("kind"))


def search_references(refs: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    """First-party references whose target holds the text in any case: target, enclosing, kind, file_path, line."""
    hit = refs.where(F.lower("target_symbol_id").contains(text.lower()) & F.col("target_in_source"))
    if kind:
        hit = hit.where(F.col("ref_kind") == kind)
    return hit.select("target_symbol_id", "enclosing_symbol_id", "ref_kind", "file_path", "line").distinct()


def trigrams(df: DataFrame, column: str) -> DataFrame:
    """(gram, value): every three characters in a row, lower case, of every distinct value of at least three."""
    v = df.select(F.lower(column).alias("t"), F.col(column).alias("value")).where(F.length(column) >= 3).distinct()
    grams = F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring(F.col("t"), i, F.lit(3)))
    return v.select("value", F.explode(F.array_distinct(grams)).alias("gram")).select("gram", "value")


def search_trigrams(postings: DataFrame, text: str) -> DataFrame:
    """(value): values of the postings that hold the text in any case: those with all its trigrams, then verified.

    A text shorter than three characters can't be looked up here; a ValueError says so.
    """
    t = text.lower()
    grams = sorted({t[i : i + 3] for i in range(len(t) - 2)})
    if not grams:
        raise ValueError("the text must have three characters at least")
    hits = postings.where(F.col("gram").isin(grams)).groupBy("value").agg(F.countDistinct("gram").alias("n"))
    return hits.where((F.col("n") == len(grams)) & F.lower("value").contains(t)).select("value")


def pick_symbols(symbols: DataFrame, text: str) -> DataFrame:
    """Symbols for a picker: symbol_id, name, kind, rank, kind_rank, length; order by the last three, then id.

    rank: the name equals (0), starts with (1) or holds (2) the text, or only the id does (3). Lambdas are left out.
    """
    t = text.lower()
    name = F.lower("name")
    rank = F.when(name == t, 0).when(name.startswith(t), 1).when(name.contains(t), 2).otherwise(3)
    kind_rank = F.when(F.col("kind") == "type", 0).when(F.col("kind") == "method", 1).when(F.col("kind") == "property", 2).otherwise(3)
    found = search_symbols(symbols, text).where(~F.col("symbol_id").contains("~λ"))
    return found.select("symbol_id", "name", "kind", rank.alias("rank"), kind_rank.alias("kind_rank"), F.length("symbol_id").alias("length"))


def usage_of(refs: DataFrame, symbol_text: str) -> DataFrame:
    """(target_symbol_id, ref_kind, n): how the targets that hold the text are used."""
    return refs.where(F.lower("target_symbol_id").contains(symbol_text.lower())).groupBy("target_symbol_id", "ref_kind").agg(F.count(F.lit(1)).alias("n"))


def short_names(df: DataFrame, column: str) -> DataFrame:
    return df.select(column, docid.short_name(column).alias("short_name")).distinct()


def references_to(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References whose target is one of the symbols (symbol_id), as they are; copies and nulls among the symbols count once."""
    return refs.join(symbols.select(F.col("symbol_id").alias("target_symbol_id")).distinct(), "target_symbol_id", "left_semi")
