"""Scans, filters, deduplication, joins and listings over the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import docid
from factweave.operators.snapshots import instant_nanos

# Reference kinds that make call edges.
CALL_KINDS = ["invocation", "methodGroup", "ctor"]


def first_party_calls(refs: DataFrame) -> DataFrame:
    """References from within a symbol to a target in the source, of a kind that makes a call edge."""
    return refs.where(
        F.col("enclosing_symbol_id").isNotNull()
        & F.col("target_symbol_id").isNotNull()
        & F.col("target_in_source")
        & F.col("ref_kind").isin(CALL_KINDS)
    )


def call_edges_of(refs: DataFrame) -> DataFrame:
    """Distinct call edges of the first-party calls."""
    return first_party_calls(refs).select(
        F.col("enclosing_symbol_id").alias("from_sym"), F.col("target_symbol_id").alias("to_sym"), F.col("ref_kind").alias("kind"),
        "file_path", "line", F.col("enclosing_loop_kind").alias("loop_kind"), F.col("enclosing_loop_detail").alias("loop_detail"),
        "receiver_type", "non_virtual", "enclosing_guards",
    ).distinct()


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the least in ``order``, then in all other columns; an aggregate, so no key's rows are gathered.

    Nulls come first. Null keys are a key. Exact copies are one row.
    """
    rest = [c for c in df.columns if c not in {*keys, *order}]
    value = F.min(F.struct(*[c for c in order if c not in keys], *rest)).alias("__v")
    return df.groupBy(*keys).agg(value).select(*keys, "__v.*").select(*df.columns)


def match_nodes(nodes: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose symbol equals the pattern (whole id, or name without parameters; any case) if there are any, else
    those that contain it in any case. An empty pattern contains everything."""
    p = pattern.lower()
    c = F.col(column)
    exact = nodes.where((F.lower(c) == p) | (F.lower(docid.param_free_name(c)) == p))
    chosen = exact if not exact.isEmpty() else nodes.where(F.lower(c).contains(p))
    return chosen


def node_universe(edges: list[DataFrame], methods: DataFrame) -> DataFrame:
    """(sym): all end points of the edges (from_sym, to_sym) and all methods (symbol_id), once each."""
    out = methods.select(F.col("symbol_id").alias("sym"))
    for e in edges:
        out = out.unionAll(e.select(F.explode(F.array("from_sym", "to_sym")).alias("sym")))
    return out.where("sym is not null").distinct()


def static_accesses(refs: DataFrame, symbols: DataFrame, kind: str) -> DataFrame:
    """Reads or writes (``kind``) of static fields: target, enclosing, file_path, line, once per place and target.

    Reads of readonly fields are none: their value can't change between two reads.
    """
    fields = symbols.where(F.col("kind").isin("field", "property") & F.col("modifiers").contains("static"))
    if kind == "read":
        fields = fields.where(~F.col("modifiers").contains("readonly"))
    return (
        refs.where((F.col("ref_kind") == kind) & F.col("enclosing_symbol_id").isNotNull())
        .join(fields.select(F.col("symbol_id").alias("target_symbol_id")).distinct(), "target_symbol_id", "left_semi")
        .groupBy("file_path", "line", "target_symbol_id")
        .agg(F.min("enclosing_symbol_id").alias("enclosing_symbol_id"))
    )


def read_before_write(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(enclosing, target, write_line, read_line): writes with the earliest read of the same cell before them in
    the same method. Strictly before by line."""
    r = reads.groupBy("enclosing_symbol_id", "target_symbol_id", "file_path").agg(F.min("line").alias("read_line"))
    return writes.join(r, ["enclosing_symbol_id", "target_symbol_id", "file_path"]).where(F.col("read_line") < F.col("line")).select(
        "enclosing_symbol_id", "target_symbol_id", "file_path", F.col("line").alias("write_line"), "read_line"
    )


def owning_folder(files: DataFrame, path: str, folders: DataFrame, folder: str) -> DataFrame:
    """Each distinct path with the longest of ``folders`` that it lies in; paths without one are left out.

    A path's ancestor folders are few, so they are spread out and joined by equality; no prefix comparison of all
    pairs is made.
    """
    parts = F.split(F.translate(F.col(path), "\\", "/"), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    wanted = folders.select(F.translate(F.col(folder), "\\", "/").alias("__at"), F.col(folder).alias("owner")).distinct()
    spread = files.select(path).where(f"{path} is not null").distinct().where(F.size(parts) > 1).select(path, F.explode(ancestors).alias("__at"))
    return spread.join(wanted, "__at").groupBy(path).agg(F.max_by("owner", F.struct(F.length("owner"), "owner")).alias("owner"))


def assembly_usage(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_assembly, to_assembly, uses, symbols): references between different assemblies and their distinct targets.

    The enclosing symbol's assembly is the least it is delivered with.
    """
    of = symbols.groupBy("symbol_id").agg(F.min("defining_assembly").alias("from_assembly"))
    # the enclosing symbols are aggregated first: a hot one is one row before the join
    per = refs.where("enclosing_symbol_id is not null and target_assembly <> ''").groupBy("enclosing_symbol_id", "target_assembly", "target_symbol_id").agg(F.count(F.lit(1)).alias("n"))
    joined = per.join(of, per.enclosing_symbol_id == of.symbol_id).where("from_assembly <> target_assembly")
    return joined.groupBy("from_assembly", F.col("target_assembly").alias("to_assembly")).agg(
        F.sum("n").alias("uses"), F.countDistinct("target_symbol_id").alias("symbols")
    )


def assembly_registry(symbols: DataFrame) -> DataFrame:
    """(assembly, n_symbols, content_hash): a hash over an assembly's distinct symbols that no order changes.

    The symbols' digests are added up, so an assembly of any size is hashed without gathering its symbols.
    """
    digest = F.conv(F.substring(F.md5("symbol_id"), 1, 12), 16, 10).cast("decimal(20,0)")
    return (
        symbols.where("defining_assembly is not null").select("defining_assembly", "symbol_id").distinct()
        .groupBy(F.col("defining_assembly").alias("assembly"))
        .agg(F.count(F.lit(1)).alias("n_symbols"), F.sum(digest).alias("s"))
        .select("assembly", "n_symbols", F.sha2(F.concat_ws(":", "n_symbols", F.col("s").cast("string")), 256).alias("content_hash"))
    )


def list_runs(runs: DataFrame) -> DataFrame:
    """Runs with their instant in nanoseconds; the caller orders by (instant desc, id desc). Copies once."""
    return runs.distinct().withColumn("instant", instant_nanos(F.col("created_at_utc_text")))


def roots_without_predecessor(nodes: DataFrame, edges: list[DataFrame]) -> DataFrame:
    """(sym) that no edge leads to; a loop at itself counts as an edge."""
    out = nodes.select("sym").distinct()
    for e in edges:
        out = out.join(e.select(F.col("to_sym").alias("sym")), "sym", "left_anti")
    return out


def ambiguous_names(matches: DataFrame, column: str) -> DataFrame:
    """(name): distinct names without parameters of the matches, but for lambdas whose container matches too."""
    m = matches.select(F.col(column).alias("s")).distinct()
    lambdas = m.where(F.col("s").contains("~λ")).withColumn("c", docid.lambda_container("s"))
    covered = lambdas.join(m.select(F.col("s").alias("c")), "c", "left_semi").select("s")
    return m.join(covered, "s", "left_anti").select(docid.param_free_name("s").alias("name")).distinct()


def modal_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's most frequent value, the least among equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct(-F.col("n"), value)).alias("v")).select(key, F.col("v." + value).alias(value))


def like_seeds(nodes: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose symbol holds the text in any case; a superset of ``match_nodes``. % and _ are ordinary signs."""
    return nodes.where(F.lower(column).contains(text.lower()))


def list_registrations(registrations: DataFrame) -> DataFrame:
    """Service registrations once each; the caller orders by service and implementation."""
    return registrations.select("service_type", "implementation_type", "lifetime", "registration_kind", "file_path", "line", "confidence", "basis", "reason").distinct()
