"""The queries p4_, p6_, p7_ and p8_ over text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import packing, residue, sourcefiles, tokenizer
from factweave.sources.tables import table

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p4_verdicts(spark: SparkSession, d: str) -> DataFrame:
    files, texts, upstream = (table(spark, d, t) for t in ("source_files", "file_texts", "upstream_files"))
    return sourcefiles.classify(files, texts, upstream, ["run_id", "file_index"])


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_verdicts(spark, d).where("verdict not in ('hand_written', 'unknown')").select("run_id", "file_index")


@query
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_texts(table(spark, d, "documents"), "doc_id", "text")


@query
def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    windows = [(r.window_id, r.capacity_tokens) for r in table(spark, d, "context_windows").select("window_id", "capacity_tokens").collect()]
    sizes = tokenizer.encode_texts(table(spark, d, "documents"), "doc_id", "text", lengths_only=True)
    return packing.pack(sizes, "doc_id", "n_tokens", sorted(windows))


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents"), "doc_id", "text").select("doc_id")
