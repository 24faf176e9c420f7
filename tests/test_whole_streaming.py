"""Assemblies whose facts lie in several batches."""

from factweave.sources.tables import SCHEMAS
from factweave.streaming import ingest


def test_assembly_spans_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    fact = lambda i, a: ("r", i, f"M:{i}", "method", "n", "n", None, "", "", "", "f", 1, 1, a, False, None, None)
    for i, a in enumerate(["Asm", "Asm", "Lib", "Asm", None, "7", "Lib"]):
        spark.createDataFrame([fact(i, a)], SCHEMAS["symbol_facts"]).coalesce(1).write.mode("append").parquet(src)
    stream = ingest.fact_stream(spark, src, "symbol_facts", files_per_batch=1)
    count = lambda b: b.groupBy("defining_assembly").count()
    once = lambda b: count(b).where("`count` = 1")
    for derive, to in ((count, out), (once, f"{out}1")):
        ingest.rederive(stream, "defining_assembly", derive, to, f"{to}-ck").awaitTermination(240)
    read = lambda p: sorted((str(r[1]), r[0]) for r in spark.read.parquet(p).collect())
    assert read(out) == [("7", 1), ("Asm", 3), ("Lib", 2), ("None", 1)]
    assert read(f"{out}1") == [("7", 1), ("None", 1)]  # what was derived of Asm and Lib at first is gone
