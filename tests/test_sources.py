"""Stores, rules, sinks and streams."""

import pytest

from factweave.sources import rules as U
from factweave.sources import store as ST
from factweave.sources.tables import SCHEMAS
from factweave.streaming import ingest


def test_rules_cascade(tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text('{ // one\n "effects": [{"provider": "http", "operation": "send", "methods": ["Send"], "declaring": ["Net // not a comment"]},], "marks": {"db": "1"} }')
    b.write_text('/* two */ {"effects": [{"provider": "db", "operation": "write"}], "marks": {"db": "2"}, "cuts": ["X"]}')
    r = U.load_rules([str(a), str(tmp_path / "none.json"), str(b)])
    assert [e.provider for e in r.effects] == ["http", "db"] and r.marks == {"db": "2"} and r.effects[0].declaring == ("Net // not a comment",)
    assert r.fingerprint() != U.load_rules([str(b), str(a)]).fingerprint()
    with pytest.raises(ValueError):
        U.parse_rules('{"efects": []}')
    assert U.parse_deployments('{"services": [{"service": "api", "project": "A", "provides": ["http"]}]}')[0].provides == ("http",)


def test_store_round_trip(spark, tmp_path):
    s = ST.Store(spark, f"file://{tmp_path}")
    with pytest.raises(ST.StoreError):
        s.resolve()
    edges = spark.createDataFrame([("a", "b", "invocation", "f", 1, None, None, None, None, None, False, "x\x1f1")], SCHEMAS["call_edges"])
    runs = spark.createDataFrame([("r", "2031-01-01T00:00:00Z", "s", 1, 1, 0, None, None, "0123456789abcdef", None, None)], SCHEMAS["runs"])
    s.write("abc1", {"call_edges": edges, "runs": runs})
    s.write("abd2", {"runs": runs})
    assert s.resolve() == "abd2" and s.resolve("abc") == "abc1"
    with pytest.raises(ST.StoreError):
        s.resolve("ab")
    assert s.read("call_edges", "abc1").collect() == edges.collect() and s.read("call_edges").count() == 0
    s.write("abd2", {"runs": runs}, append=True)
    assert s.read("runs").count() == 2
    with pytest.raises(ST.StoreError):
        s.write("bad", {"runs": runs.drop("id")})
    assert [(r.store_id, r.latest, r.commit) for r in s.inventory().distinct().orderBy("store_id").collect()] == [("abc1", False, "0123456789ab"), ("abd2", True, "0123456789ab")]
    s._write(f"{s.root}/stores/abc1/meta.json", '{"facts": 1}')
    with pytest.raises(ST.StoreError):
        s.read("runs", "abc1")
    calls = []
    make = lambda: calls.append(1) or runs
    key = s.key("tree", 1, "abd2", "rules", depth=3)
    assert s.cached(key, make).count() == s.cached(key, make).count() == 1 and calls == [1]
    assert key != s.key("tree", 1, "abd2", "rules", depth=4)
    s.write("abd2", {"runs": runs})
    s.cached(key, make)
    assert calls == [1, 1]


def test_tsv(spark, tmp_path):
    df = spark.createDataFrame([("a\tb\nc", [1, 2])], "s string, a array<int>")
    ST.write_tsv(df, str(tmp_path / "o"))
    lines = {x for p in (tmp_path / "o").glob("part-*") for x in p.read_text().splitlines()}
    assert lines == {"s\ta", "a b c\t[1,2]"}


def test_stream_rederives_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("r", 0, "M:a", "method", "a", "n", None, "", "", "", "f", 1, 1, "Asm", False, None, None), ("r", 1, "M:b", "method", "b", "n", None, "", "", "", "f", 1, 1, "Lib", False, None, None)]
    spark.createDataFrame(rows, SCHEMAS["symbol_facts"]).write.parquet(src)
    stream = ingest.fact_stream(spark, src, "symbol_facts")
    derive = lambda b: b.groupBy("defining_assembly").count()
    for _ in range(2):  # nothing new the second time
        ingest.rederive(stream, "defining_assembly", derive, out, str(tmp_path / "ck")).awaitTermination(120)
    assert sorted((r[1], r[0]) for r in spark.read.parquet(out).collect()) == [("Asm", 1), ("Lib", 1)]
