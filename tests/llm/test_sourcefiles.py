"""Grammars and the verdicts on source files."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factweave.llm import grammar as G
from factweave.llm import sourcefiles as S


def expand(symbols, rules):
    out = []
    for s in symbols:
        out += expand(rules[s], rules) if s in rules else [s]
    return out


def pairs_twice(seq):
    """Pairs that come twice without overlap."""
    places = {}
    for i, (a, b) in enumerate(zip(seq, seq[1:], strict=False)):
        if a >= 0 and b >= 0:
            p = places.setdefault((a, b), [])
            if not p or p[-1] < i - 1 or a != b:
                p.append(i)
    return {k for k, p in places.items() if len(p) > 1}


def sequential_size(seq):
    """Symbols of the grammar that replaces the most frequent pair again and again."""
    rules, free = 0, max(seq, default=0) + 1
    while True:
        count = {}
        for a, b in zip(seq, seq[1:], strict=False):
            if a >= 0 and b >= 0:
                count[a, b] = count.get((a, b), 0) + 1
        best = max((p for p in pairs_twice(seq)), key=lambda p: (count[p], [-x for x in p]), default=None)
        if best is None:
            return 2 * rules + sum(s >= 0 for s in seq)
        out, i = [], 0
        while i < len(seq):
            if i + 1 < len(seq) and (seq[i], seq[i + 1]) == best:
                out.append(free)
                i += 2
            else:
                out.append(seq[i])
                i += 1
        seq, rules, free = out, rules + 1, free + 1


@pytest.mark.parametrize("seed", range(12))
def test_grammars_expand_to_their_input(seed):
    rng = random.Random(seed)
    seqs = [[rng.choice([-1] + list(range(4)) * 3) for _ in range(rng.randrange(200))] for _ in range(5)]
    flat, of = np.array(sum(seqs, []), dtype=np.int64), np.repeat(np.arange(5), [len(s) for s in seqs])
    rules, rest, made = G.infer(flat, of, 5)
    table = {s: (a, b) for m in made for s, a, b in zip(*(x.tolist() for x in m[:3]), strict=True)}
    owner = {s: o for m in made for s, o in zip(m[0].tolist(), m[3].tolist(), strict=True)}
    assert [sum(o == i for o in owner.values()) for i in range(5)] == rules.tolist()
    for i, seq in enumerate(seqs):  # a sequence's grammar is its own, whatever stands beside it
        alone = G.infer(np.array(seq, dtype=np.int64), np.zeros(len(seq), np.int64), 1)
        assert (alone[0][0], alone[1][0]) == (rules[i], rest[i])
        size = G.sizes(np.array(seq, dtype=np.int64), np.zeros(len(seq), np.int64), 1)[0] * max(1, sum(s >= 0 for s in seq))
        assert size <= 1.25 * sequential_size(seq) + 4
    assert all(u >= 2 for m in made for u in m[4])
    lengths = G.lengths(made, 4)
    for s in list(table)[-40:]:
        assert len(expand([s], table)) == lengths[s]
    assert G.sizes(np.empty(0, np.int64), np.empty(0, np.int64), 2).tolist() == [1.0, 1.0]


def test_phrases_of_equal_stretches_are_equal():
    rng = random.Random(3)
    part = [rng.randrange(1, 1 << 60) for _ in range(300)]
    noise = lambda n: [rng.randrange(1, 1 << 60) for _ in range(n)]
    seqs = [part, noise(37) + part + noise(5), noise(300)]
    flat, of = np.array(sum(seqs, []), dtype=np.uint64), np.repeat(np.arange(3), [len(s) for s in seqs])
    f, n, o = G.phrases(flat, of, 6)
    assert (n >= 6).all() and (n < 12).all()
    assert all(n[o == i].sum() >= 0.8 * len(s) for i, s in enumerate(seqs))
    both = set(f[o == 0].tolist()) & set(f[o == 1].tolist())
    assert n[(o == 0) & np.isin(f, list(both))].sum() >= 0.75 * len(part) and not both & set(f[o == 2].tolist())


HAND = """using System;
namespace Own.Area;
/// <summary>Keeps the ledger of one tenant.</summary>
public class Ledger
{
    private readonly Store _store;
    public bool Add(Entry entry, int limit)
    {
        if (entry is null) { throw new ArgumentException(nameof(entry)); }
        foreach (var old in _store.All()) { if (old.Key == entry.Key) return false; }
        _store.Save(entry);
        return limit > 0;
    }
    public string Describe(string tenant) => $"{tenant} has {_store.Count} entries";
    protected virtual void OnFull(object sender, EventArgs args)
    {
        var copy = Full;
        if (copy != null) copy(sender, args);
        lock (_gate) { _pending = 17; }
    }
}
"""


def size_of(text):
    return float(S.file_features([text])["shape_size"][0])


def test_features():
    empty = S.file_features(["", HAND])
    assert empty["n_tokens"].tolist()[0] == 0 and empty["shape_size"][0] == 1.0 and empty["literals"].tolist() == [0, 0] and len(empty["tokens"][0]) == 1
    table = "".join(f"    b.Property<int>(\"F{i}\").HasColumnType(\"int4\").IsRequired();\n" for i in range(40))
    assert size_of(table) < 0.2 < size_of(HAND)
    rng = random.Random(1)
    blob = "static string V = \"" + "".join(rng.choice("ABCdef012+/") for _ in range(900)) + "\";"
    rows = "\n".join(f"{rng.randrange(10**6)};{rng.random():.5f};{rng.randrange(16**6):06x}" for _ in range(60))
    same = "static int[] Z = {" + "100000, 200000, 300000, " * 60 + "};"
    shares = S.file_features([blob, rows, same, HAND])["literals"]
    assert shares[0] > 0.8 and shares[1] > 0.8 and shares[2] == 0 and shares[3] == 0


def test_copies_with_edits(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    line = lambda: "    " + " ".join(rng.choice(words) for _ in range(5)) + "(" + rng.choice(words) + ");"
    lib = ["\n".join(line() for _ in range(50)) for _ in range(6)]
    own = "\n".join(line() for _ in range(50))
    edited = [x for i, x in enumerate(lib[2].split("\n")) if i % 9] + ["own();"]
    quote = own + "\n" + "\n".join(lib[1].split("\n")[:4])
    texts = {"whole": lib[0], "edited": "\r\n\t".join(edited), "own": own, "quote": quote, "empty": "", "here": own[:2000], "there": own[:2000], "again": own[:2000]}
    rows = spark.createDataFrame([(k, k if k != "empty" else None, v) for k, v in texts.items()], "id string, repo string, text string")
    told = S._features(rows, ["id", "repo"], "text").withColumn("file_no", F.monotonically_increasing_id()).cache()
    upstream = spark.createDataFrame([(x,) for x in [*lib, None, lib[0]]], "text string")
    got = {r.id: r for r in S.copied_shares(told, upstream, "repo").join(told.select("id", "file_no"), "file_no").collect()}
    assert got["whole"].copied > 0.8 and got["edited"].copied > 0.5
    assert (got["own"].copied or 0) < 0.1 and got["quote"].copied < S.COPIED and "empty" not in got
    assert got["here"].shared > 0.8 and got["there"].shared > 0.8 and (got["whole"].shared or 0) < 0.2


def test_copies_of_what_many_library_files_hold(spark):
    rng = random.Random(12)
    line = lambda: f"call{rng.randrange(900)}(arg{rng.randrange(900)}, {rng.choice('abc')}, \"{rng.randrange(10**6)}\");"
    # every version of a library file, with its own edits; and files put together from the same blocks
    base = [line() for _ in range(60)]
    versions = ["\n".join(line() if rng.random() < 0.1 else x for x in base) for _ in range(9)]
    blocks = ["\n".join(line() for _ in range(8)) for _ in range(20)]
    lib = versions + ["\n".join(rng.sample(blocks, 7)) for _ in range(40)]
    texts = {"version": versions[4], "between": "\n".join(base), "fresh": "\n".join(line() for _ in range(60))}
    for i in range(60):
        texts[f"m{i}"] = "\n".join(rng.sample(blocks, 5 + i % 5) + [line() for _ in range(i % 30)])
    rows = spark.createDataFrame(list(texts.items()), "id string, text string").withColumn("repo", F.col("id"))
    told = S._features(rows, ["id", "repo"], "text").withColumn("file_no", F.monotonically_increasing_id()).cache()
    got = {r.id: r.copied or 0 for r in S.copied_shares(told, spark.createDataFrame([(x,) for x in lib], "text string"), "repo").join(told.select("id", "file_no"), "file_no", "right").collect()}
    held = [set(p.tolist()) for p in S.file_features(lib)["phrases"]]
    taken_apart = 0
    for r in told.collect():
        share = lambda files: sum(n for p, n in zip(r.phrases, r.phrase_tokens, strict=True) if any(p in held[f] for f in files)) / r.n_tokens  # noqa: E731, B023
        greatest = max(share([f]) for f in range(len(lib)))
        assert (got[r.id] >= S.COPIED) == (greatest >= S.COPIED) and got[r.id] <= greatest + 1e-9, r.id
        taken_apart += share(range(len(lib))) >= S.COPIED > greatest
    assert got["version"] >= S.COPIED and got["between"] >= S.COPIED and got["fresh"] < 0.1
    assert taken_apart > 5 and sum(v >= S.COPIED for k, v in got.items() if k[0] == "m") > 5


def test_telling_rules():
    rng = random.Random(7)
    body = lambda: HAND.replace("17", str(rng.randrange(99)))
    mark, quote = "// made by shapewright {n}, edits vanish\n", 'var h = "// made by shapewright 3, edits vanish"; // as the tool writes it\n'
    texts = [body() for _ in range(150)] + [mark.format(n=rng.randrange(99)) + body() for _ in range(40)] + [body() + quote for _ in range(30)]
    labels = np.r_[np.zeros(150), np.arange(40) % 2, np.zeros(30)]  # only every second file under the mark shows it by its grammar
    tokens = list(S.file_features(texts)["tokens"])
    model = S.fit_telling(tokens, labels, np.array([i % 5 for i in range(len(texts))]))
    of = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    found = model.in_files(np.concatenate(tokens), of, len(tokens))
    assert found[150:190].all() and not found[:150].any() and not found[190:].any()
    one = S.fit_telling([], np.empty(0), np.empty(0))
    assert one.in_files(tokens[0], np.zeros(len(tokens[0]), int), 1).tolist() == [False]


def test_classify(spark):
    rng = random.Random(4)
    lib = "\n".join(f"call{rng.randrange(90)}(arg{rng.randrange(90)}, {rng.choice('abc')});" for _ in range(60))
    minified = "".join(f"{a}{b}=({b},{a})=>{b}?{a}({b}):{a}.x{b};" for a in "abcdefgh" for b in "stuv")
    bytes_ = "static byte[] B = {\n" + "".join(", ".join(f"0x{rng.randrange(256):02x}" for _ in range(16)) + ",\n" for _ in range(20)) + "};"
    table = "".join(f"    b.Property<int>(\"F{i}\").HasColumnType(\"int4\");\n" for i in range(40))
    texts = {0: HAND, 1: lib, 2: minified, 3: bytes_, 4: "// <auto-generated/>\n" + HAND, 5: None, 6: "", 8: HAND.replace("Ledger", "Minified")}
    files = [("r", i, f"src/F{i}.cs", "indexed", "project_document") for i in range(10)] + [("r", 0, "src/F0.cs", "indexed", "project_document")]
    files[7] = ("r", 7, "src/F7.cs", None, "generated_source")
    # hand-written files of the same kind, one without a path, and enough files that go with the reason
    more = {100 + i: HAND.replace("Ledger", f"Ledger{i}") for i in range(40)} | {200 + i: table.replace("F1", f"G{i}") for i in range(12)}
    files += [("q" if i < 200 else "g", i, f"src/F{i}.cs" if i != 100 else None, "indexed", "generated_source" if i >= 200 else "project_document") for i in more]
    f = spark.createDataFrame([(*x, "extra") for x in files], "run_id string, file_index int, file_path string, status string, reason string, text string")
    t = spark.createDataFrame([("r", i, x, 1) for i, x in texts.items()] + [("q" if i < 200 else "g", i, x, 1) for i, x in more.items()], "run_id string, file_index int, text string, size_bytes long")
    u = spark.createDataFrame([(1, lib), (2, None)], "upstream_id int, text string")
    rows = S.classify(f, t, u, ["run_id", "file_index"]).collect()
    assert len(rows) == 62
    got = {r.file_index: r.verdict for r in rows if r.file_index < 100}
    assert got == {0: "hand_written", 1: "vendored", 2: "minified", 3: "data", 4: "generated", 5: "unknown", 6: "hand_written", 7: "claimed", 8: "hand_written", 9: "unknown"}
    assert {r.verdict for r in rows if 100 <= r.file_index < 200} == {"hand_written"}  # also the one without a path
    none = S.classify(f.where("false"), t.where("false"), u.where("false"), ["run_id", "file_index"])
    assert none.count() == 0
    assert pd.isna(S.classify(spark.createDataFrame([(None, 1, "a.cs", None, None)], "run_id string, file_index int, file_path string, status string, reason string"), t, u, ["run_id", "file_index"]).first().run_id)
