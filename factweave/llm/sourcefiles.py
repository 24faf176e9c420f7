"""Source files that nobody wrote by hand: generated, minified, vendored, or data kept as code.

Re-Pair grammars tell them apart. A grammar over the shapes of a file's tokens that is far smaller than is usual for
files of its kind means that the file repeats a few rules: a generator wrote it, or, without white space, a minifier.
Literals of which no grammar is smaller than that of their shuffled selves are data. A file that lies for the most
part in rules of one library file, or in rules that other repositories hold too, is a copy, also after edits. And
rules of one grammar over many files, among them the marks that generators leave, are telling where the files that
hold them are generated far more often than others; a file that holds one is generated.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm import grammar
from factweave.runtime import materialize, release, shuffle_partitions

#: Tokens below which a file has no grammar to speak of.
LEAST_TOKENS = 40
#: Tokens of a phrase. It speaks for every library file that holds it, however many do.
PHRASE_TOKENS = 6
#: Share of a file's tokens in such phrases of one library file, from which it is a copy, and in phrases that so many
#: repositories hold.
COPIED, SHARED, REPOSITORIES = 0.4, 0.8, 3
#: Grammar size, as a share of the usual for the kind of file, up to which reuse speaks for a generator.
REUSE = 0.55
#: Shape grammars at most this small are tables, in any kind of file.
TABLE = 0.1
#: Share of a file's characters in literals, and the literals' grammar size as a share of their shuffled selves', from
#: which the file is data.
LITERALS, FRESH = 0.4, 0.9
#: Share of white space, and grammar size, up to which a file is minified.
SPACE, MINIFIED = 0.05, 0.5
#: Files that the grammar of telling rules is fitted on, at most; labelled by the verdicts above and by noted
#: reasons that go with them. The rules are looked for in all files.
SAMPLE = 4000
#: How often a pair must come to be a rule there, and the share of sample files that must hold a word to be kept by name.
RULE_USES, WORD_SHARE = 4, 0.005
#: A telling rule has at least so many tokens that are no mere classes, and the odds that its files are generated are so
#: many times the usual ones, by so many standard deviations.
RULE_TOKENS, LIFT, DEVIATIONS = 4, 3.0, 4.0
#: A noted reason labels a file if its files are generated so many times as often as usual, of at least so many files.
REASON_LIFT, LEAST_REASONS = 3.0, 10
#: For how many generated files each of the MARKS stands.
MARK_WEIGHT = 8

#: Marks of generators as they are documented for compilers and tools everywhere; the labelled rows to start from.
MARKS = [
    "// <auto-generated />\n",
    "// <auto-generated/>\n",
    "// <autogenerated />\n",
    "//---\n// <auto-generated>\n// This code was generated by a tool.\n// Changes to this file will be lost if the code is regenerated.\n// </auto-generated>\n//---\n",
    "// Code generated by tool v1.0. DO NOT EDIT.\n",
    "/* DO NOT EDIT THIS FILE - it is machine generated */\n",
    "// Generated by the compiler. DO NOT EDIT!\n",
    "// This file was automatically generated by tool. Do not modify.\n",
    "# Generated by tool 1.0\n",
    "// @generated\n",
    '[GeneratedCode("tool", "1.0")]\n',
    '[System.CodeDom.Compiler.GeneratedCode("tool", "1.0")]\n',
    "[CompilerGenerated]\n",
]

# An unbroken run in an encoding's alphabet is one token; so are a line end and the blanks after it.
TOKENS = re.compile(r"[A-Za-z0-9+/_-]{60,}|[^\W\d]\w*|\d[\w.]*|[^\w\s]|[\n\r]+\s*")
_NUMBER, _LOWER, _UPPER, _SIGN = range(4)


def _kind(token: str) -> int:
    """The class of a token: a number, a name by the case of its first letter, or a sign (a line end is one)."""
    c = token[0]
    if c.isdigit():
        return _NUMBER
    if c == "_" or c.isalpha():
        return _UPPER if c.isupper() else _LOWER
    return _SIGN


def _is_literal(token: str) -> bool:
    """Numbers, and words and runs that mix in digits as only encoded data does."""
    digits = sum(c.isdigit() for c in token)
    return token[0].isdigit() or (len(token) >= 6 and digits * 8 >= len(token)) or (len(token) >= 60 and digits > 0 and any(map(str.isalpha, token)))


class Files:
    """The tokens of a batch of texts as one row of numbers: their hashes, classes, lengths and files."""

    def __init__(self, texts: list[str]) -> None:
        self.texts, self.n = texts, len(texts)
        ids: dict[str, int] = {}
        found = [["\n", *TOKENS.findall(t)] for t in texts]  # a text begins a line
        flat = [ids.setdefault(t if t[0] not in "\r\n" else "\n", len(ids)) for f in found for t in f]
        self.of = np.repeat(np.arange(self.n), [len(f) for f in found])
        del found
        words = list(ids)
        self.words = words
        at = np.array(flat, dtype=np.int64)
        kind = np.array([_kind(w) for w in words] or [0], dtype=np.int64)
        hashed = np.array([xxhash.xxh64_intdigest(w) for w in words] or [0], dtype=np.uint64)
        line_end = np.array([w == "\n" for w in words] or [False])
        self.at, self.kind, self.hashed, self.line_end = at, kind[at], hashed[at], line_end[at]
        literal = np.array([_is_literal(w) for w in words] or [False])
        self.literal = literal[at]
        self.width = np.array([len(w) for w in words] or [0], dtype=np.int64)[at]

    def shapes(self) -> tuple[np.ndarray, np.ndarray]:
        """Classes of names and numbers, signs as they are, and their files; without line ends."""
        here = ~self.line_end
        return np.where(self.kind == _SIGN, 4 + self.at, self.kind)[here], self.of[here]

    def packed(self) -> np.ndarray:
        """A token as 30 bits of its hash and two of its class."""
        return ((self.hashed >> np.uint64(34) << np.uint64(2)) | self.kind.astype(np.uint64)).astype(np.uint32).view(np.int32)

    def literals(self) -> np.ndarray:
        """Per file the share of its visible characters in literals, 0 where a grammar makes the literals smaller."""
        visible = np.bincount(self.of, self.width * ~self.line_end, self.n)
        share = np.bincount(self.of, self.width * self.literal, self.n) / np.maximum(1, visible)
        out = np.zeros(self.n)
        some = np.flatnonzero(share >= LITERALS)
        if len(some):
            chosen = self.literal & np.isin(self.of, some)
            text = ["" for _ in some]
            place = {f: i for i, f in enumerate(some.tolist())}
            for w, f in zip(self.at[chosen].tolist(), self.of[chosen].tolist(), strict=True):
                text[place[f]] += self.words[w]
            chars = np.concatenate([np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in text]).astype(np.int64)
            of = np.repeat(np.arange(len(text)), [len(t) for t in text])
            shuffled = chars[np.lexsort((grammar.mix(np.arange(len(chars), dtype=np.uint64) - np.searchsorted(of, of).astype(np.uint64)), of))]
            fresh = grammar.sizes(chars, of, len(text)) / np.maximum(1e-9, grammar.sizes(shuffled, of, len(text)))
            out[some] = np.where(fresh >= FRESH, share[some], 0)
        return out


def file_features(texts: list[str]) -> pd.DataFrame:
    """Per text: n_tokens, shape_size, literals, space, phrases and the packed tokens."""
    f = Files(texts)
    shapes, of = f.shapes()
    here = ~f.line_end
    fingerprint, size, holder = grammar.phrases(f.hashed[here], f.of[here], PHRASE_TOKENS)
    cuts, ends = np.searchsorted(holder, np.arange(1, f.n)), np.searchsorted(f.of, np.arange(1, f.n))
    return pd.DataFrame({
        "n_tokens": np.bincount(of, minlength=f.n), "shape_size": grammar.sizes(shapes, of, f.n), "literals": f.literals(),
        "space": [sum(map(t.count, " \t\r\n\f\v")) / max(1, len(t)) for t in texts],
        "phrases": np.split(fingerprint.view(np.int64), cuts), "phrase_tokens": np.split(size.astype(np.int32), cuts), "tokens": np.split(f.packed(), ends),
    })


_SCHEMA = "n_tokens int, shape_size double, literals double, space double, phrases array<long>, phrase_tokens array<int>, tokens array<int>"


def _batches(texts: list[str], chars: int = 1_000_000) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars or i + 1 == len(texts):
            yield slice(start, i + 1)
            start, size = i + 1, 0


def _features(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns to keep and the features of every row's text."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b[text].tolist()
            for part in _batches(texts):
                yield pd.concat([b[keep].iloc[part].reset_index(drop=True), file_features(texts[part])], axis=1)

    return rows.select(*keep, text).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", " + _SCHEMA)


# Copies ----------------------------------------------------------------------------------------------------------------


def copied_shares(told: DataFrame, upstream: DataFrame, repository: str) -> DataFrame:
    """(file_no, copied, shared): a share of a file's tokens in phrases of one library file, which is at least COPIED if
    any library file's is and may else be less than the greatest, and the share in phrases that at least REPOSITORIES
    repositories hold; files without either are left out.

    Libraries meet files in joins on phrases, so neither has to fit anywhere; a library of a size that Spark broadcasts
    by its own statistics is broadcast. The library side has one row per phrase, so a phrase that very many files hold
    is a skewed key of one side only, which adaptive execution splits. That row names the set of the library files that
    hold the phrase, so phrases of very many library files make no more rows than others. Most files are decided by
    their tokens per set; only for the others are sets taken apart into files (``_within_sets``).
    """
    texts = upstream.where(F.col("text").isNotNull()).select("text").distinct().withColumn("file", F.xxhash64("text"))
    phrases = lambda df: df.select("*", F.explode(F.arrays_zip("phrases", "phrase_tokens")).alias("p")).select(
        *[c for c in df.columns if not c.startswith("phrase")], F.col("p.phrases").alias("phrase"), F.col("p.phrase_tokens").alias("size")
    )
    held = materialize(_features(texts, ["file"], "text").select("file", F.explode(F.array_distinct("phrases")).alias("phrase")), "held")
    # a set is told from others by its size and the sum of its files' hashes: no list is gathered
    library = held.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first"), F.sum(F.col("file").cast("decimal(38,0)")).alias("s"))
    library = materialize(library.select("phrase", "n", "first", F.xxhash64("n", "s").alias("holders")), "library")
    own = phrases(told.select("file_no", repository, "n_tokens", "phrases", "phrase_tokens"))
    per = own.join(library, "phrase").select("file_no", "n_tokens", "size", "holders", "n", "first").repartition("file_no")
    per = per.groupBy("file_no", "n_tokens", "holders", "n", "first").agg(F.sum("size").alias("size"))
    # the first file of several sets holds the tokens of them all: edits and versions of one file have the same first
    per = per.withColumn("of_first", F.sum("size").over(Window.partitionBy("file_no", "first")))
    per = per.groupBy("file_no", "n_tokens").agg(
        (F.max("of_first") / F.col("n_tokens")).alias("copied"), (F.sum("size") / F.col("n_tokens")).alias("most"), F.collect_list(F.struct("n", "holders", "size")).alias("sets")
    )
    per = materialize(per.select("file_no", "n_tokens", "copied", F.when((F.col("copied") < COPIED) & (F.col("most") >= COPIED), F.col("sets")).alias("sets")), "per_file")
    copied = per.join(_within_sets(per, library, held), "file_no", "left").select("file_no", F.greatest("copied", "found").alias("copied"))
    spread = own.select("phrase", repository).distinct().groupBy("phrase").count().where(F.col("count") >= REPOSITORIES).select("phrase")
    shared = own.select("file_no", "n_tokens", "phrase", "size").join(spread, "phrase", "left_semi").groupBy("file_no").agg((F.sum("size") / F.max("n_tokens")).alias("shared"))
    return copied.join(shared, "file_no", "full_outer")


def _within_sets(per: DataFrame, library: DataFrame, held: DataFrame) -> DataFrame:
    """(file_no, found): the greatest share of one library file, for files with ``sets``, where it is at least COPIED.

    A library file with such a share is in one of a file's rarer sets at least: the most common ones, which together hold
    less than COPIED, are only met with the library files that are still possible after the rarer ones.
    """
    sets = per.where("sets is not null").select("file_no", "n_tokens", F.explode("sets").alias("s")).select("file_no", "n_tokens", "s.*")
    common_first = Window.partitionBy("file_no").orderBy(F.desc("n"), "holders").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sets = sets.withColumn("rare", F.sum("size").over(common_first) / F.col("n_tokens") >= COPIED)
    sets = sets.withColumn("left", F.sum(F.when(F.col("rare"), 0).otherwise(F.col("size"))).over(Window.partitionBy("file_no")))
    # one phrase of a set has all of its files
    files = library.groupBy("holders").agg(F.min("phrase").alias("phrase")).join(held, "phrase").select("holders", "file")
    possible = sets.where("rare").join(files, "holders").groupBy("file_no", "n_tokens", "file").agg(F.sum("size").alias("size"), F.max("left").alias("left"))
    possible = possible.where((F.col("size") + F.col("left")) / F.col("n_tokens") >= COPIED).drop("left")
    common = sets.where("not rare").select("file_no", "holders", F.col("size").alias("more"))
    whole = possible.join(common, "file_no", "left").join(files.withColumn("__in", F.lit(True)), ["holders", "file"], "left")
    whole = whole.groupBy("file_no", "n_tokens", "file", "size").agg(F.sum(F.when(F.col("__in"), F.col("more")).otherwise(0)).alias("more"))
    return whole.groupBy("file_no").agg(F.max((F.col("size") + F.col("more")) / F.col("n_tokens")).alias("found"))


# Telling rules ---------------------------------------------------------------------------------------------------------


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of numbers below 2^31, in order."""
    key = np.unique((a.astype(np.int64) << 32) | b)
    return key >> 32, key & 0xFFFFFFFF


@dataclass
class Telling:
    """A grammar over words and classes, round by round, and which of its rules tell generated files."""

    words: np.ndarray
    rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    rules: np.ndarray

    def _symbols(self, tokens: np.ndarray) -> np.ndarray:
        kind = tokens.view(np.uint32) & np.uint32(3)
        at = np.searchsorted(self.words, tokens)
        known = (at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == tokens) if len(self.words) else np.zeros(len(tokens), bool)
        return np.where(known & (kind != _NUMBER), 4 + at, kind.astype(np.int64))

    def parse(self, tokens: np.ndarray, of: np.ndarray, made: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left when the rules are applied, and their files. ``made`` collects every rule's
        symbol with the files that use it, also within other rules."""
        seq, of = self._symbols(tokens), of.astype(np.int64)
        for keys, symbol, uses in self.rounds:
            if len(seq) < 2:
                break
            key = (seq[:-1] << 32) | seq[1:]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (keys[at] == key) & (of[1:] == of[:-1])
            where = np.flatnonzero(grammar._peaks(np.r_[np.where(hit, uses[at], 0), 0], np.r_[-at, 0]))
            seq[where] = symbol[at[where]]
            if made is not None:
                made.append(_distinct(seq[where], of[where]))
            stay = np.ones(len(seq), dtype=bool)
            stay[where + 1] = False
            seq, of = seq[stay], of[stay]
        return seq, of

    def in_files(self, tokens: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Whether each file holds a telling rule."""
        seq, of = self.parse(tokens, of)
        out = np.zeros(n, dtype=bool)
        out[of[np.isin(seq, self.rules)]] = True
        return out


def fit_telling(tokens: list[np.ndarray], labels: np.ndarray, repositories: np.ndarray) -> Telling:
    """The grammar of the files' tokens and the MARKS, and its telling rules by the files' labels (0 .. 1)."""
    marks = Files(MARKS * MARK_WEIGHT)
    cuts = np.searchsorted(marks.of, np.arange(1, marks.n))
    all_tokens = [*tokens, *np.split(marks.packed(), cuts)]
    n = len(all_tokens)
    label = np.r_[labels, np.ones(marks.n)]
    # a mark stands for files of as many repositories
    repo = np.r_[pd.factorize(repositories)[0], len(labels) + np.arange(marks.n) // len(MARKS)]
    of = np.repeat(np.arange(n), [len(t) for t in all_tokens])
    flat = np.concatenate(all_tokens)
    word, number = np.unique(flat, return_inverse=True)
    held = np.bincount(_distinct(number, of)[0], minlength=len(word))
    words = word[held >= max(RULE_USES, WORD_SHARE * len(labels))]
    model = Telling(words, [], np.empty(0, np.int64))
    symbols = model._symbols(flat)
    # borders between files; all files are one sequence to the grammar
    edge = np.r_[np.flatnonzero(of[1:] != of[:-1]) + 1]
    _, _, made = grammar.infer(np.insert(symbols, edge, -1), np.zeros(len(symbols) + len(edge), np.int64), 1, RULE_USES)
    for symbol, left, right, _, uses in made:
        key = (left << 32) | right
        order = np.argsort(key)
        model.rounds.append((key[order], symbol[order], uses[order]))
    uses_of: list[tuple[np.ndarray, np.ndarray]] = []
    model.parse(flat, of, uses_of)
    length = grammar.lengths(made, 4 + len(words), 4)
    base = float(np.clip(labels.mean() if len(labels) else 0.0, 0.01, 0.5))
    wanted = LIFT * base / (1 - base + LIFT * base)
    telling: dict[int, bool] = {}
    children = {k: (x, y) for m in made for k, x, y in zip(m[0].tolist(), m[1].tolist(), m[2].tolist(), strict=True)}
    for rule, holder in uses_of:  # in the order of their making, so parts come before what they are parts of
        which, at = np.unique(rule, return_inverse=True)
        files, hits = np.bincount(at), np.bincount(at, label[holder])
        repos = np.bincount(_distinct(at, repo[holder])[0], minlength=len(which))
        tells = (hits >= wanted * files) & (hits - base * files >= DEVIATIONS * np.sqrt(base * (1 - base) * files)) & (repos >= 2)
        # a rule that is clearly harmless stays so whatever its parts are, as a mark that is only quoted
        harmless = hits < wanted * files - np.sqrt(wanted * (1 - wanted) * files)
        for k, yes, no in zip(which.tolist(), tells.tolist(), harmless.tolist(), strict=True):
            telling[k] = (yes and length[k] >= RULE_TOKENS) or (not no and any(telling.get(x, False) for x in children[k]))
    model.rules = np.array(sorted(k for k, yes in telling.items() if yes), dtype=np.int64)
    return model


# Verdicts --------------------------------------------------------------------------------------------------------------


def classify(files: DataFrame, texts: DataFrame, upstream: DataFrame, keys: list[str], repository: str | None = None) -> DataFrame:
    """keys and verdict of every file: vendored, data, minified, generated, hand_written, claimed or unknown.

    ``files`` has keys, file_path and reason, ``texts`` keys and text, ``upstream`` text. ``repository`` names the
    column of a file's repository (by default the first key). A file delivered more than once counts once. The usual
    grammar size is the median over all files of an extension; files without a path or extension are a kind too. Name,
    status and reason never decide about a text: reasons only label files where telling rules are learned. A file
    without a text (null, or none delivered) is claimed where most files with its noted reason, of at least
    LEAST_REASONS, are not hand-written, else unknown. An empty text is hand_written. Null keys join nothing and
    come out as they are without a text. Empty tables give no rows.
    """
    repository = repository or keys[0]
    kept = list(dict.fromkeys([*keys, repository]))
    once = files.groupBy(*keys).agg(F.min("file_path").alias("file_path"), F.min("reason").alias("reason"), *[F.min(x).alias(x) for x in kept[len(keys):]])
    once = once.withColumn("extension", F.coalesce(F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1)), F.lit("")))
    # a file costs processor time, not bytes: sizes say too little for adaptive execution to set the number of tasks
    tasks = max(shuffle_partitions(files.sparkSession), 4 * files.sparkSession.sparkContext.defaultParallelism)
    with_text = once.repartition(tasks, *keys).join(texts.select(*keys, F.col("text").alias("__text")).where("__text is not null").repartition(tasks, *keys), keys)
    told = materialize(_features(with_text, [*kept, "extension", "reason"], "__text").withColumn("file_no", F.monotonically_increasing_id()), "files")
    usual = told.groupBy("extension").agg(F.percentile_approx("shape_size", 0.5, 1000).alias("usual"))
    slim = told.drop("phrases", "phrase_tokens", "tokens").join(usual, "extension").join(copied_shares(told, upstream, repository), "file_no", "left")
    judged = materialize(slim.fillna(0.0, ["copied", "shared"]).withColumn("verdict", verdict()).select(*kept, "file_no", "reason", "verdict"), "judged")
    model = files.sparkSession.sparkContext.broadcast(_fit(judged, told, keys, repository))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tokens = [np.asarray(t, dtype=np.int32) for t in b["tokens"]]
            if tokens:
                found = model.value.in_files(np.concatenate(tokens), np.repeat(np.arange(len(b)), [len(t) for t in tokens]), len(b))
                yield b.loc[found, ["file_no"]]

    telling = told.select("file_no", "tokens").mapInPandas(run, "file_no long").withColumn("__telling", F.lit(True))
    told = judged.join(telling, "file_no", "left").select(*keys, "reason", F.when(F.col("__telling") & (F.col("verdict") == "hand_written"), "generated").otherwise(F.col("verdict")).alias("verdict"))
    told = materialize(told, "verdicts")
    mostly = told.groupBy("reason").agg(F.avg((F.col("verdict") != "hand_written").cast("int")).alias("share"), F.count(F.lit(1)).alias("n"))
    claims = mostly.where(F.col("reason").isNotNull() & (F.col("share") > 0.5) & (F.col("n") >= LEAST_REASONS)).select("reason", F.lit("claimed").alias("claim"))
    rest = once.join(told.select(*keys), keys, "left_anti").join(claims, "reason", "left")
    return told.select(*keys, "verdict").unionByName(rest.select(*keys, F.coalesce("claim", F.lit("unknown")).alias("verdict")))


def _fit(judged: DataFrame, told: DataFrame, keys: list[str], repository: str) -> Telling:
    """Telling rules from at most SAMPLE files, drawn by the hashes of their keys: the grammars' verdict is a file's
    label, and so is a noted reason that goes with generated files far more often than others."""
    drawn = judged.where("verdict in ('generated', 'hand_written')").withColumn("__h", F.xxhash64(*keys)).orderBy("__h", "file_no").limit(SAMPLE)
    drawn = told.select("file_no", "tokens").join(F.broadcast(drawn.select("file_no", F.col(repository).alias("repository"), "reason", "verdict")), "file_no").repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        got = pa.Table.from_batches(held) if held else schema.empty_table()
        column = got.column("tokens").combine_chunks()
        tokens = np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))[:-1]) if len(got) else []
        label = np.array([v == "generated" for v in got.column("verdict").to_pylist()], dtype=float)
        reason = pd.Series([r or "" for r in got.column("reason").to_pylist()], dtype=object)
        by_reason = pd.Series(label).groupby(reason.to_numpy()).agg(["mean", "size"])
        often = by_reason.index[(by_reason["mean"] > 0) & (by_reason["mean"] >= REASON_LIFT * label.mean()) & (by_reason["size"] >= LEAST_REASONS)] if len(got) else []
        label = np.maximum(label, reason.isin(often).to_numpy(dtype=float))
        model = fit_telling(tokens, label, np.array([str(r) for r in got.column("repository").to_pylist()], dtype=object))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    schema = pa.schema([("repository", pa.string()), ("reason", pa.string()), ("verdict", pa.string()), ("tokens", pa.list_(pa.int32()))])
    # one task fits it: the sample is bounded, and the driver only sees the model
    fitted = drawn.select(F.col("repository").cast("string"), "reason", "verdict", "tokens").mapInArrow(run, "model binary").first()
    return pickle.loads(fitted.model) if fitted else fit_telling([], np.empty(0), np.empty(0))


def verdict(usual: str = "usual") -> Column:
    """vendored, data, minified, generated or hand_written, from the features and the kind's usual grammar size."""
    return F.expr(
        f"""case when n_tokens >= {LEAST_TOKENS} and (copied >= {COPIED} or shared >= {SHARED}) then 'vendored'
            when literals >= {LITERALS} then 'data'
            when n_tokens >= {LEAST_TOKENS} and space <= {SPACE} and shape_size <= {MINIFIED} then 'minified'
            when n_tokens >= {LEAST_TOKENS} and shape_size <= {TABLE} then 'data'
            when n_tokens >= {LEAST_TOKENS} and shape_size <= {REUSE} * {usual} then 'generated'
            else 'hand_written' end"""
    )
