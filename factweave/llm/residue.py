"""Texts that are template residue, filler, error pages or script notices instead of content.

Character n-gram models of natural text, of four kinds of residue and of page frames give a likelihood ratio at
every place of a text. Averaged over a window it says which stretches are residue, and of which kind. A text is
residue if next to nothing but such stretches is left of it once the frame (headings, page menus, footers) is set
aside. The models start from example lines; natural text is counted over the whole corpus; texts that are surely
residue go from the natural model to the one of their kind. Everything after the search for slots runs over one
numpy row of code points per batch of texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm import seeds
from factweave.runtime import materialize, release, spread

N = 5
#: Counters of the natural model. A bucket's chance share, 1 / BUCKETS, is far below FLOOR, whatever the corpus' size.
BUCKETS = 1 << 22
#: Grams of a window, and how many places it judges.
WINDOW, STRIDE = 17, 4
#: Share up to which a gram counts as never seen, in any model; a model has at most 1 / FLOOR grams above it.
FLOOR = 1.5e-6
#: Mean log likelihood ratio of a window from which its middle is residue, and of a line from which it is frame.
RATIO, FRAME_RATIO = 0.15, 0.0
#: Share of residue in what is no frame, from which a text is a case, and from which the models learn from it.
COVERAGE, SURE = 0.5, 0.7
KINDS = ["notice", "error", "filler", "template"]
#: The sign of an open slot, and how many of them stand for one.
SLOT, SLOT_WIDTH = "▢", 6
#: Longest label of a field, in characters.
LABEL = 25

# Strings of special tokens: they say nothing.
_NOISE = re.compile(r"<\|[a-z_]+\|>|<s>|</s>|<unk>|<pad>|\[CLS\]|\[SEP\]|\[PAD\]|\[UNK\]|\[MASK\]")
# The forms of open slots. Every form begins with a literal sign and ends at the next of its kind, so a search is linear.
_SLOTS = re.compile(
    r"\{\{\{?[^{}\n]+\}?\}\}|<<[^<>\n]+>>|\[\[[^\[\]\n]+\]\]|@@[^@\n]+@@|#\{[^{}\n]+\}|\$\{[^{}\n]+\}|\{[A-Za-z_][\w .]*\}|<%=?[^<>%\n]+%>"
    r"|%[A-Z][A-Z0-9_]+%|\$[A-Z][A-Z0-9_]+\$|\((?:fill in|insert|add|enter)\b[^()\n]*\)|\[(?:insert|your|add|enter|todo|fill in)\b[^\[\]\n]*\]"
    r"|\[[A-Z][A-Z0-9 _/-]{2,}\](?!\()|<(?:your|insert|enter|add)\b[^<>\n]*>|…[^…\n]+…|__[A-Z][A-Z0-9_]+__|____+|\.\.\.\.\.+|x(?<!\wx)xxx*\b|X(?<!\wX)XXX*\b|T(?<!\wT)B[DC]\b|N(?<!\wN)/N\b"
)
_BREAKS = "\n\r\x0b\x0c\x85  "
_SPACE, _BREAK, _DIGIT = 32, 10, 48
_LAST = 0x20000  # code points from here on are taken as they are


def _fold(c: str) -> int:
    """What a character counts as: its lower case without marks, a digit as 0, any space as a blank; 0 drops it."""
    if c in _BREAKS:
        return _BREAK
    if c.isspace():
        return _SPACE
    kind = unicodedata.category(c)
    if c != SLOT and kind in ("Cf", "Mn", "So", "Sk", "Cc", "Cs", "Co", "Cn"):
        return 0
    if kind == "Nd":
        return _DIGIT
    if "가" <= c <= "힣":
        return ord(c)
    plain = unicodedata.normalize("NFKD", c).lower()
    return ord(plain[0]) if plain else 0


def folding() -> tuple[np.ndarray, np.ndarray]:
    """The table of ``_fold``, and which code points are letters, digits or slots."""
    fold = np.fromiter((_fold(chr(i)) for i in range(_LAST)), dtype=np.uint32, count=_LAST)
    solid = np.fromiter((chr(i).isalnum() for i in range(_LAST)), dtype=bool, count=_LAST)
    solid[ord(SLOT)] = True
    return fold, solid


def _marked(text: str) -> str:
    return _SLOTS.sub(SLOT * SLOT_WIDTH, _NOISE.sub("", text))


class Batch:
    """Texts as one row of folded code points, every line between two line ends, and the gram at each place."""

    def __init__(self, texts: list[str | None], fold: np.ndarray, solid: np.ndarray) -> None:
        self.n = len(texts)
        marked = [_marked(t) if t else "" for t in texts]
        sizes = np.fromiter(map(len, marked), dtype=np.int64, count=self.n)
        raw = np.frombuffer("\n".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        del marked
        codes = np.where(raw < _LAST, fold[np.minimum(raw, _LAST - 1)], raw)
        doc = np.repeat(np.arange(self.n), sizes + 1)[: len(codes)]  # a text and the line end after it
        codes, doc = _squeeze(codes, doc)
        at = np.flatnonzero(codes == _BREAK)
        #: Lines by their first place and their end; the row begins and ends with line ends.
        self.start, self.end = at[:-1] + 1, at[1:]
        self.doc = doc[self.start] if len(self.start) else np.empty(0, np.int64)
        self.codes, self.solid = codes, np.where(codes < _LAST, solid[np.minimum(codes, _LAST - 1)], True)
        # a gram belongs to the line of its middle and may hold a line end at its edges only
        c = np.r_[codes, np.full(N, _BREAK, np.uint32)]
        m = len(codes)
        pair = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        four = (pair[:-2] ^ (pair[:-2] >> np.uint32(15))) * np.uint32(0x85EBCA77) + pair[2:]
        h = ((four[:-1] ^ (four[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + c[4:])[:m]
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
        self.gram = ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int32)
        b = c == _BREAK
        self.whole = ~(b[1 : m + 1] | b[2 : m + 2] | b[3 : m + 3])

    def counts(self, docs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, how often) of all texts' grams, or of those of the texts marked in ``docs``."""
        use = self.whole
        if docs is not None:
            inside = np.zeros(len(use) + 1, dtype=np.int32)
            lines = docs[self.doc]
            inside[self.start[lines] - 1] += 1  # lines are apart, so no place comes twice
            inside[self.end[lines] - 1] -= 1
            use = use & (np.cumsum(inside[:-1]) > 0)
        return np.unique(self.gram[use], return_counts=True)

    def scores(self, models: Models) -> np.ndarray:
        """Per text the weight of each kind's stretches, of content and of frame, as KINDS and two more columns."""
        width = len(KINDS)
        out = np.zeros((self.n, width + 2))
        if not len(self.doc):
            return out
        known = models.log_share[models.row[self.gram]]
        natural = models.natural[self.gram]
        known[:, width] -= np.maximum(natural, known[:, :width].max(axis=1))
        known[:, :width] -= natural[:, None]
        known[~self.whole] = 0
        sums = np.zeros((len(known) + 1, width + 1))
        np.cumsum(known, axis=0, dtype=np.float64, out=sums[1:])
        seen = np.r_[0, np.cumsum(self.whole)]
        lo, hi = self.start - 1, np.maximum(self.start, self.end - N + 2)  # the line's grams
        framed = sums[hi, width] - sums[lo, width]
        frame_line, label_end = self._forms()
        lengths = self.end - self.start
        # lines too short for a gram say nothing
        is_frame = frame_line | (lengths < N - 2) | (framed > FRAME_RATIO * np.maximum(1, seen[hi] - seen[lo]))
        # a line is judged STRIDE places at a time, by the window of grams around them
        n = -(-lengths // STRIDE)
        line = np.repeat(np.arange(len(n)), n)
        first = self.start[line] + STRIDE * (np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n))
        last = np.minimum(first + STRIDE, self.end[line])
        a = np.maximum(lo[line], first - N // 2 - WINDOW // 2)
        b = np.minimum(hi[line], last - N // 2 + WINDOW // 2)
        a = np.minimum(a, np.maximum(b - 1, lo[line]))
        b = np.maximum(b, a + 1)
        mean = (sums[b, :width] - sums[a, :width]) / np.maximum(1, seen[b] - seen[a])[:, None]
        kind = mean.argmax(axis=1)
        kind[mean[np.arange(len(kind)), kind] <= RATIO] = width
        kind[is_frame[line]] = width + 1
        weight = np.r_[0, np.cumsum(self.solid & ~self._names())]
        # the label of an open field is the form's, not the author's
        begin = np.minimum(np.maximum(first, label_end[line]), last)
        flat = np.bincount(self.doc[line].astype(np.int64) * (width + 2) + kind, weights=weight[last] - weight[begin], minlength=self.n * (width + 2))
        return flat.reshape(self.n, width + 2)

    def _names(self) -> np.ndarray:
        """Places of words with a dot inside (names of types, hosts, files): such names stand in content and residue."""
        dots = np.flatnonzero(self.codes[1:-1] == ord(".")) + 1
        inner = dots[self.solid[dots - 1] & self.solid[dots + 1]]
        word = np.cumsum((self.codes == _SPACE) | (self.codes == _BREAK))
        named = np.zeros(len(word) + 1, dtype=bool)
        named[word[inner]] = True
        return named[word]

    def _forms(self) -> tuple[np.ndarray, np.ndarray]:
        """Which lines are headings or fields with a one-word value, and where the label of a field that is an open
        slot ends."""
        count = lambda mask: np.r_[0, np.cumsum(mask)]
        slots, blanks = count(self.codes == ord(SLOT)), count(self.codes == _SPACE)
        n_slots = slots[self.end] - slots[self.start]
        colons = np.flatnonzero(self.codes == ord(":"))
        colon = np.r_[colons, len(self.codes)][np.searchsorted(colons, self.start)]
        field = (colon < self.end - 2) & (colon - self.start <= LABEL) & (self.codes[np.minimum(colon + 1, len(self.codes) - 1)] == _SPACE)
        value = np.minimum(colon + 2, self.end)
        open_field = field & (n_slots > 0) & (slots[self.end] - slots[value] == self.end - value)
        one_word = field & (n_slots == 0) & (blanks[self.end] == blanks[value])
        heading = (self.codes[self.start] == ord("#")) & (n_slots == 0)
        return heading | one_word, np.where(open_field, colon, self.start)


def _squeeze(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without what is dropped, runs of blanks, digits and line ends as one, no blanks at line ends; a line end before
    and after everything, which belong to no line."""
    keep = codes != 0
    codes, doc = codes[keep], doc[keep]
    for _ in range(2):  # blanks between line ends vanish at the second time
        if not len(codes):
            break
        before, after = np.r_[np.uint32(_BREAK), codes[:-1]], np.r_[codes[1:], np.uint32(_BREAK)]
        keep = np.where(
            codes == _SPACE, (before != _SPACE) & (before != _BREAK) & (after != _BREAK), ((codes != _DIGIT) & (codes != _BREAK)) | (codes != before)
        )
        codes, doc = codes[keep], doc[keep]
    if len(codes) and codes[-1] == _BREAK:
        codes, doc = codes[:-1], doc[:-1]
    edge = np.array([_BREAK], np.uint32)
    return np.r_[edge, codes, edge] if len(codes) else edge, np.r_[0, doc, 0] if len(codes) else np.zeros(1, np.int64)


@dataclass
class Models:
    """Log shares of grams: ``natural`` by bucket; of the kinds and the frame by the row that ``row`` gives a bucket,
    row 0 being a gram that none of them knows."""

    natural: np.ndarray
    row: np.ndarray
    log_share: np.ndarray
    fold: np.ndarray
    solid: np.ndarray

    @classmethod
    def of(cls, natural: tuple[np.ndarray, np.ndarray, int], shares: list[dict[int, float]], fold: np.ndarray, solid: np.ndarray) -> Models:
        """``natural`` has buckets, counts and their total, ``shares`` the kinds' and the frame's shares by bucket."""
        bucket, n, total = natural
        nat = np.full(BUCKETS, np.log(FLOOR), dtype=np.float32)
        nat[bucket] = np.log(np.maximum(n, 0) / max(1, total) + FLOOR)
        known = np.array(sorted({b for s in shares for b in s}), dtype=np.int64)
        row = np.zeros(BUCKETS, dtype=np.int32)
        row[known] = np.arange(1, len(known) + 1)
        table = np.full((len(known) + 1, len(shares)), np.log(FLOOR), dtype=np.float32)
        for k, s in enumerate(shares):
            table[row[np.fromiter(s, np.int64, len(s))], k] = np.log(np.fromiter(s.values(), np.float64, len(s)) + FLOOR)
        return cls(nat, row, table, fold, solid)


def _shares(bucket: np.ndarray, n: np.ndarray, total: int | None = None) -> dict[int, float]:
    return dict(zip(bucket.tolist(), (n / max(1, total or n.sum())).tolist(), strict=True))


def seed_shares(fold: np.ndarray, solid: np.ndarray) -> list[dict[int, float]]:
    """Shares of the kinds and the frame in the example lines."""
    texts = [seeds.NOTICE, seeds.ERROR, seeds.FILLER, seeds.TEMPLATE, seeds.FRAME]
    return [_shares(*Batch([t.replace(SLOT, SLOT * SLOT_WIDTH)], fold, solid).counts()) for t in texts]


def _mixed(a: dict[int, float], b: dict[int, float]) -> dict[int, float]:
    """Half of each; a alone where b is empty."""
    return {g: (a.get(g, 0) + b.get(g, 0)) / 2 for g in {*a, *b}} if b else a


def is_residue(scores: np.ndarray, least: float = COVERAGE) -> np.ndarray:
    """Which rows of scores have residue, and little else beside the frame."""
    found = scores[:, : len(KINDS)].sum(axis=1)
    return (found > 0) & (found >= least * (found + scores[:, len(KINDS)]))


def _batches(texts: list[str | None], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _counted(docs: DataFrame, text: str, shared, models: bool) -> DataFrame:
    """(kind, bucket, n): gram counts over all texts (kind -1), or over those that are surely residue, by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(KINDS) if models else 1, BUCKETS), dtype=np.int64)
        for rows in batches:
            texts = rows.column(0).to_pylist()
            for a, b in _batches(texts):
                if not models:
                    at, n = Batch(texts[a:b], *shared.value).counts()
                    total[0, at] += n
                    continue
                m = shared.value
                batch = Batch(texts[a:b], m.fold, m.solid)
                scores = batch.scores(m)
                sure, main = is_residue(scores, SURE), scores[:, : len(KINDS)].argmax(axis=1)
                for k in range(len(KINDS)):
                    if (mine := sure & (main == k)).any():
                        at, n = batch.counts(mine)
                        total[k, at] += n
        for k, counts in enumerate(total):
            at = np.flatnonzero(counts)
            kind = np.full(len(at), k if models else -1, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["kind", "bucket", "n"])

    rows = spread(docs.select(text).where(F.col(text).isNotNull())).mapInArrow(run, "kind int, bucket int, n long")
    return rows.groupBy("kind", "bucket").agg(F.sum("n").alias("n"))


def _fetch(counted: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """kind: (buckets, counts, total of all counts). What is below a tenth of FLOOR stays where it is, so the driver
    gets at most 10 / FLOOR numbers a kind, and far fewer on text."""
    kept = materialize(counted, "grams")
    totals = {r.kind: r.n for r in kept.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n * FLOOR / 10)) for k, n in totals.items()], F.lit(0.0))
    t = kept.where(F.col("n") >= least).toArrow()
    kind, bucket, n = (t.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    release(kept)
    return {k: (bucket[kind == k].astype(np.int64), n[kind == k], total) for k, total in totals.items()}


def fit(docs: DataFrame, text: str) -> Models:
    """Models from all texts of a corpus in two passes: natural text first, then what is surely residue.

    What the driver holds is bounded by BUCKETS and FLOOR, whatever the corpus.
    """
    sc = docs.sparkSession.sparkContext
    fold, solid = folding()
    started = seed_shares(fold, solid)
    nothing = (np.empty(0, np.int64), np.empty(0, np.int64), 0)
    bucket, n, total = _fetch(_counted(docs, text, sc.broadcast((fold, solid)), False)).get(-1, nothing)
    first = Models.of((bucket, n, total), started, fold, solid)
    learned = _fetch(_counted(docs, text, sc.broadcast(first), True))
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[bucket] = n
    for at, m, less in learned.values():  # residue is no natural text
        counts[at] -= m
        total -= less
    shares = [_mixed(s, _shares(*learned[k]) if k in learned else {}) for k, s in enumerate(started)]
    return Models.of((bucket, counts[bucket], total), shares, fold, solid)


def residue_scores(docs: DataFrame, key: str, text: str, models: Models) -> DataFrame:
    """(key, notice, error, filler, template, content, frame, kind, is_residue) of every row with a text: what each
    kind of stretch weighs in it, in letters and digits, and the residue's main kind (null without residue).

    Null, empty and blank texts are no cases: nulls are left out, the others score 0. Equal texts score alike
    under every key; texts of any length are read whole. An empty table gives no rows; other columns of ``docs``
    are not read. Strings that look like special tokens and control characters are passed over.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = [*KINDS, "content", "frame"]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(1).to_pylist()
            for a, b in _batches(texts):
                m = shared.value
                s = Batch(texts[a:b], m.fold, m.solid).scores(m)
                top = s[:, : len(KINDS)]
                main = [KINDS[k] if w else None for k, w in zip(top.argmax(axis=1), top.max(axis=1), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0)[a:b], *[pa.array(s[:, i]) for i in range(len(names))], pa.array(main, pa.string()), pa.array(is_residue(s))],
                    [key, *names, "kind", "is_residue"],
                )

    return spread(docs.select(key, text).where(F.col(text).isNotNull())).mapInArrow(
        run, f"`{key}` {kind}, {', '.join(f'{x} double' for x in names)}, kind string, is_residue boolean"
    )


def find_residue(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``residue_scores`` that are residue, by models fitted to the same corpus."""
    return residue_scores(docs, key, text, fit(docs, text)).where("is_residue")


def without_residue(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` without the texts that are residue; null, empty and blank texts stay. ``key`` must be unique."""
    return docs.join(find_residue(docs, key, text).select(key), key, "left_anti")
