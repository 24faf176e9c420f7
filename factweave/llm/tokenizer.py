"""Encoding of whole texts with a public byte-level BPE vocabulary, in numpy.

A text is split into pieces by the vocabulary's pattern. The distinct pieces of a batch that the worker has not
seen yet go into padded matrices by length; in each round every row merges its leftmost pair of least rank, the
ranks coming from a hash table of pairs, and closes the gap. A row without a known pair is done.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from factweave.runtime import spread

#: Fixed value: the pattern that splits texts before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_FOLDER = "/opt/tokenizers"
#: Pieces up to this many bytes go into matrices; longer ones are merged one by one, all places of a pair at once.
MATRIX_BYTES = 256
#: Pieces that a worker remembers; beyond that it forgets them all and starts anew.
REMEMBERED = 400_000
_NONE = np.int32(2**31 - 1)
_loaded: dict[str, BytePairEncoder] = {}


class BytePairEncoder:
    """Ranks, the hash table of mergeable pairs, and the pieces encoded so far."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.width = max(ranks.values()) + 1
        self._fill(ranks)
        self.split = regex.compile(PATTERN).findall
        self.seen: dict[str, np.ndarray] = {}

    def _fill(self, ranks: dict[bytes, int]) -> None:
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        keys = np.array(left, dtype=np.int64) * self.width + np.array(right, dtype=np.int64)
        self.bits = max(10, int(np.ceil(np.log2(len(keys) * 4))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._hash(keys)
        values = np.array(merged, dtype=np.int32)
        self.probes = 0
        while len(todo):  # one probe further each time
            self.probes += 1
            free = self.keys[slot[todo]] < 0
            first = np.zeros(len(todo), dtype=bool)
            first[np.unique(slot[todo], return_index=True)[1]] = True
            put = todo[free & first]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], values[put]
            todo = todo[~(free & first)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair (the id it merges into); _NONE for pairs that don't merge, or with a pad (-1)."""
        out = np.full(a.shape, _NONE, dtype=np.int32)
        valid = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        keys = a.ravel()[valid].astype(np.int64) * self.width + b.ravel()[valid]
        slot, flat = self._hash(keys), out.ravel()
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == keys
            flat[valid[hit]] = self.ranks[slot[hit]]
            on = ~hit & (found >= 0)
            if not on.any():
                break
            valid, keys, slot = valid[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(a.shape)

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Encode pieces of at most ``width`` bytes."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ids = np.full((len(pieces), width + 1), -1, dtype=np.int32)
        ids[:, :width][np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        pair = self.lookup(ids[:, :-1], ids[:, 1:])
        done: list[np.ndarray] = [None] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            at = pair.argmin(axis=1)
            each = np.arange(len(rows))
            least = pair[each, at]
            out = least == _NONE
            for r in np.flatnonzero(out):
                done[rows[r]] = ids[r, : lengths[rows[r]]].copy()
            if out.any():
                keep = ~out
                rows, ids, pair, at, least = rows[keep], ids[keep], pair[keep], at[keep], least[keep]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            # merge, close the gap, and look up the two pairs that are new
            ids[each, at] = least
            cols = np.arange(ids.shape[1])
            ids = np.take_along_axis(ids, np.minimum(cols + (cols > at[:, None]), ids.shape[1] - 1), axis=1)
            ids[:, -1] = -1
            cols = cols[:-1]
            pair = np.take_along_axis(pair, np.minimum(cols + (cols > at[:, None]), len(cols) - 1), axis=1)
            pair[:, -1] = _NONE
            pair[each, at] = self.lookup(ids[each, at], ids[each, at + 1])
            before = at > 0
            pair[each[before], at[before] - 1] = self.lookup(ids[each[before], at[before] - 1], ids[each[before], at[before]])
            lengths[rows] -= 1
            longest = int(lengths[rows].max())
            if longest + 1 < ids.shape[1]:
                ids, pair = ids[:, : longest + 1], pair[:, :longest]
        return done

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """Encode one long piece: a merge never makes a pair of lower rank, so all places of the least pair can
        merge in one round, from the left where they overlap."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        pair = self.lookup(ids[:-1], ids[1:])
        while len(pair) and (least := pair.min()) != _NONE:
            at = np.flatnonzero(pair == least)
            if len(at) > 1:  # of neighbouring places every other one, from the start of each row of neighbours
                starts = np.r_[True, np.diff(at) > 1]
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
                at = at[nth % 2 == 0]
            ids[at] = least
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            place = at - np.arange(len(at))
            ids = ids[keep]
            pair = pair[np.delete(np.arange(len(pair)), at)] if len(at) else pair
            redo = np.unique(np.r_[place, place - 1])
            redo = redo[(redo >= 0) & (redo < len(ids) - 1)]
            pair = pair[: len(ids) - 1]
            pair[redo] = self.lookup(ids[redo], ids[redo + 1])
        return ids

    def encode_pieces(self, pieces: list[str]) -> None:
        """Encode pieces not seen so far and remember them."""
        raw = [p.encode("utf-8") for p in pieces]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        low = 0
        for width in (4, 8, 12, 16, 24, 32, 64, 128, MATRIX_BYTES):
            bucket = np.flatnonzero((sizes > low) & (sizes <= width))
            for start in range(0, len(bucket), 1 << 15):
                some = bucket[start : start + (1 << 15)]
                for i, ids in zip(some, self._merge_matrix([raw[i] for i in some], width), strict=True):
                    self.seen[pieces[i]] = ids
            low = width
        for i in np.flatnonzero(sizes > MATRIX_BYTES):
            self.seen[pieces[i]] = self._merge_long(raw[i])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null and empty texts have none. Special tokens' strings are ordinary text."""
        split = [self.split(t) if t else [] for t in texts]
        fresh = list({p for s in split for p in s if p not in self.seen})
        if len(self.seen) + len(fresh) > REMEMBERED:
            self.seen = {}
            fresh = list({p for s in split for p in s})
        self.encode_pieces(fresh)
        none = np.empty(0, dtype=np.int32)
        return [np.concatenate([self.seen[p] for p in s]) if s else none for s in split]


def encoder(path: str) -> BytePairEncoder:
    """The vocabulary at path, loaded once per worker."""
    if path not in _loaded:
        _loaded[path] = BytePairEncoder(path)
    return _loaded[path]


def _slices(texts: list[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Stretches of a batch of about so many characters; one text is never split."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_texts(docs: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER, lengths_only: bool = False) -> DataFrame:
    """(key, ids) of every row, or (key, n_tokens) with ``lengths_only``; ids without special tokens.

    Null and empty texts give an empty list; rows are kept as often as they come, a null key as well. Texts of
    any length are encoded whole. An empty table gives no rows. Other columns never leave the scan. The folder
    must hold the vocabulary on every executor.
    """
    path = f"{folder}/{name}.tiktoken"
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                ids = bpe.encode(texts[a:b])
                sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                if lengths_only:
                    yield pa.RecordBatch.from_arrays([keys[a:b], pa.array(sizes.astype(np.int32))], [key, "n_tokens"])
                    continue
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                values = pa.array(np.concatenate(ids).astype(np.int32) if len(ids) else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays([keys[a:b], pa.ListArray.from_arrays(offsets, values)], [key, "ids"])

    out = f"`{key}` {kind}, " + ("n_tokens int" if lengths_only else "ids array<int>")
    return spread(docs.select(key, text)).mapInArrow(run, out)
