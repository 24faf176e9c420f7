"""Re-Pair grammars over many token sequences at once, and phrases that equal texts share.

A rule is a pair of symbols that comes at least twice. Sequential Re-Pair makes the most frequent pair a rule, again
and again; here a round makes rules of all pairs that are more frequent than the pairs they overlap, in all
sequences of a batch, so a round is a few sorts and the rounds are few. Sequences never share rules unless told to.
"""

from __future__ import annotations

import numpy as np

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _M1 + mix(b))


def _peaks(rank: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Places whose (rank, tie) is above that of both neighbours, of which no two are neighbours; rank 0 is none.

    In a run of equal ones every second place is taken, from the left.
    """
    same = np.r_[False, (rank[1:] == rank[:-1]) & (tie[1:] == tie[:-1])]
    at = np.arange(len(rank))
    odd = (at - np.maximum.accumulate(np.where(same, 0, at))) % 2 == 1  # within its run
    above = lambda r, t, s, u: (r > s) | ((r == s) & (t > u))
    left = np.r_[True, above(rank[1:], tie[1:], rank[:-1], tie[:-1])] | same
    right = np.r_[above(rank[:-1], tie[:-1], rank[1:], tie[1:]), True] | np.r_[same[1:], False]
    # a run is taken only where it is above what surrounds it
    start = ~same
    run = np.cumsum(start) - 1
    first, last = np.flatnonzero(start), np.r_[np.flatnonzero(start)[1:] - 1, len(rank) - 1]
    good = left[first] & right[last]
    return good[run] & ~odd & (rank > 0)


def infer(symbols: np.ndarray, of: np.ndarray, n: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]:
    """(rules per sequence, what is left of each, all rules).

    ``symbols`` are numbers from 0, -1 is a border that no rule crosses; ``of`` gives each its sequence, 0 .. n - 1, in
    order. Rules come round by round as (symbol, left, right, sequence, uses); a rule's symbol is above all before.
    """
    seq, of = symbols.astype(np.int64), of.astype(np.int64)
    free = int(seq.max(initial=-1)) + 1
    rules, made = np.zeros(n, dtype=np.int64), []
    while len(seq) > 1:
        ok = (of[1:] == of[:-1]) & (seq[1:] >= 0) & (seq[:-1] >= 0)
        at = np.flatnonzero(ok)
        if not len(at):
            break
        # pairs of the same sequence and symbols get one number, in order; symbols of a batch fit 24 bits, or sort twice
        left, right = seq[at], seq[at + 1]
        if n << 48 < 1 << 62 and free < 1 << 24:
            key = (of[at] << 48) | (left << 24) | right
            order = np.argsort(key, kind="stable")
            s = key[order]
            new = np.r_[True, s[1:] != s[:-1]]
        else:
            order = np.lexsort((right, left, of[at]))
            new = np.r_[True, (np.diff(of[at][order]) != 0) | (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)]
        number = np.empty(len(at), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        count = np.bincount(number)
        rank = np.zeros(len(seq), dtype=np.int64)
        tie = np.zeros(len(seq), dtype=np.int64)
        c = count[number]
        rank[at] = np.where(c >= least, c, 0)
        tie[at] = -number  # the pair of the lesser symbols among equals
        taken = _peaks(rank, tie)
        pair = np.full(len(seq), -1, dtype=np.int64)
        pair[at] = number
        uses = np.bincount(pair[taken], minlength=len(count))
        kept = uses >= least
        taken &= np.r_[kept, False][pair]
        if not taken.any():
            # what is left overlaps itself away: no pair can be used twice
            break
        where = np.flatnonzero(taken)
        symbol = np.full(len(count), -1, dtype=np.int64)
        symbol[kept] = free + np.arange(kept.sum())
        first = at[order[new]][kept]
        made.append((symbol[kept], seq[first].copy(), seq[first + 1].copy(), of[first], uses[kept]))
        np.add.at(rules, of[first], 1)
        free += int(kept.sum())
        seq[where] = symbol[pair[where]]
        stay = np.ones(len(seq), dtype=bool)
        stay[where + 1] = False
        seq, of = seq[stay], of[stay]
    return rules, np.bincount(of[seq >= 0], minlength=n), made


def sizes(symbols: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Symbols of each sequence's grammar (two a rule, and what is left) per symbol of it; 1 for an empty one."""
    rules, rest, _ = infer(symbols, of, n)
    total = np.bincount(of[symbols >= 0], minlength=n)
    return np.where(total > 0, (rest + 2 * rules) / np.maximum(1, total), 1.0)


def lengths(made: list[tuple[np.ndarray, ...]], terminals: int, free: int = 0) -> np.ndarray:
    """By symbol the number of terminals it stands for, of which the first ``free`` don't count."""
    out = np.ones(terminals + sum(len(m[0]) for m in made), dtype=np.int64)
    out[:free] = 0
    for symbol, left, right, _, _ in made:
        out[symbol] = out[left] + out[right]
    return out


def phrases(hashes: np.ndarray, of: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, length, sequence) of the phrases that sequences fall into: the rules of the grammar of a text
    taken twice, in which every pair comes at least twice, with ties broken by content.

    So equal stretches fall into equal phrases wherever they stand, but for a few tokens at their ends. Pairs are
    joined until a phrase has ``least`` tokens; ``hashes`` are the tokens'.
    """
    seq, of = hashes.astype(np.uint64), of.astype(np.int64)
    size = np.ones(len(seq), dtype=np.int64)
    while len(seq) > 1:
        ok = (of[1:] == of[:-1]) & (size[1:] < least) & (size[:-1] < least)
        if not ok.any():
            break
        h = np.zeros(len(seq), dtype=np.uint64)
        h[:-1] = _pair_hash(seq[:-1], seq[1:])
        rank = np.r_[ok, False].astype(np.int64)
        taken = _peaks(rank, (h >> np.uint64(1)).astype(np.int64))
        where = np.flatnonzero(taken)
        seq[where] = h[where]
        size[where] += size[where + 1]
        stay = np.ones(len(seq), dtype=bool)
        stay[where + 1] = False
        seq, of, size = seq[stay], of[stay], size[stay]
    long = size >= least
    return seq[long], size[long], of[long]
