"""Filling containers of a fixed capacity with texts, by bin completion over the histogram of sizes.

Sizes are whole tokens of at most one capacity, so items of a size are alike and the whole corpus is a histogram
of at most ``capacity`` counts, however many texts there are. On it, branch and bound enumerates the undominated
completions of a container around the largest size left and uses each as often as the counts allow; a branch
whose waste exceeds what a better packing may waste is cut. The best-fit packing is the first incumbent. The plan
is a list of (filling, how often) bounded by the number of sizes; texts then find their container by their number
among the texts of their size.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.runtime import materialize, release, with_dense_id

#: A filling: (sizes from the largest down, how many containers get it).
Filling = tuple[tuple[int, ...], int]


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best fit, largest sizes first, a whole class of sizes at a time."""
    open_bins: dict[int, list[list]] = {}  # by room left: [sizes, how many]
    room_left: set[int] = set()
    done: list[Filling] = []
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fit = min((r for r in room_left if r >= size), default=None)
            if fit is None:
                per = min(capacity // size, left)
                n = left // per
                sizes, room = (size,) * per, capacity - size * per
                left -= n * per
            else:
                sizes, have = open_bins[fit].pop()
                n = min(have, left)
                if have > n:
                    open_bins[fit].append([sizes, have - n])
                if not open_bins[fit]:
                    room_left.discard(fit)
                sizes, room = (*sizes, size), fit - size
                left -= n
            if room:
                open_bins.setdefault(room, []).append([sizes, n])
                room_left.add(room)
            else:
                done.append((sizes, n))
    return done + [(tuple(s), n) for r in room_left for s, n in open_bins[r]]


def _completions(sizes: list[int], counts: dict[int, int], room: int, want: float, steps: float) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, fullest first: depth-first over the sizes from the largest down. All of them
    where ``want`` and ``steps`` are infinite.

    A filling is dominated when a size left over fits and could be added, or when one of its sizes could be
    swapped for a larger one left over that still fits.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    chosen: list[int] = []
    budget = [steps]
    usable = [s for s in sizes if s <= room and counts[s]]
    reach = [0] * (len(usable) + 1)  # all that the sizes from here on can add up to
    for i in range(len(usable) - 1, -1, -1):
        reach[i] = reach[i + 1] + usable[i] * counts[usable[i]]
    smallest = usable[-1] if usable else 0
    least_waste = [room + 1]

    def undominated(waste: int) -> bool:
        used = {}
        for s in chosen:
            used[s] = used.get(s, 0) + 1
        if waste >= smallest and any(s <= waste and counts[s] > used.get(s, 0) for s in reversed(usable)):
            return False
        for s in used:
            for bigger in range(s + 1, s + waste + 1):
                if counts.get(bigger, 0) > used.get(bigger, 0):
                    return False
        return True

    def go(i: int, left: int) -> None:
        budget[0] -= 1
        if budget[0] < 0 or (len(found) >= want and least_waste[0] == 0):
            return
        while i < len(usable) and usable[i] > left:
            i += 1
        if i == len(usable) or left < smallest:
            if (len(found) < want or left <= least_waste[0]) and undominated(left):
                found.append((left, tuple(chosen)))
                least_waste[0] = min(least_waste[0], left)
            return
        if want != math.inf and left - reach[i] > least_waste[0] and found:  # even all of them leave more waste than the best so far
            return
        size = usable[i]
        most = min(counts[size], left // size)
        for n in range(most, -1, -1):
            chosen.extend([size] * n)
            go(i + 1, left - n * size)
            del chosen[len(chosen) - n :]
            if budget[0] < 0:
                return

    if not usable:
        return [()]
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 3 * len(usable) + 1000))
    go(0, room)
    found.sort(key=lambda x: x[0])
    return [f for _, f in (found if want == math.inf else found[:want])] or [()]


def bin_completion(counts: dict[int, int], capacity: int, branches: int = 3, nodes: int = 200, steps: int = 4000, exact: bool = False) -> list[Filling]:
    """Fillings that use every item once, in as few containers as the search finds.

    Sizes must be in 1..capacity. ``branches`` completions are tried per container, ``nodes`` complete packings'
    worth of descents in all and ``steps`` steps per enumeration, and a completion is used as often as the counts
    allow; within these the search is branch and bound, beyond them the best packing found so far stands (never worse
    than best fit). ``exact`` knows none of these bounds: every undominated completion is tried one container at a
    time, so the packing has the fewest containers there can be, in time exponential in the number of items.
    """
    if exact:
        branches = nodes = steps = math.inf
    counts = {s: n for s, n in counts.items() if n > 0}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("sizes must be between 1 and the capacity")
    total = sum(s * n for s, n in counts.items())
    bound = max(-(-total // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))
    best = best_fit(counts, capacity)
    best_n = sum(n for _, n in best)
    state = {"plan": best, "n": best_n, "descents": 0}

    def descend(counts: dict[int, int], plan: list[Filling], used: int, waste: int) -> None:
        stack = [(counts, plan, used, waste)]
        while stack and state["n"] > bound and state["descents"] < nodes:
            counts, plan, used, waste = stack.pop()
            counts, plan = dict(counts), list(plan)
            sizes = sorted(counts, reverse=True)
            while True:
                if waste > (state["n"] - 1) * capacity - total:  # no better than the incumbent any more
                    break
                sizes = [s for s in sizes if counts.get(s)]
                if not sizes:
                    if used < state["n"]:
                        state["plan"], state["n"] = plan, used
                    break
                largest = sizes[0]
                counts[largest] -= 1
                options = _completions(sizes, counts, capacity - largest, branches, steps)
                counts[largest] += 1
                for other in options[:0:-1]:
                    if len(stack) < 4 * nodes:
                        stack.append(_apply(counts, plan, used, waste, (largest, *other), capacity, exact))
                counts, plan, used, waste = _apply(counts, plan, used, waste, (largest, *options[0]), capacity, exact)
            state["descents"] += 1

    descend(counts, [], 0, 0)
    return state["plan"]


def _apply(counts: dict[int, int], plan: list[Filling], used: int, waste: int, filling: tuple[int, ...], capacity: int, once: bool):
    need: dict[int, int] = {}
    for s in filling:
        need[s] = need.get(s, 0) + 1
    n = 1 if once else min(counts[s] // k for s, k in need.items())
    counts = dict(counts)
    for s, k in need.items():
        counts[s] -= n * k
    return counts, [*plan, (filling, n)], used + n, waste + n * (capacity - sum(filling))


def _segments(plan: list[Filling]) -> pd.DataFrame:
    """(size, first, n, container, slot): items first .. first + n * slots - 1 of a size fill slots of containers."""
    rows, nth, container = [], {}, 0
    for filling, n in plan:
        per: dict[int, int] = {}
        for s in filling:
            per[s] = per.get(s, 0) + 1
        for s, k in per.items():
            rows.append((s, nth.get(s, 0), k, container))
            nth[s] = nth.get(s, 0) + n * k
        container += n
    return pd.DataFrame(rows, columns=["size", "first", "per", "container"]).sort_values(["size", "first"], ignore_index=True)


def pack(sizes: DataFrame, key: str, n_tokens: str, windows: list[tuple[int, int]], **search: int) -> DataFrame:
    """(window_id, container_id, key, piece, start_token, n_tokens): where every text lies, for each capacity.

    ``windows`` has (window_id, capacity). A text above the capacity is cut into full pieces and a rest, piece
    counting from 0; others have piece 0. Null and zero sizes take no place and do not come out. Every token of
    every text lies in exactly one container and no container exceeds its capacity. Rows with equal keys are
    separate items. Texts of a size are taken in the order of the key, so the result is the same each time. An
    empty table gives no rows. To the driver go at most ``capacity`` counts per window.
    """
    spark = sizes.sparkSession
    kind = sizes.schema[key].dataType.simpleString()
    if any(capacity < 1 for _, capacity in windows):
        raise ValueError("capacities must be positive")
    result = f"window_id int, container_id long, `{key}` {kind}, piece int, start_token int, n_tokens int"
    if not windows:
        return spark.createDataFrame([], result)
    # measured once: the sort below reads its input twice
    one = materialize(sizes.where(f"`{n_tokens}` > 0").select(F.col(key).alias("k"), F.col(n_tokens).alias("n")), "sizes")
    caps = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(c).alias("c")) for w, c in windows])
    per = one.select("k", "n", F.explode(caps).alias("x")).select("k", "n", "x.w", "x.c")
    cut = F.expr("transform(sequence(0, (n - 1) div c), i -> struct(cast(i as int) as piece, cast(i * c as int) as at, cast(least(c, n - i * c) as int) as size))")
    pieces = per.select("w", "k", F.explode(cut).alias("p")).select("w", "k", "p.piece", "p.at", "p.size")
    numbered = with_dense_id(pieces, ["w", "size", "k", "piece"], "nth", "pieces")
    release(one)
    histogram = {(r.w, r.size): (r.n, r.least) for r in numbered.groupBy("w", "size").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("least")).collect()}
    segments = {}
    for w, c in windows:
        counts = {s: n for (v, s), (n, _) in histogram.items() if v == w}
        plan = bin_completion(counts, c, **search)
        table = _segments(plan)
        begin = table["size"].map({s: at for (v, s), (_, at) in histogram.items() if v == w}).to_numpy(dtype=np.int64)
        segments[w] = (begin + table["first"].to_numpy(np.int64), table["per"].to_numpy(np.int64), table["container"].to_numpy(np.int64))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            container = np.zeros(len(rows), dtype=np.int64)
            for w, (first, per, base) in segments.items():
                mine = np.flatnonzero(rows["w"].to_numpy() == w)
                if len(mine):
                    nth = rows["nth"].to_numpy()[mine]
                    at = np.searchsorted(first, nth, side="right") - 1
                    container[mine] = base[at] + (nth - first[at]) // per[at]
            yield pd.DataFrame({"window_id": rows["w"], "container_id": container, key: rows["k"], "piece": rows["piece"], "start_token": rows["at"], "n_tokens": rows["size"]})

    return numbered.mapInPandas(place, result)
