"""Packing plans over a histogram of lengths: linear grouping, few-size configurations, best fit.

Everything here works on counts by length, so its cost depends on the capacity, never on the rows.
A plan is a list of bins of one content: (how many such bins, {length: how many of it in each}).
"""

from __future__ import annotations

import numpy as np


class Bins:
    """Classes of bins of equal content, found by what room is left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list] = {}
        self.rooms = np.zeros(capacity + 1, dtype=bool)

    def add(self, count: int, content: dict[int, int]) -> None:
        if count:
            room = self.capacity - sum(n * k for n, k in content.items())
            self.by_room.setdefault(room, []).append([count, content])
            self.rooms[room] = True

    def best_fit(self, length: int, count: int) -> None:
        """Puts count items of this length where the least room is left, opening bins when none fits."""
        while count:
            fits = np.flatnonzero(self.rooms[length:])
            if not len(fits):
                per = self.capacity // length
                self.add(count // per, {length: per})
                self.add(int(count % per > 0), {length: count % per})
                return
            room = int(fits[0]) + length
            bins, content = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room]
                self.rooms[room] = False
            per = room // length
            full, rest = min(bins, count // per), 0
            if full < bins:
                rest = min(count - full * per, per - 1)
            grown = lambda k: {**content, length: content.get(length, 0) + k}
            self.add(full, grown(per) if full else content)
            self.add(int(rest > 0), grown(rest) if rest else content)
            self.add(bins - full - int(rest > 0), content)
            count -= full * per + rest

    def total(self) -> int:
        return sum(c for held in self.by_room.values() for c, _ in held)

    def classes(self) -> list[tuple[int, dict[int, int]]]:
        return [(c, content) for room in sorted(self.by_room) for c, content in self.by_room[room]]


def linear_groups(large: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """Cuts (length, count) runs, longest first, into groups of equal cardinality."""
    total = sum(c for _, c in large)
    size = -(-total // groups)
    out: list[list[list[int]]] = [[]]
    room = size
    for length, count in large:
        while count:
            if not room:
                out.append([])
                room = size
            take = min(room, count)
            out[-1].append([length, take])
            room -= take
            count -= take
    return out


def configurations(sizes: list[int], needs: list[int], capacity: int, rounds: int = 150) -> list[tuple[float, np.ndarray]]:
    """The fractional optimum over bin configurations: revised simplex, columns made by a knapsack."""
    m = len(sizes)
    columns = [np.eye(m)[i] * (capacity // sizes[i]) for i in range(m)]
    base = list(range(m))
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    need = np.array(needs, dtype=float)
    x = inverse @ need
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        worth = np.zeros(capacity + 1)
        choice = np.full(capacity + 1, -1)
        order = np.argsort(sizes)
        arr, val = np.array(sizes)[order], prices[order]
        for c in range(int(arr[0]), capacity + 1):
            k = int(np.searchsorted(arr, c, side="right"))
            got = worth[c - arr[:k]] + val[:k]
            best = int(got.argmax())
            if got[best] > worth[c - 1]:
                worth[c], choice[c] = got[best], order[best]
            else:
                worth[c], choice[c] = worth[c - 1], -2
        if worth[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(m), capacity
        while c > 0 and choice[c] != -1:
            if choice[c] == -2:
                c -= 1
            else:
                column[choice[c]] += 1
                c -= sizes[choice[c]]
        step = inverse @ column
        ratios = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratios.argmin())
        if not np.isfinite(ratios[leave]):
            break
        columns.append(column)
        base[leave] = len(columns) - 1
        pivot = inverse[leave] / step[leave]
        inverse = inverse - np.outer(step, pivot)
        inverse[leave] = pivot
        x = np.maximum(inverse @ need, 0)
    return [(float(v), columns[j]) for v, j in zip(x, base, strict=True) if v > 0]


def _substitute(bins: Bins, count: int, config: np.ndarray, runs: list[list[list[int]]]) -> None:
    """Fills count bins of a configuration with actual lengths of its groups, longest first."""
    slots = [g for g, k in enumerate(config.astype(int)) for _ in range(k)]
    taken = []
    for g in slots:
        parts, want = [], count
        while want and runs[g]:
            run = runs[g][-1]
            take = min(want, run[1])
            parts.append((run[0], take))
            run[1] -= take
            want -= take
            if not run[1]:
                runs[g].pop()
        taken.append(parts + ([(0, want)] if want else []))
    marks = sorted({int(e) for parts in taken for e in np.cumsum([t for _, t in parts])})
    at = [[0, 0] for _ in slots]
    begin = 0
    for end in marks:
        content: dict[int, int] = {}
        for s, parts in enumerate(taken):
            while at[s][1] + parts[at[s][0]][1] <= begin:
                at[s][1] += parts[at[s][0]][1]
                at[s][0] += 1
            length = parts[at[s][0]][0]
            if length:
                content[length] = content.get(length, 0) + 1
        if content:
            bins.add(end - begin, content)
        begin = end


def plan(histogram: dict[int, int], capacity: int, share: float, groups: int) -> Bins:
    """One packing of the histogram; lengths above share * capacity are the large ones."""
    bins = Bins(capacity)
    lengths = sorted((n for n, c in histogram.items() if c), reverse=True)
    full = [n for n in lengths if n == capacity]
    large = [(n, histogram[n]) for n in lengths if share * capacity < n < capacity]
    small = [(n, histogram[n]) for n in lengths if n <= share * capacity and n < capacity]
    for n in full:
        bins.add(histogram[n], {n: 1})
    if large:
        runs = linear_groups(large, min(groups, sum(c for _, c in large)))
        sizes = [g[0][0] for g in runs]
        needs = [sum(c for _, c in g) for g in runs]
        merged: list[int] = []
        for i, s in enumerate(sizes):  # groups that round up to one size are one group
            if i and sizes[merged[-1]] == s:
                runs[merged[-1]] += runs[i]
                needs[merged[-1]] += needs[i]
            else:
                merged.append(i)
        runs, sizes, needs = ([x[i] for i in merged] for x in (runs, sizes, needs))
        left = [list(reversed(g)) for g in runs]
        for value, config in configurations(sizes, needs, capacity):
            if int(value + 1e-6):
                _substitute(bins, int(value + 1e-6), config, left)
        small = [(n, c) for g in left for n, c in reversed(g)] + small
    for n, c in sorted(small, reverse=True):
        bins.best_fit(n, c)
    return bins


def best_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """The plan with the fewest bins over a few cuts between large and small and numbers of groups."""
    least = -(-sum(n * c for n, c in histogram.items()) // capacity)
    best = None
    for share, groups in ((0.5, 48), (0.25, 16), (0.25, 48), (0.125, 32)):
        found = plan(histogram, capacity, share, groups)
        if best is None or found.total() < best.total():
            best = found
        if best.total() == least:
            break
    return best.classes() if best else []
