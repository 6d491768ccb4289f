"""One-to-one assignment of one component of candidate pairs."""

from __future__ import annotations

from collections.abc import Iterable
from heapq import heappop, heappush


def assign(pairs: Iterable[tuple[int, int, float]], method: str = "optimal") -> list[tuple[int, int, float]]:
    """greedy: nearest first, ties by (a, b). optimal: most pairs, then least sum of squared distances (shortest augmenting paths)."""
    pairs = sorted(pairs)
    if method == "greedy":
        taken_a, taken_b, out = set(), set(), []
        for d, a, b in sorted((d, a, b) for a, b, d in pairs):
            if a not in taken_a and b not in taken_b:
                taken_a.add(a)
                taken_b.add(b)
                out.append((a, b, d))
        return out
    if method != "optimal":
        raise ValueError(f"unknown method {method!r}")
    # Rows and columns by number; a row may also stay alone, in a column of its own that is dearer than all real pairs together, so more pairs always win.
    rows, cols = sorted({p[0] for p in pairs}), sorted({p[1] for p in pairs})
    at_a, at_b = ({v: i for i, v in enumerate(x)} for x in (rows, cols))
    n, m = len(rows), len(cols)
    far = 1.0 + sum(p[2] ** 2 for p in pairs)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, d in pairs:
        near[at_a[a]].append((at_b[b], d * d))
    for i in range(n):
        near[i].append((m + i, far))
    price_row, price_col, owner = [0.0] * n, [0.0] * (m + n), [-1] * (m + n)
    for start in range(n):
        # Cheapest way to a free column, over the candidates only (Dijkstra on reduced costs).
        least, from_row, done, heap, row, way = {}, {}, {}, [], start, 0.0
        while True:
            for j, c in near[row]:
                d = way + c - price_row[row] - price_col[j]
                if j not in done and d < least.get(j, float("inf")):
                    least[j], from_row[j] = d, row
                    heappush(heap, (d, j))
            while heap[0][1] in done or heap[0][0] > least[heap[0][1]]:
                heappop(heap)
            way, end = heappop(heap)
            if owner[end] < 0:
                break
            done[end] = way
            row = owner[end]
        price_row[start] += way
        for j, d in done.items():
            price_row[owner[j]] += way - d
            price_col[j] -= way - d
        while True:
            row = from_row[end]
            owner[end], end = row, next((j for j, _ in near[row] if owner[j] == row and j != end), -1)
            if row == start:
                break
    real = {(p[0], p[1]): p[2] for p in pairs}
    return sorted((rows[owner[j]], cols[j], real[rows[owner[j]], cols[j]]) for j in range(m) if owner[j] >= 0)
