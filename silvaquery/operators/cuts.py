"""Piecewise constant fits on graphs by cut pursuit (Landrieu and Obozinski 2017), with maximum flow in lockstep, for the graph of one tile.

The energy is the sum of squared distances of rows to their region's mean plus ``penalty`` times the weight of all edges between
regions. Regions begin as the graph's connected parts. Each round splits all of them at once, each by the best binary cut: the
two values and the cut are found in turn, the cut by maximum flow; a split stays if it lowers the energy. A last pass undoes
splits that no longer pay by merging neighbours, and rounds go on while the energy falls.
"""

from __future__ import annotations

import heapq

import numpy as np


def connected(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For nodes 0 .. n - 1, the smallest node that each reaches over the edges."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        off = a != b
        if not off.any():
            return label
        np.minimum.at(label, np.maximum(a[off], b[off]), np.minimum(a[off], b[off]))
        while (label[label] != label).any():
            label = label[label]


def energy(x: np.ndarray, edges: np.ndarray, weight: np.ndarray, penalty: float, region: np.ndarray) -> float:
    region = np.unique(region, return_inverse=True)[1]
    size = np.bincount(region)
    mean = np.stack([np.bincount(region, c) / size for c in x.T], axis=1)
    return float(((x - mean[region]) ** 2).sum() + penalty * weight[region[edges[:, 0]] != region[edges[:, 1]]].sum())


def min_cut(n: int, edges: np.ndarray, capacity: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Which nodes lie on the first side of a least cut: a node with ``pull`` above zero pays it on the second side, below zero its size on the first.

    Push-relabel in lockstep: all nodes with too much push along all edges that lead one step down at the same time, and those
    that cannot are raised. Heights are made exact by a search from the second side again and again. Parts without a connection are solved side by side.
    """
    if not len(edges):
        return pull > 0
    order = np.argsort(np.concatenate((edges[:, 0], edges[:, 1])), kind="stable")
    tail, head = (np.concatenate(x)[order] for x in ((edges[:, 0], edges[:, 1]), (edges[:, 1], edges[:, 0])))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    back = place[(order + len(edges)) % len(order)]
    room = np.concatenate((capacity, capacity)).astype(float)[order]
    first = np.searchsorted(tail, np.arange(n + 1))
    some = np.flatnonzero(first[1:] > first[:-1])
    least = 1e-12 * max(float(np.abs(pull).max(initial=0.0)), float(capacity.max(initial=0.0)), 1e-300)
    spare, drain = np.maximum(pull, 0.0), np.maximum(-pull, 0.0)
    far = n + 1

    def heights() -> np.ndarray:
        high = np.full(n, far)
        high[drain > least] = 1
        front, k = drain > least, 1
        while True:
            # Nodes with room towards the front are one step farther.
            step = np.zeros(n, bool)
            step[tail[(room > least) & front[head]]] = True
            front = step & (high == far)
            if not front.any():
                return high
            k += 1
            high[front] = k

    high, n_round = heights(), 0
    while True:
        given = np.minimum(spare, drain)
        spare, drain = spare - given, drain - given
        busy = (spare > least) & (high < far)
        if not busy.any():
            break
        open_ = busy[tail] & (room > least) & (high[tail] == high[head] + 1)
        want = np.where(open_, room, 0.0)
        before = np.cumsum(want) - want
        before -= before[first[:-1].clip(max=len(want) - 1)][tail]
        sent = np.clip(spare[tail] - before, 0.0, want)
        room += sent[back] - sent
        spare += np.bincount(head, sent, n) - np.bincount(tail, sent, n)
        n_round += 1
        if n_round % 12 == 0:
            high = heights()
            continue
        lowest = np.full(n, far)
        lowest[some] = np.minimum.reduceat(np.where(room > least, high[head], far), first[some])
        stuck = (spare > least) & (high < far) & (drain <= least) & (lowest >= high)
        high = np.where(stuck, np.minimum(lowest + 1, far), high)
    return heights() == far


def means_of(x: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    size = np.maximum(np.bincount(group, minlength=n), 1)
    return np.stack([np.bincount(group, c, n) / size for c in x.T], axis=1)


def best_splits(x: np.ndarray, edges: np.ndarray, cost: np.ndarray, region: np.ndarray, n: int, turns: int = 8) -> np.ndarray:
    """For regions 0 .. n - 1 at once: the side of each row in its region's best binary cut, from two values along the axis of most spread."""
    mean = means_of(x, region, n)
    off = x - mean[region]
    spread = np.stack([np.bincount(region, off[:, i] * off[:, j], n) for i in range(x.shape[1]) for j in range(x.shape[1])], axis=1).reshape(n, x.shape[1], x.shape[1]) / np.maximum(np.bincount(region, minlength=n), 1)[:, None, None]
    size, axis = np.linalg.eigh(spread)
    step = axis[:, :, -1] * np.sqrt(np.maximum(size[:, -1:], 0.0))
    value, side = np.stack((mean - step, mean + step)), None
    for _ in range(turns):
        pull = ((x - value[1][region]) ** 2).sum(1) - ((x - value[0][region]) ** 2).sum(1)
        now = min_cut(len(x), edges, cost, pull)
        if side is not None and (now == side).all():
            break
        side = now
        both = region * 2 + ~side
        many = np.bincount(both, minlength=2 * n).reshape(n, 2)
        new = means_of(x, both, 2 * n).reshape(n, 2, -1)
        # A side that is empty keeps its value.
        value = np.where((many > 0).T[:, :, None], new.transpose(1, 0, 2), value)
    return side


def split_regions(x: np.ndarray, edges: np.ndarray, cost: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Regions split while that lowers the energy; regions stay connected."""
    live = np.ones(len(x), bool)
    while live.any():
        rows = np.flatnonzero(live)
        number = np.full(len(x), -1)
        number[rows] = np.arange(len(rows))
        names, own = np.unique(region[rows], return_inverse=True)
        inside = live[edges[:, 0]] & live[edges[:, 1]] & (region[edges[:, 0]] == region[edges[:, 1]])
        e, c, n = number[edges[inside]], cost[inside], len(names)
        side = best_splits(x[rows], e, c, own, n)
        both = own * 2 + ~side
        parts = connected(len(rows), *e[both[e[:, 0]] == both[e[:, 1]]].T)
        # A side in several pieces makes each a region of its own, with its own mean.
        part = np.unique(parts, return_inverse=True)[1]
        fit = ((x[rows] - means_of(x[rows], part, part.max() + 1)[part]) ** 2).sum(1)
        was = ((x[rows] - means_of(x[rows], own, n)[own]) ** 2).sum(1)
        cut = part[e[:, 0]] != part[e[:, 1]]
        gain = np.bincount(own, was - fit, n) - np.bincount(own[e[cut, 0]], c[cut], n)
        good = gain > 1e-9 * np.maximum(np.bincount(own, was, n), 1e-12)
        region = region.copy()
        region[rows] = np.where(good[own], rows[parts], region[rows])
        live = np.zeros(len(x), bool)
        live[rows[good[own]]] = True
    return region


def merge_regions(x: np.ndarray, edges: np.ndarray, weight: np.ndarray, penalty: float, region: np.ndarray | None = None) -> np.ndarray:
    """Region number of each row of ``x``: pairs of neighbouring regions (of rows, at first, or of ``region``) are merged, best first, while that lowers the energy."""
    region = np.arange(len(x)) if region is None else np.unique(region, return_inverse=True)[1]
    n = int(region.max()) + 1 if len(region) else 0
    mean, size, up = means_of(x.astype(float), region, n), np.bincount(region, minlength=n).astype(float), np.arange(n)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in zip(region[edges].tolist(), weight.tolist()):
        if a != b:
            near[a][b] = near[b][a] = near[a].get(b, 0.0) + w

    def gain(a: int, b: int) -> float:
        d = mean[a] - mean[b]
        return penalty * near[a][b] - size[a] * size[b] / (size[a] + size[b]) * float(d @ d)

    stamp = np.zeros(n, int)
    heap = [(-gain(a, b), a, b, 0, 0) for a in range(n) for b in near[a] if a < b]
    heapq.heapify(heap)
    while heap:
        g, a, b, sa, sb = heapq.heappop(heap)
        if g >= 0:
            break
        if stamp[a] != sa or stamp[b] != sb or up[a] != a or up[b] != b:
            continue
        mean[a] = (mean[a] * size[a] + mean[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        up[b] = a
        near[a].pop(b, None)
        for c, w in near[b].items():
            near[c].pop(b, None)
            if c != a:
                near[a][c] = near[c][a] = near[a].get(c, 0.0) + w
        near[b] = {}
        stamp[a] += 1
        for c in near[a]:
            p, q = min(a, c), max(a, c)
            heapq.heappush(heap, (-gain(p, q), p, q, stamp[p], stamp[q]))
    while (up != up[up]).any():
        up = up[up]
    return np.unique(up[region], return_inverse=True)[1]


def lowered(x: np.ndarray, edges: np.ndarray, weight: np.ndarray, penalty: float, region: np.ndarray) -> np.ndarray:
    """Rounds of splits and merges from ``region`` on, while the energy falls."""
    last = energy(x, edges, weight, penalty, region)
    while True:
        new = merge_regions(x, edges, weight, penalty, split_regions(x, edges, penalty * weight, region))
        now = energy(x, edges, weight, penalty, new)
        if not now < last - 1e-9 * abs(last):
            return region
        region, last = new, now


def cut_pursuit(x: np.ndarray, edges: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Region number of each row of ``x``; ``edges`` are pairs of rows with weights.

    The descent runs from above, from the connected parts, and from below, from merged single rows; each
    part of the graph keeps the better end, so that the energy is never above that of merging alone.
    """
    x, edges, weight = np.asarray(x, float), np.asarray(edges, np.int64).reshape(-1, 2), np.asarray(weight, float)
    if not len(x):
        return np.zeros(0, int)
    keep = edges[:, 0] != edges[:, 1]
    edges, weight = edges[keep], weight[keep]
    x = x - x.mean(0)
    part = connected(len(x), *edges.T)
    ends = [lowered(x, edges, weight, penalty, start) for start in (part, merge_regions(x, edges, weight, penalty))]
    costs = []
    for region in ends:
        number = np.unique(region, return_inverse=True)[1]
        fit = ((x - means_of(x, number, number.max() + 1)[number]) ** 2).sum(1)
        cut = number[edges[:, 0]] != number[edges[:, 1]]
        costs.append(np.bincount(part, fit, len(x)) + penalty * np.bincount(part[edges[cut, 0]], weight[cut], len(x)))
    above = (costs[0] <= costs[1])[part]
    return np.unique(np.where(above, ends[0], len(x) + ends[1]), return_inverse=True)[1]
