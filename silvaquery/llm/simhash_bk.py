"""SimHash near-duplicates found with BK-trees.

Fingerprints (64 bits) come from word shingles. Two fingerprints that differ in at most three bits
agree wholly in at least two of five blocks of bits, so each distinct fingerprint goes into the ten
shards named by a pair of blocks and its bits there, and every shard has a BK-tree of its own: a
child hangs from its parent by the integer Hamming distance between them, and a search follows only
edges whose label is within the radius of the distance found. Trees travel to the fingerprints that
must search them by that key; nothing that grows with the corpus is broadcast or collected.
Equal fingerprints are one node, so exact copies cost nothing, however many there are. A shard of
more than ``hot`` fingerprints is dealt out anew by four finer keys (the bits it leaves open in four runs, one of which agrees),
which loses no pair; what is still as large is dealt out again, three times at most, after which 16 open bits bound a shard.

Defined cases: a null text is an empty one; a text without words has fingerprint zero and is linked
like any other; null doc_ids get a fingerprint, and as component the smallest doc_id that is not null,
if any; repeated rows give repeated results; an empty table gives an empty result. Of the input only
the named columns matter, so further columns of any name do not interfere.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, bounded, free_name, whole_groups, words_of, written
from .components import connected_components, local_components

#: First bits of the five blocks, and the end.
BLOCKS = (0, 13, 26, 39, 52, 64)
RADIUS = 3
HOT = 4096
#: Minima of shingle hashes that the nodes of a shard share in the near-duplicate stage.
BAND = 4


def _stirred(h: np.ndarray, nth: int) -> np.ndarray:
    """Another 64-bit hash made of one (the finaliser of SplitMix64)."""
    x = h + np.uint64(nth * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """Hashes of the text's word shingles, repeats included; a shorter text is one shingle, one without words has none."""
    w = words_of(text)
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) > shingle:
        parts = map(b" ".join, zip(*(w[i:] for i in range(shingle))))
        n = len(w) - shingle + 1
    else:
        parts, n = iter([b" ".join(w)]), 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, seed) for p in parts), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42, width: int = 1) -> np.ndarray:
    """The text's SimHash as ``width`` signed 64-bit integers; the first comes from the shingles' hashes themselves."""
    return simhash(shingle_hashes(text, shingle, seed), width)


def simhash(h: np.ndarray, width: int = 1) -> np.ndarray:
    """SimHash of 64-bit hashes; of none it is zero."""
    n = len(h)
    out = np.zeros(width, np.int64)
    if not n:
        return out
    for k in range(width):
        counts = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            part = h[at:at + (1 << 16)]
            bits = np.unpackbits((_stirred(part, k) if k else part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            full = len(bits) // 255 * 255
            # Sums of 255 bits fit in a byte, which keeps the additions narrow.
            counts += bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[full:].sum(0, dtype=np.int64)
        out[k] = np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0]
    return out


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42, name: str = "fingerprint", width: int = 1) -> DataFrame:
    """``docs`` with a fingerprint in one more column, the last: a signed 64-bit integer, or ``width`` of them as little-endian bytes."""

    def make() -> Callable:
        if width == 1:
            return lambda texts: [[int(fingerprint(t, shingle, seed)[0]) for t in texts]]
        return lambda texts: [[fingerprint(t, shingle, seed, width).tobytes() for t in texts]]

    return add_columns(docs, [text], [(name, "long" if width == 1 else "binary")], make)


def as_hex(fp: Column) -> Column:
    """A signed 64-bit integer as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class Forest:
    """BK-trees over the points (rows of 64-bit integers) of many shards, grown level by level.

    ``shard`` numbers each point's tree. The first point of a shard is its root; of the points at one
    distance below a node the first becomes the child by that edge and the others go below it.
    """

    def __init__(self, points: np.ndarray, shard: np.ndarray):
        n, self.span = len(points), 64 * points.shape[1] + 1
        self.points = points
        self.parent, self.edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        _, first, which = np.unique(shard, return_index=True, return_inverse=True)
        node_of = first[which]  # where each point has got to
        self.root = node_of.copy()
        rest = np.setdiff1d(np.arange(n), first)
        while len(rest):
            d = self.distance(points[rest], points[node_of[rest]])
            _, at, which = np.unique(node_of[rest] * self.span + d, return_index=True, return_inverse=True)
            child = rest[at]
            self.parent[child], self.edge[child] = node_of[child], d[at]
            node_of[rest] = child[which]
            stay = np.ones(len(rest), bool)
            stay[at] = False
            rest = rest[stay]
        kids = np.flatnonzero(self.parent >= 0)
        keys = self.parent[kids] * self.span + self.edge[kids]
        order = np.argsort(keys, kind="stable")
        self.kids, self.keys = kids[order], keys[order]

    @staticmethod
    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # Unsigned: of a signed integer NumPy counts the bits of its absolute value.
        return np.bitwise_count((a ^ b).view(np.uint64)).sum(1, dtype=np.int64)

    def search(self, query: np.ndarray, start: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index of query, index of point) at most ``radius`` apart, searching from the node ``start`` of each query."""
        q, node = np.arange(len(query)), start
        while len(q):
            d = self.distance(query[q], self.points[node])
            near = d <= radius
            yield q[near], node[near]
            low = np.searchsorted(self.keys, node * self.span + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.keys, node * self.span + np.minimum(d + radius, self.span - 1), "right")
            n = high - low
            begin = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            q, node = np.repeat(q, n), self.kids[begin + np.arange(n.sum())]


def near_links(points: np.ndarray, shard: np.ndarray, radius: int, block: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """For each point that some other of its shard is near: the point, and the smallest point linked to it here.

    ``points`` repeat from shard to shard; the result has each once. Tree edges within the radius are links
    already; only points outside their shard's largest group so far need searching for, as a link between groups
    has an end in a smaller one. So a large group of near copies costs a tree, not its pairs.
    """
    forest = Forest(points, shard)
    values, name = np.unique(points, axis=0, return_inverse=True)
    name = name.ravel()
    everyone = np.arange(len(values))
    close = np.flatnonzero((forest.parent >= 0) & (forest.edge <= radius))
    label = local_components(name[close], name[forest.parent[close]], len(values))
    group, count = np.unique(forest.root * len(values) + label[name], return_counts=True)
    order = np.lexsort((group, -count, group // len(values)))
    largest = order[np.unique(group[order] // len(values), return_index=True)[1]]
    ask = np.flatnonzero(~np.isin(forest.root * len(values) + label[name], group[largest]))
    for at in range(0, len(ask), block):
        rows = ask[at:at + block]
        for q, p in forest.search(points[rows], forest.root[rows], radius):
            a, b = name[rows[q]], name[p]
            new = label[a] != label[b]
            # What was joined so far goes in as links to the label, so no list of pairs outlives its step.
            if new.any():
                label = local_components(np.concatenate((a[new], everyone)), np.concatenate((b[new], label)), len(values))
    moved = np.flatnonzero(label != everyone)
    return values[moved], values[label[moved]]


def _mask(blocks: tuple[int, ...]) -> int:
    bits = sum(((1 << BLOCKS[b + 1]) - 1) ^ ((1 << BLOCKS[b]) - 1) for b in blocks)
    return bits - (1 << 64) if bits >> 63 else bits


def _finer(mask: int) -> list[int]:
    """Four masks that each add a run of the bits which this one leaves open."""
    left = [b for b in range(64) if not (mask >> b) & 1]
    out = []
    for k in range(4):
        bits = mask & ((1 << 64) - 1) | sum(1 << b for b in left[k * len(left) // 4:(k + 1) * len(left) // 4])
        out.append(bits - (1 << 64) if bits >> 63 else bits)
    return out


def fingerprint_components(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT, levels: int = 3) -> DataFrame:
    """Distinct fingerprints ``(fp)`` -> ``(node, root)`` for those that have a link, root the component's smallest.

    A shard is a mask and the bits under it; the first masks are pairs of blocks.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the shards hold all pairs up to radius {RADIUS}")
    masks = [_mask(p) for p in combinations(range(5), 2)]
    under = lambda m: F.struct(m.alias("mask"), F.col("fp").bitwiseAND(m).alias("bits"))
    keyed = distinct.select("fp", F.explode(F.array(*(under(F.lit(m)) for m in masks))).alias("k")).select("fp", "k.*")
    for _ in range(levels):
        crowded = written(keyed.groupBy("mask", "bits").count().filter(F.col("count") > hot).select("mask", "bits"), "simhash-hot")
        if crowded.isEmpty():
            break
        finer = F.create_map(*(x for m in masks for x in (F.lit(m), F.array(*map(F.lit, _finer(m))))))
        dealt = keyed.join(crowded, ["mask", "bits"]).select("fp", F.explode(F.transform(finer[F.col("mask")], under)).alias("k")).select("fp", "k.*")
        keyed = keyed.join(crowded, ["mask", "bits"], "left_anti").select("fp", "mask", "bits").unionByName(dealt)
        masks = sorted({x for m in masks for x in [m, *_finer(m)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["mask", "bits"], 200_000):
            key = np.column_stack([rows.column(c).to_numpy() for c in ("mask", "bits")])
            shard = np.cumsum((np.diff(key, axis=0, prepend=key[:1]) != 0).any(1))
            a, b = near_links(rows.column("fp").to_numpy().reshape(-1, 1), shard, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(b[:, 0])], names=["u", "v"])

    edges = keyed.repartition("mask", "bits").sortWithinPartitions("mask", "bits").mapInArrow(run, "u long, v long")
    return connected_components(edges, "simhash-cc")


def bits_apart(similarity: float, bits: int, sureness: float = 5.0) -> int:
    """A number of differing bits that texts with this Jaccard similarity of shingles keep to: for texts of equal length all
    but one pair in a million, for sets of four and five shingles (whose bits differ more often) all but one in a thousand."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + sureness * math.sqrt(bits * p * (1 - p)))


def band_count(similarity: float, least: int = BAND, recall: float = 0.999) -> int:
    """Tables of ``least`` minima that find a pair at the threshold with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log1p(-(similarity**least)))


def bands_of(h: np.ndarray, tables: int, least: int = BAND, seed: int = 9) -> np.ndarray:
    """One key a table, made of ``least`` minima of the distinct hashes in as many random orders."""
    rng = np.random.default_rng(seed)
    stir, times = (rng.integers(0, 1 << 63, (tables * least, 1), dtype=np.uint64) for _ in range(2))
    low = np.full(tables * least, ~np.uint64(0))
    for at in range(0, len(h), 1 << 13):
        low = np.minimum(low, ((h[at:at + (1 << 13)] ^ stir) * (times << np.uint64(1) | np.uint64(1))).min(1))
    key = np.arange(tables, dtype=np.uint64)
    for column in low.reshape(tables, least).T:
        key = _stirred(key ^ column, 1)
    return key.view(np.int64)


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets without repeats; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


class Shards:
    """The shards of more than one point in a task: points (fingerprints) with their numbers, and a BK-tree for each shard.

    The root is the point nearest to the majority of its shard's bits, so copies of one text meet that text first.
    """

    def __init__(self, rows: pa.Table, width: int, radius: int):
        _, shard, count = np.unique(rows.column("band").to_numpy(), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count[shard] > 1)
        shared = shared[np.argsort(shard[shared], kind="stable")]
        rows, shard = rows.take(pa.array(shared)), shard[shared]
        points = np.frombuffer(b"".join(rows.column("fp").to_pylist()), "<i8").reshape(-1, width)
        if len(points):
            begin = np.flatnonzero(np.diff(shard, prepend=-1))
            size = np.diff(begin, append=len(shard))
            far = np.zeros(len(points), np.int64)
            for k in range(width):
                bits = np.unpackbits(np.ascontiguousarray(points[:, k:k + 1]).view(np.uint8), axis=1, bitorder="little")
                most = np.packbits(np.add.reduceat(bits, begin, axis=0, dtype=np.int32) * 2 > size[:, None], axis=1, bitorder="little").view(np.int64)[:, 0]
                far += np.bitwise_count((points[:, k] ^ np.repeat(most, size)).view(np.uint64))
            order = np.lexsort((far, shard))
            rows, points = rows.take(pa.array(order)), points[order]
        self.radius, self.rows, self.points, self.node = radius, rows, points, rows.column("node").to_numpy()
        self.forest = Forest(points, shard)
        self.largest = int(count.max(initial=1))

    def nearest_above(self) -> tuple[np.ndarray, np.ndarray]:
        """For each point the nearest of the points above it in its tree, and the distance; roots have -1."""
        f = self.forest
        best, gap, at = f.parent.copy(), f.edge.copy(), f.parent
        while True:
            at = np.where(at >= 0, f.parent[at], -1)
            live = np.flatnonzero(at >= 0)
            if not len(live):
                return best, gap
            d = f.distance(self.points[live], self.points[at[live]])
            less = d < gap[live]
            best[live[less]], gap[live[less]] = at[live[less]], d[less]

    def outside(self, group: np.ndarray) -> np.ndarray:
        """Points that are not in their shard's largest group; any pair of two groups has an end among them."""
        pair, which, count = np.unique(np.column_stack((self.forest.root, group)), axis=0, return_inverse=True, return_counts=True)
        order = np.lexsort((-count, pair[:, 0]))
        first = order[np.unique(pair[order, 0], return_index=True)[1]]
        return np.flatnonzero(~np.isin(which.ravel(), first))

    def near(self, ask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a point asked for and another within the radius; blocks are small where shards are large."""
        block = max(1, min(4000, 2_000_000 // self.largest))
        for at in range(0, len(ask), block):
            part = ask[at:at + block]
            for q, p in self.forest.search(self.points[part], self.forest.root[part], self.radius):
                yield part[q], p


def may_link(codes: np.ndarray, owner: np.ndarray, size: np.ndarray, label: np.ndarray, similarity: float) -> np.ndarray:
    """Which points of a shard may be alike to one of another label, by what their sets hold that any such point has.

    ``codes`` are all points' hashes, sorted, ``owner`` whose they are. Two sets are alike only where they share ``s (m + n) / (1 + s)`` of their m and
    n hashes, so a point whose hashes that others have are too few for any size there is cannot link; it is taken out, and
    so are its hashes, again and again. A family of texts with one template and endings of their own falls away in one round.
    """
    n, live = len(size), np.ones(len(size), bool)
    begin = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1)) if len(codes) else np.zeros(0, np.int64)
    length = np.diff(begin, append=len(codes))
    while live.any():
        own = label[owner]
        on = live[owner]
        shared = np.zeros(len(codes), bool)
        if len(begin):
            least, most = np.minimum.reduceat(np.where(on, own, np.iinfo(np.int64).max), begin), np.maximum.reduceat(np.where(on, own, -1), begin)
            shared = np.repeat((most >= 0) & (least < most), length) & on
        held = np.bincount(owner[shared], minlength=n)
        # The other's size lies between what this one's own and what it can share allow.
        low, high = similarity * size - 1e-6, held * (1 + similarity) / similarity - size + 1e-6
        sizes = np.sort(size[live])
        others = np.searchsorted(sizes, high, "right") - np.searchsorted(sizes, low, "left") - ((size >= low) & (size <= high) & live)
        now = live & (others > 0) & (held >= similarity * size - 1e-6)
        if (now == live).all():
            break
        live = now
    return live


def across(s: Shards, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between points with different labels, found by the trees and checked by their sets, as many as join all that can be joined.

    A link joins two labels at once, so later points need not be compared with those they are joined to already. Within a shard the
    sets are turned into lists of the points that have each hash, and a point's list of lists gives the sizes of all its intersections. Points
    that cannot link, by the hashes they share with any other, are not compared at all.
    """
    names, label = np.unique(s.rows.column("label").to_numpy(), return_inverse=True)
    joined = np.arange(len(names))  # label by label, its smallest so far
    raw = s.rows.column("items").combine_chunks() if isinstance(s.rows.column("items"), pa.ChunkedArray) else s.rows.column("items")
    sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in raw]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    ask, root = s.outside(label), s.forest.root
    begin = np.flatnonzero(np.diff(root, prepend=-1))
    end = np.append(begin[1:], len(root))
    for shard in np.unique(np.searchsorted(begin, ask, "right") - 1).tolist():
        low, high = int(begin[shard]), int(end[shard])
        mine = ask[np.searchsorted(ask, low):np.searchsorted(ask, high)]
        codes, owner = np.concatenate(sets[low:high]), np.repeat(np.arange(high - low), size[low:high])
        order = np.argsort(codes, kind="stable")
        codes, owner = codes[order], owner[order]
        live = may_link(codes, owner, size[low:high], joined[label[low:high]], similarity)
        mine = mine[live[mine - low]]
        for q, p in s.near(mine) if len(mine) else ():
            apart = (joined[label[q]] != joined[label[p]]) & live[p - low]
            q, p = q[apart], p[apart]
            order = np.argsort(q, kind="stable")
            q, p = q[order], p[order]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            for own, other in zip(q[first].tolist(), np.split(p, first[1:])):
                other = other[joined[label[other]] != joined[label[own]]]
                if not len(other):
                    continue
                a, b = np.searchsorted(codes, sets[own], "left"), np.searchsorted(codes, sets[own], "right")
                both = np.bincount(np.concatenate([owner[i:j] for i, j in zip(a.tolist(), b.tolist())]) if len(a) else owner[:0], minlength=high - low)[other - low]
                total = size[own] + size[other] - both
                hit = other[both / np.maximum(total, 1) >= similarity]
                _, one = np.unique(joined[label[hit]], return_index=True)
                hit = hit[one]
                if len(hit):
                    yield np.full(len(hit), s.node[own]), s.node[hit]
                    same = np.append(joined[label[hit]], joined[label[own]])
                    joined[np.isin(joined, same)] = same.min()


def similar_components(prints: DataFrame, nodes: DataFrame, text: str, shingle: int, similarity: float = 0.8, width: int = 4) -> DataFrame:
    """``nodes(node, fp, bands)`` -> ``(node, root)`` for those linked to another: links are pairs whose sets of shingles have this Jaccard similarity.

    ``prints`` has the texts of the nodes. Shards hold the nodes that agree on a band; BK-trees over the fingerprints find
    the pairs that are near enough to be compared, and the sets of 32-bit shingle hashes of both decide. Each point is
    compared first with the nearest above it in its tree, so a large group becomes one component at the cost of a tree;
    then, where the trees find near points of other components, with those, in the shard's own task, so no list of pairs
    leaves it but the links that join components.
    """
    radius = bits_apart(similarity, 64 * width)
    pair_type = "u long, v long"

    def together(make: Callable[[Shards], Iterator[tuple[np.ndarray, np.ndarray]]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in whole_groups(batches, ["band"]):
                shards = Shards(rows, width, radius)
                for u, v in make(shards) if len(shards.node) else ():
                    pairs = np.unique(np.column_stack((np.minimum(u, v), np.maximum(u, v))), axis=0)
                    for at in range(0, len(pairs), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[at:at + 10_000, k]) for k in (0, 1)], names=["u", "v"])

        return run

    def first(s: Shards) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tree links; as (node, node) all nodes that any other is near."""
        everyone = np.arange(len(s.node))
        above, gap = s.nearest_above()
        close = np.flatnonzero((above >= 0) & (gap <= radius))
        yield s.node[close], s.node[above[close]]
        close = np.flatnonzero((s.forest.parent >= 0) & (s.forest.edge <= radius))
        seen = np.zeros(len(everyone), bool)
        seen[close] = seen[s.forest.parent[close]] = True
        for q, p in s.near(s.outside(local_components(close, s.forest.parent[close], len(everyone)))):
            other = q != p
            seen[q[other]] = seen[p[other]] = True
        yield s.node[seen], s.node[seen]

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 1):
                sets = [np.unique(shingle_hashes(t, shingle).astype(np.uint32)).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "items"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [[np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(c)] for c in ("a", "b")]
            yield batch.select(["u", "v"]).filter(pa.array([similarity_of(a, b) >= similarity for a, b in zip(*of)], pa.bool_()))

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        one, two = (sets.select(F.col("node").alias(n), F.col("items").alias(i)) for n, i in (("u", "a"), ("v", "b")))
        return written(pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b").mapInArrow(alike, pair_type), tag)

    keyed = F.explode("bands").alias("band")
    found = written(nodes.select("node", "fp", keyed).repartition("band").sortWithinPartitions("band").mapInArrow(together(first), pair_type).distinct(), "simhash-tree")
    texts = prints.select("node", text).mapInArrow(hashes, "node long, items binary").groupBy("node").agg(F.first("items").alias("items"))
    sets = written(texts.join(found.filter("u = v").select(F.col("u").alias("node")), "node"), "simhash-sets")
    links = verified(found.filter("u <> v"), "simhash-links")
    named = connected_components(links, "simhash-cc").withColumnRenamed("root", "label")
    active = nodes.join(sets, "node").join(named, "node", "left")
    asked = active.select("node", "fp", F.coalesce("label", "node").alias("label"), "items", keyed).repartition("band").sortWithinPartitions("band")
    more = written(asked.mapInArrow(together(lambda shards: across(shards, similarity)), pair_type), "simhash-links")
    return connected_components(links.unionByName(more), "simhash-cc")


def rooted_fingerprints(prints: DataFrame, fp: str, doc_id: str, components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with fingerprint and id -> ``(fp, least, root)``, one row per distinct fingerprint: its smallest id and its component."""
    nodes = written(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least")), "simhash-nodes")
    parts = components(nodes.select("fp"))
    return written(nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-rooted")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """``(doc_id, fingerprint string, component_id)`` for each row of ``docs``."""
    prints = with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle, name="fp").drop("text")
    prints = written(prints, "simhash-prints")
    rooted = rooted_fingerprints(prints, "fp", "doc_id", lambda d: fingerprint_components(d, radius, hot))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.select(F.col("fp").alias("node"), "root").join(least, "root")
    return prints.join(found, prints.fp == found.node).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, width: int = 4) -> DataFrame:
    """``docs`` without near-duplicates of at least this similarity: of each component one row stays, one with the smallest doc_id.

    Two texts are linked where the Jaccard similarity of their sets of word shingles is at least ``similarity``; a component is
    what such links join. Rows with a null doc_id stay only where their component has no other, as one row; texts
    without words are copies of one another.
    """
    tables = band_count(similarity)

    def make() -> Callable:
        def run(texts: list) -> list:
            out = [], [], []
            for t in texts:
                h = np.unique(shingle_hashes(t, shingle))
                out[0].append(xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63))
                out[1].append(simhash(h, width).tobytes())
                out[2].append(bands_of(h, tables) if len(h) else [])
            return out

        return run

    prints = written(add_columns(docs, [text], [("node", "long"), ("fp", "binary"), ("bands", "array<long>")], make), "simhash-docs")
    node, fp, bands = prints.columns[-3:]
    slim = prints.select(F.col(node).alias("node"), F.col(fp).alias("fp"), F.col(bands).alias("bands"), F.col(doc_id).alias("id"))
    nodes = written(slim.groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min("id").alias("least")), "simhash-nodes")
    words = free_name(["node"], "text")
    parts = similar_components(prints.select(F.col(node).alias("node"), F.col(text).alias(words)), nodes.select("node", "fp", "bands"), words, shingle, similarity, width)
    rooted = nodes.select("node", "least").join(parts, "node", "left")
    # The kept row of each component is named first, by ids alone, so that only kept rows' texts move, and once.
    named = rooted.groupBy(F.coalesce("root", "node")).agg(F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), "node")).alias("k"))

    def key(at: Column, ident: Column) -> Column:
        return F.concat_ws(":", at.cast("string"), ident.cast("string"))

    own = free_name(prints.columns, "kept_key")
    right = named.select(key(F.col("k.node"), F.col("k.id")).alias(own))
    return prints.withColumn(own, key(F.col(node), F.col(doc_id))).join(right, own).dropDuplicates([own]).select(*docs.columns)
