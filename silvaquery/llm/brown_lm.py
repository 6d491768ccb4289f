"""Scoring texts with a class-based n-gram model (Brown et al. 1992).

Every word of the training texts has one class, found by exchange: a word is in the class that makes the likelihood of
class bigrams highest. The ``CORE`` commonest words are exchanged one after another against one another until none moves;
then every other word goes to the class that does so given the classes of core words before and behind all its
occurrences, each word by itself, so the work is spread over the cluster by
word (a step of the distributed exchange of Uszkoreit and Brants 2008). The vocabulary grows with the texts; no
word is left out or put together with others by a hash.

The model is a mixture, P(w | v) = a P(class w | class v) P(w | class w) + (1 - a) P(w). Both word probabilities are
proportional to count + 0.5, and every class, as the vocabulary, keeps 0.5 for a word that was not seen; so over
all words and the unseen one it sums to one, and it is the unigram times a factor that depends on two classes only.
Each text ends with one end token, which is also the context of its first word. An unseen word has no class: as a word it
may come from any, as a context it predicts classes by their frequency.

Texts are split once, into blocks of about 2 MB with a dictionary each. Words among the ``LOCAL`` commonest (a
bound on what tasks hold, not on the vocabulary) are known to every task; rarer ones are looked up by a join of
(block, word) with the table of words. In the model's table all words count.

Defined cases: null or empty texts have the end token alone; rows with a null id are scored but neither learned
from nor held out; repeated rows count and are scored each; without training rows all counts are zero; a word without
a core word beside it goes to the last class; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

CORE, CLASSES, LOCAL = 2048, 64, 1 << 18
#: Bytes of text in a block, most documents in it, tokens whose contexts one placing group is expected to hold.
BLOCK_BYTES, BLOCK_ROWS, GROUP = 2 << 20, 5000, 1_000_000
#: Blocks that go to Python at a time, each some megabytes, and rows of placing groups, whose number grows with blocks times groups (blocks among them stop at bytes).
AT_ONCE, SENT_AT_ONCE = 1, 128
#: Counts up to this have their gains in a table.
SMALL = 64
END = b""


def coded(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, number of each token's word, tokens per text), A-Z lower-cased, with an end token behind each text."""
    texts = texts.cast(pa.large_string())
    # A new array, as ascii_lower misreads one that is a slice of another.
    texts = pc.if_else(pc.is_valid(texts), texts, pa.scalar("", pa.large_string()))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found = lists.flatten().dictionary_encode()
    names, codes = found.dictionary.cast(pa.large_binary()).to_pylist(), found.indices.to_numpy()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    if END in names:
        # Blanks at a text's beginning or end leave an empty string, which is no word; its number stands for the end.
        end = names.index(END)
        real = codes != end
        codes, row = codes[real], row[real]
    else:
        end = len(names)
        names.append(END)
    sizes = np.bincount(row, minlength=len(lists))
    return names, np.insert(codes, np.cumsum(sizes), end), sizes + 1


def blocks_of(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, training, text)`` as blocks: ``(block, ids, training, sizes, codes, words)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, nth = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            length = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                # As many rows as fit, at least one.
                end = min(int(np.searchsorted(length, (length[at - 1] if at else 0) + BLOCK_BYTES, "right")), at + BLOCK_ROWS)
                part = batch.slice(at, max(1, end - at))
                names, codes, sizes = coded(part.column(2))
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(k)) for k in (0, 1)]
                raw = [sizes.astype("<i4").tobytes(), codes.astype("<u2" if len(names) < 1 << 16 else "<u4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([high + nth]), *lists, *(pa.array([x], pa.binary()) for x in raw), pa.array([names], pa.list_(pa.binary()))], names=["block", "ids", "training", "sizes", "codes", "words"])
                at, nth = at + part.num_rows, nth + 1

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "training", "text").mapInArrow(run, f"block long, ids array<{kind}>, training array<boolean>, sizes binary, codes binary, words array<binary>")


def tokens_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, sizes, whether each token is of a training text) of a block."""
    sizes = np.frombuffer(row["sizes"], "<i4")
    codes = np.frombuffer(row["codes"], "<u2" if len(row["codes"]) == 2 * sizes.sum() else "<u4").astype(np.int64)
    return codes, sizes, np.repeat(np.array(row["training"], bool), sizes)


def contexts(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The code before each token; a text's first word stands behind an end token."""
    return np.concatenate((codes[sizes[:1] - 1], codes[:-1]))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def word_counts(blocks: DataFrame) -> DataFrame:
    """``(word binary, n long)`` over training texts; the empty word is the end token. Counts of a task's blocks are added up before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def added() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).group_by("word").aggregate([("n", "sum")]).combine_chunks()
            return pa.RecordBatch.from_arrays([t.column("word").chunk(0), t.column("n_sum").chunk(0)], names=["word", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                codes, _, learn = tokens_of(part.select(["training", "sizes", "codes"]).to_pylist()[0])
                words = part.column(3).flatten()
                n = np.bincount(codes[learn], minlength=len(words))
                there = np.flatnonzero(n)
                if len(there):
                    held.append(pa.RecordBatch.from_arrays([words.take(pa.array(there)), pa.array(n[there])], names=["word", "n"]))
                    size += len(there)
                if size > 1_000_000:
                    yield added()
                    held, size = [], 0
        if held:
            yield added()

    return blocks.select("training", "sizes", "codes", "words").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """Classes of items by the exchange algorithm (Kneser & Ney 1993), starting from items dealt by frequency.

    ``bigrams[a, b]`` counts b after a. An item moves to the class that raises sum n log n of class bigrams,
    less that of class unigrams on both sides, most; sweeps end when nothing moves.
    """
    n = len(bigrams)
    total = bigrams.sum(1) + bigrams.sum(0)
    order = np.argsort(-total, kind="stable")
    of = np.zeros(n, np.int64)
    of[order] = np.arange(n) % classes
    left = np.zeros((classes, n))  # class before item
    right = np.zeros((n, classes))  # item before class
    np.add.at(left, of, bigrams)
    np.add.at(right.T, of, bigrams.T)
    table = np.zeros((classes, classes))
    np.add.at(table.T, of, left.T)
    f = xlogx
    for _ in range(sweeps):
        moved = 0
        for i in order.tolist():
            if not total[i]:
                continue
            old, own = of[i], bigrams[i, i]
            out, into = right[i].copy(), left[:, i].copy()  # counts of item -> class, class -> item
            out[old] -= own
            into[old] -= own
            # Take the item out of its class.
            table[old] -= out
            table[:, old] -= into
            table[old, old] -= own
            rows, cols = table.sum(1), table.sum(0)
            # Adding to class k changes row k by out, column k by into, and the corner by own and both.
            some_out, some_in = np.flatnonzero(out), np.flatnonzero(into)
            a, b = table[:, some_out], table[some_in]
            gain_row = (f(a + out[some_out]) - f(a)).sum(1)
            gain_col = (f(b + into[some_in, None]) - f(b)).sum(0)
            d = np.diagonal(table)
            corner = f(d + out + into + own) - f(d + out) - f(d + into) + f(d)
            r, c = out.sum() + own, into.sum() + own
            change = gain_row + gain_col + corner - (f(rows + r) - f(rows)) - (f(cols + c) - f(cols))
            new = int(np.argmax(change))
            if change[new] <= change[old] + 1e-9:
                new = int(old)
            table[new] += out
            table[:, new] += into
            table[new, new] += own
            if new != old:
                moved += 1
                of[i] = new
                left[old] -= bigrams[i]
                left[new] += bigrams[i]
                right[:, old] -= bigrams[:, i]
                right[:, new] += bigrams[:, i]
        if not moved:
            break
    return of


class Placing:
    """Places words by what stands around them, against fixed class bigrams."""

    def __init__(self, table: np.ndarray):
        self.table, k = table, len(table)
        self.row, self.col, self.classes = table.sum(1), table.sum(0), k
        # Slot s < k: the class s stands before; slot k + s: it stands behind. Cells that a word of class j would add to.
        self.cells = np.concatenate((table, table.T))
        x = np.arange(1, SMALL + 1)[:, None, None]
        self.add = (xlogx(self.cells + x) - xlogx(self.cells)).astype(np.float32)

    def gains(self, start: np.ndarray, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Change of the likelihood (words x classes); a word's entries begin at ``start``."""
        e = self.add[np.minimum(n, SMALL) - 1, slot]
        big = np.flatnonzero(n > SMALL)
        e[big] = xlogx(self.cells[slot[big]] + n[big, None]) - xlogx(self.cells[slot[big]])
        out = np.add.reduceat(e, start).astype(np.float64)
        for side, total in ((slot < self.classes, self.col), (slot >= self.classes, self.row)):
            m, of = np.unique(np.add.reduceat(np.where(side, n, 0), start), return_inverse=True)
            out -= (xlogx(total + m[:, None]) - xlogx(total))[of]
        return out

    def best(self, start: np.ndarray, slot: np.ndarray, n: np.ndarray, step: int = 1000) -> np.ndarray:
        """The class of each word, ties to the smallest."""
        edge, out = np.append(start, len(slot)), []
        for i in range(0, len(start), step):
            a, b = edge[i], edge[min(i + step, len(start))]
            out.append(self.gains(start[i:i + step] - a, slot[a:b], n[a:b]).argmax(1))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def transitions(table: np.ndarray) -> np.ndarray:
    """P(class | class before), smoothed; the row beyond the last is that of an unseen word."""
    k = len(table)
    t = table + 0.1
    by_frequency = t.sum(0)
    return np.concatenate((t / t.sum(1, keepdims=True), (by_frequency / by_frequency.sum())[None])).reshape(k + 1, k)


def class_factors(table: np.ndarray, class_mass: np.ndarray, all_d: float) -> np.ndarray:
    """What the model's probability is as a multiple of the unigram's, by class before and class; the last row and column stand for unseen words.

    ``class_mass``: the sum of count + 0.5 over a class's words, and 0.5 for an unseen one.
    """
    to = transitions(table) * (all_d / class_mass)
    ratio = np.concatenate((to, to.sum(1, keepdims=True)), axis=1)
    # Weight of the class model against the unigram, by expectation maximisation on the counts.
    seen, weight = table, 0.9
    for _ in range(30):
        if not seen.sum():
            break
        part = weight * ratio[:-1, :-1]
        weight = min(0.99, float((part / (part + 1 - weight) * seen).sum() / seen.sum()))
    return weight * ratio + 1 - weight


@dataclass
class Fitted:
    """Blocks with the places of their words, and classes: of common words by place, of rarer ones in a table."""

    blocks: DataFrame
    common: list[bytes]
    count: np.ndarray
    of: np.ndarray
    rare: DataFrame  # (word, class, n)
    total: int
    distinct: int

    @property
    def all_d(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


TOKENS = ["training", "sizes", "codes"]


def placed_blocks(blocks: DataFrame, common: Broadcast) -> DataFrame:
    """Blocks with ``ranks``, each word's place among the common ones (an Arrow array) or -1, and the names of the others only."""
    names = [*blocks.columns[:5], "ranks", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                words = part.column(5).flatten().cast(pa.binary())
                rank = pc.fill_null(pc.index_in(words, common.value), -1).to_numpy().astype("<i4")
                rare = words.filter(pa.array(rank < 0))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(5)), pa.array([rank.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(rare)], pa.int32()), rare)], names=names)

    kinds = dict(blocks.dtypes)
    return blocks.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in blocks.columns[:5]) + ", ranks binary, rare array<binary>")


def fit_classes(blocks: DataFrame, classes: int = CLASSES) -> Fitted:
    """Classes of all words of the blocks' training texts; ``blocks`` are rewritten, and their files deleted."""
    vocabulary = written(word_counts(blocks), "brown-words", AT_ONCE)
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The largest set of words, all of those as common as its rarest, that keeps to the bound.
    sizes = vocabulary.groupBy("n").agg(F.count("*").alias("m"))
    least = sizes.select("n", F.sum("m").over(Window.orderBy(F.desc("n"))).alias("so_far")).filter(F.col("so_far") <= LOCAL).agg(F.min("n")).first()[0]
    common = vocabulary.filter(F.col("n") >= (least if least is not None else 1 << 62)).toArrow()
    pairs = sorted(zip((-common.column("n").to_numpy()).tolist(), common.column("word").to_pylist()))
    count, common = np.array([-n for n, _ in pairs], np.int64), [w for _, w in pairs]
    forget(vocabulary)
    sent = blocks.sparkSession.sparkContext.broadcast(pa.array(common, pa.binary()))
    ranked = written(placed_blocks(blocks, sent), "brown-blocks", AT_ONCE, large=True)
    sent.destroy()
    forget(blocks)
    core = min(CORE, len(pairs))

    # ---- the commonest words, against one another
    def core_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(core * core, np.int64)
        for row in rows_of(batches):
            codes, sizes, learn = tokens_of(row)
            rank = np.frombuffer(row["ranks"], "<i4").astype(np.int64)
            rank = np.where(rank < core, rank, -1)
            a, b = rank[contexts(codes, sizes)], rank[codes]
            ok = learn & (a >= 0) & (b >= 0)
            pair, n = np.unique((a[ok] * core + b[ok]).astype(np.int32), return_counts=True)
            seen[pair] += n
        there = np.flatnonzero(seen).astype(np.int32)
        for at in range(0, len(there), 100_000):
            part = there[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(seen[part])], names=["pair", "n"])

    of, table = np.full(len(pairs), -1, np.int64), np.zeros((classes, classes))
    if core:
        bigrams = summed_table(ranked.select(*TOKENS, "ranks").mapInArrow(core_pairs, "pair long, n long"), core)
        of[:core] = exchange(bigrams, classes)
        np.add.at(table, (of[:core, None], of[None, :core]), bigrams)

    # ---- all other words, by the core words beside them
    groups, known = max(1, math.ceil(total / GROUP)), of.copy()

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words with the classes around them, in groups: common ones by place, rare ones by name."""
        for row in rows_of(batches):
            codes, sizes, learn = tokens_of(row)
            rank = np.frombuffer(row["ranks"], "<i4").astype(np.int64)
            c = np.where(rank >= 0, known[rank], -1) if len(known) else np.full(len(rank), -1)
            n = np.bincount(codes[learn], minlength=len(rank))
            asked = (n > 0) & ((rank >= core) | (rank < 0))
            before = contexts(codes, sizes)
            # A token's slots: the class before it, and that of the next one; a text's end has none behind it.
            w, slot = [], []
            for own, other, base in ((codes, before, 0), (before, codes, classes)):
                ok = learn & asked[own] & (c[other] >= 0)
                if base and len(ok):
                    ok[np.cumsum(sizes)[:-1]] = ok[0] = False
                w.append(own[ok])
                slot.append((c[other[ok]] + base).astype(np.uint8))
            w, slot = np.concatenate(w), np.concatenate(slot)
            names = np.flatnonzero(asked)
            if not len(names):
                continue
            nth = np.cumsum(rank < 0) - 1  # place among the block's rare names
            hashed = np.fromiter(map(zlib.crc32, row["rare"]), np.int64, len(row["rare"]))
            group = np.where(rank[names] >= 0, rank[names], hashed[nth[names]] if len(hashed) else 0) % groups
            order = np.argsort(group, kind="stable")
            names, group = names[order], group[order]
            place = np.zeros(len(rank), np.int64)
            place[names] = np.arange(len(names))
            order = np.argsort(place[w], kind="stable")
            slot, held = slot[order], np.bincount(place[w], minlength=len(names))
            edge, ends = np.flatnonzero(np.diff(group, prepend=-1)), np.concatenate(([0], np.cumsum(held)))
            out = []
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(names)]):
                own = names[a:b]
                out.append((int(group[a]), rank[own].astype("<i4").tobytes(), [row["rare"][i] for i in nth[own[rank[own] < 0]].tolist()], n[own].astype("<i4").tobytes(), held[a:b].astype("<i4").tobytes(), slot[ends[a]:ends[b]].tobytes()))
            kinds = (pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=["grp", "ranks", "names", "n", "held", "slots"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ``(rank, word, class, n)``, group by group: common words have a place, rare ones a name."""
        placing, gather = Placing(table), None
        for row in rows_of(batches):
            if gather is None or gather.group != row["grp"]:
                if gather:
                    yield gather.close(placing)
                gather = Gather(row["grp"])
            gather.add(row)
        if gather:
            yield gather.close(placing)

    sent = ranked.select(*TOKENS, "ranks", "rare").mapInArrow(around, "grp int, ranks binary, names array<binary>, n binary, held binary, slots binary")
    # Groups grow with the tokens, and so do the partitions that they are dealt to.
    parts = max(int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // 4))
    got = written(sent.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(place, "rank int, word binary, class int, n long"), "brown-classes", SENT_AT_ONCE)
    mine = got.filter("rank >= 0").select("rank", "class").toArrow()
    of[mine.column("rank").to_numpy()] = mine.column("class").to_numpy()
    return Fitted(ranked, common, count, of, got.filter("rank < 0").select("word", "class", "n"), total, distinct)


class Gather:
    """Counts of the words of one group with their slots, from the blocks' rows."""

    def __init__(self, group: int):
        self.group, self.index, self.keys, self.size, self.tally = group, {}, [], 0, []

    def add(self, row: dict) -> None:
        rare, index = iter(row["names"]), self.index
        at = np.fromiter((index.setdefault(r if r >= 0 else next(rare), len(index)) for r in np.frombuffer(row["ranks"], "<i4").tolist()), np.int64, len(row["ranks"]) // 4)
        self.tally.append((at, np.frombuffer(row["n"], "<i4").astype(np.int64)))
        slots = np.frombuffer(row["slots"], np.uint8)
        self.keys.append(((np.repeat(at, np.frombuffer(row["held"], "<i4")) << 8) | slots, np.ones(len(slots), np.int64)))
        self.size += len(slots)
        if self.size > 1_500_000:
            self.keys = [packed(self.keys)]
            self.size = len(self.keys[0][0])

    def close(self, placing: Placing) -> pa.RecordBatch:
        n, best = np.zeros(len(self.index), np.int64), np.full(len(self.index), placing.classes - 1, np.int64)
        for at, m in self.tally:
            np.add.at(n, at, m)
        key, times = packed(self.keys)
        some, start = np.unique(key >> 8, return_index=True)
        best[some] = placing.best(start, key & 255, times)
        names = list(self.index)
        return pa.RecordBatch.from_arrays([
            pa.array([x if isinstance(x, int) else -1 for x in names], pa.int32()), pa.array([None if isinstance(x, int) else x for x in names], pa.binary()),
            pa.array(best, pa.int32()), pa.array(n)], names=["rank", "word", "class", "n"])


def score_texts(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", classes: int = CLASSES) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` and, before them, ``training``, one row per row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"), F.col(text).alias("text"))
    blocks = written(blocks_of(rows), "brown-texts", large=True)
    return score_blocks(blocks, dict(rows.dtypes)["doc_id"], classes)


def score_blocks(blocks: DataFrame, kind: str, classes: int) -> DataFrame:
    """Scores of the blocks' texts, written; ``kind`` is the type of the ids."""
    fitted = fit_classes(blocks, classes)
    of, count, rare, total, all_d, blocks = fitted.of, fitted.count, fitted.rare, fitted.total, fitted.all_d, fitted.blocks

    # Every word of every block gets its class and count.
    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch.column(0).to_pylist(), (batch.column(1).slice(i, 1).flatten() for i in range(batch.num_rows))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), pa.array(np.arange(len(words), dtype=np.int32)), words.cast(pa.binary())], names=["block", "nth", "word"])

    asked = blocks.select("block", "rare").mapInArrow(unknown, "block long, nth int, word binary").join(rare, "word")
    by_block = asked.groupBy("block").agg(F.collect_list(F.struct("nth", "class", "n")).alias("found"))

    def known_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                rank = np.frombuffer(part.column(4)[0].as_py(), "<i4")
                c, n = np.full(len(rank), classes, np.uint8), np.zeros(len(rank), "<i8")
                there = np.flatnonzero(rank >= 0)
                c[there], n[there] = of[rank[there]], count[rank[there]]
                found = part.column(5).flatten()
                if len(found):
                    code = np.flatnonzero(rank < 0)[found.field("nth").to_numpy()]
                    c[code], n[code] = found.field("class").to_numpy(), found.field("n").to_numpy()
                raw = [pa.array([v.tobytes()], pa.binary()) for v in (c, n)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), *raw], names=["ids", *TOKENS, "classes", "counts"])

    full = blocks.drop("rare").join(by_block, "block", "left").select("ids", *TOKENS, "ranks", "found")
    kept = written(full.mapInArrow(known_words, f"ids array<{kind}>, training array<boolean>, sizes binary, codes binary, classes binary, counts binary"), "brown-coded", AT_ONCE, large=True)
    forget(blocks)

    def all_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, wide = np.zeros((classes + 1) ** 2, np.int64), classes + 1
        for row in rows_of(batches):
            codes, sizes, learn = tokens_of(row)
            c = np.frombuffer(row["classes"], np.uint8).astype(np.int64)
            a, b = c[contexts(codes, sizes)], c[codes]
            seen += np.bincount((a * wide + b)[learn], minlength=wide * wide)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(seen[there])], names=["pair", "n"])

    table = summed_table(kept.select(*TOKENS, "classes").mapInArrow(all_pairs, "pair long, n long"), classes + 1)[:classes, :classes]
    mass = np.full(classes, 0.5) + np.bincount(of, count + 0.5, classes) if len(of) else np.full(classes, 0.5)
    for r in rare.groupBy("class").agg(F.sum(F.col("n") + F.lit(0.5)).alias("m")).collect():
        mass[r["class"]] += r["m"]
    log_factor, log_d = np.log10(class_factors(table, mass, all_d)), float(np.log10(all_d))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                row = part.select([*TOKENS, "classes", "counts"]).to_pylist()[0]
                codes, sizes, _ = tokens_of(row)
                c, n = np.frombuffer(row["classes"], np.uint8).astype(np.int64), np.frombuffer(row["counts"], "<i8")
                at = np.repeat(np.arange(len(sizes)), sizes)
                base = np.bincount(at, np.log10(n + 0.5)[codes], len(sizes)) - sizes * log_d
                more = np.bincount(at, log_factor[c[contexts(codes, sizes)], c[codes]], len(sizes))
                known = np.bincount(at, (n > 0)[codes], len(sizes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row["training"], pa.bool_()), part.column(0).flatten(), pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(np.full(len(sizes), total)), pa.array(base), pa.array(base + more)], names=["training", "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return written(kept.mapInArrow(score, f"training boolean, doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "brown-scores", AT_ONCE)


def packed(keys: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, n = (np.concatenate(x) for x in zip(*keys))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def summed_table(pairs: DataFrame, classes: int) -> np.ndarray:
    """``pairs(pair, n)`` of numbered cells, added up: a square table."""
    got = written(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "brown-pairs", AT_ONCE).toArrow()
    out = np.zeros(classes * classes)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(classes, classes)
