"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Tokenizer A is a byte-level BPE that reads a blank and the text, B a sentencepiece model that puts the blank there itself. Both
sequences cover the same bytes, so a batch of documents is one string of bytes to both: tokens are laid end to end, documents begin at
offsets in it, and ends of tokens are running sums of their lengths. The ends of A and of B are counted by byte, once for the
whole batch. Where both end, the sequences are cut into groups; where either ends, the tokens of A and B that lie there overlap, and that
byte stands for their link. Running sums of the counts number tokens, groups and links, and their
values at the documents' last bytes give each document's own numbers.

Counts over the corpus: how often two ids are linked is counted by block (some ``BLOCK_BYTES`` of text), each block's distinct pairs are
added up over the cluster, and the sums go back to the blocks as one row for each distinct pair of a block. Documents
hold places in their block's list of pairs, so no link is shuffled, and a pair that is everywhere has a row a block.
The highest count of an id of B is a table of at most B's vocabulary, the only one broadcast. Blocks lie in the shared folder between the two passes.

Defined cases: texts that are null or empty, or whose tokens do not give back the bytes of a blank and the text (a character that B normalises or
that stands for a blank in it), have no tokens, zeros and an empty digest; strings of special tokens are plain text; repeated rows and null
ids are documents of their own; an empty table gives an empty result; other columns are not read. Very long texts are handled whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, worker_cache, written
from .encoding import KEPT_RUNS, PAIR, Store
from .transducer import byte_letters

#: A blank between characters that are no white space: no token of either kind goes over it, so what stands on both sides is encoded apart.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: In place of a run's tokens where they do not give its bytes.
NOT_ITS_BYTES = 0xFFFFFFFF

#: Bytes of text that are encoded and cut at a time; bytes of text, and documents, of a block.
PART_BYTES, BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 8 << 20, 10_000
#: Distinct pairs in one row of the written table.
ROW_PAIRS = 4096

DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
WRITTEN = f"block long, {DOCUMENT}, places binary, times binary, first long, pairs array<long>, links array<long>"


class Pair:
    """The two tokenizers, and the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        letters = byte_letters()
        with open(a, encoding="utf-8") as f:
            names = json.load(f)["model"]["vocab"]
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(letters[c] for c in name)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        # Pieces have blanks at their beginning only, and A cuts texts in front of a blank before a word: then runs are encoded each by itself.
        with open(a, encoding="utf-8") as f:
            cut = json.load(f)["pre_tokenizer"]
        self.by_runs = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.store = Store()
        # Spelled ids: one followed by a comma, one that is its side's last of a group.
        self.spelled = np.array([s for n, end in ((len(self.bytes_a), b"|"), (len(self.bytes_b), b";")) for s in (*(b"%d," % i for i in range(n)), *(b"%d" % i + end for i in range(n)))], object)

    def _piece(self, i: int) -> bytes:
        name = self.b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Both sequences of ids of each text, empty where either doesn't give the text's bytes."""
        own = [t or "" for t in texts]
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in own], add_special_tokens=False)]
        b = self.b.encode(own, num_threads=1)
        for i, t in enumerate(own):
            whole = (" " + t).encode()
            if not t or b"".join(map(self.bytes_a.__getitem__, a[i])) != whole or b"".join(map(self.bytes_b.__getitem__, b[i])) != whole:
                a[i], b[i] = [], []
        return a, b


    def _values(self, runs: list[str]) -> list[bytes]:
        """Of each run the number of A's ids, those, and B's."""
        out = []
        for at in range(0, len(runs), 20_000):
            for run, a, b in zip(runs[at:at + 20_000], *self.tokens(runs[at:at + 20_000])):
                out.append(np.array([len(a), *a, *b] if a or not run else [NOT_ITS_BYTES], "<u4").tobytes())
        return out

    def encoded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A of all texts, how many each text has, and the same of B; each distinct run is encoded once while it is kept."""
        parts = [BETWEEN.split(t) if self.by_runs else [t] for t in (t or "" for t in texts)]
        coded = pa.array([r for x in parts for r in x], pa.large_string()).dictionary_encode()
        names, run = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        key = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, names.cast(pa.large_binary()).to_pylist())), PAIR)
        _, known = self.store.find(key)
        new = np.flatnonzero(~known)
        if len(self.store.key) + len(new) > KEPT_RUNS:
            self.store.__init__()
            new = np.arange(len(names))
        self.store.add(key[new], self._values(names.take(pa.array(new)).to_pylist()))
        at, _ = self.store.find(key)
        first, size, blob = self.store.first[at], self.store.size[at].astype(np.int64), self.store.blob
        n_a = blob[first].astype(np.int64)
        wrong = n_a == NOT_ITS_BYTES
        n_a[wrong] = 0
        n_b = np.where(wrong, 0, size - 1 - n_a)
        edge = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        # A text of which one run is wrong has no tokens at all.
        bad = np.diff(np.concatenate(([0], np.cumsum(wrong[run])))[edge]) > 0
        run = run[~np.repeat(bad, np.diff(edge))]
        edge = np.concatenate(([0], np.cumsum(np.where(bad, 0, np.diff(edge)))))
        out = []
        for begin, n in ((first + 1, n_a), (first + 1 + n_a, n_b)):
            own = n[run]
            upto = np.cumsum(own)
            total = int(upto[-1]) if len(upto) else 0
            out += [blob[np.repeat(begin[run] - upto + own, own) + np.arange(total)].astype(np.int64), np.diff(np.concatenate(([0], upto))[edge])]
        return tuple(out)


def by_document(counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sum of ``counts`` (one value a byte) between documents' offsets, from one running sum."""
    sums = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    return np.diff(sums[before])


def align(pair: Pair, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> dict:
    """A batch's documents (ids of all, and how many each has): groups, links as (id of A, id of B) in order, and the digest of each document's groups."""
    end_a, end_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
    total = int(end_a[-1]) if len(end_a) else 0
    # Where each document's bytes begin: behind those of all tokens before.
    before = np.concatenate(([0], end_a))[np.concatenate(([0], np.cumsum(n_a)))]
    ends_a, ends_b = np.bincount(end_a - 1, minlength=total), np.bincount(end_b - 1, minlength=total)
    cut = (ends_a > 0) & (ends_b > 0)
    either = np.flatnonzero(ends_a + ends_b)
    # Tokens that ended before a byte number the token that lies there.
    passed_a, passed_b = np.cumsum(ends_a)[either] - ends_a[either], np.cumsum(ends_b)[either] - ends_b[either]
    passed = np.cumsum(cut)
    group_a, group_b = passed[end_a - 1] - cut[end_a - 1], passed[end_b - 1] - cut[end_b - 1]
    return {"n_a": n_a, "n_b": n_b, "n_groups": by_document(cut, before), "n_links": by_document(ends_a + ends_b > 0, before), "links": a[passed_a] << 32 | b[passed_b], "digests": digests(pair, a, b, n_a, n_b, group_a, group_b)}


def digests(pair: Pair, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups written out."""
    groups = int(group_a[-1]) + 1 if len(group_a) else 0
    upto_a, upto_b = np.cumsum(np.bincount(group_a, minlength=groups)), np.cumsum(np.bincount(group_b, minlength=groups))
    # In the written order a token of A stands behind B's tokens of the groups before, one of B behind A's of its own as well.
    order = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True)[:len(a)], np.append(group_b[1:] != group_b[:-1], True)[:len(b)]
    order[np.arange(len(a)) + np.concatenate(([0], upto_b))[group_a]] = a + last_a * len(pair.bytes_a)
    order[np.arange(len(b)) + upto_a[group_b]] = 2 * len(pair.bytes_a) + b + last_b * len(pair.bytes_b)
    words = pair.spelled[order].tolist()
    out, at = [], 0
    for n in (n_a + n_b).tolist():
        out.append(hashlib.sha256(b"".join(words[at:at + n])[:-1]).hexdigest() if n else "")
        at += n
    return out


def blocks_of(docs: DataFrame, a: str | None, b: str | None) -> DataFrame:
    """First pass: documents with the places of their pairs, and the pairs of each block with their number of links."""
    spark_names = [x.strip().split()[0] for x in WRITTEN.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = both(a, b), TaskContext.get().partitionId() << 32

        def made(block: int, ids: list, parts: list[dict]) -> Iterator[pa.RecordBatch]:
            n = {k: np.concatenate([p[k] for p in parts]) for k in ("n_a", "n_b", "n_groups", "n_links", "links")}
            pairs, place = np.unique(n["links"], return_inverse=True)
            own = np.repeat(np.arange(len(ids)), n["n_links"]) * len(pairs) + place
            own, times = np.unique(own, return_counts=True)
            edge = np.searchsorted(own, np.arange(len(ids) + 1) * len(pairs)).tolist()
            place = (own % max(len(pairs), 1)).astype("<u4")
            times = times.astype("<u4")
            digest = [d for p in parts for d in p["digests"]]
            for at in range(0, len(ids), 500):
                to = min(at + 500, len(ids))
                columns = [[block] * (to - at), ids[at:to], *(n[k][at:to] for k in ("n_a", "n_b", "n_groups", "n_links")), digest[at:to], *([x[edge[i]:edge[i + 1]].tobytes() for i in range(at, to)] for x in (place, times)), *[[None] * (to - at)] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=spark_names)
            links = np.bincount(np.searchsorted(pairs, n["links"]), minlength=len(pairs))
            for at in range(0, len(pairs), ROW_PAIRS):
                columns = [[block], *[[None]] * 8, [at], [pairs[at:at + ROW_PAIRS]], [links[at:at + ROW_PAIRS]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=spark_names)

        ids, parts, size = [], [], 0
        for batch in batches:
            for piece in bounded(batch, 1):
                names, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                at = 0
                while at < len(texts):
                    to, n = at, 0
                    while to < len(texts) and n < PART_BYTES:
                        n += len(texts[to] or "")
                        to += 1
                    parts.append(align(pair, *pair.encoded(texts[at:to])))
                    ids += names[at:to]
                    size += n
                    at = to
                    if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                        yield from made(number, ids, parts)
                        number += 1
                        ids, parts, size = [], [], 0
        if ids:
            yield from made(number, ids, parts)

    return docs.mapInArrow(run, WRITTEN)


def both(a: str | None, b: str | None) -> Pair:
    """The process's pair of tokenizers; without paths those of the installed public vocabularies, found where the task runs."""
    kept = worker_cache()
    if ("alignment", a, b) not in kept:
        import public_tokenizers

        kept["alignment", a, b] = Pair(a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model"))
    return kept["alignment", a, b]


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pair, count, best)`` over the corpus, and each block's own pairs ``(block, place, pair)``."""
    listed = blocks.filter("pairs IS NOT NULL").select("block", "first", F.posexplode(F.arrays_zip("pairs", "links")).alias("n", "p"))
    rows = listed.select("block", (F.col("first") + F.col("n")).alias("place"), F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    counts = rows.groupBy("pair").agg(F.sum("links").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    # One row an id of B, so no more than its vocabulary has.
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(best), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), rows.drop("links")


def align_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """One row per document: numbers of tokens, groups and links, digest of its groups, ``n_best``, ``count_sum``."""
    blocks = written(blocks_of(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), a, b), "aligned")
    counts, own = pair_counts(blocks)
    names = [x.split()[0] for x in DOCUMENT.split(", ")]
    known = own.join(counts, "pair").select("block", "place", "count", "best", *(F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in DOCUMENT.split(", "))), *(F.lit(None).cast("binary").alias(n) for n in ("places", "times")))
    said = blocks.filter("pairs IS NULL").select("block", *(F.lit(None).cast(t).alias(n) for n, t in (("place", "long"), ("count", "long"), ("best", "boolean"))), *names, "places", "times")
    # A block's counts come before its documents, in the order of their places.
    rows = known.unionByName(said).withColumn("later", F.col("place").isNull()).repartition("block").sortWithinPartitions("block", "later", "place")
    kinds = [pa.int64()] * 5 + [pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        table = np.zeros((2, 0), np.int64)
        for batch in batches:
            number, later = batch.column("block").to_numpy(), batch.column("later").to_numpy(zero_copy_only=False)
            edge = [0, *(1 + np.flatnonzero((number[1:] != number[:-1]) | (later[1:] != later[:-1]))).tolist(), batch.num_rows]
            for at, to in zip(edge, edge[1:]):
                if at == to:
                    continue
                part = batch.slice(at, to - at)
                if number[at] != block:
                    block, held, table = number[at], [], np.zeros((2, 0), np.int64)
                if not later[at]:
                    held.append(np.stack((part.column("count").to_numpy(), part.column("best").to_numpy(zero_copy_only=False).astype(np.int64))))
                    continue
                if held:
                    table, held = np.concatenate(held, axis=1), []
                raw = part.column("places").to_pylist()
                place, times = (np.frombuffer(b"".join(x), "<u4") for x in (raw, part.column("times").to_pylist()))
                edges = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raw])))
                sums = [np.diff(np.concatenate(([0], np.cumsum(row[place] * times)))[edges]) for row in table] if len(place) else [np.zeros(len(raw), np.int64)] * 2
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(sums[1], pa.int64()), pa.array(sums[0], pa.int64())], names=[*names, "n_best", "count_sum"])

    return rows.mapInArrow(run, f"{DOCUMENT}, n_best long, count_sum long")
