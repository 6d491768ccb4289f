"""Token counts by a tokenizer compiled into a deterministic transducer.

A tokenizer that normalises characters, splits texts into pieces and merges each piece's bytes (BPE with word ends)
is turned into one transducer over characters. BPE is local: a sequence of tokens is the right one exactly
where each pair of neighbours is what BPE makes of those two tokens' bytes. So each prefix of a piece has
one last token, and what may still happen depends on a bounded past: a state holds, for every beginning of a token that the piece
now ends in, where in the tree of tokens it stands, the last token in front of it, and how many tokens fewer that
prefix had. Reading a character leads to one next state and emits the change of the number of tokens (0 or below where
tokens join); a state's final output is what the end of the piece changes. Splitting into pieces (letters, single
numbers, all else, contractions behind an apostrophe) has states of its own, so white space leads to the start state from anywhere.
States and transitions are determinised as texts reach them and kept by the Python process, in a hash table of arrays;
beyond ``KEPT_STATES`` it starts anew, which changes no result. Classes and normal forms of characters come from the tokenizer itself.

Counting: the texts of an Arrow batch stand one behind another, each with an end mark, and are cut into chunks of
``CHUNK`` characters whatever the texts' lengths. A chunk's state map is tabulated where its left context leads: all chunks read
the ``WARM_UP`` characters before them from the start state, then themselves, in lockstep. The scan composes neighbouring
maps: where the state at the end of a chunk is not the one its right neighbour began with, the neighbour's map
is tabulated at the right state, until all maps meet; then all states are those of one reader from the first character on. Prefix sums
of the emitted counts, taken at the end marks, are the texts' numbers of tokens. So one very long text is as many chunks as short ones are.

Defined cases: a null or empty text has no tokens and no bytes; strings of added tokens inside a text are one token each, as in the library's
default; repeated rows and null ids are counted like any others; an empty table gives an empty result; other
columns go through untouched, new columns whose names are taken get underscores in front.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, worker_cache
from .encoding import vocabulary_path

#: Characters of a chunk, and of what is read before it.
CHUNK, WARM_UP = 128, 32
#: States that a process keeps (some 500 bytes each).
KEPT_STATES = 300_000
#: Symbols that are no characters: the end of a text, an added token.
END, ADDED = 0x110000, 0x110001
#: Characters that normal form C leaves alone whatever stands beside them in a text of such characters only: below the combining marks, and common marks.
INERT = re.compile("[\x00-ɏ‐-‧€]*")
#: Characters of texts that are counted together.
BATCH_CHARS = 1 << 20


def byte_letters() -> dict[str, int]:
    """Byte of each letter that byte-level tokenizers write for it: printable ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge rules: the tree of tokens and which tokens may be neighbours. A byte that ends a piece counts as byte + 256."""

    ROOT = 0

    def __init__(self, model: dict):
        ids, letters, suffix = model["vocab"], byte_letters(), model["end_of_word_suffix"]
        spelled: dict[int, tuple[int, ...]] = {ids[c]: (b,) for c, b in letters.items()} | {ids[c + suffix]: (b + 256,) for c, b in letters.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for n, rule in enumerate(model["merges"]):
            one, two = rule.split(" ") if isinstance(rule, str) else rule
            a, b, made = ids[one], ids[two], ids[one + two]
            self.rank[a, b] = n
            self.parts.setdefault(made, (a, b))
            spelled.setdefault(made, spelled[a] + spelled[b])
        self.child: dict[int, int] = {}
        self.token: dict[int, int] = {}
        self.inner: set[int] = set()
        self.rights: dict[int, list] = {}
        self.lefts: dict[int, list] = {}
        self.kept: dict[tuple[int, int], bool] = {}
        for t in (t for t in spelled if self.alone(t)):
            node = self.ROOT
            for b in spelled[t]:
                self.inner.add(node)
                node = self.child.setdefault(node << 9 | b, len(self.child) + 1)
            self.token[node] = t

    def spine(self, t: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge of ``t`` while it is made, each with the rank of the rule that ends it."""
        kept = self.lefts if side == 0 else self.rights
        if t not in kept:
            out, end = [], float("inf")
            x = t
            while True:
                out.append((x, end))
                if x not in self.parts:
                    break
                end, x = self.rank[self.parts[x]], self.parts[x][side]
            kept[t] = out
        return kept[t]

    def crossed(self, a: int, b: int, skip: tuple | None = None) -> bool:
        """Whether a rule joins something across the border of two tokens before both are whole. Of equal ranks the left one comes first."""
        for x, end_x in self.spine(a, 1):
            for y, end_y in self.spine(b, 0):
                r = self.rank.get((x, y))
                if r is not None and (x, y) != skip and r < end_x and r <= end_y:
                    return True
        return False

    def alone(self, t: int) -> bool:
        """Whether BPE makes ``t`` of its own bytes."""
        if t not in self.parts:
            return True
        a, b = self.parts[t]
        return self.fits(a, b, (a, b)) and self.alone(a) and self.alone(b)

    def fits(self, a: int, b: int, skip: tuple | None = None) -> bool:
        key = (a, b) if skip is None else (a, ~b)
        if key not in self.kept:
            if len(self.kept) > 2_000_000:
                self.kept.clear()
            self.kept[key] = not self.crossed(a, b, skip)
        return self.kept[key]


class Transducer:
    """States by number; ``step`` reads one symbol for many readers at once."""

    START, APOSTROPHE = 0, 1

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("type") != "BPE" or not model.get("end_of_word_suffix") or model.get("unk_token") or model.get("dropout") or "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" not in json.dumps(spec["pre_tokenizer"]):
            raise ValueError("only byte-level BPE with word ends, split into letters, single numbers and all else, can be compiled")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that are looked for in normalised texts, or take blanks along, cannot be compiled")
        self.library = Tokenizer.from_file(path)
        self.merges = Merges(model)
        self.added = re.compile("|".join(sorted((re.escape(t["content"]) for t in spec["added_tokens"]), key=len, reverse=True)) or r"(?!)")
        self.contractions = {s: None for s in re.findall(r"'(\w+)\|", json.dumps(spec["pre_tokenizer"]))}
        self.classes: dict[str, str] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [("start",), ("apostrophe", "")]
        self.number = {s: i for i, s in enumerate(self.states)}
        self._table(16)

    def _table(self, bits: int) -> None:
        self.bits, self.filled = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.next, self.out = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int16)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or the empty slot where it belongs."""
        mask = (1 << self.bits) - 1
        at = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.keys[at]
        off = np.flatnonzero((got != keys) & (got >= 0))
        while len(off):
            at[off] = (at[off] + 1) & mask
            got = self.keys[at[off]]
            off = off[(got != keys[off]) & (got >= 0)]
        return at

    def _insert(self, keys: np.ndarray, after: np.ndarray, out: np.ndarray) -> None:
        if (self.filled + len(keys)) * 3 > 1 << self.bits:
            held = self.keys >= 0
            old = self.keys[held], self.next[held], self.out[held]
            self._table(max(self.bits + 1, int(self.filled + len(keys)).bit_length() + 2))
            self._insert(*old)
        left = np.arange(len(keys))
        while len(left):
            at = self._place(keys[left])
            # Of new keys that fall on one slot, one gets it; the others look again.
            _, first = np.unique(at, return_index=True)
            self.keys[at[first]], self.next[at[first]], self.out[at[first]] = keys[left[first]], after[left[first]], out[left[first]]
            left = np.delete(left, first)
        self.filled += len(keys)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = state.astype(np.int64) << 21 | symbol
        at = self._place(key)
        new = self.keys[at] < 0
        if new.any():
            fresh = np.unique(key[new])
            made = [self.compiled(k >> 21, k & 0x1FFFFF) for k in fresh.tolist()]
            self._insert(fresh, np.array([q for q, _ in made], np.int32), np.array([n for _, n in made], np.int16))
            at = self._place(key)
        return self.next[at], self.out[at]

    # ------------------------------------------------ compiling one transition

    def _name(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
        return self.number[state]

    def class_of(self, char: str) -> str:
        """What the tokenizer takes a normalised character for."""
        if char not in self.classes:
            cut = self.library.pre_tokenizer.pre_tokenize_str
            self.classes[char] = "space" if not cut(char) else "letter" if len(cut("a" + char)) == 1 else "number" if len(cut(char + char)) == 2 else "other"
        return self.classes[char]

    def compiled(self, state: int, symbol: int) -> tuple[int, int]:
        if symbol >= END:
            return self.START, self._over(state) + (symbol == ADDED)
        total = 0
        for char in self.library.normalizer.normalize_str(chr(symbol)):
            state, n = self._read(state, char)
            total += n
        return state, total

    def _over(self, state: int) -> int:
        """What the end of a piece adds in this state."""
        kind = self.states[state]
        if kind[0] == "word":
            return kind[3]
        if kind[0] == "apostrophe":
            return sum(self._whole(x) for x in ("'", kind[1]) if x)
        return 0

    def _whole(self, piece: str) -> int:
        items, total, end = ((Merges.ROOT, None, 0),), 0, 0
        for b in piece.encode():
            items, n, end = self._byte(items, b)
            total += n
        return total + end

    def _read(self, state: int, char: str) -> tuple[int, int]:
        kind, sort = self.states[state], self.class_of(char)
        if kind[0] == "apostrophe":
            tail = kind[1] + char
            if tail in self.contractions:
                return self.START, self._whole("'" + tail)
            if any(c.startswith(tail) for c in self.contractions):
                return self._name(("apostrophe", tail)), 0
            if not kind[1] and sort == "other":
                word, n = self._grown("other", ((Merges.ROOT, None, 0),), "'")
                return self._and(self._read(word, char), n)
            # The apostrophe was a piece of its own, and what stands behind it begins anew.
            q, n = self.START, self._whole("'")
            for c in tail:
                q, more = self._read(q, c)
                n += more
            return q, n
        if kind[0] == "word" and kind[1] == sort:
            return self._grown(sort, kind[2], char)
        n = self._over(state)
        if sort == "space":
            return self.START, n
        if sort == "number":
            return self.START, n + self._whole(char)
        if char == "'" and self.contractions:
            return self.APOSTROPHE, n
        return self._and(self._grown(sort, ((Merges.ROOT, None, 0),), char), n)

    @staticmethod
    def _and(to: tuple[int, int], n: int) -> tuple[int, int]:
        return to[0], to[1] + n

    def _grown(self, sort: str, items: tuple, char: str) -> tuple[int, int]:
        total, end = 0, 0
        for b in char.encode():
            items, n, end = self._byte(items, b)
            total += n
        return self._name(("word", sort, items, end)), total

    def _byte(self, items: tuple, b: int) -> tuple[tuple, int, int]:
        """(items after byte ``b``, change of the number of tokens, change by an end of the piece right behind it)."""
        m = self.merges
        moved, last, n, end = [], None, 0, None
        for node, before, d in items:
            to = m.child.get(node << 9 | b)
            if to is not None:
                t = m.token.get(to)
                if t is not None and last is None and (before is None or m.fits(before, t)):
                    last, n = t, d + 1
                if to in m.inner:
                    moved.append((to, before, d))
            to = m.child.get(node << 9 | b + 256)
            t = m.token.get(to) if to is not None else None
            if t is not None and end is None and (before is None or m.fits(before, t)):
                end = d + 1
        if last is None or end is None:
            raise RuntimeError("no token fits: the merge rules are not local")
        return (*((to, before, d - n) for to, before, d in moved), (Merges.ROOT, last, 0)), n, end - n

    # ------------------------------------------------ counting

    def symbols(self, text: str) -> np.ndarray:
        """The text's symbols: characters, normalised where neighbours matter, and added tokens."""
        parts = []
        for n, piece in enumerate(self.added.split(text)):
            if n:
                parts.append(np.array([ADDED], np.uint32))
            if not INERT.fullmatch(piece):
                piece = self.library.normalizer.normalize_str(piece)
            parts.append(np.frombuffer(piece.encode("utf-32-le"), "<u4"))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def emitted(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens emitted at each symbol by one reader from the first on; the chunks' maps are made side by side."""
        n = -(-len(symbols) // CHUNK)
        grid = np.full((n, CHUNK), END, np.int64)
        grid.reshape(-1)[:len(symbols)] = symbols
        columns = np.ascontiguousarray(grid.T)
        start = np.zeros(n, np.int32)
        for k in range(CHUNK - WARM_UP, CHUNK):
            start[1:], _ = self.step(start[1:], columns[k, :-1])
        end, out = np.empty(n, np.int32), np.empty((CHUNK, n), np.int16)
        todo = np.arange(n)
        while len(todo):
            state = start[todo]
            for k in range(CHUNK):
                state, out[k, todo] = self.step(state, columns[k, todo])
            end[todo] = state
            todo = 1 + np.flatnonzero(start[1:] != end[:-1])
            start[todo] = end[todo - 1]
        return out.T.reshape(-1)[:len(symbols)]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text."""
        if len(self.states) > KEPT_STATES:
            self.reset()
        got, held, size, total = [], [], 0, len(texts)
        for i, text in enumerate(texts):
            held += [self.symbols(text or ""), np.array([END], np.uint32)]
            size += len(held[-2]) + 1
            if size >= BATCH_CHARS or i + 1 == total:
                symbols = np.concatenate(held)
                sums = np.cumsum(self.emitted(symbols), dtype=np.int64)[symbols == END]
                got.append(np.diff(sums, prepend=0))
                held, size = [], 0
        return np.concatenate(got) if got else np.zeros(0, np.int64)


def transducer(path: str) -> Transducer:
    """The process's transducer of a tokenizer file."""
    kept = worker_cache()
    if ("transducer", path) not in kept:
        kept["transducer", path] = Transducer(path)
    return kept["transducer", path]


def count_tokens(docs: DataFrame, text: str = "text", limit: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``."""

    def make():
        machine = transducer(vocabulary_path(vocabulary))

        def compute(texts: list[str | None]) -> tuple:
            n = machine.counts(texts)
            return [len((t or "").encode()) for t in texts], n, n > limit

        return compute

    return add_columns(docs, [text], [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")], make)


def documents_counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return count_tokens(rows).drop("text")
