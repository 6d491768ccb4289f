"""Token ids of whole texts by the tokenizers library, each distinct run of non-blanks encoded once while it is kept."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import worker_cache

#: Runs that one process keeps, some 30 bytes each; beyond it the store starts anew, which changes no result.
KEPT_RUNS = 1_000_000
#: Lower-case Latin letters that every normaliser leaves alone, and ASCII marks but apostrophes behind them.
PAIR = np.dtype([("high", "<u8"), ("low", "<u8")])
PLAIN = re.compile(r"([a-zß-öø-įı-ňŊ-ž]+)([!-&(-/:-@\[-`{-~]*)")


class Store:
    """Ids of runs by 128-bit hash, in sorted arrays: a tenth of a dict's memory."""

    def __init__(self) -> None:
        self.key = np.zeros(0, PAIR)
        self.first, self.size, self.blob = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, whether found) of hashes; both halves count, so runs that share one are told apart."""
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key["high"], key["high"]), len(self.key) - 1)
        # Keys with the same upper half stand side by side; step to the one with the lower half.
        while True:
            on = (self.key["high"][at] == key["high"]) & (self.key["low"][at] < key["low"]) & (at + 1 < len(self.key))
            on[on] = self.key["high"][at[on] + 1] == key["high"][on]
            if not on.any():
                return at, self.key[at] == key
            at = at + on

    def add(self, key: np.ndarray, values: list[bytes]) -> None:
        size = np.fromiter(map(len, values), np.int32, len(values)) // 4
        first = np.cumsum(size, dtype=np.int64) - size + len(self.blob)
        both = np.concatenate((self.key, key))
        order = np.lexsort((both["low"], both["high"]))
        self.key, self.first, self.size = both[order], np.concatenate((self.first, first))[order], np.concatenate((self.size, size))[order]
        self.blob = np.concatenate((self.blob, np.frombuffer(b"".join(values), "<u4")))


def splits_by_blanks(path: str) -> bool:
    """Whether a tokenizer file lower-cases, drops white space and puts an end on words, so that runs between blanks are encoded each by itself."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    text = lambda part: json.dumps(spec.get(part) or {})
    return spec["model"].get("type") == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>" and "Lowercase" in text("normalizer") and "\\\\s+" in text("pre_tokenizer") + text("normalizer")


class Encoder:
    """Encodes texts with a tokenizer file; one that lower-cases, drops white space, and splits words from marks goes run by run.

    With such a tokenizer a text has the ids of its runs between blanks one after another, whatever the
    case of A-Z, and a run of letters with marks behind has those of the letters, then
    those of the marks (checked against whole texts in the tests). New words are encoded many at a time, as one text, whose
    words the end-of-word tokens tell apart. Texts that may hold special tokens are encoded whole, and all texts are with other tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        kept = worker_cache().setdefault(("tokenizer", path), {})
        if not kept:
            kept["tokenizer"] = Tokenizer.from_file(path)
            vocabulary = kept["tokenizer"].get_vocab(with_added_tokens=True)
            ends = np.zeros(max(vocabulary.values()) + 1, bool)
            ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
            kept["ends"], kept["store"], kept["by_runs"] = ends, Store(), splits_by_blanks(path)
        self.tokenizer, self.ends, self.store, self.by_runs = kept["tokenizer"], kept["ends"], kept["store"], kept["by_runs"]

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain letters."""
        out: list[bytes] = []
        for at in range(0, len(words), 5000):
            part = words[at:at + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part) and cut[-1:] == len(ids):
                raw, edge = ids.tobytes(), (cut * 4).tolist()
                out += [raw[a:b] for a, b in zip([0, *edge], edge)]
            else:
                out += self._alone(part)
        return out

    def _ids(self, runs: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(runs), 30_000):
            part = [r.decode() for r in runs[at:at + 30_000]]
            found = [PLAIN.fullmatch(r.lower()) for r in part]
            names = list({m[1] for m in found if m})
            cores = dict(zip(names, self._words(names)))
            names = list({m[2] for m in found if m})
            marks = dict(zip(names, self._alone(names)))
            other = [r for r, m in zip(part, found) if not m]
            rest = iter(self._alone(other))
            out += [cores[m[1]] + marks[m[2]] if m else next(rest) for m in found]
        return out

    def encode(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids per text, ``end`` last; a null text is an empty one."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_runs:
            last = np.array([end], "<u4").tobytes()
            return [np.frombuffer(x + last, "<u4") for x in self._alone(texts.to_pylist())]
        special = pc.match_substring(texts, "<|")
        plain = pc.if_else(special, pa.scalar("", pa.large_string()), texts)
        lists = pc.split_pattern(pc.replace_substring(pc.ascii_lower(plain), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.cast(pa.large_binary()).to_pylist()
        key = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, names)), PAIR)
        _, known = self.store.find(key)
        new = np.flatnonzero(~known)
        if len(self.store.key) + len(new) > KEPT_RUNS:
            self.store.__init__()
            new = np.arange(len(names))
        self.store.add(key[new], self._ids([names[i] for i in new.tolist()]))
        at, found = self.store.find(key)
        if not found.all():
            raise RuntimeError("a run is missing from the store")
        first, size, blob = self.store.first[at], self.store.size[at], self.store.blob
        runs, edge = coded.indices.to_numpy(), lists.offsets.to_numpy()
        edge = edge - edge[0]
        at = np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist()
        whole = dict(zip(at, self._alone(texts.take(pa.array(at, pa.int64())).to_pylist())))
        del texts, plain, lists, names
        out = []
        for i in range(len(edge) - 1):
            own = runs[edge[i]:edge[i + 1]]
            n = size[own]
            before = np.cumsum(n, dtype=np.int64)
            total = int(before[-1]) if len(before) else 0
            ids = np.empty(total + 1, "<u4")
            ids[:-1] = blob[np.repeat(first[own] - before + n, n) + np.arange(total)]
            ids[-1] = end
            out.append(np.frombuffer(whole[i] + ids[-1:].tobytes(), "<u4") if i in whole else ids)
        return out


def vocabulary_path(path: str | None = None) -> str:
    """``path``, or the 49k word BPE of the installed public vocabularies, found where the task runs."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
