"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is its words' byte n-grams (with word boundaries), each hashed to a row of an embedding table; the
average of the rows goes through a linear softmax. Table and softmax are trained together by
stochastic gradient descent in NumPy on the driver, on a bounded sample of labelled rows (``sample_rows`` in all, ``per_language``
of a language at most; distinct texts, drawn by hash of id and text, so reruns agree). A part of the sample is held
back to calibrate: a temperature makes the scores probabilities.

A text is rejected where its calibrated score is below ``SURE``, more likely wrong than right, or where it does not look like any
learned language: the softmax must choose one, so the share of the text's n-grams that the sample has is
looked at as well. The floor is ``SLACK`` times the share that all but one in a thousand of the texts held back reach,
and a text's own share is given three standard errors, so short texts are rejected on clear evidence only.

As softmax(W mean(E)) = softmax(mean(E W)), scoring needs only the products E W (one row per hash bucket), and
words are looked up once per task. Whole texts are read.

Defined cases: a null text, or one without any letter, is ``und`` with score 0 and rejected; repeated rows score
alike; languages beyond the ``most_languages`` commonest are not learned (a bound on the model, as each has a column in it);
if no labelled row exists, every text is ``und`` with score 0; an empty table gives an empty
result; other columns go through untouched, and new ones get underscores in front where a name is taken.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, drawn_at_most, hash_share

#: Words kept by one task; beyond it the store starts anew, which changes no result.
KEPT_WORDS = 200_000
#: Least calibrated score, and how far below the usual share of known n-grams a text may be.
SURE, SLACK = 0.5, 0.8
#: Bits of the table of n-grams that the sample has.
GRAM_BITS = 1 << 21
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter; the pattern also takes number signs such as fractions, which are looked at again."""
    m = LETTER.search(text)
    return bool(m) and (m[0].isalpha() or any(map(str.isalpha, text)))


def subwords(word: bytes) -> list[int]:
    """Hashes of a word's 2-, 3- and 4-grams with its boundaries, and of the word itself; hash buckets are their remainders."""
    w = b"<" + word + b">"
    crc = zlib.crc32
    out = [crc(w[i:i + n]) for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    out.append(crc(w, 77))
    return out


def grams(count: int) -> int:
    """How many of so many subwords are 4-grams (they stand behind the shorter ones, before the word)."""
    # A word of m letters with boundaries has m + 1, m and m - 1 grams, and itself.
    return max(0, (count - 1) // 3 - 1)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x languages: what a subword adds to each language's logit
    bias: np.ndarray
    temperature: float
    buckets: int
    known: np.ndarray  # which 4-grams the sample has, packed bits
    floor: float  # least share of them

    def seen(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes % GRAM_BITS
        return (self.known[at >> 3] >> (at & 7).astype(np.uint8)) & 1


def _segments(texts: list[str], labels: np.ndarray, rng: np.random.Generator, each: int) -> tuple[list[list[bytes]], np.ndarray]:
    """Runs of 1 to 80 words from anywhere in the texts, so that short texts are learned too."""
    out, y = [], []
    for text, label in zip(texts, labels):
        words = text.encode().lower().split()
        if not words:
            continue
        for _ in range(each):
            n = int(np.exp(rng.uniform(0, np.log(80))))
            at = int(rng.integers(0, max(1, len(words) - n + 1)))
            out.append(words[at:at + n])
            y.append(label)
    return out, np.array(y, np.int64)


def train(texts: list[str], labels: list[str], buckets: int = 1 << 15, dims: int = 12, epochs: int = 3, rate: float = 0.5, batch: int = 64, seed: int = 5) -> Model | None:
    """Fit on the given rows; one in five is held back for calibration."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    order = rng.permutation(len(texts))
    held, fit = order[:len(order) // 5], order[len(order) // 5:]
    emb = rng.uniform(-1, 1, (buckets, dims)) / dims
    w, bias = np.zeros((dims, len(languages))), np.zeros(len(languages))
    known: dict[bytes, list[int]] = {}

    def bag(words: list[bytes]) -> np.ndarray:
        out: list[int] = []
        for x in words:
            if x not in known:
                known[x] = subwords(x)
            out += known[x]
        return np.array(out, np.int64) % buckets

    segments, sy = _segments([texts[i] for i in fit], y[fit], rng, 2)
    bags = [bag(s) for s in segments]
    # Few rows are gone through more often.
    epochs = max(epochs, -(-600 * batch // max(1, len(bags))))
    steps, step = epochs * -(-len(bags) // batch), 0
    # Languages count alike, however many rows each has.
    share = np.bincount(sy, minlength=len(languages))
    weight = (len(sy) / (len(languages) * np.maximum(share, 1)))[sy]
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            own = order[at:at + batch]
            flat, n = np.concatenate([bags[i] for i in own]), np.array([len(bags[i]) for i in own])
            mean = np.add.reduceat(emb[flat], np.concatenate(([0], np.cumsum(n)[:-1]))) / n[:, None]
            z = mean @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), sy[own]] -= 1
            p *= np.minimum(weight[own], 10)[:, None]
            lr = rate * (1 - step / steps)
            back = p @ w.T
            w -= lr * mean.T @ p / 4
            bias -= lr * p.mean(0)
            np.add.at(emb, flat, np.repeat(-lr * back / n[:, None], n, axis=0) * 8)
            step += 1
    bits = np.zeros(GRAM_BITS, np.uint8)
    for i in fit:
        for x in set(texts[i].encode().lower().split()):
            h = known.get(x) or subwords(x)
            bits[np.array(h[len(h) - 1 - grams(len(h)):-1], np.int64) % GRAM_BITS] = 1
    model = Model(languages, emb @ w, bias, 1.0, buckets, np.packbits(bits, bitorder="little"), 0.0)
    if not len(held):
        return model
    # Calibration: on whole texts and on short runs of the rows held back.
    short, ty = _segments([texts[i] for i in held], y[held], rng, 1)
    whole = [texts[i].encode().lower().split() for i in held]
    bags = [bag(s) for s in [*short, *whole] if s]
    ty = np.concatenate((ty, np.array([y[i] for i, s in zip(held, whole) if s], np.int64)))
    z = np.stack([model.scores[b].mean(0) for b in bags]) + bias
    rows = np.arange(len(z))

    def loss(t: float) -> float:
        s = z / t
        m = s.max(1, keepdims=True)
        return float((np.log(np.exp(s - m).sum(1)) + m[:, 0] - s[rows, ty]).mean())

    model.temperature = float(min(np.exp(np.linspace(np.log(0.01), np.log(20), 250)), key=loss))
    shares = []
    for words in whole:
        h = [subwords(x) for x in words]
        flat = np.array([v for x in h for v in x[len(x) - 1 - grams(len(x)):-1]], np.int64)
        if len(flat) >= 100:
            shares.append(float(model.seen(flat).mean()))
    model.floor = SLACK * float(np.quantile(shares, 0.001)) if shares else 0.0
    return model


def fit_sample(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 1200, sample_rows: int = 60_000, most_languages: int = 1000) -> Model | None:
    """Train on a bounded sample of the rows where ``usable`` and a label is there. More labels than ``most_languages``, which bounds the model, are an error: none is left out."""
    rows = docs.filter(F.coalesce(usable, F.lit(False)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages + 1).collect()}
    if not counts:
        return None
    if len(counts) > most_languages:
        raise ValueError(f"there are more than {most_languages} languages; most_languages may allow for them")
    each = max(1, min(per_language, sample_rows // len(counts)))
    wanted = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))))
    drawn = drawn_at_most(rows.filter(hash_share("doc_id", "text") < wanted[F.col("lang")]), 2 * sample_rows, "langid-sample").orderBy("doc_id", "text").toArrow()
    return train(drawn.column("text").to_pylist(), drawn.column("lang").to_pylist())


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` as further columns."""

    def make() -> Callable:
        if model is None:
            return lambda texts: (["und"] * len(texts), np.zeros(len(texts)), [True] * len(texts))
        place: dict[bytes, int] = {}
        # Sums of logits, subwords, 4-grams, and those of them that are known.
        table = np.zeros((KEPT_WORDS, len(model.languages) + 3))

        def add(words: list[bytes]) -> None:
            bags = [subwords(w) for w in words]
            n = np.fromiter(map(len, bags), np.int64, len(bags))
            flat = np.fromiter((i for b in bags for i in b), np.int64, int(n.sum()))
            at, first, last = len(place), np.cumsum(n) - n, np.cumsum(n) - 1
            four = np.maximum(0, (n - 1) // 3 - 1)
            table[at:at + len(words), :-3] = np.add.reduceat(model.scores[flat % model.buckets], first)
            known = np.concatenate(([0], np.cumsum(model.seen(flat), dtype=np.int64)))
            table[at:at + len(words), -3:] = np.column_stack((n, four, known[last] - known[last - four]))
            place.update(zip(words, range(at, at + len(words))))

        def total(words: list[bytes]) -> np.ndarray:
            out = np.zeros(len(model.languages) + 3)
            step = min(50_000, KEPT_WORDS)
            for at in range(0, len(words), step):
                part = words[at:at + step]
                new = set(part).difference(place)
                if len(place) + len(new) > KEPT_WORDS:
                    place.clear()
                    new = set(part)
                if new:
                    add(list(new))
                out += table[np.fromiter(map(place.__getitem__, part), np.int64, len(part))].sum(0)
            return out

        def compute(texts: list[str | None]) -> tuple:
            lang, score, rejected = [], np.zeros(len(texts)), []
            split = [t.encode().lower().split() if t and has_letter(t) else None for t in texts]
            for k, words in enumerate(split):
                if k % 100 == 0:
                    # New words of a hundred texts are hashed together.
                    new = {w for s in split[k:k + 100] if s for w in s}.difference(place)
                    if len(new) <= KEPT_WORDS:
                        if len(new) + len(place) > KEPT_WORDS:
                            place.clear()
                            new = {w for s in split[k:k + 100] if s for w in s}
                        if 0 < len(new) <= KEPT_WORDS:
                            add(list(new))
                if words is None:
                    lang.append("und")
                    rejected.append(True)
                    continue
                got = total(words)
                z = (got[:-3] / got[-3] + model.bias) / model.temperature
                p = np.exp(z - z.max())
                best = int(p.argmax())
                lang.append(model.languages[best])
                score[k] = p[best] / p.sum()
                share = got[-1] / max(got[-2], 1.0)
                near = share + 3 * np.sqrt(max(share * (1 - share), 1 / max(got[-2], 1.0)) / max(got[-2], 1.0))
                rejected.append(bool(score[k] < SURE or near < model.floor))
            return lang, score, rejected

        return compute

    return add_columns(docs, [text], [("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")], make)
