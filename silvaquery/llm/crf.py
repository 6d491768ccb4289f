"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given for documents; the field needs them for tokens. So tokens are labelled first: from a bounded sample
of labelled rows, a greedy cover picks the fewest word shapes (a whole word, its beginning, or its end) that
stand in the toxic documents and next to never in the others; a token of a toxic document with such
a shape is labelled toxic. The field (two states, weights for a word's shapes, its own and its neighbour's state) is
fitted to runs of tokens around those and to runs from clean documents, by gradient
ascent in NumPy on the driver. Forward-backward marginals give each token's chance of being
toxic; a document's largest and its summed chances go into a small logistic model, fitted on sampled rows
the field has not seen, which gives the score. Offsets are code points of runs of tokens whose chance is at least 0.5.

Whole texts are scored in one chain. Forward and backward passes go over fixed-length pieces first, whose 2 x 2
products are then chained, which gives the same marginals as token after token.

Defined cases: a null or empty text, or one without words, gets the score that the logistic model gives to no evidence and
no spans; without labelled rows of both kinds every score is the share of toxic labels (0 without any);
of several labels for one doc_id the largest counts; repeated rows score alike; an empty table gives an empty
result; other columns go through, and new ones get underscores in front where a name is taken.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, drawn_at_most, hash_share

#: Words kept by one task; beyond it the store starts anew, which changes no result.
KEPT_WORDS = 200_000
#: Rows of each label expected in the sample that the model is fitted on.
TOXIC_ROWS, CLEAN_ROWS = 1500, 3000
BUCKETS = 1 << 17
MARKS = ".,;:!?\"'()[]{}*#$%&|-_<>=+~`/\\".encode()
PIECE = 64
#: Most features of a word: bias, itself, six beginnings, three ends.
FEATURES = 11


def core(word: bytes) -> bytes:
    """A word without marks around it, lower-cased as Unicode does."""
    return word.strip(MARKS).decode(errors="replace").lower().encode()


def shapes(word: bytes) -> list[str]:
    """The word, its beginnings of 3 to 8 letters and its ends of 4 to 6."""
    w = core(word).decode(errors="replace")
    return ["=" + w] + ["^" + w[:n] for n in range(3, 9) if len(w) > n] + ["$" + w[-n:] for n in (4, 5, 6) if len(w) > n]


def features(word: bytes) -> list[int]:
    return [0] + [1 + zlib.crc32(s.encode()) % (BUCKETS - 1) for s in shapes(word)]


@dataclass
class Model:
    weights: np.ndarray  # of toxic against not, by feature
    trans: np.ndarray  # [from, to], logs
    logistic: np.ndarray  # bias, largest chance (logit), log of 1 + summed chances, log of 1 + words
    prior: float


class ShapeStore(dict):
    """Shapes of words, worked out when asked for; starts anew when it holds many, so the driver's memory stays small."""

    def __missing__(self, word: bytes) -> list[str]:
        if len(self) > 20_000:
            self.clear()
        self[word] = out = shapes(word)
        return out


def shape_counts(words: list[bytes], known: ShapeStore) -> Counter:
    """How many of a text's words have each shape."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        for s in known[w]:
            out[s] += n
    return out


def toxic_shapes(toxic: list[list[bytes]], clean: list[list[bytes]], purity: float = 0.98, least: int = 3) -> dict[str, int]:
    """Greedy cover of toxic documents by shapes that clean ones do not have, or do not have so often.

    Gives each chosen shape with how many words of a document must have it (1 to 3) for it to tell.
    """
    known = ShapeStore()
    # Most shapes stand in fewer documents than count; hashed numbers of documents tell which may have enough.
    slots = 1 << 22
    often = np.zeros(slots, np.int32)
    for words in toxic:
        often[np.unique(np.fromiter((zlib.crc32(s.encode()) % slots for w in set(words) for s in known[w]), np.int64))] += 1
    where: dict[tuple[str, int], set[int]] = defaultdict(set)
    for i, words in enumerate(toxic):
        for s, n in shape_counts(words, known).items():
            if len(s) > 2 and often[zlib.crc32(s.encode()) % slots] >= least:
                for k in range(1, min(n, 3) + 1):
                    where[s, k].add(i)
    where = {s: d for s, d in where.items() if len(d) >= least}
    spoiled: Counter = Counter()
    for words in clean:
        for s, n in shape_counts(words, known).items():
            for k in range(1, min(n, 3) + 1):
                if (s, k) in where:
                    spoiled[s, k] += 1
    ratio = len(toxic) / max(1, len(clean))
    # Clean documents are weighed as if there were as many as toxic ones.
    pure = {s: d for s, d in where.items() if len(d) / (len(d) + spoiled[s] * max(ratio, 0.2)) >= purity}
    words_alone = {s[0]: d for s, d in pure.items() if s[1] == 1 and s[0][0] == "=" and len(d) >= max(8, len(toxic) // 100)}
    chosen: dict[str, int] = {}
    open_docs, floor = set(range(len(toxic))), max(least, len(toxic) // 200)
    while pure:
        # Of shapes that cover as many, one word is better evidence than several, and the longer shape the safer choice.
        best = max(pure, key=lambda s: (len(pure[s]), -s[1], s[0][0] == "=", len(s[0]), s[0]))
        if len(pure[best]) < floor:
            break
        chosen[best[0]] = min(best[1], chosen.get(best[0], 3))
        open_docs -= pure.pop(best)
        pure = {s: d for s, x in pure.items() if len(d := x & open_docs) >= floor}
    # Other words as pure, which the cover did not need, tell as well; but they must stand between different
    # words from document to document, or they may only be words of one text that has many near copies.
    between: dict[str, set] = defaultdict(set)
    for words in toxic:
        for a, w, b in zip([b"", *words], words, [*words[1:], b""]):
            if (s := known[w][0]) in words_alone:
                between[s].add((a, b))
    for s, d in words_alone.items():
        if len(between[s]) >= 0.8 * len(d):
            chosen[s] = 1
    return chosen


def token_labels(words: list[bytes], chosen: dict[str, int]) -> np.ndarray:
    """Flags for the tokens of a toxic document."""
    known = ShapeStore()
    counts = shape_counts(words, known)
    live = {s for s, k in chosen.items() if counts[s] >= k}
    return np.array([not live.isdisjoint(known[w]) for w in words], bool)


def _chain(s: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state and of (state, next state) for equal-length rows of emissions ``s`` (rows x steps).

    The state before the first token is the other one, not toxic.
    """
    n, steps = s.shape
    e = np.stack([np.ones_like(s), np.exp(np.clip(s, -30, 30))], axis=2)
    a = np.exp(trans)
    alpha, beta = np.empty((n, steps, 2)), np.empty((n, steps, 2))
    alpha[:, 0] = e[:, 0] * a[0]
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for t in range(1, steps):
        alpha[:, t] = (alpha[:, t - 1] @ a) * e[:, t]
        alpha[:, t] /= alpha[:, t].sum(1, keepdims=True)
    beta[:, -1] = 1
    for t in range(steps - 2, -1, -1):
        beta[:, t] = (beta[:, t + 1] * e[:, t + 1]) @ a.T
        beta[:, t] /= beta[:, t].sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    pair = alpha[:, :-1, :, None] * a * (beta[:, 1:] * e[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return p[:, :, 1], pair


def marginals(scores: list[np.ndarray], trans: np.ndarray) -> list[np.ndarray]:
    """Chance of the toxic state for every token of every text, texts of any length together.

    Texts are cut into pieces of PIECE tokens (padded with neutral steps). Vectors are carried through
    all pieces at once from both states, which gives each piece's 2 x 2 product; products are chained text by
    text, and the pieces are run again from the states that come in. The same goes backwards.
    """
    lengths = np.array([len(x) for x in scores])
    pieces = -(-lengths // PIECE)
    total = int(pieces.sum())
    if not total:
        return [np.zeros(0) for _ in scores]
    first = np.cumsum(pieces) - pieces
    flat = np.concatenate(scores)
    slot = np.concatenate([np.arange(n) + f * PIECE for n, f in zip(lengths, first)])
    odds = np.ones(total * PIECE)
    odds[slot] = np.exp(np.clip(flat, -30, 30))
    odds = odds.reshape(total, PIECE).T.copy()  # steps x pieces
    real = np.zeros(total * PIECE, bool)
    real[slot] = True
    real = real.reshape(total, PIECE).T.copy()
    a = np.exp(trans)

    def step(o: np.ndarray, t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        x, y = o * a[0, 0] + t * a[1, 0], (o * a[0, 1] + t * a[1, 1]) * odds[k]
        z = x + y
        r = real[k]
        return np.where(r, x / z, o), np.where(r, y / z, t)

    def back(o: np.ndarray, t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        y = t * odds[k]
        p, q = a[0, 0] * o + a[0, 1] * y, a[1, 0] * o + a[1, 1] * y
        z = p + q
        r = real[k]
        return np.where(r, p / z, o), np.where(r, q / z, t)

    def product(move: Callable, order: range) -> tuple[np.ndarray, ...]:
        """Each piece's effect on the two unit vectors, with the logs of what was divided out."""
        out = []
        for o, t in ((np.ones(total), np.zeros(total)), (np.zeros(total), np.ones(total))):
            log = np.zeros(total)
            for k in order:
                if move is step:
                    x, y = o * a[0, 0] + t * a[1, 0], (o * a[0, 1] + t * a[1, 1]) * odds[k]
                else:
                    y = t * odds[k]
                    x, y = a[0, 0] * o + a[0, 1] * y, a[1, 0] * o + a[1, 1] * y
                z, r = x + y, real[k]
                o, t, log = np.where(r, x / z, o), np.where(r, y / z, t), log + np.where(r, np.log(z), 0)
            out.append((o, t, log))
        return out

    def carried(move: Callable, order: range, begin: tuple[float, float], reverse: bool) -> tuple[np.ndarray, np.ndarray]:
        """State that comes into each piece."""
        (o0, t0, l0), (o1, t1, l1) = product(move, order)
        top = np.maximum(l0, l1)
        w0, w1 = np.exp(l0 - top), np.exp(l1 - top)
        into_o, into_t = np.empty(total), np.empty(total)
        texts = np.flatnonzero(pieces)
        texts = texts[np.argsort(-pieces[texts], kind="stable")]
        o, t = np.full(len(texts), begin[0]), np.full(len(texts), begin[1])
        for j in range(int(pieces.max())):
            live = int((pieces[texts] > j).sum())
            at = first[texts[:live]] + (pieces[texts[:live]] - 1 - j if reverse else j)
            into_o[at], into_t[at] = o[:live], t[:live]
            x = o[:live] * w0[at] * o0[at] + t[:live] * w1[at] * o1[at]
            y = o[:live] * w0[at] * t0[at] + t[:live] * w1[at] * t1[at]
            o, t = x / (x + y), y / (x + y)
        return into_o, into_t

    forward = range(PIECE)
    o, t = carried(step, forward, (1.0, 0.0), False)
    ahead_o, ahead_t = np.empty((PIECE, total)), np.empty((PIECE, total))
    for k in forward:
        o, t = step(o, t, k)
        ahead_o[k], ahead_t[k] = o, t
    o, t = carried(back, range(PIECE - 1, -1, -1), (0.5, 0.5), True)
    out = np.empty((PIECE, total))
    for k in range(PIECE - 1, -1, -1):
        x, y = ahead_o[k] * o, ahead_t[k] * t
        out[k] = y / (x + y)
        o, t = back(o, t, k)
    flat = out.T.ravel()[slot]
    return np.split(flat, np.cumsum(lengths)[:-1])


def fit_field(rows: list[list[bytes]], marks: list[np.ndarray], rounds: int = 80, width: int = 24, seed: int = 3) -> Model:
    """Fit to runs of ``width`` tokens; ``marks`` flags each token."""
    rng = np.random.default_rng(seed)
    runs, y = [], []
    for words, flags in zip(rows, marks):
        hits = np.flatnonzero(flags)
        starts = {max(0, int(h) - int(rng.integers(0, width))) for h in hits[:6]}
        for at in starts or ({int(rng.integers(0, max(1, len(words) - width)))} if len(words) else set()):
            if len(words) - at >= 1:
                runs.append(words[at:at + width])
                y.append(flags[at:at + width])
    runs, y = [r + [b""] * (width - len(r)) for r in runs], [np.pad(f, (0, width - len(f))) for f in y]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for r in runs for w in r))}
    known = np.full((len(number), FEATURES), BUCKETS, np.int32)
    for w, i in number.items():
        f = features(w)
        known[i, :len(f)] = f
    idx = known[np.array([[number[w] for w in r] for r in runs], np.int32).reshape(-1, width)]
    gold = np.array(y, float).reshape(-1, width)
    weights, trans = np.zeros(BUCKETS + 1), np.zeros((2, 2))
    gw, gt = np.full(BUCKETS + 1, 1e-6), np.full((2, 2), 1e-6)
    states = gold.astype(int)
    want = np.zeros((2, 2))
    np.add.at(want, (states[:, :-1].ravel(), states[:, 1:].ravel()), 1)
    np.add.at(want[0], states[:, 0], 1)
    for _ in range(rounds):
        p, pair = _chain(sum(weights[idx[:, :, k]] for k in range(FEATURES)), trans)
        wrong = (gold - p).ravel()
        g = sum(np.bincount(column, wrong, BUCKETS + 1) for column in idx.reshape(-1, FEATURES).T) - 0.02 * weights
        g[BUCKETS] = 0
        expected = pair.sum((0, 1))
        expected[0] += len(p) - p[:, 0].sum(), p[:, 0].sum()
        t = want - expected - 0.1 * trans
        gw, gt = gw + g * g, gt + t * t
        weights, trans = weights + 0.4 * g / np.sqrt(gw), trans + 0.2 * t / np.sqrt(gt)
    return Model(weights[:BUCKETS], trans, np.zeros(4), 0.0)


def summary(p: np.ndarray) -> tuple[float, ...]:
    """What the logistic model sees of a text's marginals."""
    top = min(max(float(p.max(initial=1e-6)), 1e-6), 1 - 1e-6)
    return 1.0, float(np.log(top / (1 - top))), float(np.log1p(p.sum())), float(np.log1p(len(p)))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Newton steps with a ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        b = b + np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.05 * b), -2, 2)
    return b


class Scorer:
    """Emissions of words, kept per task, and marginals of texts."""

    def __init__(self, model: Model):
        self.model, self.place, self.table = model, {}, np.zeros(KEPT_WORDS)

    def learn(self, words: set[bytes]) -> None:
        """Emissions of new words, summed in one go; at most KEPT_WORDS are kept."""
        if len(self.place) + len(words) > KEPT_WORDS:
            self.place.clear()
        names = list(words)
        bags = [features(w) for w in names]
        n = np.fromiter(map(len, bags), np.int64, len(bags))
        flat = np.fromiter((i for b in bags for i in b), np.int64, int(n.sum()))
        at = len(self.place)
        self.table[at:at + len(names)] = np.add.reduceat(self.model.weights[flat], np.cumsum(n) - n)
        self.place.update(zip(names, range(at, at + len(names))))

    def emissions(self, words: list[bytes]) -> np.ndarray:
        out = []
        step = min(50_000, KEPT_WORDS)
        for at in range(0, len(words), step):
            part = words[at:at + step]
            new = set(part).difference(self.place)
            if new:
                self.learn(set(part) if len(self.place) + len(new) > KEPT_WORDS else new)
            out.append(self.table[np.fromiter(map(self.place.__getitem__, part), np.int64, len(part))])
        return np.concatenate(out) if out else np.zeros(0)

    def chances(self, rows: list[list[bytes]]) -> list[np.ndarray]:
        # New words of many texts are taken together, if they fit; the rest is met text by text.
        new = set().union(*rows).difference(self.place)
        if 0 < len(new) <= KEPT_WORDS - len(self.place):
            self.learn(new)
        return marginals([self.emissions(r) for r in rows], self.model.trans)

    def score(self, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.model.logistic, summary(p)), -30, 30))))


def train(toxic: list[str], clean: list[str], prior: float) -> Model | None:
    """Fit on texts of either label; every fourth of each is kept from the field and fits the logistic model."""
    # One object for each distinct word, however often it stands.
    same: dict[bytes, bytes] = {}
    t, c = ([[same.setdefault(w, w) for w in (x or "").encode().lower().split()] for x in texts] for texts in (toxic, clean))
    if not t or not c:
        return None
    held = lambda x: x[::4] if len(x) >= 4 else x
    rest = lambda x: [w for i, w in enumerate(x) if i % 4] or x
    chosen = toxic_shapes(rest(t), rest(c))
    fit_t, fit_c = rest(t), rest(c)
    marks = [token_labels(w, chosen) for w in fit_t]
    some = [i for i, f in enumerate(marks) if f.any()]
    model = fit_field([fit_t[i] for i in some] + fit_c, [marks[i] for i in some] + [np.zeros(len(w), bool) for w in fit_c])
    model.prior = prior
    scorer = Scorer(model)
    rows, x = held(t) + held(c), []
    for at in range(0, len(rows), 50):
        x += [summary(p) for p in scorer.chances(rows[at:at + 50])]
    x = np.array(x)
    model.logistic = fit_logistic(x, np.array([1.0] * len(held(t)) + [0.0] * len(held(c))))
    return model


def fit_sample(docs: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[Model | None, float]:
    """(model, share of toxic labels); only rows where ``usable`` are learned from, drawn by hash of the id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("toxic_label"))
    counts = {r["toxic_label"]: r["n"] for r in known.groupBy("toxic_label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 + n0:
        return None, 0.0
    share = F.when(F.col("toxic_label") == 1, F.lit(TOXIC_ROWS / max(1, n1))).otherwise(F.lit(CLEAN_ROWS / max(1, n0)))
    # The sampled ids are bounded by the two sizes above, whatever the tables hold; ids that have many texts are drawn from once more.
    drawn = F.broadcast(known.filter(hash_share("doc_id") < share).select(F.col("doc_id").alias("label_id"), "toxic_label"))
    rows = docs.filter(usable).select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    got = drawn_at_most(rows.join(drawn, F.col("id") == F.col("label_id")).select("id", "t", "toxic_label"), 2 * (TOXIC_ROWS + CLEAN_ROWS), "crf-sample").orderBy("id", "t").toArrow()
    flag = got.column("toxic_label").to_numpy()
    toxic, clean = (got.filter(pa.array(flag == k)).column("t").to_pylist() for k in (1, 0))
    return train(toxic, clean, n1 / (n1 + n0)), n1 / (n1 + n0)


def spans_of(text: str, flagged: np.ndarray) -> list[dict]:
    """Code-point offsets of runs of flagged words."""
    out: list[dict] = []
    last = -2
    places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    for i in flagged:
        a, b = places[i]
        if i == last + 1:
            out[-1]["end"] = b
        else:
            out.append({"start": a, "end": b})
        last = i
    return out


def score_toxicity(docs: DataFrame, model: Model | None, prior: float = 0.0, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``spans`` (offsets in code points, end exclusive)."""

    def make() -> Callable:
        if model is None:
            return lambda texts: ([prior] * len(texts), [int(prior >= 0.5)] * len(texts), [[] for _ in texts])
        scorer = Scorer(model)

        def compute(texts: list[str | None]) -> tuple:
            score, spans = [], []
            for at in range(0, len(texts), 500):
                part = texts[at:at + 500]
                for t, p in zip(part, scorer.chances([t.encode().lower().split() if t else [] for t in part])):
                    score.append(scorer.score(p))
                    flagged = np.flatnonzero(p >= 0.5)
                    spans.append(spans_of(t, flagged) if len(flagged) else [])
            return score, [int(s >= 0.5) for s in score], spans

        return compute

    return add_columns(docs, [text], [("score", "double"), ("predicted", "int"), ("spans", "array<struct<start:int,end:int>>")], make)
