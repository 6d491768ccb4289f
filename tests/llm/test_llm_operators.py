"""Each operator against brute force on small rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
import math
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from silvaquery.llm import brown_lm, chat, components, crf, langid, mixing, packing, pstable, simhash_bk, sstable, topk
from silvaquery.llm.common import LARGE_ROWS, fold
from silvaquery.llm.encoding import Encoder, vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, fp string, row int"
LONG = "word " * 30_000


def rows():
    texts = ["the cat sat on the mat", "The CAT sat on the mat", "", None, "   \n\t", "un deux trois quatre cinq", LONG, "Ünïcode – „text“ İstanbul ΣΑΣ", "a", "the cat sat on the mat"]
    base = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}" if i % 4 else None, len(t) if t else None, 1, 0.5, "x", 3) for i, t in enumerate(texts)]
    return [*base, base[0], (None, "no id here", None, None, None, None, None, None, None), (77, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return (t or "").encode().lower().split()


# ---------------------------------------------------------------- 1


def test_brown_counts_and_base(docs):
    got = [r.asDict() for r in brown_lm.score_texts(docs, fold("doc_id", 5) != 1).collect()]
    seen = collections.Counter()
    for r in rows():
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 1:
            seen.update([*words(r[1]), b""])
    n, v = sum(seen.values()), len(seen)
    want = sorted((str(r[0]), len(words(r[1])) + 1, round(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(r[1]), b""]), 6)) for r in rows())
    assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def brown_corpus(spark, n=300):
    """Texts of two word orders, long enough for several blocks and slices."""
    rng = np.random.default_rng(12)
    out = []
    for i in range(n):
        t = []
        for _ in range(int(rng.integers(1, 60))):
            t += [f"n{rng.zipf(1.4) % 400}", "is" if i % 2 else "Was", f"a{rng.zipf(1.4) % 300}"]
        out.append((i, ("  " if i % 7 == 0 else "") + " ".join(t)))
    return spark.createDataFrame(out, "doc_id long, text string"), out


def test_brown_scores_against_brute_force(spark, monkeypatch):
    """Whatever words are common, the score is that of the written-out mixture with the fitted classes."""
    d, data = brown_corpus(spark)
    learn = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    for core, local in ((2048, 1 << 18), (20, 60)):
        monkeypatch.setattr(brown_lm, "CORE", core)
        monkeypatch.setattr(brown_lm, "LOCAL", local)
        monkeypatch.setattr(brown_lm, "BLOCK_BYTES", 20_000)
        k = 6
        rows_ = d.select("doc_id", (fold("doc_id", 5) != 1).alias("training"), "text")
        blocks = brown_lm.written(brown_lm.blocks_of(rows_), "test-blocks")
        assert blocks.count() > 1
        f = brown_lm.fit_classes(blocks, k)
        of = {w: (int(f.of[i]), int(f.count[i])) for i, w in enumerate(f.common)} | {bytes(r.word): (r["class"], r.n) for r in f.rare.collect()}
        seen = collections.Counter()
        for i, t in data:
            if learn(i):
                seen.update([*words(t), b""])
        assert {w: n for w, (_, n) in of.items()} == dict(seen) and (len(f.common) < len(seen)) == (local == 60)
        table, mass = np.zeros((k, k)), np.full(k, 0.5)
        for i, t in data:
            if learn(i):
                run = [b"", *words(t), b""]
                for a, b in zip(run, run[1:]):
                    table[of[a][0], of[b][0]] += 1
        for c, n in of.values():
            mass[c] += n + 0.5
        total, v = sum(seen.values()), len(seen)
        all_d = total + 0.5 * (v + 1)
        factor = brown_lm.class_factors(table, mass, all_d)

        def p(w, before):
            return (seen[w] + 0.5) / all_d * factor[of[before][0] if before in of else k, of[w][0] if w in of else k]

        for before in (b"", b"is", b"never"):
            assert sum(p(w, before) for w in [*of, b"never"]) == pytest.approx(1.0)
        got = {r.doc_id: r.score for r in brown_lm.score_texts(d, fold("doc_id", 5) != 1, classes=k).collect()}
        for i, t in data:
            run = [b"", *words(t), b""]
            assert got[i] == pytest.approx(sum(math.log10(p(w, a)) for a, w in zip(run, run[1:])), rel=1e-6)
        held = [i for i, _ in data if not learn(i)]
        base = {r.doc_id: r.base_score for r in brown_lm.score_texts(d, fold("doc_id", 5) != 1, classes=k).collect()}
        assert sum(got[i] for i in held) > sum(base[i] for i in held)


def test_brown_tasks_hold_few_blocks(spark, monkeypatch):
    """What a task writes, reads or sends to Python at a time is bounded by bytes, however many blocks it has."""
    rng = np.random.default_rng(5)
    texts = [" ".join(np.char.mod("%x", rng.integers(1 << 60, 1 << 62, 40_000)).tolist()) for _ in range(24)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    groups, real = {}, brown_lm.written

    def spied(df, tag, *a, **b):
        out = real(df, tag, *a, **b)
        metas = [pq.ParquetFile(urllib.parse.urlparse(f).path).metadata for f in out.inputFiles()]
        groups[tag] = [m.row_group(i).num_rows for m in metas for i in range(m.num_row_groups)]
        return out

    monkeypatch.setattr(brown_lm, "written", spied)
    monkeypatch.setattr(brown_lm, "BLOCK_BYTES", 500_000)
    monkeypatch.setitem(LARGE_ROWS, "parquet.block.size", str(2 << 20))
    assert brown_lm.score_texts(d, F.lit(True)).count() == 24
    for tag in ("brown-texts", "brown-blocks"):
        assert sum(groups[tag]) == 24 and max(groups[tag]) <= 12, groups

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    sent = [r.n for r in real(d.mapInArrow(sizes, "n long"), "test-sizes", brown_lm.SENT_AT_ONCE).collect()]
    assert sum(sent) == 24 and max(sent) <= 8 and spark.conf.get(name) == before


def test_brown_splits_slices_right():
    import pyarrow as pa

    texts = pa.array([f"É{i} Wörld  of\tTexts {i} ñ" * (i % 5) for i in range(400)] + [None])
    for at, n in ((0, 401), (33, 200), (390, 11)):
        names, codes, sizes = brown_lm.coded(texts.slice(at, n))
        want = [w for t in texts.slice(at, n).to_pylist() for w in [*words(t), b""]]
        assert [names[c] for c in codes] == want and sizes.sum() == len(want)


def test_placing_takes_the_likeliest_class():
    rng = np.random.default_rng(13)
    k, f = 5, brown_lm.xlogx
    table = rng.integers(0, 50, (k, k)).astype(float)
    ll = lambda t: f(t).sum() - f(t.sum(0)).sum() - f(t.sum(1)).sum()
    for big in (1, 100):
        into, out = rng.integers(0, 4, k) * big, rng.integers(0, 4, k) * big
        slots = np.flatnonzero(np.concatenate((into, out)))
        g = brown_lm.Placing(table).gains(np.array([0]), slots, np.concatenate((into, out))[slots])[0]
        for c in range(k):
            if not into[c] and not out[c]:
                t = table.copy()
                t[c] += out
                t[:, c] += into
                # The neighbours' own totals grow by the same wherever the word goes.
                same = (f(table.sum(0) + out) - f(table.sum(0))).sum() + (f(table.sum(1) + into) - f(table.sum(1))).sum()
                assert g[c] == pytest.approx(ll(t) + same - ll(table), abs=1e-2)


def test_brown_empty_and_untrained(empty, docs):
    assert brown_lm.score_texts(empty, F.lit(True)).count() == 0
    got = brown_lm.score_texts(docs, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)


def test_exchange_separates_two_languages():
    rng = np.random.default_rng(0)
    table = np.zeros((20, 20))
    for half in (0, 10):
        table[half:half + 10, half:half + 10] = rng.integers(5, 20, (10, 10))
    of = brown_lm.exchange(table, 2)
    assert len(set(of[:10])) == 1 and len(set(of[10:])) == 1 and of[0] != of[10]


# ---------------------------------------------------------------- 2


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    trans, s = rng.normal(size=(2, 2)), rng.normal(size=6) * 2
    weight, toxic = 0.0, np.zeros(6)
    for k in range(64):
        y = [(k >> i) & 1 for i in range(6)]
        w = math.exp(sum(trans[a, b] for a, b in zip([0, *y], y)) + sum(s[i] for i in range(6) if y[i]))
        weight += w
        toxic += w * np.array(y)
    assert np.allclose(crf.marginals([s], trans)[0], toxic / weight)
    many = [rng.normal(size=n) for n in (0, 1, 63, 64, 65, 300)]
    for one, got in zip(many, crf.marginals(many, trans)):
        if len(one):
            assert np.allclose(crf._chain(one[None], trans)[0][0], got)


def toxic_corpus(spark, n=240):
    rng = np.random.default_rng(2)
    vocab = [f"{a}{b}" for a in ("ba", "do", "ki", "mu", "re") for b in ("lo", "ti", "na", "su")]
    data, labels = [], []
    for i in range(n):
        t = list(rng.choice(vocab, 40))
        bad = i % 3 == 0
        if bad:
            for at in rng.integers(0, 40, 3):
                t[at] = str(rng.choice(["zarg", "Vlorp!", "zargish"]))
        data.append((i, " ".join(t)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_and_spans(spark):
    docs, labels = toxic_corpus(spark)
    learn = fold("doc_id", 5) != 0
    model, prior = crf.fit_sample(docs, labels.filter(learn), learn)
    got = crf.score_toxicity(docs, model, prior).filter(fold("doc_id", 5) == 0).collect()
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    for r in got:
        for s in r.spans:
            assert any(w in r.text[s["start"]:s["end"]].lower() for w in ("zarg", "vlorp"))


def test_toxicity_score_against_brute_force(spark):
    """The document's score from marginals by a plain pass over the chain, token after token."""
    docs, labels = toxic_corpus(spark, 90)
    model, prior = crf.fit_sample(docs, labels, F.lit(True))
    for r in crf.score_toxicity(docs, model, prior).limit(40).collect():
        e = [math.exp(sum(model.weights[f] for f in crf.features(w))) for w in words(r.text)]
        a, n = np.exp(model.trans), len(words(r.text))
        ahead, v = [], np.array([1.0, 0.0])
        for x in e:
            v = (v @ a) * [1, x]
            v = v / v.sum()
            ahead.append(v)
        back, v = [np.ones(2)], np.ones(2)
        for x in reversed(e[1:]):
            v = a @ (v * [1, x])
            v = v / v.sum()
            back.append(v)
        p = np.array([f[1] * b[1] / (f * b).sum() for f, b in zip(ahead, reversed(back))])
        top = min(max(p.max(), 1e-6), 1 - 1e-6)
        z = model.logistic @ [1, math.log(top / (1 - top)), math.log1p(p.sum()), math.log1p(n)]
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6) and r.predicted == int(r.score >= 0.5)


def test_toxicity_edges(spark, docs, empty):
    corpus, labels = toxic_corpus(spark, 60)
    model, prior = crf.fit_sample(corpus, labels, F.lit(True))
    got = crf.score_toxicity(docs, model, prior)
    assert got.columns[:len(docs.columns)] == docs.columns and "_score" in got.columns
    assert all(0 <= r["_score"] <= 1 and not (r["spans"] and not r["text"]) for r in got.collect())
    assert got.count() == len(rows()) and crf.score_toxicity(empty, model, prior).count() == 0
    none, share = crf.fit_sample(corpus, labels.limit(0), F.lit(True))
    assert none is None and {r["_score"] for r in crf.score_toxicity(docs, none, share).collect()} == {0.0}


# ---------------------------------------------------------------- 3


def targets(sizes, share=1.5, most=2.0):
    """Sharing out in rounds, as the contract words it."""
    w = {k: (5, 2, 1)[i % 3] for i, k in enumerate(sizes)}
    left, open_, out = share * sum(sizes.values()), dict(sizes), {}
    while open_:
        level = left / sum(w[k] for k in open_)
        over = [k for k, s in open_.items() if level * w[k] > most * s]
        if not over:
            return out | {k: level * w[k] for k in open_}
        for k in over:
            out[k] = most * open_.pop(k)
            left -= out[k]
    return out


def test_mixing_targets_and_copies(spark):
    data = [(i, " ".join(["w"] * (1 + i * 7 % 50)), f"s{i % 7}" if i % 9 else None) for i in range(900)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix_documents(d).collect()
    sizes = collections.Counter()
    for _, t, s in data:
        sizes[s] += len(t.split())
    want = targets({k: sizes[k] for k in sorted(sizes, key=lambda s: (s is None, s or ""))})
    src = {i: s for i, _, s in data}
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(want[src[r.doc_id]]) and r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[src[r.doc_id]] += r.taken
    assert all(abs(taken[k] - want[k]) <= 60 for k in want)
    assert sorted(got) == sorted(mixing.mix_documents(d.repartition(7)).collect())
    copies = mixing.mixed_copies(d)
    assert copies.columns == d.columns
    assert {(r.doc_id): r["count"] for r in copies.groupBy("doc_id").count().collect()} == {r.doc_id: r.copies for r in got if r.copies}


def test_mixing_edges(docs, empty):
    got = mixing.mix_documents(docs)
    assert got.count() == len(rows()) and mixing.mix_documents(empty).count() == 0
    assert all(r.taken <= 2 * r.size for r in got.collect())
    out = mixing.mixed_copies(docs)
    assert out.columns == docs.columns and mixing.mixed_copies(empty).count() == 0


# ---------------------------------------------------------------- 4


def test_pstable_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16)).astype("f4")
    x[100:160] = x[:60] + rng.normal(size=(60, 16)).astype("f4") * 0.05
    x[200:210] = x[5]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [1.0, None]), (903, [float("nan")] * 16), (904, [float("inf")] * 16), (905, []), (None, [1.0] * 16), (906, [float(v) for v in x[5]] + [0.0])]
    got = {r.vec_id: r for r in pstable.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    found = sum(got[i].n_links for i in range(300))
    assert 0.95 * (link.sum() - 300) <= found <= link.sum() - 300 + 2 * 13
    assert got[205].component_id == 5 and not got[205].kept and got[5].kept and got[906].component_id == 5
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 906))
    assert got[None].n_links == 0 and not got[None].kept


def test_pstable_recall_just_above_the_threshold(spark):
    rng = np.random.default_rng(16)
    data, pairs = [], []
    for i in range(1500):
        u = rng.normal(size=32)
        v = rng.normal(size=32)
        u /= np.linalg.norm(u)
        v -= u * (u @ v)
        v /= np.linalg.norm(v)
        c = rng.uniform(0.9501, 0.97)
        data += [(2 * i, (u * 3).tolist()), (2 * i + 1, (c * u + math.sqrt(1 - c * c) * v).tolist())]
    x = np.array([r for _, r in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = np.argwhere(np.triu(x @ x.T >= 0.95, 1))
    got = {r.vec_id: r.n_links for r in pstable.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert len(link) >= 1500 and 0.95 * 2 * len(link) <= sum(got.values()) <= 2 * len(link)


def test_pstable_blocks_and_empty(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=8) + rng.normal(size=(60, 8)) * 0.01
    d = spark.createDataFrame([(i, [float(v) for v in r], "x") for i, r in enumerate(x)], "vec_id long, embedding array<double>, n string")
    for hot in (2048, 7):
        got = pstable.near_vectors(d, hot=hot).collect()
        assert {(r.n_links, r.component_id) for r in got} == {(59, 0)}
    assert pstable.near_vectors(d.limit(0)).count() == 0


# ---------------------------------------------------------------- 5


def whole_encodings(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return [np.array(e.ids, "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_whole_texts():
    import pyarrow as pa

    texts = [r[1] for r in rows()] + ["don't I'LL we're", "x,y;z... ?! ...", "<|endoftext|> a <|STARTOFTEXT|>", "3.14 1,000 ½", "été", "a b c", "ÉTÉ Ñandú ß ẞ İ", "日本語 text 123abc", "tab\tnew\r\nline\x0bv\x1cf"]
    got = Encoder(vocabulary_path()).encode(pa.array(texts), 2)
    for t, g, w in zip(texts, got, whole_encodings(texts)):
        assert g[-1] == 2 and (g[:-1] == w).all(), t


def test_sstable_round_trip(spark, docs, empty, tmp_path):
    got = sstable.round_trip(spark, docs)
    ids = [np.append(w, 2).astype("<u4") for w in whole_encodings([r[1] for r in rows()])]
    want = sorted((-1 if r[0] is None else r[0], len(w), zlib.crc32(w.tobytes())) for r, w in zip(rows(), ids))
    back = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got.collect())
    assert sorted(x[1:] for x in back) == want and [x[1] for x in back] == [x[0] for x in want]
    assert [x[0] for x in back] == np.concatenate(([0], np.cumsum([x[2] for x in back])[:-1])).tolist()
    assert sstable.round_trip(spark, empty).count() == 0
    path = f"file://{tmp_path}/shards"
    manifest = sstable.write_shards(docs, path, partitions=3).collect()
    assert len(sstable.lookup(path, manifest, 0)) == 2 and len(sstable.lookup(path, manifest, None)) == 1 and not sstable.lookup(path, manifest, 5000)


def test_sstable_splits_ids_that_repeat(spark, tmp_path):
    d = spark.createDataFrame([(None, f"text {i}") for i in range(300)] + [(7, "same")] * 300 + [(9, "last")], "doc_id long, text string")
    path = f"file://{tmp_path}/shards"
    manifest = sstable.write_shards(d, path, partitions=4)
    assert manifest.agg(F.max("entries")).first()[0] < 400 and manifest.count() == 4
    got = sstable.read_shards(manifest, path).collect()
    assert collections.Counter(r.doc_id for r in got) == {None: 300, 7: 300, 9: 1} and max(got, key=lambda r: r.start).doc_id == 9
    assert len(sstable.lookup(path, manifest.collect(), 7)) == 300 and len(sstable.lookup(path, manifest.collect(), None)) == 300


def test_store_tells_runs_with_half_a_hash_apart():
    from silvaquery.llm.encoding import PAIR, Store

    s, key = Store(), np.array([(5, 9), (5, 1), (5, 4), (2, 7), (9, 0)], PAIR)
    s.add(key[:3], [np.array([k], "<u4").tobytes() for k in (59, 51, 54)])
    s.add(key[3:], [np.array([k], "<u4").tobytes() for k in (27, 90)])
    at, found = s.find(key)
    assert found.all() and s.blob[s.first[at]].tolist() == [59, 51, 54, 27, 90]
    assert not s.find(np.array([(5, 2), (5, 10), (1, 1), (99, 99)], PAIR))[1].any()


def test_encoder_of_another_tokenizer_takes_whole_texts(tmp_path):
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    spec = json.load(open(vocabulary_path(), encoding="utf-8"))
    spec["normalizer"] = None
    path = str(tmp_path / "other.json")
    json.dump(spec, open(path, "w"))
    texts = ["Two Words  and-more", None, ""]
    got = Encoder(path).encode(pa.array(texts), 2)
    want = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [g.tolist() for g in got] == [[*e.ids, 2] for e in want] and Encoder(vocabulary_path()).by_runs


def test_sstable_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 64)
    p = tmp_path / "x.sst"
    docs = [(i // 3 - 20, np.arange(i % 9, dtype="<u4") + 70_000 * (i % 2)) for i in range(200)]
    with open(p, "wb") as f:
        w = sstable.Writer(f)
        for k, v in docs:
            w.add(sstable.key_of(k), v)
        w.finish()
    with open(p, "rb") as f:
        r = sstable.Reader(f)
        assert len(r.index) > 10 and r.entries == 200
        assert [(sstable.id_of(k), v.tolist()) for k, v in r.scan()] == [(k, v.tolist()) for k, v in docs]
        for k in range(-20, 46):
            assert [v.tolist() for v in r.get(k)] == [v.tolist() for q, v in docs if q == k]
    with open(p, "rb") as f, pytest.raises(ValueError):
        import io

        sstable.Reader(io.BytesIO(f.read()[:-1]))


# ---------------------------------------------------------------- 6


def test_language_held_out(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    held = fold("doc_id", 4) == 2
    model = langid.fit_sample(d, ~held)
    got = langid.predict(d.filter(held), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 1


def test_language_rejects_what_was_not_learned(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit_sample(d, fold("doc_id", 4) != 2)
    rng = np.random.default_rng(14)
    letters = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, 9)))) for _ in range(60)) for _ in range(40)]
    foreign = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar, akıl ve vicdana sahiptirler", "Все люди рождаются свободными и равными в своём достоинстве и правах"]
    got = langid.predict(spark.createDataFrame([(t,) for t in letters + foreign], "text string"), model).collect()
    assert sum(r.rejected for r in got) >= len(got) - 1


def brute_language(model, text):
    """Averages over all n-grams of the text, written out."""
    h = [v for w in words(text) for v in langid.subwords(w)]
    z = np.mean([model.scores[v % model.buckets] for v in h], axis=0) + model.bias
    p = np.exp((z - z.max()) / model.temperature)
    four = [zlib.crc32((b"<" + w + b">")[i:i + 4]) for w in words(text) for i in range(len(w) - 1)]
    return model.languages[int(p.argmax())], float(p.max() / p.sum()), (sum(int(model.seen(np.array([v]))[0]) for v in four), len(four))


def test_language_scores_against_brute_force(spark, docs, sf, monkeypatch):
    model = langid.fit_sample(spark.read.parquet(f"{sf}/documents.parquet"), fold("doc_id", 4) != 2)
    monkeypatch.setattr(langid, "KEPT_WORDS", 3000)
    sample = spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).unionByName(docs.select("text"))
    for r in langid.predict(sample, model).collect():
        if r.lang_pred != "und":
            lang, score, (seen, n) = brute_language(model, r.text)
            assert r.lang_pred == lang and r.score == pytest.approx(score)
            share = seen / max(n, 1)
            near = share + 3 * math.sqrt(max(share * (1 - share), 1 / max(n, 1)) / max(n, 1))
            assert r.rejected == (score < langid.SURE or near < model.floor)


def test_language_edges(spark, docs, empty, sf):
    model = langid.fit_sample(spark.read.parquet(f"{sf}/documents.parquet"), F.lit(True))
    got = langid.predict(docs, model)
    assert "_score" in got.columns and langid.predict(empty, model).count() == 0
    for r in got.collect():
        blank = not r.text or not any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == blank and (not blank or (r["_score"] == 0 and r.rejected))
    odd = spark.createDataFrame([(0, "½ ② 12 !?"), (1, "½ x")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.predict(odd, model).orderBy("doc_id").collect()] == [True, False]
    none = langid.fit_sample(empty, F.lit(True))
    assert none is None and {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


# ---------------------------------------------------------------- 7

TURNS = [("system", "be # nice"), ("user", "\\### Assistant: </turn> ok"), ("assistant", "a\\b <c>\n"), ("user", ""), ("assistant", ""), ("ro:le\n#", "x"), ("assistant", "</turn>\n### user: hi")]


def test_chat_template_is_reversible():
    assert chat.parse_marked(chat.marked_turns(TURNS)) == TURNS


@pytest.mark.parametrize("section", [2, 64])
def test_chat_digests(spark, section):
    data = [(c, t, r, x, "extra") for c in (1, 2) for t, (r, x) in enumerate(TURNS)] + [(3, 0, "assistant", None, None), (3, None, None, "first", None), (3, 0, "assistant", None, None), (None, 1, "user", "z", None)]
    d = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, section string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(d, section=section)).collect()}
    said = "".join(x for r, x in TURNS if r == "assistant")
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in TURNS).encode()).hexdigest() == got[2].turns_sha256
    assert got[1].loss_chars == len(said) and got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].n_turns == len(TURNS)
    assert got[1].formatted_chars == len(chat.marked_turns(TURNS)) and not got[1].rewritten
    assert got[3].n_turns == 3 and got[3].turns_sha256 == hashlib.sha256(b"\nfirst\nassistant\n\nassistant\n\n").hexdigest() and got[None].n_turns == 1
    assert chat.digests(chat.format_conversations(d.limit(0))).count() == 0


def test_chat_detects_rewritten_history():
    def last_only(turns):
        return "".join(f"[{r}]{t if i == len(turns) - 1 else '...'};" for i, (r, t) in enumerate(turns))

    assert chat.is_local(chat.marked_turns) and not chat.is_local(last_only)
    out, spans, mask, rewritten = chat.render(last_only, [("user", "hello"), ("assistant", "bye")])
    assert rewritten and out == "[user]...;[assistant]bye;"
    out, spans, mask, rewritten = chat.render(chat.marked_turns, TURNS)
    assert not rewritten and [out[a:b] for a, b in spans] == [chat.marked_turns([t]) for t in TURNS]
    assert [chat.unescape(out[a:b]) for a, b in mask] == [x for r, x in TURNS if r == "assistant"]


def test_chat_masks_of_rewriting_templates():
    def drops_system(turns):
        return "".join(f"<{r}>{t}</{r}>" for i, (r, t) in enumerate(turns) if r != "system" or i == len(turns) - 1)

    turns = [("system", "S"), ("user", "U1"), ("assistant", "A1"), ("user", "U2"), ("assistant", "A2 more")]
    out, spans, mask, rewritten = chat.render(drops_system, turns)
    assert rewritten and [out[a:b] for a, b in mask] == ["A1", "A2 more"]

    def forgets(turns):
        return "".join(f"[{r}]{t if i > len(turns) - 3 else ''}" for i, (r, t) in enumerate(turns))

    out, spans, mask, rewritten = chat.render(forgets, turns)
    assert rewritten and [out[a:b] for a, b in mask] == ["A2 more"]

    def turns_late(turns):
        return "".join(f"{r}:{t};" if i < 70 else f"{i}{r}:{t};" for i, (r, t) in enumerate(turns))

    assert not chat.is_local(turns_late) and chat.is_local(chat.marked_turns)


@pytest.mark.parametrize("local", [None, False])
def test_chat_of_long_conversations(spark, local):
    data = [(c, t, ("user", "assistant")[t % 2], f"text # {t} of {c}") for c in (5, None) for t in range(90)] + [(6, 0, "assistant", "same")] * 50
    d = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(d, section=16, local=local)).collect()}
    for c in (5, 6, None):
        own = [(r, x) for k, _, r, x in data if k == c]
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        said = "".join(x for r, x in own if r == "assistant")
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[c].formatted_chars == len(chat.marked_turns(own))


# ---------------------------------------------------------------- 8


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "HEAD", 16)
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(260, 12)) * 4) / 4
    x[50:60] = x[3]
    data = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(500, None, 1), (501, [float("nan")] * 12, 1), (502, [None] * 12, 1), (None, [1.0] * 12, 1), (503, [], 1), (3, [float(v) for v in x[3]], 1), (600, [0.0] * 12, 2)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int").repartition(5)
    got = collections.defaultdict(list)
    for r in topk.top_inner_products(d, d.filter("vec_id % 100 = 0")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    q = np.floor(x * 1024).astype(int)
    # The repeated row of 3 is a candidate twice.
    ids = [*range(260), 3, 600]
    q = np.vstack([q, q[3:4], np.zeros((1, 12), int)])
    assert sorted(got) == [0, 100, 200, 600]
    for k, found in got.items():
        s = q @ q[ids.index(k)]
        want = sorted(((-int(s[j]), i) for j, i in enumerate(ids) if i != k))[:10]
        assert sorted(found) == [(n + 1, i, -v) for n, (v, i) in enumerate(want)]
    assert topk.top_inner_products(d.limit(0), d.limit(0)).count() == 0
    few = d.filter("vec_id in (100, 7, 8)")
    assert topk.top_inner_products(few, few.filter("vec_id = 100")).count() == 2


def test_topk_of_repeated_rows_against_sql(spark):
    import duckdb
    import pandas as pd

    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 4)]) for i in (0, 0, 1, 1, 1, 2, 3, 3, 100, 100, 7, 7, 200)]
    rows += [rows[0], rows[2], rows[2], rows[6]]
    got = sorted(tuple(r) for r in topk.top_inner_products(*(spark.createDataFrame(x, "vec_id long, embedding array<float>") for x in (rows, [r for r in rows if r[0] % 100 == 0]))).collect())
    embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding"])  # noqa: F841
    from silvaquery.llm.queries import TOPK

    want = sorted(duckdb.sql(TOPK.replace("FROM embeddings", "FROM (SELECT vec_id, CAST(embedding AS FLOAT[]) AS embedding FROM embeddings)")).fetchall())
    assert got == want


def test_topk_of_very_large_components(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(120, 6)) * 10.0 ** rng.choice([0, 4, 8, 30, 160], (120, 1))
    x[100] = x[101]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)
    q = [[int(v * 1024) if abs(v) > 2**52 else math.floor(v * 1024) for v in r] for _, r in data]
    got = collections.defaultdict(list)
    for r in topk.top_inner_products(d, d.filter("vec_id % 20 = 0")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    for k in range(0, 120, 20):
        s = [(-sum(a * b for a, b in zip(q[k], q[j])), j) for j in range(120) if j != k]
        assert sorted(got[k]) == [(n + 1, j, clip(-v)) for n, (v, j) in enumerate(sorted(s)[:10])]


# ---------------------------------------------------------------- 9


def brute_fingerprint(text):
    import xxhash

    w = words(text)
    if not w:
        return 0
    parts = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    c = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for b in range(64):
            c[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * c[b] > len(parts))


def test_simhash_edges(docs, empty):
    got = simhash_bk.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(r[0]), f"{brute_fingerprint(r[1]):016x}") for r in rows())
    by = {r.doc_id: r.component_id for r in got}
    assert by[0] == by[1] == by[9] == 0 and by[3] == by[4] == by[77] == 2 and by[None] is None
    assert simhash_bk.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("hot", [4096, 5])
def test_simhash_links_are_all_found(spark, hot):
    rng = np.random.default_rng(6)
    base = rng.integers(-(1 << 63), 1 << 63, 40)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(12):
            for bit in rng.choice(64, 2, replace=False):
                b ^= 1 << int(bit) if bit < 63 else -(1 << 63)
            fps.add(int(b))
    fps = sorted(fps)
    d = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in simhash_bk.fingerprint_components(d, hot=hot).collect()}
    u, v = np.nonzero(np.bitwise_count((np.array(fps)[:, None] ^ np.array(fps)[None]).view(np.uint64)) <= 3)
    want = components.local_components(u, v, len(fps))
    assert [got.get(f, f) for f in fps] == [fps[i] for i in want]


def test_keep_one_drops_near_copies(spark, docs, empty):
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(3000)]
    base = [list(rng.choice(vocab, 300)) for _ in range(12)]
    data = [(i, " ".join(t)) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        near = list(t)
        near[150] = "changed"
        near[20] = "other"
        data.append((100 + i, " ".join(near)))
    got = simhash_bk.keep_one(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(12))
    out = simhash_bk.keep_one(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [0, 2, 5, 6, 7, 8, None]))
    assert simhash_bk.keep_one(empty).count() == 0


def test_keep_one_links_at_the_exact_similarity(spark):
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(5000)]
    texts = []
    for n in (12, 40, 120, 300):
        for _ in range(25):
            base = list(rng.choice(vocab, n))
            texts.append(base)
            # A shared passage of some length, and another ending: similarities from 0.4 to 0.95.
            texts += [base[:round(n * s)] + list(rng.choice(vocab, n - round(n * s))) for s in (0.6, 0.75, 0.8, 0.85, 0.88, 0.9, 0.92, 0.97)]
    hub = list(rng.choice(vocab, 200))
    texts += [hub[:at] + list(rng.choice(vocab, 16)) + hub[at + 16:] for at in range(0, 180, 3)]  # each near the hub, most not near one another
    texts.append(hub)
    data = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    u, v = np.array(links).T
    want = sorted(set(components.local_components(u, v, len(sets)).tolist()))
    assert sorted(r.doc_id for r in simhash_bk.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()) == want


@pytest.mark.parametrize("local", [0, 1000])
def test_connected_components_of_a_path(spark, local):
    d = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (101, 101)], "u long, v long")
    got = {r.node: r.root for r in components.connected_components(d, local=local).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.connected_components(d.limit(0), local=local).count() == 0


# ---------------------------------------------------------------- 10


def check_packing(pieces, texts, capacity=2048):
    want = sorted(zip([len(w) + 1 for w in whole_encodings(texts)], range(len(texts))))
    fill = collections.defaultdict(list)
    for p in pieces:
        fill[p.sequence_id].append((p.offset, p.length))
    for v in fill.values():
        at = 0
        for o, n in sorted(v):
            assert o == at and n > 0
            at += n
        assert at <= capacity
    assert sum(p.length for p in pieces) == sum(n for n, _ in want)
    return fill


def test_packing_edges(docs, empty):
    got = packing.pack_documents(docs.coalesce(1), with_ids=True).collect()
    fill = check_packing(got, [r[1] for r in rows()])
    assert len(fill) == -(-sum(p.length for p in got) // 2048)
    one = sorted((p.start, p.ids) for p in got if p.doc_id == 6)
    assert np.concatenate([i for _, i in one]).tolist() == [*whole_encodings([LONG])[0].tolist(), 1]
    assert all(zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in got)
    assert packing.pack_documents(empty).count() == 0


def test_sum_of_squares_places_as_stated():
    rng = np.random.default_rng(8)
    p = packing.SumOfSquares(32)
    for i in range(400):
        s = int(rng.integers(1, 32))
        n = p.counts.copy()
        total = lambda c: int((c[1:32] ** 2).sum())
        options = {}
        for h in range(0, 32 - s + 1):
            if h and not n[h]:
                continue
            c = n.copy()
            c[h] -= h > 0
            if h + s < 32:
                c[h + s] += 1
            options[h] = total(c)
        p.place(i, np.zeros(s, "<u4"))
        assert total(p.counts) == min(options.values())


@pytest.mark.parametrize("n", [100, 300])
@pytest.mark.parametrize("kind", ["thoughts", "window"])
def test_chat_sections_of_templates_that_probes_misjudge(spark, kind, n):
    """Sections, put together, are the whole rendering, whatever the template does with texts or from some turn on."""

    def without_thoughts(turns):
        """A common template: thoughts of the assistant are dropped from turns before the last user turn."""
        import re

        last = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=-1)
        return "".join(f"<{r}>{re.sub('<think>.*?</think>', '', t) if r == 'assistant' and i < last else t}</{r}>\n" for i, (r, t) in enumerate(turns))

    template = without_thoughts if kind == "thoughts" else lambda turns: "".join(f"<{r}>{t}</{r}>\n" for r, t in turns[-150:])
    said = [(("user", "assistant")[i % 2], f"<think>t{i}</think>a{i}" if i % 2 else f"q{i}") for i in range(n)]
    short = [("user", "x"), ("assistant", "<think>b</think>y")]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(said)] + [(None, i, r, t) for i, (r, t) in enumerate(said[:n // 2])] + [(2, i, r, t) for i, (r, t) in enumerate(short)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template).collect()
    for conv, turns in ((1, said), (None, said[:n // 2]), (2, short)):
        own = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.section)
        assert "".join(r.formatted for r in own) == template(turns)
        assert all(0 <= x.start <= x.end <= len(r.formatted) for r in own for x in [*r.spans, *r.mask])
        if kind == "thoughts" and conv != 2:
            # Each answer that is still there, in order.
            answers = [r.formatted[m.start:m.end] for r in own for m in r.mask]
            last = max(i for i, (r, _) in enumerate(turns) if r == "user")
            assert answers == [t if i > last else f"a{i}" for i, (r, t) in enumerate(turns) if r == "assistant"]


def test_forget_deletes_only_what_was_written(spark, tmp_path):
    from silvaquery.llm.common import forget, written

    spark.range(5).write.parquet(f"{tmp_path}/own")
    own = spark.read.parquet(f"{tmp_path}/own")
    made = written(own, "test-forget")
    assert made.count() == 5
    forget(made)
    forget(own)
    assert own.count() == 5
    with pytest.raises(Exception):
        made.count()


def test_too_many_languages_are_an_error(spark):
    d = spark.createDataFrame([(i, f"text number {i}", f"l{i % 7}") for i in range(70)], "doc_id long, text string, lang string")
    assert len(langid.fit_sample(d, F.lit(True), most_languages=7).languages) == 7
    with pytest.raises(ValueError, match="more than 6 languages"):
        langid.fit_sample(d, F.lit(True), most_languages=6)


def shard_of(sets):
    """One shard in which all fingerprints are the same, so that sets alone decide."""
    n = len(sets)
    rows = pa.table({"band": pa.array(np.zeros(n, np.int64)), "node": pa.array(np.arange(n)), "fp": [b"\0" * 32] * n, "label": pa.array(np.arange(n)), "items": [x.tobytes() for x in sets]})
    return simhash_bk.Shards(rows, 4, 10)


def template(rng, shared, own):
    return np.unique(np.concatenate([shared, rng.integers(0, 1 << 32, own, dtype=np.uint64).astype(np.uint32)]))


def test_hot_shards_of_unlike_texts_are_not_compared():
    """A template with endings of their own, similarity 0.76: twenty thousand members fall away without a comparison."""
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 32, 160, dtype=np.uint64).astype(np.uint32)
    sets = [template(rng, shared, 25) for _ in range(20_000)]
    s = shard_of(sets)
    s.near = None  # a search would fail
    assert 0.7 < simhash_bk.similarity_of(sets[0], sets[1]) < 0.8
    assert list(simhash_bk.across(s, 0.8)) == []


def test_links_of_hot_shards_against_brute_force():
    """Families on both sides of the threshold, of many sizes, some members being parts of others."""
    rng = np.random.default_rng(2)
    for seed in range(6):
        sets = []
        for _ in range(6):
            shared = rng.integers(0, 1 << 32, int(rng.integers(20, 120)), dtype=np.uint64).astype(np.uint32)
            for _ in range(12):
                sets.append(template(rng, shared[: int(len(shared) * rng.uniform(0.7, 1))], int(rng.integers(0, len(shared) // 4 + 1))))
        # Distinct hashes of all families mixed in a few members, so that lists of hashes cross families.
        sets += [np.unique(np.concatenate([sets[0][:30], sets[20][:30]])), sets[0], sets[5][: int(len(sets[5]) * 0.82)]]
        s = shard_of(sets)
        links = np.concatenate([np.column_stack(x) for x in simhash_bk.across(s, 0.8)] or [np.zeros((0, 2), int)])
        assert all(simhash_bk.similarity_of(sets[a], sets[b]) >= 0.8 for a, b in links.tolist())
        alike = np.array([(i, j) for i in range(len(sets)) for j in range(i) if simhash_bk.similarity_of(sets[i], sets[j]) >= 0.8]).reshape(-1, 2)
        got, want = (components.local_components(x[:, 0], x[:, 1], len(sets)) for x in (links, alike))
        assert got.tolist() == want.tolist()
