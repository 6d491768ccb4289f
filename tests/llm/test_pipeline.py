"""The pipeline's stages on awkward rows and on a small table."""

import collections

import numpy as np
import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def small(spark, sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(None, "no id of its own", None, None, None), (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "word " * 20_000, None, None, 1), (9003, "word " * 20_000, None, None, 1)], docs.schema)
    docs.unionByName(more).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages_in_order(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "mix", "pack"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if name != "pack":
            assert docs.columns == columns
        if name == "near_duplicates":
            ids = [r.doc_id for r in docs.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "mix":
            copies = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
            assert max(copies.values()) <= 2
    assert counts[1] <= counts[0] and counts[2] > 0.9 * counts[1] and counts[3] <= counts[2]
    size = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in size) <= 2048
    assert np.mean([r[1] for r in size]) > 1800


def brute_pipeline(spark, docs, sf_dir):
    """The five stages row by row in Python, with the models that the stages fit -> doc_ids kept after each, and copies."""
    import hashlib
    import math
    import zlib

    from pyspark.sql import functions as F

    from silvaquery.llm import components, crf, langid
    from silvaquery.llm.common import fold

    words = lambda t: (t or "").encode().lower().split()
    learn = F.coalesce(fold("doc_id", 5) != 0, F.lit(False))
    model, _ = crf.fit_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(learn), learn)
    rows, steps = [r.asDict() for r in docs.collect()], []

    def toxic(text):
        e = [math.exp(min(30.0, max(-30.0, sum(model.weights[f] for f in crf.features(w))))) for w in words(text)]
        a, n = np.exp(model.trans), len(e)
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
        top = min(max(p.max(initial=1e-6), 1e-6), 1 - 1e-6)
        return model.logistic @ [1, math.log(top / (1 - top)), math.log1p(p.sum()), math.log1p(n)] >= 0

    rows = [r for r in rows if not toxic(r["text"])]
    steps.append([r["doc_id"] for r in rows])
    lang = langid.fit_sample(spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema), fold("doc_id", 4) != 2)

    def known(text):
        if not text or not any(c.isalpha() for c in text):
            return False
        h = [v for w in words(text) for v in langid.subwords(w)]
        z = (np.mean([lang.scores[v % lang.buckets] for v in h], axis=0) + lang.bias) / lang.temperature
        p = np.exp(z - z.max())
        four = [zlib.crc32((b"<" + w + b">")[i:i + 4]) for w in words(text) for i in range(len(w) - 1)]
        n, share = max(len(four), 1), (sum(int(lang.seen(np.array([v]))[0]) for v in four)) / max(len(four), 1)
        return p.max() / p.sum() >= langid.SURE and share + 3 * math.sqrt(max(share * (1 - share), 1 / n) / n) >= lang.floor

    rows = [r for r in rows if known(r["text"])]
    steps.append([r["doc_id"] for r in rows])
    sets = []
    for r in rows:
        w = words(r["text"])
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    u, v = np.array(links or np.zeros((0, 2), int)).reshape(-1, 2).T
    label = components.local_components(u, v, len(rows))
    keep = {}
    for r, c in zip(rows, label.tolist()):
        old = keep.setdefault(c, r)
        if old["doc_id"] is None or (r["doc_id"] is not None and r["doc_id"] < old["doc_id"]):
            keep[c] = r
    rows = list(keep.values())
    steps.append([r["doc_id"] for r in rows])
    groups = collections.defaultdict(list)
    for r in rows:
        groups["t" if r["source"] is None else "s" + r["source"]].append(r)
    size = {k: sum(len(words(r["text"])) for r in g) for k, g in groups.items()}
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(sorted(groups))}
    left, open_, target = 1.5 * sum(size.values()), set(groups), {}
    while open_:
        level = left / sum(weight[k] for k in open_)
        over = [k for k in open_ if level * weight[k] > 2 * size[k]]
        for k in over or list(open_):
            target[k] = 2.0 * size[k] if over else level * weight[k]
            left -= target[k]
            open_.remove(k)
    taken = []
    for k, g in groups.items():
        shift = int(hashlib.md5(f"mix:{k}".encode()).hexdigest()[:8], 16) / 2**32
        rate = target[k] / size[k] if size[k] else 0.0
        hashed = lambda r: hashlib.md5(("n" + (r["text"] or "") if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()
        for n, r in enumerate(sorted(g, key=lambda r: (len(words(r["text"])), hashed(r))), 1):
            taken += [r] * int(math.floor(n * rate + shift) - math.floor((n - 1) * rate + shift))
    steps.append([r["doc_id"] for r in taken])
    return steps, taken


def test_run_against_brute_force(spark, small):
    from tokenizers import Tokenizer

    from silvaquery.llm.encoding import vocabulary_path

    docs = spark.read.parquet(f"{small}/documents.parquet")
    steps, taken = brute_pipeline(spark, docs, small)
    now = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], steps):
        now = corpus_pipeline.written(stage(spark, now, small), f"test-{name}")
        assert sorted(map(str, (r.doc_id for r in now.select("doc_id").collect()))) == sorted(map(str, want)), name
    t = Tokenizer.from_file(vocabulary_path())
    want = collections.Counter()
    for r, e in zip(taken, t.encode_batch([r["text"] or "" for r in taken], add_special_tokens=False)):
        want[r["doc_id"], len(e.ids) + 1] += len(e.ids) + 1
    got = collections.Counter()
    for p in corpus_pipeline.run(spark, small).collect():
        got[p.doc_id, p.doc_tokens] += p.length
    assert got == want


def test_run_on_empty_documents(spark, small, tmp_path):
    d = tmp_path / "none"
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, str(d)).count() == 0
