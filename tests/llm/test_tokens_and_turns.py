"""Structure repair, alignment and token counts against brute force and the tokenizers' libraries."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from silvaquery.llm import alignment, queries, repair, transducer, turns
from silvaquery.llm.encoding import vocabulary_path

# ---------------------------------------------------------------- 11

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if v is None else str(v) for v in (conv, turn, role, text))
        code = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def brute_repair(rows):
    """Row by row with whole outputs kept for each state."""
    after, result = {"": "u", "s": "u", "u": "a", "a": "u"}, {}
    named = {"u": "user", "a": "assistant"}
    hurt = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        known = [r[1] for r in own if r[1] is not None]
        faults, seen = [], set()
        for _, _, role, text in own:
            said = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        first = [r[2][:1] for r in own]

        def better(layer, state, new):
            if state not in layer or new[:2] < layer[state][:2]:
                layer[state] = new

        def inserted(layer):
            for _ in range(3):
                for state, (cost, audit, out) in list(layer.items()):
                    better(layer, after[state], (cost + 5, audit + "I", (*out, (named[after[state]], ""))))
            return layer

        layer = {"": (0, "", ())}
        for (_, _, role, text), fault, c in zip(own, faults, first):
            new = {}
            for state, (cost, audit, out) in inserted(layer).items():
                better(new, state, (cost + 2, audit + "D", out))
                if fault not in ("b", "d"):
                    more, to = 5 * (fault == "t"), after[state]
                    better(new, to, (cost + 1 + more, audit + "R", (*out, (named[to], text))))
                    if c == to or (state, c) == ("", "s"):
                        better(new, c, (cost + more, audit + "K", (*out, (role, text))))
            layer = new
        cost, audit, out = min(x for s, x in inserted(layer).items() if s in ("", "a"))
        result[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *map(faults.count, "bdt"), sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit,
                        hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest())
    return result


def made_up(seed=3):
    pick = random.Random(seed)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(pick.choice([0, 1, 3, 8, 20, 90])):
            rows.append((conv, pick.choice([None, turn, turn, turn, turn // 2, turn * 3]), pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), pick.choice(["a b.", "ok", "  ", None, "", "done!\n", "x y z?", f"n{turn}.", f"m{turn}"])))
    return rows + rows[:50]


def repaired(df):
    got = df.collect()
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    out = {r[0]: tuple(r[1:]) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("section", [64, 3])
def test_repair_against_brute_force(spark, monkeypatch, section):
    """Sections of three rows are put together in several rounds; extra columns do not interfere."""
    monkeypatch.setattr(repair, "SECTION", section)
    rows = made_up()
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("section", F.lit(1)).withColumn("audit", F.lit("x"))
    assert repaired(repair.repaired_conversations(df)) == brute_repair(rows)


def test_repair_sql_and_small_batches(spark, sf, monkeypatch):
    monkeypatch.setattr(repair, "BATCH_ROWS", 40)
    got = repaired(queries.op11_repair(spark, sf))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert got == {r[0]: r[1:] for r in con.execute(repair.ORACLE).fetchall()}


def test_repair_empty_and_all_dropped(spark):
    assert repaired(repair.repaired_conversations(spark.createDataFrame([], CONVERSATIONS))) == {}
    lost = [(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = repaired(repair.repaired_conversations(spark.createDataFrame(lost, CONVERSATIONS)))
    assert got == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c, *_ in lost}


def test_repaired_turns(spark):
    """Whole turns, not only their digest: a missing answer is put in, a user's second turn in a row becomes the assistant's."""
    said = [(1, 0, "system", "s."), (1, 1, "user", "q."), (1, 2, "assistant", "a."), (1, 3, "user", "last."), (1, 4, "user", "  "), (1, 5, "user", "r."), (2, 0, "user", "only.")]
    done = repair.repair(spark.createDataFrame(said, CONVERSATIONS))
    out = sorted(tuple(r) for r in done.turns.select("conv_id", "number", "role", "text", "edit").collect())
    assert out == [(1, 0, "system", "s.", "K"), (1, 1, "user", "q.", "K"), (1, 2, "assistant", "a.", "K"), (1, 3, "user", "last.", "K"), (1, 4, "assistant", "r.", "R")]
    assert {r.conv_id: (r.cost, r.audit) for r in done.audits.collect()} == {1: (3, "KKKKDR"), 2: (2, "D")}


def test_numbered_copies_and_one_conversation_over_ranges(spark):
    rows = [(5, i % 700, "user", f"t{i % 7}") for i in range(1400)] + [(None, None, None, None)] * 3
    got = turns.numbered(spark.createDataFrame(rows, CONVERSATIONS).repartition(4)).collect()
    for conv in (5, None):
        own = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own)))
        assert [r.number for r in own] == [sum(x.copies for x in own[:i]) for i in range(len(own))]
        assert [(r.turn or 0, r.text) for r in own] == sorted((r.turn or 0, r.text) for r in own)
    assert sum(r.copies for r in got) == len(rows)


# ---------------------------------------------------------------- 12

DOCS = "doc_id long, text string, n_a long, block string"


def brute_alignment(rows):
    """Byte ranges of single tokens, all pairs that overlap."""
    pair, counts, docs = alignment.both(None, None), collections.Counter(), []
    for doc, text in rows:
        (a,), (b,) = pair.tokens([text])
        spans = []
        for ids, known in ((a, pair.bytes_a), (b, pair.bytes_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(known[i]), i))
                at += len(known[i])
            spans.append(own)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        groups = "; ".join("|".join(",".join(str(x[2]) for x in own if lo < x[1] <= hi) for own in spans) for lo, hi in zip([0, *cuts], cuts)).replace("; ", ";")
        counts.update(links)
        docs.append((doc, len(a), len(b), len(cuts), links, hashlib.sha256(groups.encode()).hexdigest() if a else ""))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted((str(d), na, nb, ng, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), h) for d, na, nb, ng, links, h in docs)


def texts(sf, spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    odd = ["", None, "  two  blanks \n\n\t", "▁ is a blank to one", "日本語 🙂 é é", "<|endoftext|></s><s> plain", "x" * 3000, "\x00\x01", "nul\x00", "ﬁ İstanbul"]
    return rows + [(1000 + i, t) for i, t in enumerate(odd)] + rows[:2] + [(None, "no id")]


def test_alignment_against_all_pairs(spark, sf, monkeypatch):
    monkeypatch.setattr(alignment, "PART_BYTES", 2000)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 9000)
    monkeypatch.setattr(alignment, "ROW_PAIRS", 50)
    rows = texts(sf, spark)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], DOCS).repartition(3)
    got = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.align_documents(df).collect())
    assert got == brute_alignment(rows)
    assert ("1003", 0, 0, 0, 0, 0, 0, "") in got


def test_alignment_without_tokens(spark):
    for rows in ([], [(1, None, 0, ""), (2, "", 0, "")]):
        got = alignment.align_documents(spark.createDataFrame(rows, DOCS)).collect()
        assert sorted(tuple(r) for r in got) == [(i, 0, 0, 0, 0, "", 0, 0) for i, *_ in rows]


# ---------------------------------------------------------------- 13


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary_path())
    return lambda rows: [len(e.ids) for e in own.encode_batch(rows, add_special_tokens=False)]


def hard_texts():
    pick = random.Random(1)
    out = ["", "'s", "'sam", "''s", "I'll've 're 'r 'v 've '", "İstanbul ΣΑΣ ΟΔΟΣ Σ", "école ﬁ ﬀ", "<|endoftext|>a<|startoftext|> <|endoftext|>", "<|ENDOFTEXT|>", "a b c\u0085d", "1234567 ½ ²", "日本語 テキスト", "🙂🙂 a🙂b", "KΩ ẞ", "x" * 5000, "aaab" * 3000, "'" * 3000, "\x00\x01\x1c"]
    for letters in ("ab", "the ing'sd", "abcdefghijklmnopqrstuvwxyz", "'stremvldx \n!?", "éüßñ aeçà", "́̀eoaΣς İıß", "0123456789 ab", "!?.,'-\"<|>endoftext"):
        out += ["".join(pick.choice(letters) for _ in range(pick.choice([3, 8, 40, 400]))) for _ in range(120)]
    out += ["".join(chr(pick.choice([pick.randrange(0x20, 0x7F), pick.randrange(0xA0, 0x800), pick.randrange(0x900, 0xD7FF), pick.randrange(0x1F000, 0x1F900)])) for _ in range(30)) for _ in range(120)]
    return out


def test_transducer_counts_as_the_library(library):
    machine, rows = transducer.Transducer(vocabulary_path()), hard_texts()
    assert machine.counts(rows).tolist() == library(rows)
    assert machine.counts([]).tolist() == [] and machine.counts([None]).tolist() == [0]


def test_chunk_maps_meet_whatever_was_guessed(library, monkeypatch):
    """With chunks of a few characters and hardly any context most maps are tabulated anew, and the counts stay."""
    monkeypatch.setattr(transducer, "CHUNK", 4)
    monkeypatch.setattr(transducer, "WARM_UP", 1)
    monkeypatch.setattr(transducer, "BATCH_CHARS", 3000)
    rows = hard_texts()[14:400]
    assert transducer.Transducer(vocabulary_path()).counts(rows).tolist() == library(rows)


def test_states_are_made_anew(library, monkeypatch):
    monkeypatch.setattr(transducer, "KEPT_STATES", 50)
    machine, rows = transducer.Transducer(vocabulary_path()), hard_texts()[:60]
    assert [machine.counts([t])[0] for t in rows] == library(rows)
    assert len(machine.states) < 20_000


def test_documents_counted(spark, sf, library):
    got = queries.op13_transducer(spark, sf).collect()
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in got} == dict(zip(rows, library(list(rows.values()))))
    assert all(r.n_bytes == len(rows[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048) for r in got)


def test_count_tokens_keeps_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "a a", 7)], "doc_id long, text string, n_tokens int")
    got = transducer.count_tokens(df, limit=1)
    assert got.columns == ["doc_id", "text", "n_tokens", "n_bytes", "_n_tokens", "over_limit"]
    assert sorted((r.n_tokens, r.n_bytes, r._n_tokens, r.over_limit) for r in got.collect()) == [(5, 0, 0, False), (6, 0, 0, False), (7, 3, 2, True)]
    assert transducer.count_tokens(df.limit(0)).count() == 0
