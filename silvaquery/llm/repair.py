"""Conversation structure repair: the cheapest edits that make the roles of a conversation ``(s?(ua)+)?``.

A row's fault is the first of blank (no character but blanks), duplicate (role and text seen earlier in the
conversation) and truncated (its last character that is no blank is none of . ! ?). Keep (K) costs 0, rerole to user or assistant (R) 1,
delete (D) 2, insert an empty user or assistant turn (I) 5; blank and duplicate rows must go, truncated rows that stay cost
5 more. The audit is the string of edits; of cheapest ones the least in ASCII order counts.

Method: a recursive query in DuckDB, inside batches of a hash partitioning. A conversation's rows in order are cut into sections of
``SECTION`` rows, which are dealt by hash, so that no conversation is one task's. In a batch each recursion advances all its sections by one row
and keeps, for each state of the grammar that a section may begin in and each it may be in now, the least cost and its least
audit. (Equal costs allow that: of two audits for the same rows, neither is the beginning of the other, as what follows would be insertions that cost.)
What a section does to states is then an edit of its own: ``SECTION`` sections are put together by the same query, until each conversation is
one. A repaired turn's role follows from its number, so audits are cut by section again and turns are written section by section.

Copies of a row are one row with a count: all but the first are duplicates, so they are deletions behind it.

Defined cases: a null role or text is one blank; null turns come first, rows of a turn are ordered by role, then text; rows without an id are one
conversation; a role's initial is its first character, '' for an empty role, and roles are told apart by it alone; an empty table gives an empty
result; other columns are not read. Digests are of whole conversations by definition, and stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .turns import ORDER, numbered

#: Rows of a section, sections that are put together at a time.
SECTION = 64
#: Rows, or pieces, that one recursive query has in it.
BATCH_ROWS = 20_000
#: States: nothing yet, after a system turn, after a user's, after an assistant's. Costs of edits.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: State after an inserted or reroled turn.
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
BLANK = "\\x20\\x09-\\x0D"


def moves() -> list[tuple]:
    """(state, initial or null for any, state after, cost, audit, whether the row stays): up to two insertions and what is done to the row."""
    out = []
    for state in range(4):
        at, cost, audit = state, 0, ""
        for _ in range(3):
            out.append((state, None, at, cost + DELETE, audit + "D", False))
            out.append((state, None, NEXT[at], cost + REROLE, audit + "R", True))
            out += [(state, c, to, cost, audit + "K", True) for c, to in (("s", SYSTEM), ("u", USER), ("a", ASSISTANT)) if to == NEXT[at] or (at, to) == (EMPTY, SYSTEM)]
            at, cost, audit = NEXT[at], cost + INSERT, audit + "I"
    return out


ADVANCE = """
WITH RECURSIVE best AS (
  SELECT sec, begun, 0 AS k, begun AS state, CAST(0 AS BIGINT) AS cost, '' AS audit FROM start
  UNION ALL
  SELECT sec, begun, k, state, least.cost, least.audit FROM (
    SELECT b.sec, b.begun, b.k + 1 AS k, p.after AS state, min({'cost': b.cost + p.cost, 'audit': b.audit || p.audit}) AS least
    FROM best b JOIN piece p ON p.sec = b.sec AND p.k = b.k AND p.begun = b.state
    GROUP BY b.sec, b.begun, b.k, p.after))
SELECT b.sec, b.begun, b.state, b.cost, b.audit FROM best b JOIN size s ON s.sec = b.sec AND s.n = b.k ORDER BY b.sec
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with nulls as blanks and faults planted by the checksum of ``conv_id:turn``: dropped, emptied, cut, repeated, reroled."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), code.alias("code")).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("times"))
    return rows.withColumn("times", F.explode("times")).drop("times")


class Repair(NamedTuple):
    """``turns(conv_id, section, number, role, text, edit)``: what stays and what is put in; ``audits(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)``."""

    turns: DataFrame
    audits: DataFrame


def faults(rows: DataFrame) -> DataFrame:
    """Numbered rows with ``fault`` ('' where there is none) and ``section``."""
    rows = rows.withColumn("blank", ~F.col("text").rlike(f"[^{BLANK}]")).withColumn("said", F.sha2("text", 256))
    # Only what is said more than once is joined back.
    first = rows.filter("NOT blank").groupBy("conv_id", "role", "said").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("said").alias("s"), "first")
    rows = rows.join(first, (F.col("said") == F.col("s")) & (F.col("role") == F.col("r")) & F.col("conv_id").eqNullSafe(F.col("c")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("place") > F.col("first"), "duplicate").when(~F.col("text").rlike(f"[.!?][{BLANK}]*\\z"), "truncated").otherwise("")
    return rows.select(*ORDER, "copies", "place", fault.alias("fault"), F.floor(F.col("place") / SECTION).cast("long").alias("section"))


def whole_sections(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by ``conv`` and ``section`` as tables that cut no section, with the rows that begin one."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BATCH_ROWS:
            table = pa.Table.from_batches(held)
            cut = begins(table)
            if len(cut) > 1:
                yield table.slice(0, int(cut[-1])), cut[:-1]
                table = table.slice(int(cut[-1]))
            held, size = table.to_batches(), table.num_rows
    if size:
        table = pa.Table.from_batches(held)
        yield table, begins(table)


def begins(table: pa.Table) -> np.ndarray:
    conv, section = table.column("conv").to_numpy(), table.column("section").to_numpy()
    return np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (section[1:] != section[:-1])))


def advanced(con, table: pa.Table, first: np.ndarray) -> pa.Table:
    """The recursive query over the pieces that lie in ``piece``; sections but a conversation's first may begin in any state."""
    sections = table.column("section").to_numpy()[first]
    begun = [(i, s) for i, n in enumerate(sections.tolist()) for s in (range(4) if n else (EMPTY,))]
    con.register("start", pa.table({"sec": [i for i, _ in begun], "begun": pa.array([s for _, s in begun], pa.int32())}))
    out = con.sql(ADVANCE).to_arrow_table()
    at = first[out.column("sec").to_numpy()]
    return pa.table({"conv": table.column("conv").take(at), "section": table.column("section").take(at), **{n: out.column(n) for n in ("begun", "state", "cost", "audit")}})


def connection():
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
    con.execute("CREATE TEMP TABLE move (state INT, initial VARCHAR, after INT, cost BIGINT, audit VARCHAR, stays BOOLEAN)")
    con.executemany("INSERT INTO move VALUES (?, ?, ?, ?, ?, ?)", moves())
    return con


PIECES = "conv string, section long, begun int, state int, cost long, audit string"


def section_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sections -> for each state a section may begin and end in, the cheapest edits; one row more tells its pairs of roles that are not allowed."""
    con = connection()
    for table, first in whole_sections(batches):
        sec = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
        rows = table.append_column("sec", pa.array(sec)).append_column("nth", pa.array(np.arange(table.num_rows)))
        con.register("given", rows)
        con.execute("CREATE OR REPLACE TEMP TABLE row AS SELECT sec, row_number() OVER (PARTITION BY sec ORDER BY nth) - 1 AS k, initial, copies, fault IN ('blank', 'duplicate') AS must_go, fault = 'truncated' AS truncated FROM given WHERE NOT lead")
        con.execute("CREATE OR REPLACE TEMP TABLE size AS SELECT sec, count(*) AS n FROM row GROUP BY sec")
        con.execute("""CREATE OR REPLACE TEMP TABLE piece AS
            SELECT r.sec, r.k, m.state AS begun, m.after, m.cost + 2 * (r.copies - 1) + CASE WHEN m.stays AND r.truncated THEN 5 ELSE 0 END AS cost, m.audit || repeat('D', r.copies - 1) AS audit
            FROM row r JOIN move m ON (m.initial IS NULL OR m.initial = r.initial) AND NOT (m.stays AND r.must_go)""")
        yield from advanced(con, table, first).to_batches()
        # Copies stand side by side, and no role may follow itself.
        pairs = con.sql("""SELECT sec, sum(bad)::BIGINT AS bad FROM (
            SELECT sec, CASE WHEN lead THEN 0 ELSE copies - 1 + CAST(coalesce(lag(initial) OVER (PARTITION BY sec ORDER BY nth) || '>' || initial NOT IN ('s>u', 'u>a', 'a>u'), false) AS INT) END AS bad FROM given)
            GROUP BY sec ORDER BY sec""").to_arrow_table()
        at = first[pairs.column("sec").to_numpy()]
        n = len(at)
        yield pa.RecordBatch.from_arrays([table.column("conv").take(at).combine_chunks(), table.column("section").take(at).combine_chunks(), pa.array([-1] * n, pa.int32()), pa.array([-1] * n, pa.int32()), pairs.column("bad").combine_chunks(), pa.array([""] * n)], names=[x.split()[0] for x in PIECES.split(", ")])
    con.close()


def joined_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces ``nth`` of longer sections -> the pieces of those."""
    con = connection()
    for table, first in whole_sections(batches):
        sec = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
        con.register("given", table.append_column("sec", pa.array(sec)))
        con.execute("CREATE OR REPLACE TEMP TABLE piece AS SELECT sec, nth AS k, begun, state AS after, cost, audit FROM given")
        con.execute("CREATE OR REPLACE TEMP TABLE size AS SELECT sec, max(k) + 1 AS n FROM piece GROUP BY sec")
        yield from advanced(con, table, first).to_batches()
    con.close()


def cut_audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's audit, then its sections with their rows -> each section's part of the audit and the turns that stand before it."""
    names = ["conv", "section", "edits", "before", "led"]
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    audit, at, turns, led = "", 0, 0, False
    for batch in batches:
        out = []
        for conv, section, text, n, last in zip(*(batch.column(c).to_pylist() for c in ("conv", "section", "audit", "rows", "last"))):
            if section is None:
                audit, at, turns = text, 0, 0
                # Users and assistants come in pairs, so one turn more is a system turn in front.
                led = (len(text) - text.count("D")) % 2 == 1
                continue
            to = len(audit)
            if not last:
                to = at
                while n:
                    n -= audit[to] != "I"
                    to += 1
            own = audit[at:to]
            out.append((conv, section, own, turns, led))
            at, turns = to, turns + len(own) - own.count("D")
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


TURNS = "conv string, section long, number long, role string, text string, edit string"


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A section's part of the audit, then its rows -> its repaired turns."""
    names, kinds = [x.split()[0] for x in TURNS.split(", ")], (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    left, number, led, now = "", 0, False, None
    for batch in batches:
        out = []

        def put(role: str | None, text: str, edit: str) -> None:
            nonlocal number
            own = ("assistant", "user")[(number + led) % 2 == 0] if not (led and number == 0) else "system"
            out.append((*now, number, own if role is None else role, text, edit))
            number += 1

        for conv, section, edits, before, first, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv", "section", "edits", "before", "led", "role", "text", "copies"))):
            if edits is not None:
                # What is left of the section before are insertions behind its last row.
                for e in left:
                    put(None, "", e)
                left, number, led, now = edits, before, first, (conv, section)
                continue
            while left[0] == "I":
                put(None, "", "I")
                left = left[1:]
            if left[0] != "D":
                put(role if left[0] == "K" else None, text, left[0])
            left = left[copies:]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
    if left:
        out = []
        for e in left:
            out.append((*now, number, ("assistant", "user")[(number + led) % 2 == 0], "", e))
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def repair(rows: DataFrame) -> Repair:
    """``rows(conv_id, turn, role, text)`` repaired; conversations without rows are not in it."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"))
    # Ids as text from here on, a blank for those without, so that keys are never null.
    rows = written(faults(numbered(rows)).withColumn("conv", shown("conv_id")).drop("conv_id"), "repair-rows")
    both = F.array(F.struct("section", F.lit(False).alias("lead")), F.struct((F.col("section") + 1).alias("section"), F.lit(True).alias("lead")))
    small = rows.select("conv", "place", "copies", "fault", F.substring("role", 1, 1).alias("initial"), F.when(F.col("place") % SECTION == SECTION - 1, both).otherwise(F.slice(both, 1, 1)).alias("s"))
    small = small.select("conv", F.explode("s").alias("s"), "place", "copies", "fault", "initial").select("conv", "s.section", "s.lead", "place", "copies", "fault", "initial")
    made = written(small.repartition("conv", "section").sortWithinPartitions("conv", "section", "place").mapInArrow(section_pieces, PIECES), "repair-sections")
    pieces, top = made.filter("begun >= 0"), (rows.agg(F.max("section")).first()[0] or 0)
    while top:
        dealt = pieces.withColumn("nth", F.col("section") % SECTION).withColumn("section", F.floor(F.col("section") / SECTION).cast("long"))
        pieces = written(dealt.repartition("conv", "section").sortWithinPartitions("conv", "section", "nth").mapInArrow(joined_pieces, PIECES), "repair-joined")
        top //= SECTION
    closing = F.when(F.col("state") == SYSTEM, "II").when(F.col("state") == USER, "I").otherwise("")
    least = F.min(F.struct((F.col("cost") + INSERT * F.length(closing)).alias("cost"), F.concat("audit", closing).alias("audit")))
    audits = written(pieces.filter("begun = 0 AND section = 0").groupBy("conv").agg(least.alias("least")).select("conv", "least.cost", "least.audit"), "repair-audits")

    ends = rows.groupBy("conv").agg(F.max("section").alias("end"))
    sizes = rows.groupBy("conv", "section").agg(F.sum("copies").alias("rows")).join(ends, "conv").select("conv", "section", F.lit(None).cast("string").alias("audit"), "rows", (F.col("section") == F.col("end")).alias("last"))
    told = audits.select("conv", F.lit(None).cast("long").alias("section"), "audit", F.lit(0).cast("long").alias("rows"), F.lit(False).alias("last")).unionByName(sizes)
    edits = told.repartition("conv").sortWithinPartitions("conv", "section").mapInArrow(cut_audits, "conv string, section long, edits string, before long, led boolean")
    none = lambda **kinds: [F.lit(None).cast(t).alias(n) for n, t in kinds.items()]
    texts = rows.select("conv", "section", "place", *none(edits="string", before="long", led="boolean"), "role", "text", "copies")
    heads = edits.select("conv", "section", *none(place="long"), "edits", "before", "led", *none(role="string", text="string", copies="long"))
    turns = texts.unionByName(heads).repartition("conv", "section").sortWithinPartitions("conv", "section", "place").mapInArrow(edited, TURNS)

    spans = rows.groupBy("conv", "turn").agg(F.count(F.lit(1))).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    many = lambda fault, n: F.sum(F.when(fault, n).otherwise(0))
    fault, copies = F.col("fault"), F.col("copies")
    counted = rows.groupBy("conv").agg(many(fault == "blank", copies).alias("blank"), many(fault != "blank", copies - F.when(fault == "duplicate", 0).otherwise(1)).alias("duplicate"), many(fault == "truncated", F.lit(1)).alias("truncated"))
    illegal = made.filter("begun < 0").groupBy("conv").agg(F.sum("cost").alias("illegal"))
    summary = audits.join(spans, "conv").join(counted, "conv").join(illegal, "conv")
    summary = summary.select(own_id(), *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), "audit")
    return Repair(turns.select(own_id(), *(F.col(x.split()[0]) for x in TURNS.split(", ")[1:])), summary)


def own_id() -> Column:
    return F.when(F.col("conv") != " ", F.col("conv")).cast("long").alias("conv_id")


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines; texts stream through, so no conversation is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "role", "text"))):
                if c != conv:
                    if state:
                        out.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], names=["conv", "repaired_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], names=["conv", "repaired_sha256"])

    rows = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), "number", "role", "text")
    return rows.repartition("conv").sortWithinPartitions("conv", "number").mapInArrow(run, "conv string, repaired_sha256 string").select(own_id(), "repaired_sha256")


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """The contract's row for each conversation of ``rows``, after planting faults."""
    done = repair(damaged(rows))
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    # All that is known of a conversation meets in one aggregation.
    said = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", *none("long", *longs), *none("string", "audit", "repaired_sha256"))
    said = said.unionByName(done.audits.select("conv_id", *longs, "audit", *none("string", "repaired_sha256"))).unionByName(digests(done.turns).select("conv_id", *none("long", *longs), *none("string", "audit"), "repaired_sha256"))
    empty = hashlib.sha256().hexdigest()
    return said.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in longs), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"))


ORACLE = """
WITH RECURSIVE keyed AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS named FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(named) + 1), lambda i: CAST(ord(named[i]) AS BIGINT))),
    lambda sum, byte: list_reduce(list_prepend(xor(sum, byte), list_transform(range(8), lambda i: CAST(i AS BIGINT))), lambda x, i: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))), 4294967295) % 20 AS code FROM keyed),
kept AS (
  SELECT conv, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) FROM coded WHERE code <> 0)),
row AS (
  SELECT *, role[1] AS initial, row_number() OVER (PARTITION BY conv, role, text ORDER BY k) AS nth, lag(role[1]) OVER (PARTITION BY conv ORDER BY k) AS before
  FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS k FROM kept)),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM row),
told AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || '>' || initial NOT IN ('s>u', 'u>a', 'a>u')) AS illegal, count(*) AS n FROM faulty GROUP BY conv),
move(state, initial, after, cost, audit) AS (VALUES MOVES),
best AS (
  SELECT conv, CAST(0 AS BIGINT) AS k, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': ''} AS least FROM told
  UNION ALL
  SELECT b.conv, b.k + 1, m.after, min({'cost': b.least.cost + m.cost + CASE WHEN m.audit NOT LIKE '%D' AND f.fault = 'truncated' THEN 5 ELSE 0 END, 'audit': b.least.audit || m.audit})
  FROM best b JOIN faulty f ON f.conv = b.conv AND f.k = b.k + 1 JOIN move m ON m.state = b.state AND (m.initial IS NULL OR m.initial = f.initial) AND (m.audit LIKE '%D' OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY b.conv, b.k, m.after),
final AS (
  SELECT conv, min({'cost': least.cost + CASE state WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'audit': least.audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}) AS least
  FROM best JOIN told USING (conv) WHERE k = n GROUP BY conv),
edit AS (
  SELECT conv, i, least.audit[i] AS edit, length(replace(least.audit[1:i], 'I', '')) AS k, length(replace(least.audit[1:i], 'D', '')) AS number, length(replace(least.audit, 'D', '')) % 2 AS led
  FROM (SELECT conv, least, unnest(range(1, length(least.audit) + 1)) AS i FROM final)),
turn AS (
  SELECT e.conv, e.i, CASE WHEN e.edit = 'K' THEN f.role WHEN (e.number - e.led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e.edit = 'I' THEN '' ELSE f.text END AS line
  FROM edit e LEFT JOIN faulty f ON f.conv = e.conv AND f.k = e.k WHERE e.edit <> 'D'),
whole AS (SELECT conv, string_agg(line, chr(10) ORDER BY i) AS said FROM turn GROUP BY conv)
SELECT k.conv_id, coalesce(t.gaps, 0) AS gaps, coalesce(t.blank, 0) AS blank, coalesce(t.duplicate, 0) AS duplicate, coalesce(t.truncated, 0) AS truncated, coalesce(t.illegal, 0) AS illegal,
  coalesce(f.least.cost, 0) AS cost, coalesce(f.least.audit, '') AS audit, sha256(coalesce(w.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM keyed) k LEFT JOIN told t USING (conv) LEFT JOIN final f USING (conv) LEFT JOIN whole w USING (conv)
""".replace("MOVES", ", ".join(f"({state}, {'NULL' if initial is None else repr(initial)}, {after}, {cost}, {audit!r})" for state, initial, after, cost, audit, _ in moves()))
