"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string; nothing is known of its inside. To
find where each turn lies in the output, successive prefixes of the conversation are rendered and
consecutive outputs compared: where the longer output begins with the shorter one, what it adds is the new
turn's span; where it doesn't, the template rewrites history, the conversation is marked so, and the
spans are given anew by the outputs' common beginning. Where the text sits inside its span is found in the same
way: the turn is rendered with two probe texts, and their first and last differences
frame the text's place.

The production template writes ``### role: text</turn>`` and a newline per turn; the characters \\, # and < in
texts, and : and newlines as well in roles, get a backslash in front, which ``unescape`` takes off again, so no text
can write a control string.

Long conversations: prefixes would cost the square of their length, so a conversation is cut into
sections of ``section`` turns, each rendered after the last turn of the one before as context. Sections are made and
rendered in any task, so neither one long conversation nor many rows without an id are one task's. This is right
for templates whose output for a turn depends on that turn and the one before it only. The production template is known to be such
(``local=True``). Another template is probed first; one that fails is rendered in whole prefixes. Probes can't see what a
template does with texts, so where they find nothing, each conversation of several sections is also rendered once as a whole, and one whose
sections, put together, differ from that, or rewrite turns of the section before, is rendered again in whole prefixes. Digests are of whole
conversations by definition, and stream.

Defined cases: null text is empty, null role is an empty role; a null turn comes first, turns that tie are
ordered by role, then text; a null conv_id is a conversation of its own; repeated rows are turns of their
own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import turns as order_of_turns
from .common import written

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]


def escape(text: str) -> str:
    return re.sub(r"([\\#<])", r"\\\1", text)


def escape_role(role: str) -> str:
    return re.sub(r"([\\#<:\n])", r"\\\1", role)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def marked_turns(turns: Turns) -> str:
    """The production template."""
    return "".join(f"### {escape_role(r)}: {escape(t)}</turn>\n" for r, t in turns)


def parse_marked(text: str) -> Turns:
    """Turns of what ``marked_turns`` wrote."""
    found = re.findall(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", text, flags=re.DOTALL)
    return [(unescape(r), unescape(t)) for r, t in found]


def common_start(a: str, b: str) -> int:
    """Length of the longest common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def text_frame(template: Template, before: Turns, role: str) -> tuple[int, int]:
    """Characters that the template puts before and behind a turn's text, counted from the end of what it wrote for ``before``."""
    base = len(template(before))
    one, two = template([*before, (role, "a")]), template([*before, (role, "b")])
    head = common_start(one, two)
    tail = common_start(one[head:][::-1], two[head:][::-1])
    return head - base, tail


def is_local(template: Template, turns: int = 140) -> bool:
    """Whether outputs only grow and a turn's output depends on itself and the turn before only, on probes."""
    roles = ("system", "user", "assistant", "user", "assistant", "user", "user", "assistant", "assistant", "tool")
    said = [(roles[i % 10] if i < 20 else roles[1 + i % 9], f"probe {i}" * (i % 3)) for i in range(turns)]
    last = template([])
    for n in range(1, len(said) + 1):
        now = template(said[:n])
        if not now.startswith(last):
            return False
        context = said[max(0, n - 2):n - 1]
        if n > 1 and template([*context, said[n - 1]])[len(template(context)):] != now[len(last):]:
            return False
        last = now
    return True


def text_inside(template: Template, turns: Turns, nth: int, out: str) -> tuple[int, int] | None:
    """Where the text of the nth turn lies in the output of all turns, by two probes in its place; None where it is not written."""
    role = turns[nth][0]
    one, two = (template([*turns[:nth], (role, x), *turns[nth + 1:]]) for x in "ab")
    if one == two:
        return None
    head = common_start(one, two)
    return head, len(out) - common_start(one[head:][::-1], two[head:][::-1])


def render(template: Template, turns: Turns, context: Turns = [], marked_role: str = "assistant") -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """(output of ``turns`` behind ``context``, span of each turn, spans of the marked role's texts, whether history was rewritten).

    Where history was rewritten, texts are looked for in the whole output.
    """
    last = template(context)
    base, spans, mask, rewritten = len(last), [], [], False
    for n, (role, _) in enumerate(turns):
        now = template([*context, *turns[:n + 1]])
        start = len(last)
        if not now.startswith(last):
            rewritten, start = True, common_start(now, last)
            spans = [(min(a, start - base), min(b, start - base)) for a, b in spans]
        spans.append((start - base, len(now) - base))
        if role == marked_role and not rewritten:
            head, tail = text_frame(template, [*context, *turns[:n]], role)
            mask.append((len(last) + head - base, len(now) - tail - base))
        last = now
    if rewritten:
        every = [*context, *turns]
        found = [text_inside(template, every, n, last) for n in range(len(context), len(every)) if every[n][0] == marked_role]
        mask = [(max(a - base, 0), max(b - base, 0)) for a, b in filter(None, found)]
    return last[base:], spans, mask, rewritten


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``number``: each turn's place in its conversation, from 0."""
    n = order_of_turns.numbered(rows, "chat-turns")
    return n.select(*order_of_turns.ORDER, F.explode(F.sequence(F.col("number"), F.col("number") + F.col("copies") - 1)).alias("number"))


def strayed(formatted: DataFrame, rows: DataFrame, template: Template) -> DataFrame:
    """``conv_id`` of conversations of several sections that, put together, are not what the template makes of the whole, or whose spans leave their section."""
    several = formatted.filter("section > 0").select("conv_id").distinct().select(F.col("conv_id").alias("c"))
    mine = lambda df: df.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    none = lambda **kinds: [F.lit(None).cast(t).alias(n) for n, t in kinds.items()]
    early = F.exists(F.concat("spans", "mask"), lambda x: x["start"] < 0)
    both = mine(formatted).select("conv_id", F.col("section").alias("at"), F.lit(True).alias("made"), "formatted", early.alias("early"), *none(role="string", text="string"))
    both = both.unionByName(mine(rows).select("conv_id", F.col("number").alias("at"), F.lit(False).alias("made"), *none(formatted="string", early="boolean"), "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[int | None]:
            conv, said, begun, want, wrong = None, [], False, None, False
            for batch in batches:
                for c, made, text, early, role, said_text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "made", "formatted", "early", "role", "text"))):
                    if not begun or c != conv:
                        if begun and (wrong or want):
                            yield conv
                        conv, said, begun, want, wrong = c, [], True, None, False
                    if not made:
                        said.append((role or "", said_text or ""))
                        continue
                    # Turns come before sections; the whole is compared piece by piece.
                    if want is None:
                        want, said = template(said), []
                    wrong |= bool(early) or not want.startswith(text)
                    want = want[len(text):]
            if begun and (wrong or want):
                yield conv

        got = list(found())
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64())], names=["conv_id"])

    return both.repartition("conv_id").sortWithinPartitions("conv_id", "made", "at").mapInArrow(run, "conv_id long")


def format_conversations(rows: DataFrame, template: Template = marked_turns, section: int = 64, marked_role: str = "assistant", local: bool | None = None) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` -> one row per section: ``(conv_id, section, formatted, spans, mask, rewritten)``.

    Spans count code points from the beginning of the section's output; sections in order make up the whole output.
    """
    unsure = local is None
    local = is_local(template, 2 * section + 12) if local is None else local
    fields = "conv_id long, section long, formatted string, spans array<struct<start:long,end:long>>, mask array<struct<start:long,end:long>>, rewritten boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(conv: int | None, number: int, turns: Turns, context: Turns) -> tuple:
            out, spans, mask, rewritten = render(template, turns, context, marked_role)
            pair = lambda x: [{"start": a, "end": b} for a, b in x]
            return conv, number, out, pair(spans), pair(mask), rewritten

        def sections() -> Iterator[tuple]:
            now, turns, context = None, [], []
            for batch in batches:
                for c, part, lead, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "section", "lead", "role", "text"))):
                    if (c, part) != now:
                        if turns:
                            yield made(*now, turns, context)
                        now, turns, context = (c, part), [], []
                    (context if lead else turns).append((role or "", text or ""))
            if turns:
                yield made(*now, turns, context)

        held = []
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.bool_())
        names = ["conv_id", "section", "formatted", "spans", "mask", "rewritten"]
        for x in sections():
            held.append(x)
            if len(held) >= 200:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), kinds)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), kinds)], names=names)

    rows = numbered(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))
    whole = lambda df: df.select("conv_id", F.lit(0).cast("long").alias("section"), F.lit(False).alias("lead"), "number", "role", "text")
    rendered = lambda df: df.repartition("conv_id", "section").sortWithinPartitions("conv_id", "section", "number").mapInArrow(run, fields)
    if not local:
        return rendered(whole(rows))
    # A section's last turn goes to the next one too, as its context.
    own = F.floor(F.col("number") / section).cast("long")
    both = F.array(F.struct(own.alias("section"), F.lit(False).alias("lead")), F.struct((own + 1).alias("section"), F.lit(True).alias("lead")))
    cut = rows.withColumn("s", F.explode(F.when(F.col("number") % section == section - 1, both).otherwise(F.slice(both, 1, 1)))).select("conv_id", "s.section", "s.lead", "number", "role", "text")
    if not unsure:
        return rendered(cut)
    made = written(rendered(cut), "chat-sections")
    wrong = written(strayed(made, rows, template), "chat-strayed").select(F.col("conv_id").alias("c"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    return made.join(wrong, same, "left_anti").unionByName(rendered(whole(rows.join(wrong, same, "left_semi"))))


def digests(formatted: DataFrame) -> DataFrame:
    """What the contract asks, read back from sections: digests go section by section, so no conversation is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_rows() -> Iterator[tuple]:
            conv, begun, state = None, False, None
            for batch in batches:
                for c, text, mask, rewritten in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "mask", "rewritten"))):
                    if not begun or c != conv:
                        if begun:
                            yield conv, *state[:1], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]
                        conv, begun, state = c, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                    for role, said in parse_marked(text):
                        state[0] += 1
                        state[1].update(f"{role}\n{said}\n".encode())
                    for m in mask:
                        said = unescape(text[m["start"]:m["end"]])
                        state[2] += len(said)
                        state[3].update(said.encode())
                    state[4] += len(text)
                    state[5] |= rewritten
            if begun:
                yield conv, *state[:1], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        held = []
        for x in all_rows():
            held.append(x)
            if len(held) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), kinds)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), kinds)], names=names)

    rows = formatted.select("conv_id", "section", "formatted", "mask", "rewritten").repartition("conv_id").sortWithinPartitions("conv_id", "section")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean")


def formatted_digests(rows: DataFrame) -> DataFrame:
    return digests(written(format_conversations(rows, local=True), "chat"))
