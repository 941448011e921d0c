"""Chat formatting by incremental rendering of a template that is only called, never looked into.

A template is a function from turns to text. It is called with successive
prefixes of a conversation; where each output begins with the one before, the
added piece is the new turn's span. Two more calls with other texts in the last
turn's place tell what of the piece is the template's and what is the text: the
pieces' common start and common end. A turn whose output does not begin with the
one before rewrites history; that is reported, and spans that the change reaches
are dropped, so that no loss falls on text that is not there any more.

Conversations are cut into blocks of BLOCK turns, each rendered by itself behind
the CONTEXT turns before it, so that a conversation of any length is spread over
the cluster and a turn costs at most as much as BLOCK + CONTEXT of them. That a
template looks no further back is checked: the first turn of a block must read
the same behind one turn less. Rows get their place in a conversation from a
range sort; the driver sees one row for each partition of it.

Edge cases: null text and null role are empty; rows without conv_id are one
conversation; turns that are equal or null are ordered by (turn, nulls first, hash
of role and text); repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, settle

BLOCK, CONTEXT = 32, 2
LOSS_ROLES = ("assistant",)

Turn = tuple[str, str]
SPAN = "role string, start long, stop long, body long, body_stop long, loss boolean"


@dataclass(frozen=True)
class Template:
    """``render`` is the black box; ``unescape`` and ``parse`` undo it where a reader wants the turns back."""

    render: Callable[[list[Turn]], str]
    unescape: Callable[[str], str]
    parse: Callable[[str], list[Turn]]


_TURN = re.compile(r"<turn ((?:[^\\>]++|\\.)*+)>\n((?:[^\\<]++|\\.|<(?!turn |/turn>))*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def _escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<turn ", "\\<turn ").replace("</turn>", "\\</turn>")


def _mark(turns: list[Turn]) -> str:
    return "".join(f"<turn {role.replace('\\', '\\\\').replace('>', '\\>')}>\n{_escape(text)}</turn>\n" for role, text in turns)


def _unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def _parse(text: str) -> list[Turn]:
    turns, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn begins at character {at}")
        turns.append((_unescape(found[1]), _unescape(found[2])))
        at = found.end()
    return turns


#: Turns between marks. A backslash goes before every backslash and every control string of a text, so any text can be read back.
MARKED = Template(_mark, _unescape, _parse)


def _common(a: str, b: str) -> int:
    """Length of the common start."""
    return len(os.path.commonprefix([a, b]))


def spans(render: Callable[[list[Turn]], str], turns: list[Turn], context: list[Turn] = (), loss_roles: tuple[str, ...] = LOSS_ROLES) -> tuple[str, list[tuple], str | None]:
    """The text that ``turns`` add behind ``context``, a span for each turn still in place, and what is wrong with the template.

    A span is (role, start, stop, body, body_stop, loss) in code points of the
    text; body is where the turn's own text stands, found for turns under loss.
    """
    before, fault, found = list(context), None, []
    base = out = render(before) if before else ""
    shift = len(base)
    for k, (role, text) in enumerate(turns):
        now = render([*before, (role, text)])
        kept = len(out)
        if not now.startswith(out):
            kept = _common(out, now)
            fault = fault or f"turn {k} rewrites what stood from character {kept - shift}"
            found = [s for s in found if s and s[2] <= kept] if kept >= shift else []
            shift = min(shift, kept)
        body = body_stop = None
        if role in loss_roles:
            pieces = [render([*before, (role, probe)]) for probe in "ab"]
            if all(p.startswith(now[:kept]) for p in pieces):
                a, b, own = pieces[0][kept:], pieces[1][kept:], now[kept:]
                head, tail = _common(a, b), _common(a[::-1], b[::-1])
                if own[:head] == a[:head] and (not tail or own[-tail:] == a[-tail:]) and head + tail <= len(own):
                    body, body_stop = kept + head, len(now) - tail
            if body is None:
                fault = fault or f"turn {k}: the place of its text was not found"
        if k == 0 and len(before) > 1 and not fault:
            short = before[1:]
            if render([*short, (role, text)])[len(render(short)) :] != now[kept:]:
                fault = f"the template looks more than {len(before) - 1} turns back"
        found.append((role, kept, len(now), body, body_stop, body is not None))
        before.append((role, text))
        out = now
    return out[shift:], [tuple(x - shift if isinstance(x, int) and not isinstance(x, bool) else x for x in s) for s in found], fault


def _placed(rows: DataFrame) -> DataFrame:
    """conv, role, text and the place of each row in its conversation, from 0."""
    order = ["conv", "turn", "tie"]
    ranged = rows.withColumn("tie", F.xxhash64("role", "text")).repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text", F.spark_partition_id().alias("part"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = object(), 0
        for batch in batches:
            local = []
            for conv in batch.column("conv").to_pylist():
                last, n = conv, n + 1 if conv == last else 0
                local.append(n)
            yield batch.append_column("local", pa.array(local, pa.int64()))

    held = settle(ranged.mapInArrow(number, ranged.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", local bigint"))
    # A row a partition: its first conversation, and its last one with the rows it has there.
    edges = held.groupBy("part").agg(F.min(F.struct("conv")).alias("first"), F.max(F.struct("conv", "local")).alias("last")).orderBy("part").collect()
    carried, rows_before, offsets = object(), 0, []
    for e in edges:
        first, last, n = e["first"]["conv"], e["last"]["conv"], e["last"]["local"] + 1
        offset = rows_before if first == carried else 0
        if offset:
            offsets.append((e["part"], first, offset))
        carried, rows_before = last, n + (offset if first == last else 0)
    if not offsets:
        return held.select("conv", "role", "text", F.col("local").alias("place"))
    table = held.sparkSession.createDataFrame(offsets, f"part int, starts {held.schema['conv'].dataType.simpleString()}, offset long")
    place = F.col("local") + F.when(F.col("conv").eqNullSafe(F.col("starts")), F.coalesce("offset", F.lit(0))).otherwise(0)
    return held.join(F.broadcast(table), "part", "left").select("conv", "role", "text", place.alias("place"))


def format_chats(rows: DataFrame, template: Template = MARKED, block: int = BLOCK, context: int = CONTEXT, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, block, first_turn, n_turns, text, spans, fault), blocks in order being the conversation's text."""
    own = rows.select(F.col("conv_id").alias("conv"), F.col("turn").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    placed = _placed(own)
    home = F.floor(F.col("place") / block).cast("long")
    # The last turns of a block are the next one's context too.
    blocks = F.when(F.col("place") % block >= block - context, F.array(home, home + 1)).otherwise(F.array(home))
    dealt = placed.withColumn("block", F.explode(blocks)).repartition("conv", "block").sortWithinPartitions("conv", "block", "place")
    conv_type = dealt.schema["conv"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("body", pa.int64()), ("body_stop", pa.int64()), ("loss", pa.bool_())]))
    names = ["role", "start", "stop", "body", "body_stop", "loss"]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, made, kind = None, [], [], None

        def finish() -> None:
            at = key[1] * block
            ahead, turns = [g[1:] for g in group if g[0] < at], [g[1:] for g in group if g[0] >= at]
            if turns:  # else a block of context alone: the conversation ends before it
                text, found, fault = spans(template.render, turns, ahead, loss_roles)
                made.append((*key, at, len(turns), text, [dict(zip(names, s, strict=True)) for s in found], fault))

        def out() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) or [[]] * 7
            types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.string(), span_type, pa.string()]
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "block", "first_turn", "n_turns", "text", "spans", "fault"])

        for batch in batches:
            give_back()
            kind = batch.schema.field("conv").type
            for conv, b, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "block", "place", "role", "text")), strict=True):
                if (conv, b) != key:
                    if key:
                        finish()
                    key, group = (conv, b), []
                group.append((place, role, text))
                if len(made) >= 500:
                    yield out()
        if key:
            finish()
            yield out()

    return dealt.select("conv", "block", "place", "role", "text").mapInArrow(render, f"conv_id {conv_type}, block long, first_turn long, n_turns long, text string, spans array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>, fault string")


def digests(formatted: DataFrame, template: Template = MARKED) -> DataFrame:
    """What can be read back from formatted conversations: turns, and the text under the loss mask, as counts and digests.

    A digest takes a conversation's text in order, so the blocks of one
    conversation stream through one task; it holds one block at a time. Fails
    where a template rewrote history.
    """
    conv_type = formatted.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, made, kind = None, [], None

        def out() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) or [[]] * 6
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def finish() -> None:
            conv, n, turns, chars, loss, length = state
            made.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), length))

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, text, found, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "spans", "fault")), strict=True):
                if fault:
                    raise ValueError(f"conversation {conv}: {fault}")
                if state is None or conv != state[0]:
                    if state:
                        finish()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in template.parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for s in found:
                    if s["loss"]:
                        said = template.unescape(text[s["body"] : s["body_stop"]])
                        state[3] += len(said)
                        state[4].update(said.encode())
                state[5] += len(text)
            if len(made) >= 500:
                yield out()
        if state:
            finish()
            yield out()

    return formatted.select("conv_id", "block", "text", "spans", "fault").repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(read, f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
