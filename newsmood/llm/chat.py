"""Conversations as training texts: turns between markers, and a mask of what the loss counts.

A turn is an opening marker, its text and a closing marker. Markers inside a text (or the name of a
role) are escaped reversibly: a backslash goes behind their first character, and a marker that has
backslashes there already gets one more. So a text never holds a marker, whatever it says.

Formatting is columnar byte assembly. Turns are sorted by conversation across tasks; a task takes
a few megabytes of them, computes the lengths of all segments (markers, pieces of text between
escapes), their cumulative offsets and the place of every byte with numpy, and copies markers and
texts into one preallocated buffer, which becomes the Arrow column as it is.

Turns are dealt by ranges of (conversation, turn), so a conversation of any size is shared by many
tasks; it comes out in parts cut between turns, in the order of ``part``. A conversation is whole in
its row unless ``edge`` is set: the first and last of a task, and those beyond ``PART`` bytes. A
marker's code points count like any others; ``loss`` holds the spans of assistant texts (code points
of the part, end exclusive).

Rows of a conversation stand by turn (null first), then role and text; repeated rows stay. A null
text or role is empty. Rows without a conversation id are one conversation without an id. Columns
beyond the four do not come out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from newsmood.llm.words import raw, row_of, slices

PART = 8 << 20
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Opening and closing markers by role, those of other roles, and the roles the loss counts.

    A marker begins with a character that no other place of a marker's rest may complete to one:
    markers in brackets of any kind do.
    """

    roles: dict = field(
        default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
    )
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    loss: tuple[str, ...] = ("assistant",)

    def markers(self) -> list[str]:
        return sorted({m for pair in self.roles.values() for m in pair} | set(self.other))

    def pattern(self, least: int) -> str:
        """A marker's first character before ``least`` or more escapes and the rest of it."""
        ends = [f"{re.escape(m[0])}(?=({re.escape(ESCAPE)}{{{least},}}{re.escape(m[1:])}))" for m in self.markers()]
        return "|".join(ends)

    def escape(self, text: str) -> str:
        return re.sub(self.pattern(0), lambda m: m[0] + ESCAPE, text)

    def unescape(self, text: str) -> str:
        return re.sub(f"({self.pattern(1)}){re.escape(ESCAPE)}", lambda m: m[1], text)

    def around(self, role: str) -> tuple[bytes, bytes]:
        """What stands before and after a text of this role."""
        if role in self.roles:
            before, after = self.roles[role]
        else:
            before, after = self.other[0] + self.escape(role) + self.other[1], self.other[2]
        return before.encode(), after.encode()


def turns_of(text: str, template: Template) -> Iterator[tuple[str, int, int]]:
    """Role, start and end of the escaped text of each turn of a formatted text."""
    opened = {pair[0]: (role, pair[1]) for role, pair in template.roles.items()}
    marker = re.compile("|".join(re.escape(m) for m in sorted(template.markers(), key=len, reverse=True)))
    at = 0
    while at < len(text):
        first = marker.match(text, at)
        if first is None:
            raise ValueError(f"no turn begins at {at}")
        if first[0] == template.other[0]:
            named = marker.search(text, first.end())
            role, start, close = template.unescape(text[first.end() : named.start()]), named.end(), template.other[2]
        else:
            (role, close), start = opened[first[0]], first.end()
        last = marker.search(text, start)
        if last is None or last[0] != close:
            raise ValueError(f"the turn at {at} has no end")
        yield role, start, last.start()
        at = last.end()


def assemble(part: pa.RecordBatch, template: Template, escapes: re.Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all turns of a batch (role, text), the offset of each turn, and of its text's start
    and end."""
    data, at = raw(part.column("text"))
    n = part.num_rows
    # Escapes stand behind the first character of a marker that ends within its own text.
    hits = [(m.start() + 1, m.end(m.lastindex)) for m in escapes.finditer(data.tobytes())]
    spots = np.array(hits, np.int64).reshape(-1, 2)
    spots = spots[np.searchsorted(at, spots[:, 0] - 1, "right") == np.searchsorted(at, spots[:, 1] - 1, "right")][:, 0]
    owner = np.searchsorted(at, spots - 1, "right") - 1
    more = np.bincount(owner, minlength=n)

    roles = part.column("role").fill_null("").dictionary_encode()
    kinds = [template.around(r) for r in roles.dictionary.to_pylist()]
    kind = roles.indices.to_numpy()
    before = np.array([len(k[0]) for k in kinds], np.int64)[kind]
    after = np.array([len(k[1]) for k in kinds], np.int64)[kind]
    size = np.diff(at)
    ends = np.cumsum(before + size + more + after)
    turn = np.concatenate([np.zeros(1, np.int64), ends])
    start, end = turn[:-1] + before, ends - after

    out = np.empty(int(turn[-1]), np.uint8)
    # Every byte moves by the start of its text and the escapes of that text up to it.
    rank = np.arange(len(spots)) - (np.cumsum(more) - more)[owner]
    cuts = np.concatenate([at[:-1], spots])
    shift = np.concatenate([start - at[:-1], (start - at[:-1])[owner] + rank + 1])
    order = np.argsort(cuts, kind="stable")
    cuts, shift = cuts[order], shift[order]
    length = np.diff(np.append(cuts, len(data)))
    out[np.arange(len(data)) + np.repeat(shift, length)] = data
    out[spots + (start - at[:-1])[owner] + rank] = ord(ESCAPE)
    for k, (left, right) in enumerate(kinds):
        rows = np.flatnonzero(kind == k)
        out[turn[rows][:, None] + np.arange(len(left))] = np.frombuffer(left, np.uint8)
        out[end[rows][:, None] + np.arange(len(right))] = np.frombuffer(right, np.uint8)
    return out, turn, start, end


def _spans(starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    spans = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)


def format_chats(
    rows: DataFrame, template: Template | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_bytes: int = PART
) -> DataFrame:
    """``conv_id, part, edge, n_turns, text, loss`` of all conversations."""
    template = template or Template()
    turns = rows.select(rows[conv_id].alias("conv_id"), rows[turn].alias("turn"), rows[role].cast("string").alias("role"), rows[text].cast("string").alias("text"))
    dealt = turns.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = T.StructType(
        [turns.schema["conv_id"], *T.StructType.fromDDL("part long, edge boolean, n_turns long, text string, loss array<struct<start: long, end: long>>")]
    )
    escapes = template.pattern(0).encode()

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, pattern = to_arrow_schema(schema), re.compile(escapes)
        task, done = TaskContext.get().partitionId() << 32, 0

        def formatted(block: pa.RecordBatch, first: np.ndarray, edges: set[int]) -> pa.RecordBatch:
            """The conversations of a block, which begin at the rows ``first``."""
            nonlocal done
            out, at, start, end = assemble(block, template, pattern)
            bounds = np.append(first, block.num_rows)
            chars = np.concatenate([np.zeros(1, np.int64), np.cumsum((out & 0xC0) != 0x80)])
            counted = np.isin(np.array(block.column("role").fill_null("").to_pylist(), object), list(template.loss))
            base = chars[at[bounds[:-1]]][row_of(bounds)][counted]
            inside = np.searchsorted(np.flatnonzero(counted), bounds)
            texts = pa.StringArray.from_buffers(len(first), pa.py_buffer(at[bounds].astype(np.int32)), pa.py_buffer(out))
            n = len(first)
            columns = [
                block.column("conv_id").take(pa.array(first)),
                pa.array(task + done + np.arange(n)),
                pa.array([i in edges for i in range(n)]),
                pa.array(np.diff(bounds)),
                texts,
                _spans(chars[start[counted]] - base, chars[end[counted]] - base, inside),
            ]
            done += n
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        held, cut, begun = None, False, False
        for batch in batches:
            for part in slices(batch, "text"):
                block = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                code = block.column("conv_id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                first = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(np.diff(code)) + 1])
                last = int(first[-1])
                if last:  # all but the last conversation are complete here
                    yield formatted(block.slice(0, last), first[:-1], {0} if cut or not begun else set())
                    begun, cut = True, False
                held = block.slice(last)
                if len(raw(held.column("text"))[0]) >= part_bytes:
                    yield formatted(held, np.zeros(1, np.int64), {0})
                    held, cut, begun = None, True, True
        if held is not None:
            yield formatted(held, np.zeros(1, np.int64), {0})

    return dealt.mapInArrow(run, schema)


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, read back from formatted texts: its turns as they were, and the
    text under the loss mask without escapes.

    Whole conversations are read where they lie. Parts of others meet in their order; a digest of
    one conversation is a chain, so one task streams its parts and holds one of them at a time.
    """
    template = template or Template()
    columns = ["conv_id", "text", "loss"]
    schema = T.StructType([formatted.schema["conv_id"], *T.StructType.fromDDL(DIGEST)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        now, state = None, None

        def row():
            n, turns, chars, loss, size = state
            values = [now[0], n, turns.hexdigest(), chars, loss.hexdigest(), size]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                name, text, loss = ((batch.column(k)[i].as_py(),) if k == 0 else batch.column(k)[i].as_py() for k in range(3))
                if name != now:
                    if now is not None:
                        done.append(row())
                    now, state = name, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(text)
                for role, a, b in turns_of(text, template):
                    state[0] += 1
                    state[1].update(f"{role}\n{template.unescape(text[a:b])}\n".encode())
                for span in loss:
                    plain = template.unescape(text[span["start"] : span["end"]])
                    state[2] += len(plain)
                    state[3].update(plain.encode())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if now is not None:
            yield row()

    whole = formatted.where("NOT edge").select(columns).mapInArrow(run, schema)
    parts = formatted.where("edge").repartition("conv_id").sortWithinPartitions("conv_id", "part").select(columns)
    return whole.unionByName(parts.mapInArrow(run, schema))
