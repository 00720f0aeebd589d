"""Chat formatting by columnar byte assembly.

Turns are dealt by conversation and sorted by turn, and a task formats them in blocks. For a block it computes the length
of every segment (opening mark, pieces of the text between escapes, closing mark), adds the lengths up to offsets, and
copies all segments by scatter indices into one buffer allocated beforehand, which becomes the values of an Arrow column
without another copy. Segments of more than LONG bytes are copied as slices, so the indices stay small.

A conversation is one row, with its text and its loss spans. Where its turns hold more than PART_BYTES, it goes on in
further rows (`part` 1, 2, …), cut between turns: a task then holds one part, however long a conversation is. All parts of
a conversation come from one task, in order, because its text and the digests of it are sequences.

Control strings inside a text get a backslash after their first character, one more than stand there already, so taking one
away restores the text. The loss mask covers the texts of the roles that are learned, without marks, as spans of characters
in the row's text.

Turns of equal number stand in the order of role, then text; a null turn comes first; a null text is empty, a null role is
the role with the empty name, a null conv_id is a conversation of its own. Repeated rows are repeated turns. Other columns
are ignored. An empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pagelib.llm.common import query, table

PART_BYTES = 2 << 20     # texts of one row, about
BLOCK_BYTES = 1 << 20    # texts assembled in one buffer, about
LONG = 4096              # longer segments are copied as slices
FORMATTED = "conv_id long, part long, n_turns long, formatted string, loss array<struct<start: long, end: long>>"
DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


@dataclass(frozen=True)
class Template:
    """Marks of a chat format. Marks must hold no character of UTF-8 beyond ASCII, and each closing mark one that does not
    come again inside it as its first, as these do."""

    begin: str = "<s>"
    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("[OUT] ", "</s>")})
    other: tuple[str, str, str] = ("[ROLE:", "] ", " [/ROLE]")     # around the name of any other role, and at the end
    learned: frozenset[str] = frozenset({"assistant"})

    def around(self, role: str) -> tuple[str, str]:
        before, name_end, after = self.other
        return self.marks.get(role) or (before + quote(role, safe="") + name_end, after)

    def control(self) -> str:
        """Pattern of a control string with any number of escapes: first character, backslashes, rest."""
        every = [self.begin, self.other[0], self.other[2], *(m for pair in self.marks.values() for m in pair)]
        rests: dict[str, list[str]] = {}
        for mark in sorted({m.strip() for m in every}):
            rests.setdefault(mark[0], []).append(re.escape(mark[1:]))
        return "|".join(rf"{re.escape(first)}\\*(?:{'|'.join(rest)})" for first, rest in rests.items())

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """Turns of a formatted text."""

    def __init__(self, template: Template) -> None:
        self.template = template
        self.escaped = re.compile(template.control())
        self.roles = {before: (role, after) for role, (before, after) in template.marks.items()}
        other = re.escape(template.other[0]) + "(.*?)" + re.escape(template.other[1])
        self.opening = re.compile("|".join([*map(re.escape, self.roles), other]))

    def plain(self, text: str) -> str:
        """The text before it was escaped."""
        return self.escaped.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text) if "\\" in text else text

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of every turn, the text unescaped."""
        at = len(self.template.begin) if formatted.startswith(self.template.begin) else 0
        while at < len(formatted):
            mark = self.opening.match(formatted, at)
            if mark is None:
                raise ValueError(f"no turn begins at character {at}")
            role, after = self.roles.get(mark[0]) or (unquote(mark[1]), self.template.other[2])
            end = formatted.index(after, mark.end())
            yield role, self.plain(formatted[mark.end():end])
            at = end + len(after)


def copy_segments(out: np.ndarray, to: np.ndarray, source: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """out[to : to + size] = source[start : start + size] for every segment."""
    short = size <= LONG
    for i in np.flatnonzero(~short):
        out[to[i]:to[i] + size[i]] = source[start[i]:start[i] + size[i]]
    to, start, size = to[short], start[short], size[short]
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return
    step = np.arange(ends[-1]) - np.repeat(ends - size, size)
    out[np.repeat(to, size) + step] = source[np.repeat(start, size) + step]


def values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return at - at[0], whole


class Assembler:
    """Formats blocks of turns; knows the marks of the roles it has met."""

    def __init__(self, template: Template) -> None:
        self.template = template
        self.control = re.compile(template.control().encode())

    def escapes(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places before which a backslash goes. A match must lie in one text; marks hold their first character once, so
        one that reaches into the next text hides no other."""
        found = np.array([m.span() for m in self.control.finditer(memoryview(text))], dtype=np.int64).reshape(-1, 2)
        inside = np.searchsorted(at, found[:, 0], "right") == np.searchsorted(at, found[:, 1] - 1, "right")
        return found[inside, 0] + 1

    def block(self, turns: pa.RecordBatch, units: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        """One row for each unit; `units` are the rows where one begins, `part` their numbers in the conversation."""
        n = len(turns)
        roles = turns.column("role").dictionary_encode()
        code = roles.indices.to_numpy(zero_copy_only=False)
        around = [self.template.around(r) for r in roles.dictionary.to_pylist()]
        first = np.zeros(n, dtype=np.int64)
        first[units[part == 0]] = 1
        kind = 2 * code + first       # opening marks come with and without the conversation's beginning
        opening = [m.encode() for before, _ in around for m in (before, self.template.begin + before)]
        closing = [after.encode() for _, after in around]
        open_size, close_size = (np.array([len(m) for m in marks], dtype=np.int64) for marks in (opening, closing))

        at, text = values(turns.column("text"))
        cut = self.escapes(text, at)
        escaped = np.searchsorted(cut, at)                 # escapes before each text
        added = np.diff(escaped)
        size = np.diff(at) + added
        total = open_size[kind] + size + close_size[code]
        start = np.concatenate([[0], np.cumsum(total)])
        body = start[:-1] + open_size[kind]

        out = np.empty(start[-1], dtype=np.uint8)
        for marks, sizes, which, to in ((opening, open_size, kind, start[:-1]), (closing, close_size, code, body + size)):
            pool = np.frombuffer(b"".join(marks), dtype=np.uint8)
            copy_segments(out, to, pool, (np.cumsum(sizes) - sizes)[which], sizes[which])
        pieces = np.sort(np.concatenate([at[:-1], cut]), kind="stable")
        row = np.searchsorted(at[:-1], pieces, "right") - 1
        before = np.searchsorted(cut, pieces, "right") - escaped[row]
        copy_segments(out, body[row] + pieces - at[row] + before, text, pieces, np.diff(pieces, append=at[-1]))
        row = np.searchsorted(at[:-1], cut, "right") - 1
        out[body[row] + cut - at[row] + np.arange(len(cut)) - escaped[row]] = ord("\\")

        chars = pc.utf8_length(turns.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + added
        place = np.concatenate([[0], np.cumsum(open_size[kind] + chars + close_size[code])])   # in characters; marks are ASCII
        unit = np.repeat(np.arange(len(units)), np.diff(units, append=n))
        loss_from = place[:-1] - place[units][unit] + open_size[kind]
        learned = np.array([r in self.template.learned for r in roles.dictionary.to_pylist()], dtype=bool)[code] & (chars > 0)
        spans = pa.StructArray.from_arrays([pa.array(loss_from[learned]), pa.array((loss_from + chars)[learned])], names=["start", "end"])
        span_at = np.concatenate([[0], np.cumsum(np.bincount(unit[learned], minlength=len(units)))])
        text_at = np.append(start[units], start[-1]).astype(np.int32)
        formatted = pa.StringArray.from_buffers(len(units), pa.py_buffer(text_at), pa.py_buffer(out))
        return pa.RecordBatch.from_arrays(
            [turns.column("conv_id").take(pa.array(units)), pa.array(part), pa.array(np.diff(units, append=n).astype(np.int64)), formatted,
             pa.ListArray.from_arrays(pa.array(span_at.astype(np.int32)), spans)], names=["conv_id", "part", "n_turns", "formatted", "loss"])

    def blocks(self, turns: pa.RecordBatch, units: np.ndarray, part: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(units):
            return
        where = (np.cumsum(size) - size)[units] // BLOCK_BYTES
        cut = np.flatnonzero(np.diff(where, prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(units)]):
            low, high = units[a], units[b] if b < len(units) else len(turns)
            yield self.block(turns.slice(low, high - low), units[a:b] - low, part[a:b])

    def stream(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by conversation and turn, formatted. The last part stays back until its end has come."""
        held, earlier = None, 0       # turns of the last part, and bytes of its conversation before them
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            ids = batch.column("conv_id")
            known = np.asarray(ids.is_valid())
            value = ids.fill_null(0).to_numpy(zero_copy_only=False)
            new = np.ones(len(batch), dtype=bool)
            new[1:] = (value[1:] != value[:-1]) | (known[1:] != known[:-1])
            size = np.diff(values(batch.column("text"))[0])
            bytes_before = np.cumsum(size) - size
            begins = np.flatnonzero(new)
            conv = np.cumsum(new) - 1
            within = bytes_before - bytes_before[begins][conv] + np.where(conv == 0, earlier, 0)
            part = within // PART_BYTES
            unit = new.copy()
            unit[1:] |= part[1:] != part[:-1]
            units = np.flatnonzero(unit)
            last = units[-1]
            yield from self.blocks(batch.slice(0, last), units[:-1], part[units[:-1]], size[:last])
            held, earlier, number = batch.slice(last), int(within[last]), int(part[last])
        if held is not None:
            yield from self.blocks(held, np.array([0]), np.array([number]), np.diff(values(held.column("text"))[0]))


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss) of `turns` (conv_id, turn, role, text); rows of a conversation stand in order."""

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Assembler(template).stream(batches)

    given = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                         F.coalesce("text", F.lit("")).alias("text"))
    ordered = given.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(formatted, FORMATTED)


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation, read back from the rows of `format_conversations` as they come: number of turns, digest of
    role and text of every turn, characters and digest of what the loss mask covers (both unescaped), and the length."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, names = template.reader(), [c.split()[0] for c in DIGESTS.split(", ")]
        now = None
        for batch in batches:
            done = []
            spans = batch.column("loss")
            starts, ends = (spans.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = spans.offsets.to_numpy(zero_copy_only=False)
            for i, (conv, part) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist())):
                text = batch.column("formatted")[i].as_py()
                if part == 0:
                    if now:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in reader.turns(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for a, b in zip(starts[at[i]:at[i + 1]], ends[at[i]:at[i + 1]]):
                    said = reader.plain(text[a:b])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            if done:
                yield rows_of(done, names)
        if now:
            yield rows_of([now], names)

    return formatted.mapInArrow(read, DIGESTS)


def rows_of(done: list[list], names: list[str]) -> pa.RecordBatch:
    conv, n, turns, chars, loss, length = zip(*done)
    return pa.RecordBatch.from_arrays(
        [pa.array(conv, pa.int64()), pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in turns]), pa.array(chars, pa.int64()),
         pa.array([h.hexdigest() for h in loss]), pa.array(length, pa.int64())], names=names)


# formatted_chars follows from the marks of the default template: 3 for the beginning of a conversation, 15 around a user's
# text, 13 around a system's, 10 around an assistant's.
SQL_OP12 = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
said AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|OUT\]|ROLE:|/ROLE\])', '\1\\\2\3', 'g')) AS chars,
    CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 10 END AS marks FROM given)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  (3 + sum(chars + marks))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query("op12_chat", SQL_OP12)
def op12_chat(spark, folder):
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], given.schema)
    return digests(format_conversations(given.unionByName(more)))
