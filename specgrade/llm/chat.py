"""Chat formatting by columnar byte assembly.

Conversations are dealt out by ranges of (conversation, turn), so that one with very many turns is
spread over tasks. Each task lays the turns of a block out in one buffer: numpy computes the lengths of headers,
contents and ends, their running offsets and the places of all bytes, and copies each
column of bytes once. Control strings inside texts are escaped, so the output can be parsed back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE, ESCAPE = "### ", " </turn>", "\\"
HEAD_END, TURN_END = ":\n", CLOSE + "\n"
# Turns and bytes of text that one output row holds at most; a longer text has a row to itself.
BLOCK_TURNS, BLOCK_BYTES = 2_000, 4_000_000
FORMATTED = "block long, n_turns int, text string, loss_start array<int>, loss_end array<int>"
_TURN = re.compile(r"### ((?:\\.|[^\\:])*):\n((?:\\.|(?! </turn>\n)[^\\])*+) </turn>\n", re.S)


def escape(texts: pa.Array) -> pa.Array:
    """Escape the escape character and the control strings of a string array."""
    for mark in (ESCAPE, "###", "</turn>"):
        texts = pc.replace_substring(texts, mark, ESCAPE + mark)
    return texts


def escape_role(roles: pa.Array) -> pa.Array:
    return pc.replace_substring(escape(roles), ":", ESCAPE + ":")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def _copy(out: np.ndarray, at: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> None:
    """Copy each string of a column to its place in the buffer."""
    lengths = np.diff(offsets)
    source = np.arange(offsets[0], offsets[-1])
    out[source + np.repeat(at - offsets[:-1], lengths)] = data[offsets[0] : offsets[-1]]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """All turns in one buffer, their offsets, and where each text begins and ends in it (2 rows)."""
    role_at, role_bytes = _bytes(roles)
    text_at, text_bytes = _bytes(texts)
    role_size, text_size = np.diff(role_at), np.diff(text_at)
    opening, middle, closing = (np.frombuffer(s.encode(), np.uint8) for s in (OPEN, HEAD_END, TURN_END))
    ends = np.cumsum(len(opening) + role_size + len(middle) + text_size + len(closing))
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    role_to = offsets[:-1] + len(opening)
    middle_to = role_to + role_size
    text_to = middle_to + len(middle)
    close_to = text_to + text_size
    buffer = np.empty(offsets[-1], np.uint8)
    for to, fixed in ((offsets[:-1], opening), (middle_to, middle), (close_to, closing)):
        buffer[to[:, None] + np.arange(len(fixed))] = fixed
    _copy(buffer, role_to, role_at, role_bytes)
    _copy(buffer, text_to, text_at, text_bytes)
    return pa.py_buffer(buffer), offsets, np.stack([text_to, close_to])


def format_conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, block, n_turns, text, loss_start, loss_end): the formatted conversations in blocks.

    The text of a conversation is that of its blocks, in order of ``block``. ``loss_start`` and ``loss_end`` are
    code points in the block's text between which it is learned: the texts of the role ``learn``.
    Turns are ordered by turn, nulls first; turns that tie by role, then text. Null roles and texts are
    empty. Repeated rows are turns of their own. A null key is a conversation of its own. Other columns are
    left out. No turns: no rows.
    """
    named = turns.select(
        F.col(f"`{key}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    dealt = named.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kind = named.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, part = batch.column(0), batch.column(4)[0].as_py()
            roles, texts = escape_role(batch.column(2)), escape(batch.column(3))
            same = pc.fill_null(pc.equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False)
            same |= (keys[1:].is_null().to_numpy(zero_copy_only=False)) & (keys[:-1].is_null().to_numpy(zero_copy_only=False))
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
            starts, held, turns_held = [0], sizes[0], 1
            for i in range(1, batch.num_rows):
                if not same[i - 1] or held + sizes[i] > BLOCK_BYTES or turns_held >= BLOCK_TURNS:
                    starts.append(i)
                    held, turns_held = 0, 0
                held, turns_held = held + sizes[i], turns_held + 1
            learned = pc.equal(batch.column(2), learn).to_numpy(zero_copy_only=False)
            edges = [*starts, batch.num_rows]
            i = 0
            while i < len(starts):  # several blocks share one buffer
                j = i + 1
                while j < len(starts) and sizes[edges[i] : edges[j + 1]].sum() <= BLOCK_BYTES:
                    j += 1
                lo, hi = edges[i], edges[j]
                buffer, offsets, places = assemble(roles[lo:hi], texts[lo:hi])
                cuts = np.array(edges[i : j + 1]) - lo
                column = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(offsets[cuts].copy()), buffer).cast(pa.string())
                # Code points before each byte: bytes that do not continue a character.
                points = np.concatenate([[0], np.cumsum((np.frombuffer(buffer, np.uint8) & 0xC0) != 0x80)])
                block_of = np.repeat(np.arange(j - i), np.diff(cuts))
                spans = points[places] - points[offsets[cuts]][block_of]
                chosen = learned[lo:hi]
                counts = np.concatenate([[0], np.cumsum(np.bincount(block_of[chosen], minlength=j - i))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(counts), pa.array(s[chosen].astype(np.int32))) for s in spans]
                numbers = (part << 40) + made + np.arange(j - i)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(edges[i:j])), pa.array(numbers), pa.array(np.diff(cuts).astype(np.int32)), column, *lists],
                    ["conv_id", "block", "n_turns", "text", "loss_start", "loss_end"],
                )
                made, i = made + j - i, j

    return dealt.mapInArrow(run, f"conv_id {kind.simpleString()}, {FORMATTED}")


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    found, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return found


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: per conversation its turns, digests and sizes.

    The blocks of a conversation pass one after the other through its digests, so a long one costs time
    but no memory.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {DIGESTS}"
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        names = ["conv_id", *[x.split()[0] for x in DIGESTS.split(", ")]]

        def out() -> pa.RecordBatch:
            kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            rows = [(k, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]) for k, s in done]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            for i in range(batch.num_rows):
                key, text = batch.column("conv_id")[i].as_py(), batch.column("text")[i].as_py()
                if state is None or key != now:
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    done.append((key, state))
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for a, b in zip(batch.column("loss_start")[i].as_py(), batch.column("loss_end")[i].as_py()):
                    learned = unescape(text[a:b])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            if len(done) > 5_000:
                last = done.pop()
                yield out()
                done = [last]
        if done:
            yield out()

    return dealt.mapInArrow(run, schema)
