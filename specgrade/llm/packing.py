"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

Lengths are at most ``capacity``, so the packing depends only on how many pieces have each
length. Spark counts them; the driver packs the histogram: the lengths go from long to short, and
a segment tree over remaining capacities finds the tightest open sequence in logarithmic time,
once for each run of equal pieces that meets equal sequences. The size of the plan this yields is
bounded by ``capacity`` alone, whatever the number of documents. Each piece then finds its place in the
plan by its length and its rank among the pieces of that length. No document text and no list of
documents reaches the driver, and no group of pieces one task.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from specgrade.llm.common import spread
from specgrade.session import materialise

PIECE_COLUMNS = "piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over remaining capacities: which have an open sequence."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def set(self, at: int, count: int) -> None:
        node = at + self.leaves
        self.open[node] = count
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] + self.open[2 * node + 1]

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` with an open sequence, or -1."""
        node = least + self.leaves
        if self.open[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node + (not self.open[2 * node])
                return node - self.leaves
            node //= 2
        return -1


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces, offset), sorted by length and rank.

    A sequence that took a piece is the tightest one while another of that length fits, so it
    is filled up before the next of its space is opened; the last one may take fewer.
    """
    tree, spans, rows, opened = CapacityTree(capacity), defaultdict(list), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def fill(space: int, first: int, sequences: int, each: int) -> None:
            """Put ``each`` pieces into every one of some equal sequences."""
            nonlocal rank, left
            for layer in range(each):
                rows.append((length, rank, first, sequences, capacity - space + layer * length))
                rank, left = rank + sequences, left - sequences
            rest = space - each * length
            if rest:
                spans[rest].append((first, sequences))
                tree.set(rest, tree.open[rest + tree.leaves] + sequences)

        while left:
            space = tree.tightest(length)
            if space < 0:  # a piece that fits no open sequence starts one
                space = capacity
                each = space // length
                first, n = opened, -(-left // each)
                opened += n
            else:
                each = space // length
                first, n = spans[space].pop()
                tree.set(space, tree.open[space + tree.leaves] - n)
            full = min(n, left // each)
            if full:
                fill(space, first, full, each)
            if full < n and left:  # fewer than fill one sequence
                fill(space, first + full, 1, left)
                full += 1
            if full < n:
                spans[space].append((first + full, n - full))
                tree.set(space, tree.open[space + tree.leaves] + n - full)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _as_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ranks and added tokens of a ``tokenizers`` file, if it is a byte-level BPE that ``tiktoken`` can follow exactly."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, split, added = whole["model"], whole.get("pre_tokenizer") or {}, whole.get("added_tokens") or []
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    vocab = model.get("vocab", {})
    plain = (
        model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        and not any(whole.get(k) for k in ("normalizer", "truncation", "padding", "post_processor"))
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        and len(vocab) == 256 + len(merges) and all(vocab.get(c, 256) < 256 for c in byte_of)
        and all(vocab.get(x + y) == 256 + i for i, (x, y) in enumerate(merges))
    )
    if not plain:
        return None
    return {bytes(byte_of[c] for c in word): i for word, i in vocab.items()}, {t["content"]: t["id"] for t in added}


def encoder(path: str):
    """``ids(texts)`` for a byte-level BPE given as a ``tokenizers`` file or as bare tiktoken ranks.

    The ids of a ``tokenizers`` file are those of its ``encode`` without special tokens around the text: an
    added token that stands inside a text has its own id. The ranks and added tokens of such a file give the
    same ids about four times as fast. Bare ranks have no added tokens.
    """
    if path.endswith(".tiktoken"):
        import base64

        with open(path, "rb") as lines:
            read = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, {}
    else:
        read = _as_ranks(path)
    if read:
        import public_tokenizers
        import tiktoken

        own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read[0], special_tokens=read[1])
        return lambda texts: [own.encode(t, allowed_special="all") for t in texts]
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    return lambda texts: [loaded.encode(t, add_special_tokens=False).ids for t in texts]


_ENCODERS: dict = {}


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, key: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """Cut each document's ids, ended by ``end``, into pieces of at most ``capacity``.

    Columns: the key, piece, start, length, ids_crc32, and the task and the rank of the piece
    among those of its length in the task. Only documents longer than ``capacity`` are cut;
    their first piece takes the remainder. Null or empty text is one piece of the end id alone.
    Repeated rows and null keys are packed like any other.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = encoder(tokenizer)
        encode, task, seen = _ENCODERS[tokenizer], TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = batch.column(1)
            source, out = [], []
            for i in range(len(texts)):
                value = texts[i].as_py()
                ids = np.array((encode([value])[0] if value else []) + [end], "<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    source.append(i)
                    out.append((j, a, b - a, zlib.crc32(ids[a:b].tobytes()), seen[b - a]))
                    seen[b - a] += 1
            columns = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(source, pa.int64())),
                    pa.array(columns[0].astype(np.int32)), *[pa.array(c) for c in columns[1:4]],
                    pa.array(np.full(len(source), task, np.int32)), pa.array(columns[4]),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_local"],
            )

    return rows.mapInArrow(cut, f"doc_id {kind}, {PIECE_COLUMNS}, _task int, _local long")


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the table of ``tokenize_pieces``.

    The pieces are stored once, so that a piece keeps its rank when a task is repeated. Pieces of
    equal length may change places with each other; the packing is the same. No pieces: an empty
    table.
    """
    stored = materialise(pieces, "pieces")
    sizes = stored.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("length", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    counts = {r[0]: r[1] for r in stored.groupBy("length").count().collect()}
    shipped = stored.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    ranked = stored.join(offsets, ["length", "_task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_local")).alias("_rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shipped.value
        scale = int(rows[:, 1].max(initial=0)) + int(rows[:, 3].max(initial=0)) + 1
        wide = rows[:, 0] * scale + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(wide, length * scale + rank, side="right") - 1
            sequence = rows[at, 2] + rank - rows[at, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(rows[at, 4])],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            )

    kind = stored.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, {PIECE_COLUMNS}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, key: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """One row for each piece of each document with its sequence and its place there."""
    return pack(tokenize_pieces(spread(docs), tokenizer, capacity, key, text, end), capacity)
