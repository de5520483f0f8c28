"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays.

Counting. Tasks turn texts into word ids (64-bit hashes) and count the words and bigrams of a
block of texts. The counts are shuffled by hash as compact arrays; a shard merges them by sorting. A
frequent word or bigram thus costs one entry a block. Bigram shards are a grid: one half of the bits
comes from the hash of the context, the other from that of the word. A shard thus meets few words many
times, and a block names each of them to it once; a frequent word is still spread over a row of the grid.
The bigram shards also tell each word its number of predecessors and of followers by count, again
as arrays shuffled by hash.

Storing. Every shard is a flat file of sorted 64-bit hashes beside files of its values, written by
Spark to the shared folder.

Scoring. One pass over the texts without a shuffle: a worker maps the files it needs into memory,
looks up the distinct bigrams and words of a block of texts and adds up log probabilities. Pages
are shared by the workers of a machine and are not part of their memory.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from specgrade.llm.common import spread
from specgrade.llm.shingles import WordHashes, chain
from specgrade.session import new_path

# Tokens that a task counts or scores at once.
BLOCK_TOKENS = 1_000_000
START, END = np.uint64(0), np.uint64(1)


def _ids(words: WordHashes, text: str | None) -> np.ndarray:
    """Word ids of a text, the end included; ids 0 and 1 are the start and the end."""
    found = words.of(text or "")
    return np.append(np.where(found < 2, found + np.uint64(2), found), END)


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the word ids of their texts, of about BLOCK_TOKENS tokens."""
    words = WordHashes()
    for batch in batches:
        start, size, texts = 0, 0, []
        for i in range(batch.num_rows):
            texts.append(_ids(words, batch.column(column)[i].as_py()))
            size += len(texts[-1])
            if size >= BLOCK_TOKENS or i == batch.num_rows - 1:
                yield batch.slice(start, i + 1 - start), texts
                start, size, texts = i + 1, 0, []


def _bigrams(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and words of every position."""
    words = np.concatenate(texts)
    contexts = np.empty_like(words)
    contexts[1:] = words[:-1]
    contexts[np.cumsum([0, *[len(t) for t in texts[:-1]]])] = START
    return contexts, words


def _halves(ids: np.ndarray) -> list[bytes]:
    """Ids as their 32 low bits and their 32 high ones."""
    return [ids.astype("<u4").tobytes(), (ids >> np.uint64(32)).astype("<u4").tobytes()]


def _whole(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u4").astype(np.uint64) | (np.frombuffer(high, "<u4").astype(np.uint64) << np.uint64(32))


def _counts(values: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest."""
    top = int(values.max(initial=0))
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _read_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _cut(shards: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """Runs of equal numbers in a sorted array."""
    edges = np.searchsorted(shards, np.arange(n + 1))
    return [(s, slice(a, b)) for s, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]


def _shard(keys: np.ndarray, bits: int) -> np.ndarray:
    """The shard of a 64-bit key: its top bits, so that shards follow the order of the keys."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _word_key(ids: np.ndarray) -> np.ndarray:
    return chain([ids])


def _bigram_key(contexts: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """64 bits: the shard, from a hash of the context and one of the word, then a hash of both."""
    half = bits // 2
    place = _shard(_word_key(contexts), half) << (bits - half) | _shard(_word_key(words), bits - half)
    return place.astype(np.uint64) << np.uint64(64 - bits) | chain([contexts, words]) >> np.uint64(bits)


def _pack(contexts: np.ndarray, words: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Bigrams by context: the contexts and their numbers of bigrams, the distinct words, each bigram's word and count."""
    order = np.argsort(contexts, kind="stable")
    held, runs = np.unique(contexts, return_counts=True)
    seen, place = np.unique(words[order], return_inverse=True)
    return [held.tobytes(), _counts(runs), seen.tobytes(), _counts(place), _counts(n[order])]


def _unpack(held: bytes, runs: bytes, seen: bytes, place: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    contexts = np.repeat(np.frombuffer(held, np.uint64), _read_counts(runs))
    return contexts, np.frombuffer(seen, np.uint64)[_read_counts(place)], _read_counts(n)


def _sum_by(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct sorted keys, the place of the first of each, and the sums of the columns."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], order[first], [np.add.reduceat(c[order], first) if len(first) else c[:0] for c in columns]


_PARTS = "kind string, shard int, a binary, b binary, c binary, d binary, e binary"


def _part(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 7
    kinds = [pa.string(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _PARTS.split(", ")])


def _count(texts: DataFrame, bits: int) -> DataFrame:
    """Arrays of word counts ('w') and bigram counts ('b') of blocks of texts, by shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches, 0):
            contexts, words = _bigrams(block)
            rows = []
            keys, at, (n,) = _sum_by(_word_key(words), [np.ones(len(words), np.int64)])
            for s, r in _cut(_shard(keys, bits), 1 << bits):
                rows.append(("w", s, *_halves(words[at[r]]), _counts(n[r]), None, None))
            keys, at, (n,) = _sum_by(_bigram_key(contexts, words, bits), [np.ones(len(words), np.int64)])
            for s, r in _cut(_shard(keys, bits), 1 << bits):
                rows.append(("b", s, *_pack(contexts[at[r]], words[at[r]], n[r])))
            starts = np.array([len(block)], np.int64)
            rows.append(("w", int(_shard(_word_key(np.array([START])), bits)[0]), *_halves(np.array([START])), _counts(starts), None, None))
            yield _part(rows)

    return texts.mapInArrow(count, _PARTS)


def _file(name: str, shard: int, data: np.ndarray | bytes) -> tuple:
    return name, shard, data if isinstance(data, bytes) else data.tobytes()


def _merge(parts: DataFrame, bits: int) -> DataFrame:
    """Files of each shard: bigram hashes and counts, and arrays for the words."""

    def merge(key, table):
        kind, shard = key[0].as_py(), key[1].as_py()
        read = lambda name: [x.as_py() for x in table.column(name)]
        files = []
        if kind == "w":
            words = np.concatenate([_whole(x, y) for x, y in zip(read("a"), read("b"))])
            n = np.concatenate([_read_counts(x) for x in read("c")])
            _, at, (n,) = _sum_by(_word_key(words), [n])
            files.append(_file("words", shard, np.concatenate([words[at].view(np.int64), n])))
        else:
            contexts, words, n = (np.concatenate(x) for x in zip(*[_unpack(*x) for x in zip(*[read(c) for c in "abcde"])]))
            keys, at, (n,) = _sum_by(_bigram_key(contexts, words, bits), [n])
            contexts, words = contexts[at], words[at]
            large = np.flatnonzero(n > 254)
            files += [
                _file("hash", shard, keys), _file("count", shard, np.minimum(n, 255).astype(np.uint8)),
                _file("large", shard, np.concatenate([keys[large].view(np.int64), n[large]])),
                _file("totals", shard, np.array([np.sum(n == k) for k in (1, 2, 3, 4)] + [len(n)], np.int64)),
            ]
            # For each word of the shard: its predecessors, its followers seen once, twice, more often.
            ones, both = np.ones(len(n), np.int64), np.concatenate([words, contexts])
            zero = 0 * ones
            columns = [np.concatenate(x) for x in ((ones, zero), (zero, (n == 1) * 1), (zero, (n == 2) * 1), (zero, (n > 2) * 1))]
            keys, at, sums = _sum_by(_word_key(both), columns)
            parts = [_shard_part(both[at[r]], [x[r] for x in sums], s) for s, r in _cut(_shard(keys, bits), 1 << bits)]
            files.append(_file("links", shard, b"".join(parts)))
        names, shards, data = zip(*files)
        return pa.table({"name": pa.array(names), "shard": pa.array(shards, pa.int32()), "data": pa.array(data, pa.binary())})

    return parts.groupBy("kind", "shard").applyInArrow(merge, "name string, shard int, data binary")


def _shard_part(ids: np.ndarray, sums: list[np.ndarray], shard: int) -> bytes:
    body = b"".join(len(x).to_bytes(8, "little") + x for x in (*_halves(ids), *[_counts(s) for s in sums]))
    return shard.to_bytes(4, "little") + len(body).to_bytes(8, "little") + body


def _split_parts(data: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(data):
        shard, size = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 12], "little")
        body, at, fields, i = data[at + 12 : at + 12 + size], at + 12 + size, [], 0
        while i < len(body):
            n = int.from_bytes(body[i : i + 8], "little")
            fields.append(body[i + 8 : i + 8 + n])
            i += 8 + n
        yield shard, fields


def _write(files: DataFrame, path: str) -> None:
    """One flat file for each row, in folders by name and shard; a line end follows the data."""
    files.withColumn("data", F.col("data").cast("string")).write.partitionBy("name", "shard").text(path)


def _read(spark: SparkSession, path: str, name: str, schema: str, unpack) -> DataFrame:
    """Rows that ``unpack`` makes of the files of a name; no rows if there are none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from unpack(content.as_py()[:-1])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{path}/name={name}")
    return found.select("content").mapInArrow(rows, schema)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts from the numbers of types seen once to four times."""
    n1, n2, n3, n4 = n[:4]
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return tuple(min(max(d, 0.05), k - 0.05) if k > 1 else min(max(d, 0.05), 0.95) for k, d in enumerate(raw, 1))


@dataclass(frozen=True)
class KneserNey:
    """A fitted model: where its files are, and its totals."""

    path: str
    bits: int
    tokens: int
    words: int
    bigrams: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_backoff: float


def fit(docs: DataFrame, text: str = "text", rows_per_shard: int = 4_000) -> KneserNey:
    """Count the texts and store the model in the shared folder.

    Null text counts as empty: an end alone. No rows: a model without words. The number of shards
    follows the number of rows.
    """
    spark = docs.sparkSession
    texts = spread(docs.select(F.col(f"`{text}`").cast("string")))
    bits = min(16, max(2, (docs.count() // rows_per_shard).bit_length()))
    path = new_path(spark, "bigrams")
    _write(_merge(_count(texts, bits), bits), path)
    numbers = lambda data: [pa.RecordBatch.from_arrays([pa.array([np.frombuffer(data, np.int64).tolist()], pa.list_(pa.int64()))], ["x"])]
    add = lambda rows, k: [int(v or 0) for v in rows.agg(*[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(k)]).first()]
    if not docs.head(1):
        return KneserNey(path, bits, 0, 0, 0, discounts([0] * 4), discounts([0] * 4), 0.0)
    pair = add(_read(spark, path, "totals", "x array<long>", numbers), 5)
    d = discounts(pair)
    schema = "shard int, ids binary, high binary, counts binary, more array<binary>"

    def counted(data: bytes) -> Iterator[pa.RecordBatch]:
        ids, n = np.frombuffer(data, np.int64).reshape(2, -1)
        ids = ids.view(np.uint64)
        yield _word_rows([(int(_shard(_word_key(ids[:1]), bits)[0]), [*_halves(ids), _counts(n)])] if len(ids) else [])

    def linked(data: bytes) -> Iterator[pa.RecordBatch]:
        yield _word_rows([(s, [f[0], f[1], None, *f[2:]]) for s, f in _split_parts(data)])

    both = _read(spark, path, "words", schema, counted).union(_read(spark, path, "links", schema, linked))

    def merge(key, table):
        shard, ids, columns = key[0].as_py(), [], [[] for _ in range(5)]
        for low, high, counts, more in zip(*[table.column(c).to_pylist() for c in ("ids", "high", "counts", "more")]):
            ids.append(_whole(low, high))
            nothing = np.zeros(len(ids[-1]), np.int64)
            given = [_read_counts(counts), *[nothing] * 4] if counts else [nothing, *[_read_counts(m) for m in more]]
            for column, values in zip(columns, given):
                column.append(values)
        ids = np.concatenate(ids)
        keys, at, (n, before, one, two, more) = _sum_by(_word_key(ids), [np.concatenate(c) for c in columns])
        real = ids[at] != START
        totals = [int(n[real].sum()), int(real.sum()), int(before.sum()), *[int((before == k).sum()) for k in (1, 2, 3, 4)], int((before > 2).sum())]
        backoff = d[0] * one + d[1] * two + d[2] * more
        files = [
            ("word_hash", keys.tobytes()), ("word_count", n.astype(np.int64).tobytes()), ("word_before", before.astype(np.int64).tobytes()),
            ("word_backoff", backoff.astype(np.float32).tobytes()), ("word_totals", np.array(totals, np.int64).tobytes()),
        ]
        names, data = zip(*files)
        return pa.table({"name": pa.array(names), "shard": pa.array([shard] * len(files), pa.int32()), "data": pa.array(data, pa.binary())})

    words_path = f"{path}-words"
    _write(both.groupBy("shard").applyInArrow(merge, "name string, shard int, data binary"), words_path)
    tokens, words, bigrams, n1, n2, n3, n4, many = add(_read(spark, words_path, "word_totals", "x array<long>", numbers), 8)
    e = discounts([n1, n2, n3, n4])
    return KneserNey(path, bits, tokens, words, bigrams, d, e, e[0] * n1 + e[1] * n2 + e[2] * many)


def _word_rows(rows: list[tuple[int, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([s for s, _ in rows], pa.int32()), *[pa.array([f[i] for _, f in rows], pa.binary()) for i in range(3)],
            pa.array([f[3:] for _, f in rows], pa.list_(pa.binary())),
        ],
        ["shard", "ids", "high", "counts", "more"],
    )


class _Mapped:
    """The model's files, mapped into memory when first needed."""

    OPEN = 400

    def __init__(self, folders: list[str], bits: int) -> None:
        self.folders, self.bits, self.maps = folders, bits, {}

    def file(self, name: str, shard: int, kind) -> np.ndarray:
        if (name, shard) not in self.maps:
            if len(self.maps) > self.OPEN:
                self.maps.clear()
            found = [p for f in self.folders for p in Path(f, f"name={name}", f"shard={shard}").glob("part-*")]
            n = (found[0].stat().st_size - 1) // np.dtype(kind).itemsize if found else 0
            self.maps[name, shard] = np.memmap(found[0], kind, "r", shape=(n,)) if n else np.empty(0, kind)
        return self.maps[name, shard]

    def find(self, keys: np.ndarray, name: str, columns: list[tuple[str, type]]) -> list[np.ndarray]:
        """The values of sorted distinct keys; 0 for a key that the model lacks."""
        out = [np.zeros(len(keys), kind) for _, kind in columns]
        for shard, run in _cut(_shard(keys, self.bits), 1 << self.bits):
            held = self.file(name, shard, np.uint64)
            if not len(held):
                continue
            at = np.minimum(np.searchsorted(held, keys[run]), len(held) - 1)
            hit = np.flatnonzero(held[at] == keys[run])
            for values, (column, kind) in zip(out, columns):
                values[run.start + hit] = self.file(column, shard, kind)[at[hit]]
        return out

    def bigram_counts(self, keys: np.ndarray) -> np.ndarray:
        n = self.find(keys, "hash", [("count", np.uint8)])[0].astype(np.int64)
        large = np.flatnonzero(n == 255)
        for shard, run in _cut(_shard(keys[large], self.bits), 1 << self.bits):
            held, counts = self.file("large", shard, np.int64).reshape(2, -1)
            n[large[run]] = counts[np.searchsorted(held.view(np.uint64), keys[large[run]])]
        return n


def _discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3)], 0.0)


def probabilities(model: KneserNey, files: _Mapped, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The model's probability of every position, and the training counts of the words."""
    keys, back = np.unique(_word_key(np.concatenate([words, contexts])), return_inverse=True)
    count, before, backoff = files.find(keys, "word_hash", [("word_count", np.int64), ("word_before", np.int64), ("word_backoff", np.float32)])
    word, context = back[: len(words)], back[len(words) :]
    uniform = 1.0 / (model.words + 1)
    if not model.bigrams:
        return np.full(len(words), uniform), np.zeros(len(words), np.int64)
    lower = (_discounted(before, model.word_discounts) + model.word_backoff * uniform) / model.bigrams
    pairs, place = np.unique(_bigram_key(contexts, words, model.bits), return_inverse=True)
    pair = _discounted(files.bigram_counts(pairs), model.pair_discounts)[place]
    total = count[context]
    known = total > 0
    p = lower[word]
    p[known] = (pair[known] + backoff[context[known]] * p[known]) / total[known]
    return p, count[word]


def _local_folders(df: DataFrame, model: KneserNey) -> list[str] | None:
    """The model's folders if every machine sees them as local paths; else they are sent to the executors."""
    paths = [model.path, f"{model.path}-words"]
    if urlparse(model.path).scheme in ("", "file"):
        return [unquote(urlparse(p).path) for p in paths]
    for p in paths:
        df.sparkSession.sparkContext.addFile(p, recursive=True)
    return None


def score(docs: DataFrame, model: KneserNey, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, its tokens, how many of them are known, and its log10 probability, also by add-one unigrams.

    Perplexity is 10 ** (-score / n_tokens). Null or empty text is one token, the end. Repeated rows
    and null keys are scored like any other; other columns are left out.
    """
    rows = spread(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")))
    kind, folders = rows.schema["doc_id"].dataType.simpleString(), _local_folders(docs, model)
    names = [os.path.basename(model.path), os.path.basename(model.path) + "-words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Mapped(folders or [SparkFiles.get(n) for n in names], model.bits)
        for part, texts in _blocks(batches, 1):
            sizes = np.array([len(t) for t in texts])
            starts = np.cumsum(sizes) - sizes
            p, n = probabilities(model, files, *_bigrams(texts))
            base = np.log10((n + 1) / (model.tokens + model.words + 1))
            columns = [sizes, np.add.reduceat((n > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(c) for c in columns]], ["doc_id", "n_tokens", "n_known", "base_score", "score"]
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
