"""Importance resampling towards a target distribution, over hashed word n-grams.

Each text is turned into bytes; one 256-byte table lower-cases A-Z and blanks the separators (it is
safe in UTF-8, where bytes from 0x80 on belong to letters), and ``bytes.split`` gives the words. The
crc32 of a word seeds that of the n-gram it begins, so an n-gram costs one call and no string.
Counters reduce the n-grams of many texts to their distinct ones before they become buckets.

Two passes read the corpus: one counts the buckets of corpus and target, one weighs every text by
the gains. The gains are one number for each bucket, whatever the corpus. The drawn texts are those
with the highest weight plus a Gumbel number of the key, which is sampling without replacement.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from specgrade.llm.common import spread, text_of
from specgrade.operators.ranking import positions
from specgrade.session import materialise

# Bytes of a text, and n-grams of a Counter, that a task holds as Python objects.
PIECE_BYTES = 1 << 20
COUNTED = 1 << 18
# What the sampling knows of a key's hash: 32 bits.
_DIGITS, _DRAWS = 8, 4294967296

_WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
TABLE = bytes(b if b in _WORD_BYTES else 32 for b in bytes(range(256)).lower())


@dataclass(frozen=True)
class Features:
    """Runs of 1 to ``longest`` words, each hashed to one of ``buckets``."""

    longest: int = 2
    buckets: int = 10_000

    def hashes(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """(words, crc32 of the n-grams that end in them) for pieces of a text of bounded size."""
        data = text.encode("utf-8", "replace").translate(TABLE)
        start, last = 0, []
        while start < len(data):
            end = start + PIECE_BYTES
            if end < len(data):
                end = data.rfind(b" ", start, end) + 1 or (data.find(b" ", end) + 1 or len(data))
            words = data[start:end].split()
            start = end
            if not words:
                continue
            chain = last + words
            spaced = [b" " + w for w in chain]
            level = list(map(crc32, chain))
            out = level[len(last):]
            for n in range(2, self.longest + 1):
                level = list(map(crc32, spaced[n - 1:], level))
                # n-grams within the words of the last piece were given with it.
                out += level[max(0, len(last) - n + 1):]
            yield len(words), out
            last = chain[max(0, len(chain) - self.longest + 1):] if self.longest > 1 else []

    def count(self, texts: DataFrame, text: str) -> dict[int, int]:
        """Occurrences by bucket over all texts: at most ``buckets`` entries."""

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(self.buckets, np.int64)
            seen: Counter[int] = Counter()

            def reduce() -> None:
                keys = np.fromiter(seen.keys(), np.int64, len(seen)) % self.buckets
                np.add.at(total, keys, np.fromiter(seen.values(), np.int64, len(seen)))
                seen.clear()

            for batch in batches:
                for value in batch.column(0):
                    for _, found in self.hashes(value.as_py()):
                        seen.update(found)
                        if len(seen) > COUNTED:
                            reduce()
            reduce()
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

        counted = texts.select(text_of(text).alias("t")).where("t <> ''").mapInArrow(tally, "bucket long, n long")
        return {r[0]: r[1] for r in counted.groupBy("bucket").agg(F.sum("n")).collect()}


@dataclass(frozen=True)
class Gains:
    """Log ratio of target to corpus by bucket, in floored thousandths."""

    features: Features
    table: np.ndarray = field(repr=False)


def gains(corpus: dict[int, int], target: dict[int, int], features: Features) -> Gains:
    """floor(1000 * ln) of the ratio of the two distributions, each count plus one."""
    s_all, t_all = sum(corpus.values()), sum(target.values())
    ratio = lambda b: (target.get(b, 0) + 1.0) * (s_all + features.buckets) / ((corpus.get(b, 0) + 1.0) * (t_all + features.buckets))
    return Gains(features, np.array([math.floor(1000 * math.log(ratio(b))) for b in range(features.buckets)], np.int64))


def fit(corpus: DataFrame, target: DataFrame, text: str = "text", features: Features | None = None) -> Gains:
    """Count both tables and compare them. Null texts have no features; an empty table counts as even."""
    features = features or Features()
    return gains(features.count(spread(corpus.select(text)), text), features.count(target.select(text), text), features)


def weigh(docs: DataFrame, model: Gains, text: str = "text", out: str = "weights") -> DataFrame:
    """Add a struct ``out`` of n_words, n_features and weight, the floored mean of the features' gains.

    A text without words (null, empty, separators only) has zeros. Other columns stay; one named
    as ``out`` is replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<n_words long, n_features long, weight long>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features, table = shipped.value.features, shipped.value.table
        for batch in batches:
            rows = np.zeros((3, len(batch)), np.int64)
            for i, value in enumerate(batch):
                words = total = n = 0
                for some, found in features.hashes(value.as_py()):
                    words, n = words + some, n + len(found)
                    total += int(table[np.array(found, np.int64) % features.buckets].sum())
                rows[:, i] = words, n, total // n if n else 0
            yield pa.StructArray.from_arrays([pa.array(r) for r in rows], ["n_words", "n_features", "weight"])

    return docs.withColumn(out, measure(text_of(text)))


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 * Gumbel number) of a key, from the first 32 bits of sha256 of "seed:key"."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, _DIGITS), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / float(_DRAWS)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 25, seed: int = 7,
    least_words: int = 20, features: Features | None = None,
) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row; ``rank`` numbers the drawn rows, best first.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred (rounded down) are
    drawn: those with the highest score, ties to the smaller key, null keys first. The others have
    no rank. Repeated rows are rows of their own, in either order. Null and empty texts have no
    features, weight 0 and no rank. Other columns, whatever their names, are left out. An empty
    corpus gives an empty result; an empty target weighs all buckets as equally likely.
    """
    model = fit(docs, target, text, features)
    rows = spread(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")))
    weighed = weigh(rows, model, "t", "w").select(
        "k", "w.n_words", "w.n_features", "w.weight", (F.col("w.weight") + gumbel(F.col("k"), seed)).alias("score")
    )
    scored = materialise(weighed, "weighed")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    placed = positions(scored.where(able), [], [F.desc("score"), F.col("k").asc()], "place")
    rank = F.when(F.col("place") <= drawn, F.col("place")).alias("rank")
    shape = [F.col("k").alias(key), "n_features", "weight", "score"]
    return placed.select(*shape, rank).union(scored.where(~able).select(*shape, F.lit(None).cast("long").alias("rank")))
