"""Product codes of vectors: integer k-means in each part of the vector, with persisted bounds.

Vectors become integers and are cut into equal parts; each part has a codebook of its own. A round
assigns every part to the nearest entry and moves each entry to the floored mean of its parts. After
the first round few assignments change, so each part keeps, from round to round, its ``b`` closest
entries with lower bounds of their distances in ascending order and one outer bound for all others
(adaptive bounds after Drake and Hamerly). Entries move between rounds: each tracked bound shrinks
by the way its entry moved, the outer bound by the longest way any entry moved. Then

* a part whose own entry is closer than every bound keeps it;
* otherwise the tracked entries up to the first bound beyond reach are measured again;
* only if the outer bound too is in reach are all entries measured.

Bounds are rounded down, and every decision they leave open is settled in integers, so results are
those of the plain method. ``b`` shrinks to what nearly all parts of the last round needed.

Vectors and bounds live in one table for each round; a task also adds one row of sums and counts to
it, from which the next codebooks follow. Codebooks have a fixed size whatever the number of rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from specgrade.llm.common import spread
from specgrade.session import discard, materialise

# Tracked entries at first, as a share of the codebook, and the least number.
TRACKED_SHARE, LEAST_TRACKED = 16, 2
# Of the parts in a round, so many in a thousand may need more entries than are tracked next.
BEYOND = 10
ROWS = 4096  # vectors that a task works on at once
_EXACT = 1 << 52  # sums below this are exact in doubles
_SLACK = 1e-12  # what square roots and sums of doubles may lose, relative


def _down(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers that are not above ``x``."""
    f = x.astype(np.float32)
    return np.where(f > x, np.nextafter(f, np.float32(-np.inf)), f).astype(np.float32)


def _roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds below and above of the square roots of integers."""
    r = np.sqrt(squares.astype(np.float64))
    return r * (1 - _SLACK), r * (1 + _SLACK)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all entries."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < _EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        d = x[:, i, None] - entries[None, :, i]
        out += d * d
    return out


@dataclass
class Bounds:
    """``ids`` (nearest first) and ``low`` of the tracked entries, ``outer`` for all others."""

    ids: np.ndarray
    low: np.ndarray
    outer: np.ndarray

    @staticmethod
    def fresh(d: np.ndarray, tracked: int) -> tuple[Bounds, np.ndarray]:
        """Bounds from all distances, and the squared distance of the nearest entry (ties: lower index)."""
        n, k = d.shape
        tracked = min(tracked, k)
        if d.max(initial=0) < 1 << 54:  # distance and index in one number
            keys = d * 256 + np.arange(k)
            order = np.sort(np.partition(keys, min(tracked, k - 1), axis=1)[:, :tracked + 1], axis=1) % 256
        else:
            order = np.argsort(d, axis=1, kind="stable")
        ids = order[:, :tracked]
        near = np.take_along_axis(d, ids, 1)
        beyond = np.take_along_axis(d, order[:, tracked:tracked + 1], 1)[:, 0] if tracked < k else None
        outer = _down(_roots(beyond)[0]) if beyond is not None else np.full(n, np.inf, np.float32)
        return Bounds(ids.astype(np.uint8), _down(_roots(near)[0]), outer), near[:, 0]

    def move(self, way: np.ndarray) -> None:
        """Entries moved by at most ``way``; keep the bounds valid and in order."""
        self.low = _down(self.low.astype(np.float64) - way[self.ids])
        self.outer = _down(self.outer.astype(np.float64) - way.max())
        self.low[:, 1:] = np.minimum.accumulate(np.minimum(self.low[:, 1:], self.outer[:, None])[:, ::-1], axis=1)[:, ::-1]

    def narrow(self, tracked: int) -> None:
        """Track fewer entries."""
        if tracked < self.ids.shape[1]:
            self.outer = np.minimum(self.outer, self.low[:, tracked:].min(axis=1))
            self.ids, self.low = self.ids[:, :tracked], self.low[:, :tracked]


def reassign(x: np.ndarray, entries: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """Bring ``bounds`` up to date; returns the squared distances and how many entries each row needed."""
    rows = np.arange(len(x))
    own = x - entries[bounds.ids[:, 0]]
    best = (own * own).sum(axis=1)
    width = bounds.ids.shape[1]
    high = _roots(best)[1]
    # Tracked entries beyond the first that the own entry does not rule out; ties stay open.
    reach = 1 + (bounds.low[:, 1:] <= high[:, None]).sum(axis=1)
    needed = np.where(bounds.outer <= high, width + 1, reach)
    bounds.low[:, 0] = _down(_roots(best)[0])
    for z in np.unique(reach[(reach > 1) & (needed <= width)]):
        at = rows[(reach == z) & (needed <= width)]
        ids = bounds.ids[at, :z]
        d = x[at][:, None, :] - entries[ids]
        d = (d * d).sum(axis=2)
        order = np.lexsort((ids, d), axis=1)
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        bounds.ids[at, :z], bounds.low[at, :z] = ids, _down(_roots(d)[0])
        best[at] = d[:, 0]
    at = rows[needed > width]
    if len(at):
        again, best[at] = Bounds.fresh(squares(x[at], entries), width)
        bounds.ids[at], bounds.low[at], bounds.outer[at] = again.ids, again.low, again.outer
    return best, needed


@dataclass(frozen=True)
class Round:
    """What a task knows: codebooks [part, entry, component], how far entries moved, how many to track."""

    books: np.ndarray
    way: np.ndarray | None
    tracked: int

    def shape(self) -> tuple[int, int, int]:
        return self.books.shape

    def run(self, x: np.ndarray, state: list[Bounds] | None) -> tuple[list[Bounds], np.ndarray, np.ndarray]:
        """Assign vectors [row, part, component]: new bounds, squared distances and needs [row, part]."""
        parts, out = self.books.shape[0], []
        best, needed = np.zeros((2, len(x), parts), np.int64)
        for p in range(parts):
            if state is None:
                bounds, best[:, p] = Bounds.fresh(squares(x[:, p], self.books[p]), self.tracked)
                needed[:, p] = bounds.ids.shape[1] + 1
            else:
                bounds = state[p]
                bounds.move(self.way[p])
                bounds.narrow(self.tracked)
                best[:, p], needed[:, p] = reassign(x[:, p], self.books[p], bounds)
            out.append(bounds)
        return out, best, needed


_STATE = "id {kind}, label {label}, v binary, state binary, codes binary, error long, totals array<long>"


def _pack(state: list[Bounds]) -> list[bytes]:
    """One value for each row: ids, lower bounds and outer bound of its parts."""
    n = len(state[0].ids)
    cols = [np.ascontiguousarray(a).view(np.uint8).reshape(n, -1) for s in state for a in (s.ids, s.low, s.outer)]
    return [r.tobytes() for r in np.concatenate(cols, axis=1)] if n else []


def _unpack(values: list[bytes], parts: int) -> list[Bounds]:
    raw = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), parts, -1)
    b = (raw.shape[2] - 4) // 5
    cut = lambda p, i, j, t: np.ascontiguousarray(raw[:, p, i:j]).view(t).copy()
    return [Bounds(cut(p, 0, b, np.uint8), cut(p, b, 5 * b, np.float32), cut(p, 5 * b, 5 * b + 4, np.float32)[:, 0]) for p in range(parts)]


def _pass(rows: DataFrame, step: Round, first: bool, last: bool) -> DataFrame:
    """One round over the table of the round before.

    Every task ends with a row of totals: sums by (part, entry, component), counts by (part,
    entry), and how many parts needed how many entries. The last round gives codes and errors.
    """
    parts, entries, width = step.shape()
    schema = _STATE.format(kind=rows.schema["id"].dataType.simpleString(), label=rows.schema["label"].dataType.simpleString())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        needs = np.zeros(entries + 2, np.int64)
        arrow = None
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                n = batch.num_rows
                x = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.int64).reshape(n, parts, width)
                state, best, needed = step.run(x, None if first else _unpack(batch.column("state").to_pylist(), parts))
                codes = np.stack([s.ids[:, 0] for s in state], axis=1)
                if not last:
                    needs += np.bincount(needed.ravel(), minlength=len(needs))
                    for p in range(parts):
                        np.add.at(sums[p], codes[:, p], x[:, p])
                        counts[p] += np.bincount(codes[:, p], minlength=entries)
                arrow = batch.column("id").type, batch.column("label").type
                nothing = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"), batch.column("label"),
                        nothing if last else batch.column("v"), nothing if last else pa.array(_pack(state), pa.binary()),
                        pa.array([c.tobytes() for c in codes], pa.binary()) if last else nothing,
                        pa.array(best.sum(axis=1)), pa.nulls(n, pa.list_(pa.int64())),
                    ],
                    ["id", "label", "v", "state", "codes", "error", "totals"],
                )
        if arrow and not last:
            totals = np.concatenate([sums.ravel(), counts.ravel(), needs])
            empty = [pa.nulls(1, t) for t in (*arrow, pa.binary(), pa.binary(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([totals], pa.list_(pa.int64()))], ["id", "label", "v", "state", "codes", "error", "totals"])

    return rows.mapInArrow(work, schema)


def _totals(done: DataFrame, length: int) -> np.ndarray:
    """The tasks' totals added up by position: one number for each."""
    added = done.select(F.posexplode("totals").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(length, np.int64)
    for i, x in added:
        out[i] = x
    return out


def _next(step: Round, totals: np.ndarray) -> Round:
    """Codebooks at the floored means, the ways of the entries and the number to track."""
    parts, entries, width = step.shape()
    cells = parts * entries
    sums, counts, needs = totals[: cells * width].reshape(step.shape()), totals[cells * width: cells * (width + 1)].reshape(parts, entries), totals[cells * (width + 1):]
    books = np.where(counts[..., None] > 0, sums // np.maximum(counts[..., None], 1), step.books)
    moved = (books - step.books).astype(np.float64)
    way = np.sqrt((moved * moved).sum(axis=2)) * (1 + _SLACK)
    tracked = step.tracked
    if step.way is not None:  # the first round measures everything and says nothing about needs
        covered = np.cumsum(needs) * 1000 >= needs.sum() * (1000 - BEYOND)
        tracked = min(tracked, max(LEAST_TRACKED, int(np.argmax(covered))))
    return Round(books, way, tracked)


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(id, label, x): components times ``scale``, floored; rows with unusable vectors are left out."""
    bad = F.exists("e", lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    good = vectors.where(F.col("e").isNotNull()).where(~F.coalesce(bad, F.lit(False)))
    # Larger numbers would not fit: 2^53 is far beyond every limit below.
    wide = float(1 << 53)
    return good.select("id", "label", F.transform("e", lambda y: F.greatest(F.lit(-wide), F.least(F.lit(wide), F.floor(y * scale).cast("double"))).cast("long")).alias("x"))


def encode(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every row with a usable vector.

    A vector that is null, or holds null, NaN or infinite components, is left out. Shorter vectors
    are filled up with zeros to the length of the longest, rounded up to a multiple of ``parts``.
    The codebooks start with the ``entries`` (at most 256) rows of smallest key, equal keys by
    their components, null keys last; with fewer rows they have fewer entries. Equal distances go
    to the lower entry; an entry without parts stays. Repeated rows count and return once each.
    Labels of any orderable type; null labels share one ``label_error``. Integers are held within
    a bound of 2^31 over the root of the part's width (2^29 for 16 components), at which errors
    still fit 64 bits. Other columns are left out. No usable row: an empty result.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte: 1 to 256 entries")
    named = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("e"))
    ready = integers(spread(named), scale)
    longest = ready.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, math.ceil(longest / parts))
    limit = math.isqrt((1 << 62) // (parts * width)) // 2
    held = lambda y: F.greatest(F.lit(-limit), F.least(F.lit(limit), y))
    full = F.concat(F.transform("x", held), F.array_repeat(F.lit(0).cast("long"), F.lit(parts * width) - F.size("x")))
    ready = ready.withColumn("x", full)
    seeds = [r.x for r in ready.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()]
    out = [F.col("id").alias(key), "code", "error", "label_error", "codebooks_sha256"]
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2)

    def binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([r.tobytes() for r in flat], pa.binary())], ["id", "label", "v"])

    kinds = ", ".join(f"{c} {ready.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    step = Round(books, None, max(LEAST_TRACKED, len(seeds) // TRACKED_SHARE))
    length = parts * len(seeds) * (width + 1) + len(seeds) + 2
    rows = ready.mapInArrow(binary, f"{kinds}, v binary")
    for n in range(rounds if seeds else 0):
        before, rows = rows if n else None, materialise(_pass(rows.where("v is not null"), step, n == 0, False), "codes")
        if before is not None:
            discard(before)
        step = _next(step, _totals(rows.select("totals").where("totals is not null"), length))
    digest = hashlib.sha256(",".join(map(str, step.books.ravel())).encode()).hexdigest()
    if not seeds:
        final = ready.select("id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")).limit(0)
    else:
        final = materialise(_pass(rows.where("v is not null"), step, rounds == 0, True).select("id", "label", "codes", "error"), "coded")
    sums = final.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "other")
    return (
        final.join(sums, F.col("label").eqNullSafe(F.col("other")))
        .withColumn("code", F.lower(F.hex("codes"))).withColumn("codebooks_sha256", F.lit(digest)).select(*out)
    )
