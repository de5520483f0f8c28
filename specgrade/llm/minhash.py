"""Near duplicates by MinHash: banding, signature verification, exact confirmation, components.

1. Each text becomes the set of its word shingles; equal sets are one class. The signature of a
   class holds the minimum of each of many universal hash functions ``a * x + b`` over its set.
2. Bands of consecutive minima are hashed. Classes that share a band meet in a bucket. With 32
   bands of 6 minima, two sets of similarity 0.85 share none with probability 3e-7.
3. Inside a bucket signatures are verified without comparing all pairs: leaders are chosen, classes
   near a leader (under ``NEAR``) leave, and a class is tied to every leader within ``NEAR`` plus the
   reach of a link. The share of differing minima is a metric, so two classes that can be linked are
   always tied to a common leader. Near copies have few leaders, so ties are about as many as rows.
   A bucket with more rows than a task should hold is dealt out;
   the leaders of its parts then meet once more.
4. Alternating large and small stars turn ties into neighbourhoods. A neighbourhood's sets are brought
   together once (a large one in pairs of blocks), and links are confirmed on full sets.
5. The same stars turn confirmed links into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from specgrade.llm.common import spread
from specgrade.llm.components import components
from specgrade.llm.shingles import WordHashes, chain, shingle_set
from specgrade.session import materialise

BANDS, MINIMA = 32, 6
# Shingles whose minima are taken at once.
BLOCK = 1 << 15
# Share of differing minima below which a class follows its leader and leaves the bucket.
NEAR = 0.35
# Standard deviations by which an estimate may miss a link.
DEVIATIONS = 5
# Classes of a bucket, and shingles of a neighbourhood, that one task compares.
BUCKET_ROWS = 20_000
BLOCK_TOKENS = 2_000_000
# Classes of a neighbourhood that ask first.
FIRST = 4


def functions(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of ``n`` universal hash functions modulo 2^64."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 64, (2, n), dtype=np.uint64)
    return a | np.uint64(1), b


def minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima [set, function] of non-empty sets, in their upper 32 bits."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out, buffer = np.empty((len(a), len(sets)), np.uint64), np.empty_like(flat)
    for i in range(len(a)):
        np.multiply(flat, a[i], out=buffer)
        buffer += b[i]
        out[i] = np.minimum.reduceat(buffer, starts)
    return (out.T >> np.uint64(32)).astype(np.uint32)


def _lists(x: np.ndarray) -> pa.Array:
    """A list<int64> array of the rows of a matrix."""
    n, k = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))


def _sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, cls, n, sig, bands): the set's digest and size, a byte of each minimum, band hashes.

    An empty set has neither class nor signature.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    a, b = functions(bands * rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def emit(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
            some = [i for i, s in enumerate(sets) if len(s)]
            cls, sig = [None] * len(sets), [None] * len(sets)
            keys = np.zeros((len(sets), bands), np.uint64)
            if some:
                low = minima([sets[i] for i in some], a, b)
                cut = low.reshape(len(some), bands, rows).astype(np.uint64)
                order = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(some), bands))
                keys[some] = chain([order, *[cut[:, :, r] for r in range(rows)]])
                for i, s in zip(some, low.astype(np.uint8)):
                    cls[i], sig[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), s.tobytes()
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(cls, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), _lists(keys)],
                ["doc_id", "cls", "n", "sig", "bands"],
            )

        for batch in batches:
            start, sets, held = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                sets.append(shingle_set(hashes.of(text.as_py() or ""), words))
                held += len(sets[-1])
                if held > BLOCK or len(sets) == 1000:
                    yield emit(batch.column(0).slice(start, len(sets)), sets)
                    start, sets, held = i + 1, [], 0
            if sets:
                yield emit(batch.column(0).slice(start, len(sets)), sets)

    return docs.mapInArrow(work, f"doc_id {kind}, cls binary, n long, sig binary, bands array<long>")


def lead(sigs: np.ndarray, near: float, far: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Leaders of the signatures, and ties (row, leader).

    Each leader ties the remaining rows whose share of differing minima is at most ``far``; those
    within ``near`` leave with it.
    """
    left, leaders, ties = np.arange(len(sigs)), [], []
    while len(left):
        first, left = left[0], left[1:]
        leaders.append(first)
        if len(left):
            apart = (sigs[left] != sigs[first]).mean(axis=1)
            ties += [(i, first) for i in left[apart <= far]]
            left = left[apart > near]
    return np.array(leaders), ties


def _ties(rows: DataFrame, near: float, far: float) -> DataFrame:
    """(u, v, key, sig) of buckets (key, part, cls, sig): ties, and one row (u = v) for each leader.

    Rows of one bucket lie together in a sorted partition, so a task holds one bucket at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, members = None, []
        out: list[tuple] = []

        def close() -> None:
            if len(members) > 1 or name and name[1] >= 0:
                sigs = np.frombuffer(b"".join(m[1] for m in members), np.uint8).reshape(len(members), -1)
                leaders, ties = lead(sigs, near, far)
                out.extend((members[i][0], members[j][0], None, None) for i, j in ties)
                if name[1] >= 0:  # the bucket has more parts
                    out.extend((members[i][0], members[i][0], name[0], members[i][1]) for i in leaders)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int64(), pa.binary()))], ["u", "v", "key", "sig"]
            )

        for batch in batches:
            for key, part, cls, sig in zip(*[batch.column(c).to_pylist() for c in ("key", "part", "cls", "sig")]):
                if name != (key, part):
                    close()
                    name, members = (key, part), []
                members.append((cls, sig))
            if len(out) > 5000:
                yield flush()
        close()
        yield flush()

    dealt = rows.select("key", "part", "cls", "sig").repartition("key", "part").sortWithinPartitions("key", "part", "cls")
    return dealt.mapInArrow(work, "u binary, v binary, key long, sig binary")


def neighbourhoods(classes: DataFrame, link: float, minima_count: int) -> DataFrame:
    """(node, component) of the classes that may be linked with another; ``classes`` has cls, sig, bands."""
    far = 1 - link + DEVIATIONS * (link * (1 - link) / minima_count) ** 0.5
    rows = classes.select("cls", F.explode("bands").alias("key"))
    full = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "full")
    # Parts of a large bucket have numbers from 0 on; -1 is a bucket in one part.
    part = F.when(F.col("n") > BUCKET_ROWS, F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / BUCKET_ROWS)).cast("int")).otherwise(-1)
    met = materialise(rows.join(full, "key").select("key", part.alias("part"), "cls"), "met")
    tied = materialise(_ties(met.join(classes.select("cls", "sig"), "cls"), NEAR, NEAR + far), "ties")
    leaders = tied.where("u = v").select("key", F.lit(-1).alias("part"), F.col("u").alias("cls"), "sig")
    # Two links of length NEAR lie between the classes of two parts and their leaders; no leader leaves.
    among = _ties(leaders, -1.0, 2 * NEAR + far)
    return components(tied.where("u <> v").select("u", "v").union(among.select("u", "v")).distinct())


def confirm(held: list[tuple[bytes, np.ndarray]], threshold: Fraction) -> list[tuple[bytes, bytes]]:
    """(class, smallest class) of the classes that links connect.

    Common shingles of one class with all others are counted at once over an index of the shingles.
    The classes whose shingles are most frequent ask first, as most of a neighbourhood is linked with
    them; then every class outside the largest component asks all that are not in its own. A link
    between two components has an end outside the largest, so none is missed.
    """
    p, q = threshold.numerator, threshold.denominator
    sizes = np.array([len(s) for _, s in held], np.int64)
    n = len(held)
    flat = np.concatenate([s for _, s in held])
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    label = np.arange(n)
    asked = np.zeros(n, bool)

    def ask(me: int) -> None:
        asked[me] = True
        tokens = held[me][1]
        fits = (sizes * q >= len(tokens) * p) & (sizes * p <= len(tokens) * q) & (label != label[me]) & ~asked
        if not fits.any():
            return
        lo, hi = np.searchsorted(flat, tokens, "left"), np.searchsorted(flat, tokens, "right")
        runs = hi - lo
        index = np.repeat(lo - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        common = np.bincount(owner[index], minlength=n)
        for other in np.flatnonzero(fits & (common * q >= p * (len(tokens) + sizes - common))):
            if label[other] != label[me]:
                label[label == label[other]] = label[me]

    start = np.concatenate([[True], flat[1:] != flat[:-1]])
    often = np.diff(np.append(np.flatnonzero(start), len(flat)))[np.cumsum(start) - 1]
    mean = np.bincount(owner, often, minlength=n) / np.maximum(sizes, 1)
    for me in np.argsort(-mean, kind="stable")[:FIRST]:
        ask(me)
    largest = np.bincount(label, minlength=n).argmax()
    for me in np.flatnonzero((label != largest) & ~asked):
        ask(me)
    least: dict[int, bytes] = {}
    for (cls, _), l in zip(held, label):
        least[l] = min(least.get(l, cls), cls)
    return [(cls, least[l]) for (cls, _), l in zip(held, label) if cls != least[l]]


def _links(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """(u, v) of the classes linked within each neighbourhood; ``sets`` is (grp, cls, n, tokens).

    A neighbourhood of more shingles than a task should hold is cut into blocks, and each pair
    of its blocks is one task.
    """
    sized = materialise(sets.groupBy("grp").agg(F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS)).cast("int").alias("blocks")), "sized")
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: (i != F.col("block")) | (F.col("blocks") == 1))
    meets = F.transform(others, lambda i: F.struct(F.least(i, F.col("block")).alias("i"), F.greatest(i, F.col("block")).alias("j")))
    rows = sets.join(sized, "grp").withColumn("block", block).withColumn("pair", F.explode(meets))

    def work(table: pa.Table) -> pa.Table:
        held = sorted(((c.as_py(), t.values.to_numpy().view(np.uint64)) for c, t in zip(table.column("cls"), table.column("tokens"))), key=lambda r: r[0])
        found = confirm(held, threshold)
        return pa.table({"u": pa.array([u for u, _ in found], pa.binary()), "v": pa.array([v for _, v in found], pa.binary())})

    return rows.select("grp", "pair", "cls", "tokens").groupBy("grp", "pair").applyInArrow(work, "u binary, v binary")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(cls, n, tokens) of the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                sets = [shingle_set(hashes.of(t.as_py() or ""), words) for t in whole.column(0).slice(start, 500)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))
                cls = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([cls, pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), values)], ["cls", "n", "tokens"])

    return docs.mapInArrow(work, "cls binary, n long, tokens array<long>")


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: Fraction = Fraction(4, 5),
    bands: int = BANDS, minima_per_band: int = MINIMA,
) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row; a group keeps its smallest key.

    Two rows are linked when the Jaccard similarity of their shingle sets, confirmed on the full
    sets, is at least ``threshold``; banding overlooks a link of just that similarity with the
    probability of the module's text (other thresholds need other bands). Equal sets are always
    linked. Null, empty and wordless texts have an empty set and are linked with nothing. Repeated
    rows each return a row, and all rows that bear a kept key are kept. Rows with a null key take
    part and are kept only if they are linked with no key at all. Other columns are left out. An
    empty table gives an empty result.
    """
    threshold = Fraction(threshold)
    docs = spread(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")))
    sketch = materialise(_sketches(docs, words, bands, minima_per_band), "sketch")
    classes = materialise(
        sketch.where("n > 0").groupBy("cls").agg(
            F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
        ),
        "classes",
    )
    near = materialise(neighbourhoods(classes, float(threshold), bands * minima_per_band), "near")
    chosen = materialise(
        near.select(F.col("node").alias("cls"), F.col("component").alias("grp")).join(classes.select("cls", "first_id"), "cls"), "chosen"
    )
    wanted = chosen.select("first_id").distinct()
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["first_id"]), "left_semi")
    sets = _sets(texts.select("text"), words).join(chosen.select("cls", "grp"), "cls").dropDuplicates(["cls"])
    joined = components(_links(materialise(sets, "sets"), threshold))
    named = joined.join(classes.select(F.col("cls").alias("node"), "first_id"), "node")
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    grouped = named.join(lowest, "component").select(F.col("node").alias("cls"), "component_id")
    copies = classes.where("rows > 1").join(grouped, "cls", "left_anti").select("cls", F.col("first_id").alias("component_id"))
    answer = materialise(grouped.union(copies), "answer")
    component = F.coalesce("component_id", "doc_id")
    return sketch.select("doc_id", "cls", "n").join(answer, "cls", "left").select(
        F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
