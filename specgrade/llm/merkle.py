"""Document fingerprints: Merkle trees over sections, paragraphs and pieces of them.

A text is cut at line ends into paragraphs. The paragraphs up to one that ends a section form a
section; a paragraph's own digest decides whether it ends one, so an edit moves no border but its
own. Each level is a digest over the digests below it. Equal texts have equal roots, and differing
branches locate edits. Apart from the tree, the whole text is cut by its own bytes into pieces of a
few letters; how many of them two texts share, each after the same neighbour and counted as often as it comes,
measures how alike they are. Everything is a column expression.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import NumericType

from specgrade.llm.common import text_of
from specgrade.operators.ranking import positions
from specgrade.session import materialise

# Rows in one bucket of the key order, about, and buckets at most: more rows make larger buckets.
BUCKET_ROWS, MAX_BUCKETS = 4_000, 20_000
# A paragraph whose digest ends so ends a section: one in eight.
SECTION_END = "[08]$"
# A piece ends after two bytes of UTF-8 whose mixed values add up to 0 modulo PIECE_BYTES, at PIECE_LIMIT bytes at the latest.
PIECE_BYTES, PIECE_LIMIT = 8, 16


def _piece_pattern() -> str:
    """Matches one piece of a text whose characters stand for its bytes."""
    mixed = lambda odd: [(b * odd % 256 ^ b * odd % 256 >> 4) % PIECE_BYTES for b in range(256)]
    first, second = mixed(167), mixed(205)
    some = lambda values, k: "[" + "".join(f"\\x{b:02x}" for b in range(256) if values[b] == k) + "]"
    ends = "|".join(some(first, k) + some(second, -k % PIECE_BYTES) for k in range(PIECE_BYTES))
    return f"(?s).{{0,{PIECE_LIMIT - 2}}}?(?:{ends})|.{{1,{PIECE_LIMIT}}}"


_PIECE = _piece_pattern()


def paragraph_hashes(text: Column) -> Column:
    """The digests of the paragraphs."""
    return F.transform(F.split(text, "\n", -1), lambda p: F.sha2(F.concat(F.lit("paragraph:"), p), 256))


def section_hashes(paragraphs: Column) -> Column:
    """The digests of the sections, each over those of its paragraphs."""
    ends = F.filter(F.transform(paragraphs, lambda h, i: F.when(h.rlike(SECTION_END), i + 1)), lambda i: i.isNotNull())
    borders = F.array_distinct(F.concat(F.array(F.lit(0)), ends, F.array(F.size(paragraphs))))
    run = lambda i: F.slice(paragraphs, F.element_at(borders, i) + 1, F.element_at(borders, i + 1) - F.element_at(borders, i))
    return F.transform(F.sequence(F.lit(1), F.size(borders) - 1), lambda i: F.sha2(F.concat(F.lit("section:"), F.array_join(run(i), ",")), 256))


def root(sections: Column) -> Column:
    """The fingerprint of a text: the digest over those of its sections."""
    return F.sha2(F.concat(F.lit("root:"), F.array_join(sections, ",")), 256)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` has it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pieces(text: Column) -> Column:
    """The pieces of a text, as byte strings in order; the bytes at a border decide, whatever the script."""
    return F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(_PIECE), F.lit(0))


def piece_marks(text: Column) -> Column:
    """A distinct hash for each piece of a text: of the piece, the one before it, and how often the two came already."""
    paired = _bind(
        F.transform(pieces(text), lambda p: F.xxhash64(p)),
        lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.coalesce(F.get(h, i - 1), F.lit(0).cast("long")))),
    )

    def numbered(again: Column) -> Column:
        starts = F.filter(F.transform(again, lambda x, i: F.when((i == 0) | (x != F.get(again, i - 1)), i)), lambda i: i.isNotNull())

        def runs(first: Column) -> Column:
            last = lambda j: F.coalesce(F.get(first, j + 1), F.size(again)) - 1
            return F.flatten(F.transform(first, lambda a, j: F.transform(F.sequence(a, last(j)), lambda i: F.xxhash64(F.get(again, a), i - a))))

        return _bind(starts, runs)

    def marks(found: Column) -> Column:
        again = _bind(F.sort_array(found), lambda s: F.filter(s, lambda x, i: x == F.get(s, i - 1)))
        return F.concat(F.array_distinct(found), _bind(again, numbered))

    return _bind(paired, marks)


def likeness(a: Column, b: Column) -> Column:
    """Dice likeness of the piece marks of two texts, repeats counted: 1 for equal texts, 0 for disjoint ones."""
    common, both = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * common / both).cast("double")


def differing_paragraphs(text: Column, other: Column) -> Column:
    """Where a text has paragraphs that ``other`` lacks: array of (number, start, end), in code points.

    Equal paragraphs are skipped by their hashes alone.
    """
    paragraphs = F.split(text, "\n", -1)
    hashes = F.transform(F.split(other, "\n", -1), lambda p: F.xxhash64(p))
    none = F.array().cast("array<struct<number:int,start:int,end:int>>")

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p)
        span = F.struct(a["number"].alias("number"), a["at"].alias("start"), end.alias("end"))
        return F.struct(
            (end + 1).alias("at"), (a["number"] + 1).alias("number"),
            F.when(F.array_contains(hashes, F.xxhash64(p)), a["out"]).otherwise(F.array_append(a["out"], span)).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("number"), none.alias("out"))
    return F.aggregate(paragraphs, start, step, lambda a: a["out"])


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, next_text): each row with the text of the next one in the order of keys; the first follows the last.

    Rows are dealt into buckets of near-equal size by quantiles of the key. To each bucket comes a copy of the
    first row of the next one, so that the order is followed inside buckets only. Null keys
    come first, rows with equal keys in the order of their texts' hashes. A single row follows itself.
    """
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), text_of(text).alias("text"))
    if not isinstance(rows.schema["doc_id"].dataType, NumericType):
        return _next_of_any(rows)
    keys = rows.select(F.col("doc_id").cast("double").alias("_key"))
    n = keys.count()
    parts = min(MAX_BUCKETS, max(1, -(-n // BUCKET_ROWS)))
    cuts = sorted(set(keys.where("_key is not null").approxQuantile("_key", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    named = rows.withColumn("_key", F.col("doc_id").cast("double"))
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        cut = Bucketizer(splits=splits, inputCol="_key", outputCol="_cut", handleInvalid="keep").transform(named)
        bucket = F.when(F.col("_key").isNull(), -1).otherwise(F.col("_cut").cast("int"))
    else:
        cut, bucket = named, F.when(F.col("_key").isNull(), -1).otherwise(F.lit(0))
    tie = F.xxhash64("text")
    numbered = cut.select("doc_id", "text", bucket.alias("_bucket"))
    order = [F.col("doc_id").asc_nulls_first(), tie]
    least = cut.groupBy(bucket.alias("_b")).agg(F.min("doc_id").alias("_least"))
    # At most MAX_BUCKETS + 1 rows of two numbers.
    least = F.broadcast(materialise(least, "least"))
    heads = numbered.join(least, (F.col("_bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_least")))
    firsts = heads.groupBy("_bucket").agg(F.min(F.struct("doc_id", tie.alias("t"), "text")).alias("f"))
    stored = materialise(firsts.select("_bucket", "f.doc_id", "f.text"), "firsts")
    buckets = sorted(r[0] for r in stored.select("_bucket").collect())
    if not buckets:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    before = F.create_map(*[F.lit(x) for b, a in zip(buckets, [buckets[-1], *buckets[:-1]]) for x in (b, a)])
    guards = stored.select("doc_id", "text", F.element_at(before, F.col("_bucket")).alias("_bucket"), F.lit(1).alias("_guard"))
    both = numbered.withColumn("_guard", F.lit(0)).unionByName(guards)
    place = W.partitionBy("_bucket").orderBy("_guard", *order)
    return both.withColumn("next_text", F.lead("text").over(place)).where("_guard = 0").select("doc_id", "text", "next_text")


def _next_of_any(rows: DataFrame) -> DataFrame:
    """``with_next`` for keys that are no numbers: by their positions in the whole order."""
    placed = positions(rows.withColumn("_tie", F.xxhash64("text")), [], [F.col("doc_id").asc_nulls_first(), F.col("_tie")], "_at", "_all")
    placed = materialise(placed, "placed")
    after = placed.select((F.pmod(F.col("_at") - 2, F.col("_all")) + 1).alias("_at"), F.col("text").alias("next_text"))
    return placed.join(after, "_at").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last half replaced by as much of the next document's beginning. Null text is
    empty; empty texts are equal and have likeness 1. Texts under 40 characters may be one or two pieces,
    of which an edit can leave none. Other columns are left out, repeated rows stay.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs, key, text).select("doc_id", "text", "next_text", edited.alias("edited"))
    texts = ("text", "edited", "next_text")
    leaves = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        *[paragraph_hashes(F.col(c)).alias(f"{c}_paragraphs") for c in texts[:2]], *[piece_marks(F.col(c)).alias(f"{c}_marks") for c in texts],
    )
    return leaves.select(
        "doc_id", "n_chars", "edited_sha256", root(section_hashes(F.col("text_paragraphs"))).alias("fingerprint"),
        root(section_hashes(F.col("edited_paragraphs"))).alias("edited_fingerprint"),
        likeness(F.col("text_marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("text_marks"), F.col("next_text_marks")).alias("near_next"),
    )
