"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

Everything is a column expression on the text. The patterns never scan a run of characters twice:
a proposal starts where its run starts or where the previous match ended, which finds the same
leftmost matches as the plain pattern. Positions come from the lengths of the pieces between the
matches, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from specgrade.llm.common import fresh, text_of


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: pattern, score of a confirmed match, words that raise the score."""

    name: str
    pattern: str
    score: float
    context: str
    base: bool = True


# Base kinds are always reported. The others need ``threshold`` and must not touch a base span.
KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+",
        0.9, "mail|contact|write to|kontakt|correo|courriel",
    ),
    Kind("ip", r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|host|server|address|adresse"),
    Kind(
        "card",
        r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
        0.8, "card|visa|credit|payment|karte|tarjeta|carte",
    ),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, "phone|tel|call|mobile|fax|whatsapp"),
    Kind(
        "iban",
        r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
        0.8, "iban|bank|account|konto|cuenta|compte", False,
    ),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, r"\bssn\b|social security|taxpayer", False),
    Kind(
        "local_phone",
        r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])",
        0.3, "phone|tel|call|mobile|fax|whatsapp", False,
    ),
)
CONTEXT_BONUS, CONTEXT_CHARS = 0.3, 40


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes the mod-97 test; spaces are skipped."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4))

    def step(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c == "", rest).when(F.ascii(c) < 65, (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + letter) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    """The check of a proposed value."""
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def _located(text: Column, kind: Kind, found: Column) -> Column:
    """Spans of the confirmed values among the matches ``found``."""
    number = [k.name for k in KINDS].index(kind.name)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>")

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        left = F.greatest(start - CONTEXT_CHARS, F.lit(0))
        near = F.lower(F.concat(text.substr(left + 1, start - left), F.lit(" "), text.substr(end + 1, F.lit(CONTEXT_CHARS))))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), CONTEXT_BONUS).otherwise(0.0)
        span = F.struct(
            start.alias("start"), F.lit(number).alias("kind"), end.alias("end"),
            F.least(F.lit(1.0), score).alias("score"),
        )
        kept = F.when(x["m"].isNotNull() & confirmed(kind.name, x["m"]), F.array_append(a["spans"], span)).otherwise(a["spans"])
        return F.struct(F.coalesce(end, start).cast("int").alias("at"), kept.alias("spans"))

    zipped = F.arrays_zip(F.split(text, kind.pattern, -1).alias("p"), found.alias("m"))
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(F.size(found) > 0, F.aggregate(zipped, start, step, lambda a: a["spans"])).otherwise(none)


def find(docs: DataFrame, text: str = "text", out: str = "pii", threshold: float = 0.5) -> DataFrame:
    """Add the spans as an array of (start, kind, end, score), by start, then kind; ends are exclusive.

    ``kind`` is the place in ``KINDS``. Null text counts as empty and has an empty array. Whole
    texts are searched. All other columns and repeated rows stay; an input column named ``out``
    is replaced.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out]
    found, spans, sure, more = (fresh(f"_{n}", docs) for n in ("found", "spans", "base", "more"))
    first = docs.select(
        *kept,
        F.struct(
            *[
                (
                    F.when(text_of(text).contains("@"), F.regexp_extract_all(text_of(text), F.lit(k.pattern), F.lit(0)))
                    .otherwise(F.array().cast("array<string>")) if k.name == "email"
                    else F.regexp_extract_all(text_of(text), F.lit(k.pattern), F.lit(0))
                ).alias(k.name)
                for k in KINDS
            ]
        ).alias(found),
    )
    located = first.select(
        *kept, F.struct(*[_located(text_of(text), k, F.col(f"{found}.{k.name}")).alias(k.name) for k in KINDS]).alias(spans)
    )
    base = F.concat(*[F.col(f"{spans}.{k.name}") for k in KINDS if k.base])
    rest = F.concat(*[F.col(f"{spans}.{k.name}") for k in KINDS if not k.base])
    split = located.select(*kept, base.alias(sure), F.filter(rest, lambda s: s["score"] >= threshold).alias(more))
    free = F.filter(more, lambda s: ~F.exists(sure, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    both = F.when(F.size(more) == 0, F.col(sure)).otherwise(F.concat(sure, free))
    return split.select(*kept, F.array_sort(both).alias(out))


def redact(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Replace each span in the text by its kind in brackets; overlapping spans become one.

    Columns and rows stay as they are, null text stays null.
    """
    pii = fresh("_pii", docs)
    found = find(docs, text, pii, threshold)
    body, names = F.col(f"`{text}`"), F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])

    def step(a: Column, s: Column) -> Column:
        put = F.concat(a["out"], body.substr(a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(
            F.when(s["start"] < a["at"], a["out"]).otherwise(put).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    cleaned = F.aggregate(pii, start, step, lambda a: F.concat(a["out"], body.substr(a["at"] + 1, F.length(body))))
    changed = F.when(F.size(pii) == 0, body).otherwise(cleaned)
    return found.select(*[changed.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _count(kind: int) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")


def summary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts and digest of the base spans, and all spans as text."""
    found = find(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", "pii").select("doc_id", "pii")
    base = [i for i, k in enumerate(KINDS) if k.base]
    return found.select(
        "doc_id",
        *[_count(i).alias(f"n_{KINDS[i].name}") for i in base],
        F.sha2(joined(F.filter("pii", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
    )
