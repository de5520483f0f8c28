"""Text expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from specgrade.functions import fixed_values as fv


@F.pandas_udf(T.StringType())
def _decompose(text: pd.Series) -> pd.Series:
    """NFKD without combining marks (Spark has no normalise function)."""

    def fold(s):
        return None if s is None else "".join(
            c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)
        )

    return text.map(fold)


def _single_folds() -> dict[str, str]:
    """Letters of the Latin blocks that fold to one letter, by rule."""
    folds = {}
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            folds[chr(code)] = base
    return folds


_FOLDS = _single_folds()
_FOLD_FROM, _FOLD_TO = "".join(_FOLDS), "".join(_FOLDS.values())


def fold_accents(col: Column) -> Column:
    """Strip accents (compatibility decomposition without combining marks).

    Latin letters are folded in the JVM; only values that hold other characters reach Python.
    """
    latin = F.translate(col, _FOLD_FROM, _FOLD_TO)
    other = F.when(latin.rlike(r"[^\x00-\x7F]"), latin)
    return F.coalesce(_decompose(other), latin)


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def normalize(col: Column) -> Column:
    """Fold accents, punctuation to spaces, lower case, single spaces; null becomes empty."""
    text = F.translate(fold_accents(F.coalesce(col.cast("string"), F.lit(""))), fv.PUNCTUATION, " " * len(fv.PUNCTUATION))
    return squeeze(F.lower(text))


def taxon_text(col: Column) -> Column:
    return F.trim(F.replace(col.cast("string"), F.lit("_"), F.lit(" ")))


def format_label(family: Column, genus: Column, epithet: Column, rank: str) -> Column:
    """Label per rank: underscores to spaces; species is genus and lower-case epithet."""
    if rank == "family":
        return taxon_text(family)
    if rank == "genus":
        return taxon_text(genus)
    if rank == "species":
        return F.trim(F.concat_ws(" ", taxon_text(genus), F.lower(taxon_text(epithet))))
    raise ValueError(f"invalid rank {rank!r}")


def normalize_taxon(name: Column, level: str) -> Column:
    """Struct (normalized, actions): actions hold (reason, confidence), in order."""
    action = "array<struct<reason:string,confidence:double>>"
    blank = F.coalesce(F.trim(name), F.lit("")) == ""
    unknown = F.lit("unknown_species" if level == "species" else f"Unknown_{level.title()}")
    s0 = F.trim(name)
    s1 = F.regexp_replace(s0, r"[^a-zA-Z0-9\s_-]", "_")
    s2 = F.replace(s1, F.lit(" "), F.lit("_"))
    s3 = F.when(s2.contains("__"), F.regexp_replace(s2, "_+", "_")).otherwise(s2)
    if level == "species":
        s4 = F.lower(s3)
        cased = s3.rlike("[A-Z]")
        case_reason = "lowercase"
    else:
        words = F.transform(
            F.split(s3, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
        )
        cased = ~s3.rlike("^[A-Z][^A-Z]*$")
        s4 = F.when(cased, F.array_join(words, "_")).otherwise(s3)
        case_reason = "capitalization"

    def act(reason: str, confidence: float, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence")))

    actions = F.filter(
        F.array(
            act("special_characters", 0.9, s1 != s0),
            act("spaces_to_underscores", 1.0, s1.contains(" ")),
            act("multiple_underscores", 1.0, s2.contains("__")),
            act(case_reason, 1.0, cased),
        ),
        lambda a: a.isNotNull(),
    )
    missing = F.array(F.struct(F.lit("missing_value").alias("reason"), F.lit(1.0).alias("confidence")))
    return F.struct(
        F.when(blank, unknown).otherwise(s4).alias("normalized"),
        F.when(blank, missing).otherwise(actions).cast(action).alias("actions"),
    )


def slug(col: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(col)), "[^a-z0-9]+", "_"), F.lit("_"))


def option_column(category: Column, option: Column) -> Column:
    return F.concat(slug(category), F.lit("__"), slug(option))


def strip_justification(col: Column) -> Column:
    """Cut from the first opening parenthesis on."""
    return F.trim(F.regexp_replace(col, r"\s*\(.*$", ""))


def normalize_prediction(col: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    return F.trim(F.rtrim(F.regexp_replace(text, r"\s*\(.*$", ""), F.lit(".")))


def is_abstention(pred: Column) -> Column:
    return pred.isin(*fv.ABSTENTIONS)


def truth_values(truth: Column) -> Column:
    """Pipe-separated truth as an array of lower-case values."""
    parts = F.transform(F.split(truth, r"\|"), lambda v: F.lower(F.trim(v)))
    return F.filter(parts, lambda v: v != "")


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def classify_prediction(prediction: Column, truth: Column) -> Column:
    """no_ground_truth / abstention / exact_match / parent_match / mismatch."""
    pred = normalize_prediction(prediction)
    values = truth_values(truth)
    parent = literal_map(fv.SUBTYPES)[pred]
    return (
        F.when(F.coalesce(truth, F.lit("")) == "", "no_ground_truth")
        .when(is_abstention(pred), "abstention")
        .when(F.size(values) == 0, "no_ground_truth")
        .when(F.array_contains(values, pred), "exact_match")
        .when(parent.isNotNull() & F.array_contains(values, F.coalesce(parent, F.lit(""))), "parent_match")
        .otherwise("mismatch")
    )


def last_token(key: Column, sep: str = "_") -> Column:
    return F.substring_index(key, sep, -1)


def after_segment(path: Column, segment: str) -> Column:
    """The path part that follows ``segment``; null when absent."""
    parts = F.split(path, "/")
    at = F.array_position(parts, segment)
    return F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))


# Version stamp in a catalog file name.
VERSION_PATTERN = r"(v\d{4}-\d{2}-\d{2}_\d+K)"


def version_of(path: Column) -> Column:
    """``<date>_<version>`` of a catalog file; null without a version stamp."""
    version = F.regexp_extract(path, VERSION_PATTERN, 1)
    return F.when(version != "", F.concat_ws("_", F.substring(version, 2, 10), version))


def model_short_name(model: Column, known: dict[str, str] | None = None) -> Column:
    """Organisation prefix and build suffixes cut; a table of known names comes first."""
    name = F.substring_index(F.coalesce(model, F.lit("")), "/", -1)
    for suffix in fv.MODEL_SUFFIXES:
        name = F.replace(name, F.lit(suffix), F.lit(""))
    name = F.when(F.lower(F.substring(name, 1, 4)) == "gpt-", F.concat(F.lit("GPT-"), F.substring(name, 5, 1 << 30))).otherwise(name)
    name = F.when(name == "", model).otherwise(name)
    return F.coalesce(literal_map(known)[model], name) if known else name


def compose_query(traits: Column, template: str, fallback: str) -> Column:
    """Query text from an array of (name, value) structs; uninformative values are left out."""
    clean = F.transform(
        traits, lambda t: F.struct(t["name"].alias("name"), F.lower(F.trim(F.coalesce(t["value"], F.lit("")))).alias("value"))
    )
    kept = F.filter(clean, lambda t: (t["value"] != "") & ~t["value"].isin(*fv.UNINFORMATIVE))
    text = F.array_join(F.transform(kept, lambda t: F.concat(t["name"], F.lit(": "), t["value"])), ", ")
    before, after = template.split("{traits}")
    return F.when(F.size(kept) == 0, F.lit(fallback)).otherwise(F.concat(F.lit(before), text, F.lit(after)))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else; blank and null texts are not.

    The parser ignores what follows a value. Inside brackets it does not, unless what follows
    closes them, and nothing closes both a bracket and a brace.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.coalesce((F.trim(text) != "") & listed.isNotNull() & keyed.isNotNull(), F.lit(False))
