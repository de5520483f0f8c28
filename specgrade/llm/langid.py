"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language. An unseen word falls back to the
longest character n-grams of it that are known: four characters, then three, two, one. The
model is fitted on a bounded sample of labelled texts and has a bounded number of entries, so it
may be sent to every worker. Prediction is one pass over the table without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from specgrade.llm.common import text_of

UNDETERMINED = "und"
# A worker forgets the scores of words when it holds more than this.
CACHE_WORDS = 300_000
_DRAWS = 1_000_003


@dataclass
class LanguageModel:
    """Log frequencies by language: one row of ``table`` for each word and n-gram."""

    languages: list[str]
    table: np.ndarray
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    longest: int = 4

    def rows_of(self, word: str) -> list[int]:
        """The rows whose mean scores a word: its own, or those of its longest known n-grams."""
        row = self.words.get(word)
        if row is not None:
            return [row]
        padded, known = f"\x02{word}\x03", self.grams
        for n in range(min(self.longest, len(padded)), 0, -1):
            rows = [known[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in known]
            if rows:
                return rows
        return []


class _Scores(dict):
    """Row numbers of tokens in a growing table; the last column counts the words."""

    def __init__(self, model: LanguageModel) -> None:
        super().__init__()
        self.model = model
        self.rows = np.zeros((0, len(model.languages) + 1), np.float32)
        self.fresh: list[str] = []

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        self.fresh.append(token)
        return n

    def _measure(self) -> None:
        """Fill in the rows of the tokens met since the last call."""
        words, token_of = [], []
        for i, token in enumerate(self.fresh):
            parts = [token] if token.isalpha() else "".join(c if c.isalpha() else " " for c in token).split()
            words += parts
            token_of += [i] * len(parts)
        found, counts = [], []
        for word in words:
            rows = self.model.rows_of(word)
            found += rows
            counts.append(len(rows))
        new = np.zeros((len(self.fresh), self.rows.shape[1]), np.float32)
        if words:
            n = np.array(counts)
            word_of = np.repeat(np.arange(len(words)), n)
            share = np.repeat(1 / np.maximum(n, 1), n)
            for k in range(len(self.model.languages)):
                mean = np.bincount(word_of, self.model.table[found, k] * share, minlength=len(words))
                new[:, k] = np.bincount(token_of, mean, minlength=len(new))
            new[:, -1] = np.bincount(token_of, minlength=len(new))
        self.rows = np.concatenate([self.rows, new])
        self.fresh = []

    def totals(self, texts: list[str]) -> np.ndarray:
        """Sums of the log frequencies by text, and its words."""
        out = np.zeros((len(texts), self.rows.shape[1]))
        for i in range(0, len(texts), 200):
            if len(self) > CACHE_WORDS:
                self.clear()
                self.rows = self.rows[:0]
            places = [list(map(self.__getitem__, t.lower().split())) for t in texts[i : i + 200]]
            self._measure()
            for j, at in enumerate(places):
                out[i + j] = self.rows[at].sum(axis=0, dtype=np.float64) if at else 0
        return out


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    docs_per_language: int = 1500,
    max_words: int = 60_000,
    max_grams: int = 120_000,
    longest: int = 4,
    max_languages: int = 1_000,
) -> LanguageModel:
    """Fit on labelled rows: about ``docs_per_language`` rows of each language, drawn by a hash of the key.

    Rows without text or label are left out, and labels beyond the ``max_languages`` most
    frequent. Of the words and n-grams the most frequent
    ``max_words`` and ``max_grams`` are kept; these bounds fix the size of the model.
    No labelled row: a model without languages, which predicts ``und``.
    """
    rows = docs.select(
        F.col(lang).cast("string").alias("_lang"), F.col(text).cast("string").alias("_text"), F.col(key).cast("string").alias("_key")
    ).where("_lang is not null and _text is not null")
    sizes = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(max_languages).collect()
    if not sizes:
        return LanguageModel([], np.zeros((0, 0), np.float32))
    most = F.create_map(*[F.lit(x) for r in sizes for x in (r[0], min(_DRAWS, _DRAWS * docs_per_language // r[1]))])
    sample = rows.where(F.pmod(F.xxhash64(F.coalesce("_key", F.lit(""))), F.lit(_DRAWS)) < F.try_element_at(most, F.col("_lang")))
    words = (
        sample.select("_lang", F.explode(F.expr(r"regexp_extract_all(lower(_text), '\\p{L}+', 0)")).alias("w"))
        .groupBy("_lang", "w").agg(F.count(F.lit(1)).alias("c"))
    ).persist()
    languages = sorted(r[0] for r in words.select("_lang").distinct().collect())
    # Columns by number: a language may have any name.
    counts = [f"c{i}" for i in range(len(languages))]
    number = F.concat(F.lit("c"), F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("_lang")) - 1)
    by_lang = lambda df: df.groupBy("w").pivot("_n", counts).agg(F.sum("c"))
    total = lambda df: df.withColumn("_all", sum((F.coalesce(F.col(c), F.lit(0)) for c in counts), F.lit(0)))
    if not languages:
        words.unpersist()
        return LanguageModel([], np.zeros((0, 0), np.float32))
    top = lambda df, n: total(by_lang(df.withColumn("_n", number))).where("_all > 1").orderBy(F.desc("_all"), "w").limit(n).drop("_all").toPandas()
    padded = F.concat(F.lit("\x02"), F.col("w"), F.lit("\x03"))
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(longest)),
            lambda n: F.when(
                F.length(padded) >= n,
                F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: padded.substr(i, n)),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    grams = words.select("_lang", F.explode(pieces).alias("w")).groupBy("_lang", "w").agg(F.count(F.lit(1)).alias("c"))
    tables, known = [], []
    for frame in (top(words, max_words), top(grams, max_grams)):
        seen = frame[counts].fillna(0).to_numpy(np.float64)
        size = np.array([len(w) for w in frame["w"]])
        log = np.zeros_like(seen)
        for group in [size == n for n in range(1, longest + 1)] if known else [slice(None)]:
            part = seen[group] + 0.1
            log[group] = np.log(part / part.sum(axis=0)) if len(part) else part
        start = sum(map(len, tables))
        known.append({w: start + i for i, w in enumerate(frame["w"])})
        tables.append(log.astype(np.float32))
    words.unpersist()
    return LanguageModel(languages, np.concatenate(tables), known[0], known[1], longest)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """Add the predicted language and its probability among the model's languages.

    Null text, text without a letter, or a model without languages: ``und`` and 0. Equal scores go
    to the first language in alphabetical order. Every other column is kept; an input column that
    bears an output's name is replaced. An empty table stays empty.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<l string, s double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = _Scores(shipped.value)
        names = shipped.value.languages
        for batch in batches:
            labels, shares = [], []
            texts = batch.to_pylist()
            for total in scores.totals([t or "" for t in texts]) if names else ():
                logs = total[:-1]
                best = int(np.argmax(logs))
                labels.append(names[best] if total[-1] else UNDETERMINED)
                shares.append(float(1.0 / np.exp(np.clip(logs - logs[best], -700, 0)).sum()) if total[-1] else 0.0)
            if not names:
                labels, shares = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            yield pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(shares, pa.float64())], ["l", "s"])

    kept = [c for c in docs.columns if c not in (out, score)]
    return docs.withColumn("_p", predict.asNondeterministic()(text_of(text))).select(
        *[F.col(f"`{c}`") for c in kept], F.col("_p.l").alias(out), F.col("_p.s").alias(score)
    )
