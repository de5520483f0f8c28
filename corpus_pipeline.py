"""Corpus pipeline: language, near duplicates, personal data, mixture, packing.

Each stage is one of the corpus operators applied to what its predecessor wrote. ``run`` writes
every stage to the shared folder, so that a later stage never repeats an earlier one.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, functions as F

from specgrade.llm import jaccard, langid, mixing, packing, pii
from specgrade.llm.common import crc_mod, spread
from specgrade.llm.queries import TOKENIZER
from specgrade.session import materialise

# Texts whose best language is less likely than this are rejected.
LEAST_LANGUAGE_SCORE = 0.4
# No source is repeated more often than this relative to the one repeated least.
MAX_REPEATS = 1.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter and texts of no clear language."""
    model = langid.fit(docs.where(crc_mod("doc_id", 4) != 2))
    named = langid.identify(spread(docs), model, out="_lang_pred", score="_lang_score")
    clear = (F.col("_lang_pred") != langid.UNDETERMINED) & (F.col("_lang_score") >= LEAST_LANGUAGE_SCORE)
    return named.where(clear).select(*docs.columns)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 of their five-word shingles, keep one."""
    return jaccard.keep_one(docs, words=5, threshold=Fraction(4, 5))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind; ``n_chars`` follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat rows of small sources by their temperature weight; every row comes at least once."""
    mixed = mixing.mix(docs, mixing.words("text"), max_repeats=MAX_REPEATS, keep_all=True)
    return mixed.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mixture into sequences of 2048 tokens."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard", duplicates_stage),
    ("personal_data", personal_data_stage),
    ("mixture", mixing_stage),
    ("best_fit_packing", packing_stage),
]
# Language scores, similarity groups and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each on what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
