"""Language model and language identification."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from specgrade.llm import langid, ngram_lm
from specgrade.llm.queries import QUERIES

TEXTS = ["the cat sat", "the cat ran", "The CAT sat on\tthe mat", None, "", "a b a b a b", "the the the the", "ça va\u00a0bien the"] * 3 + ["w " * 9000]


def brute(train, rows):
    words = lambda t: (t or "").encode().lower().split() + ["end"]
    count, pairs, contexts = Counter(), Counter(), Counter()
    for t in train:
        w = words(t)
        before = ["start", *w[:-1]]
        count.update(w)
        contexts.update(before)
        pairs.update(zip(before, w))
    preceded, follow = Counter(w for _, w in pairs), defaultdict(list)
    for (v, _), n in pairs.items():
        follow[v].append(n)
    sizes = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
    d, e = ngram_lm.discounts(sizes(pairs)), ngram_lm.discounts(sizes(preceded))
    n, v = sum(count.values()), len(count)
    rest = sum(e[min(k, 3) - 1] for k in preceded.values())

    def p(ctx, w):
        k = preceded[w]
        low = (max(k - (0, *e)[min(k, 3)], 0) + rest / (v + 1)) / len(pairs)
        if not contexts[ctx]:
            return low
        k = pairs[ctx, w]
        return (max(k - (0, *d)[min(k, 3)], 0) + sum(d[min(x, 3) - 1] for x in follow[ctx]) * low) / contexts[ctx]

    out = []
    for t in rows:
        w = words(t)
        out.append(
            (len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w),
             sum(math.log10(p(c, x)) for c, x in zip(["start", *w[:-1]], w)))
        )
    total = sum(p(b"the", x) for x in count) + p(b"the", b"never seen")
    return out, n, v, total


@pytest.mark.parametrize("block", [5, 1_000_000])
def test_model_equals_a_plain_one(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_lm, "BLOCK_TOKENS", block)
    train = TEXTS[:-2]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = ngram_lm.fit(docs.where(F.col("doc_id") < len(train)).repartition(3))
    want, n, v, total = brute(train, TEXTS)
    assert (model.tokens, model.words) == (n, v) and total == pytest.approx(1)
    got = {r.doc_id: r for r in ngram_lm.score(docs, model).collect()}
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_tokens, r.n_known) == w[:2]
        assert (r.base_score, r.score) == (pytest.approx(w[2], rel=1e-6), pytest.approx(w[3], rel=1e-6))


def test_words_that_share_40_bits_of_their_hash_are_counted_apart(spark):
    import xxhash

    one, two = "w1148563", "w3906839"
    assert (xxhash.xxh3_64_intdigest(one) ^ xxhash.xxh3_64_intdigest(two)) % 2**40 == 0
    train, asked = [f"{one} a {one} b", "a b"], [f"{one} a", f"{two} a"]
    model = ngram_lm.fit(spark.createDataFrame(list(enumerate(train)), "doc_id long, text string"))
    got = {r.doc_id: r for r in ngram_lm.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    assert [got[i].n_known for i in (0, 1)] == [3, 2]
    both = ngram_lm.fit(spark.createDataFrame([(0, f"{one} {two}")], "doc_id long, text string"))
    assert (both.words, both.bigrams) == (3, 3)


def test_bigrams_travel_in_few_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").coalesce(1)
    size = sum(F.coalesce(F.length(c), F.lit(0)) for c in "abcde")
    parts = ngram_lm._count(docs, 6).where("kind = 'b'").groupBy("shard").agg(F.sum(size).alias("n"))
    total, largest = parts.agg(F.sum("n"), F.max("n")).first()
    blocks = ngram_lm._blocks(docs.toArrow().to_batches(), 0)
    pairs = sum(len({*zip(*(x.tolist() for x in ngram_lm._bigrams(texts)))}) for _, texts in blocks)
    # Two ids of 64 bits and a count are 17 bytes; the grid spreads frequent words.
    assert total < 13 * pairs and largest < 3 * total / 64


def test_model_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    model = ngram_lm.fit(docs.limit(0))
    assert {(r.n_tokens, r.n_known, r.score) for r in ngram_lm.score(docs, model).collect()} == {(3, 0, 0.0), (1, 0, 0.0)}
    assert ngram_lm.score(docs.limit(0), ngram_lm.fit(docs)).collect() == []


def test_model_beats_unigrams_on_held_out_texts(spark):
    got = [r for r in QUERIES["op2_kneser_ney"](spark, "/root/testdata/sf0.001").collect() if r.held_out]
    assert sum(r.score > r.base_score for r in got) > 0.9 * len(got)


def test_language_accuracy(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op10_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


LABELLED = [(i, t, g) for i, (t, g) in enumerate([("the house and the dog", "en"), ("das haus und der hund", "de")] * 5)]


def test_language_edges(spark):
    train = spark.createDataFrame([*LABELLED, (90, None, "en"), (91, "x y", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model.languages == ["de", "en"]
    asked = [(1, "the dog", 0), (2, None, 0), (3, "", 0), (4, "12 :-)", 0), (5, "hundehaus", 0), (5, "hundehaus", 0), (None, "und der", 0), (7, "the house " * 30_000, 0)]
    df = spark.createDataFrame(asked, "doc_id long, text string, lang_pred long")
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(df, model).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "de"), (5, "de"), (None, "de"), (7, "en")], key=str
    )
    assert langid.identify(df.limit(0), model).collect() == []


def test_no_labels(spark):
    model = langid.fit(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string"))
    got = langid.identify(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, r.lang_score) for r in got] == [("und", 0.0)]


def test_small_cache_changes_nothing(monkeypatch):
    import numpy as np

    model = langid.LanguageModel(["a", "b"], np.array([[-1, -2], [-3, -1], [-5, -4]], np.float32), {"x": 0, "y": 1}, {"z": 2}, 4)
    texts = ["x y zz", "", "y, x-y", "q"] * 200
    wide = langid._Scores(model).totals(texts)
    monkeypatch.setattr(langid, "CACHE_WORDS", 1)
    assert (langid._Scores(model).totals(texts) == wide).all()
    assert wide[0].tolist() == [-9.0, -7.0, 3.0] and wide[3].tolist() == [0.0, 0.0, 1.0]
