"""Target resampling, MinHash groups and vector codes against plain versions."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from specgrade.llm import minhash, resample, vector_codes
from test_similar import brute, texts


def plain_features(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, percent, seed, least, longest, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    c, t = [0] * buckets, [0] * buckets
    for rows, counts in ((docs, c), (target, t)):
        for _, text in rows:
            for f in plain_features(text, longest)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(c) + buckets) / ((c[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        n, found = plain_features(text, longest)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    ranked = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    place = {id(r): k + 1 for k, r in enumerate(ranked[: len(ranked) * percent // 100])}
    return sorted([(*r[:4], place.get(id(r))) for r in out], key=str)


@pytest.mark.parametrize("longest, piece", [(2, 1 << 20), (1, 7), (3, 5), (4, 11)])
def test_resample_equals_plain(spark, monkeypatch, longest, piece):
    monkeypatch.setattr(resample, "PIECE_BYTES", piece)
    rng = random.Random(longest)
    words = ["Ab", "cd9", "É", "ßx", "naïve", "7", "tail", "data", "　", "x" * 40]
    docs = [(i, rng.choice([" ", "-", "\n", "\x7f"]).join(rng.choices(words, k=rng.choice([0, 1, 5, 25, 60])))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, " ,;\t"), (None, "data tail " * 30), (503, "data " * 20_000)]
    target = [(1, "data tail tail data naïve"), (2, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as rank", "2 as k", "3 as w").repartition(3)
    wanted = spark.createDataFrame(target, "item_id long, text string")
    got = resample.resample(frame, wanted, percent=30, seed=5, least_words=4, features=resample.Features(longest, 97))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(docs, target, 30, 5, 4, longest, 97)


def test_resample_edges(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    none = docs.limit(0)
    assert resample.resample(none, docs).collect() == []
    ranks = [r.rank for r in resample.resample(docs, none, percent=100, least_words=1).collect()]
    assert sorted(ranks) == [1, 2, 3]


@pytest.mark.parametrize("words, threshold, rows, tokens", [(5, Fraction(17, 20), 20_000, 2_000_000), (3, Fraction(9, 10), 6, 300), (5, Fraction(17, 20), 3, 200)])
def test_minhash_equals_brute_force(spark, monkeypatch, words, threshold, rows, tokens):
    monkeypatch.setattr(minhash, "BUCKET_ROWS", rows)
    monkeypatch.setattr(minhash, "BLOCK_TOKENS", tokens)
    rng = random.Random(3)
    near = [" ".join(f"w{rng.randrange(5000)}" for _ in range(150)) for _ in range(4)]
    for i in range(0, 4):
        base = near[i].split()
        for _ in range(30):
            edited = list(base)
            for _ in range(rng.choice([1, 1, 2, 3])):
                edited[rng.randrange(150)] = f"e{rng.randrange(50)}"
            near.append(" ".join(edited))
    data = texts() + [(2000 + i, t) for i, t in enumerate(near)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'c' as cls", "1 as n", "2 as component_id").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(df, words=words, threshold=threshold).collect()}
    assert got == brute(data, words, threshold)


def test_minhash_edges(spark):
    rows = [(4, "same text"), (2, "same TEXT"), (None, "same text"), (4, "same text"), (7, None), (8, ""), (8, " \n"), (None, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in minhash.near_groups(df).collect()], key=str)
    assert got == sorted([(4, 1, 2, False), (2, 1, 2, True), (None, 1, 2, False), (4, 1, 2, False), (7, 0, 7, True), (8, 0, 8, True), (8, 0, 8, True), (None, 1, None, True)], key=str)
    assert minhash.near_groups(df.limit(0)).collect() == []


def test_leaders_tie_all_near_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (5, 100), dtype=np.uint8)
    sigs = base[rng.integers(0, 5, 200)]
    noise = rng.random(sigs.shape) < rng.choice([0, 0.05, 0.2], 200)[:, None]
    sigs = np.where(noise, rng.integers(0, 256, sigs.shape, dtype=np.uint8), sigs)
    leaders, ties = minhash.lead(sigs, 0.2, 0.2 + 0.28)
    tied = {i: {i} if i in leaders else set() for i in range(200)}
    for i, j in ties:
        tied[i].add(j)
    for i in range(200):
        for j in range(i):
            if (sigs[i] != sigs[j]).mean() <= 0.28:
                assert tied[i] & tied[j]


def plain_codes(rows, parts, entries, rounds, scale):
    ok = [(i, [math.floor(scale * float(np.float32(y))) for y in v], l) for i, v, l in rows if v is not None and all(y is not None and math.isfinite(y) for y in v)]
    if not ok:
        return []
    width = -(-max(len(v) for _, v, _ in ok) // parts)
    ok = [(i, v + [0] * (parts * width - len(v)), l) for i, v, l in ok]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in ok[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((apart(x, e), k) for k, e in enumerate(books[p])) for p, x in enumerate(cut(v))] for _, v, _ in ok]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), f in zip(ok, found) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    by_label = {}
    for (_, _, l), e in zip(ok, errors):
        by_label[l] = by_label.get(l, 0) + e
    return sorted([(i, "".join(f"{k:02x}" for _, k in f), e, by_label[l], digest) for (i, _, l), f, e in zip(ok, found, errors)], key=str)


@pytest.mark.parametrize("case", ["normal", "coarse", "odd", "large", "one", "none"])
def test_codes_equal_plain(spark, case):
    rng = np.random.default_rng(8)
    entries, rounds = 20, 5
    if case in ("normal", "coarse", "large"):
        x = rng.normal(size=(400, 12))
        x = np.round(x) / 1024 if case == "coarse" else x * (1e30 if case == "large" else 1)
        rows = [(i, [float(np.float32(y)) for y in v], i % 3 or None) for i, v in enumerate(x)]
        if case == "large":
            rows = [(i, [3.0e5 * float(np.sign(y)) for y in v], l) for i, v, l in rows]
    elif case == "odd":
        rows = [(5, [1.0, 2.0, 3.0], 1), (5, [1.0, 2.0], None), (None, [9.0], 2), (7, None, 1), (8, [float("nan")], 1), (9, [None, 1.0], 1), (10, [float("inf")], 3), (11, [], 4), (5, [1.0, 2.0], None)]
    else:
        rows = [(3, [0.5, 1.5, 2.5, 3.5], None)] if case == "one" else []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as id", "1 as error", "2 as code", "3 as v").repartition(3)
    got = vector_codes.encode(df, entries=entries, rounds=rounds)
    assert sorted(map(tuple, got.collect()), key=str) == plain_codes(rows, 4, entries, rounds, 1024)


def test_codes_hold_huge_components(spark):
    df = spark.createDataFrame([(1, [1e38] * 8, 1), (2, [-1e38] * 8, 1), (3, [0.0] * 8, 1)], "vec_id long, embedding array<float>, label int")
    errors = [r.error for r in vector_codes.encode(df, entries=1, rounds=1).collect()]
    assert all(0 <= e < 2**63 for e in errors) and max(errors) > 2**58


def test_bounds_stay_valid():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (300, 4))
    entries = rng.integers(-50, 50, (32, 4))
    bounds, best = vector_codes.Bounds.fresh(vector_codes.squares(x, entries), 6)
    for tracked in (6, 5, 3, 2):
        moved = entries + rng.integers(-2, 3, entries.shape)
        bounds.move(np.sqrt(((moved - entries) ** 2).sum(1)) * (1 + 1e-12))
        bounds.narrow(tracked)
        entries = moved
        best, needed = vector_codes.reassign(x, entries, bounds)
        d = vector_codes.squares(x, entries)
        assert (best == d.min(1)).all() and (bounds.ids[:, 0] == d.argmin(1)).all()
        assert (bounds.low <= np.sqrt(np.take_along_axis(d, bounds.ids.astype(int), 1))).all()
        others = d.copy()
        np.put_along_axis(others, bounds.ids.astype(int), 1 << 40, 1)
        assert (bounds.outer <= np.sqrt(others.min(1))).all()
        assert bounds.ids.shape[1] == tracked and needed.min() >= 1


def test_names_of_columns_and_languages_cannot_clash(spark):
    from specgrade.llm import langid, merkle, mixing, pii

    reserved = ["_found", "_spans", "_base", "_more", "_pii"]
    docs = spark.createDataFrame([(1, "mail a@b.cd now")], "doc_id long, text string")
    for c in reserved:
        docs = docs.withColumn(c, F.lit("x"))
    cleaned = pii.redact(docs)
    assert cleaned.columns == docs.columns and cleaned.first()["text"] == "mail [EMAIL] now"
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, None, 5)], "doc_id long, source string, _tokens long")
    for c in ("_source", "_row", "_key", "_w", "_full", "_bucket"):
        rows = rows.withColumn(c, F.lit(1))
    mixed = mixing.mix(rows, F.col("_tokens"), keep_all=True)
    assert mixed.columns[: len(rows.columns)] == rows.columns and {r.doc_id for r in mixed.collect()} == {1, 2, 3}
    keyed = spark.createDataFrame([("b", "2"), ("a", "1"), (None, "0"), ("c", "3")], "doc_id string, text string")
    assert {r.text: r.next_text for r in merkle.with_next(keyed).collect()} == {"0": "1", "1": "2", "2": "3", "3": "0"}
    assert merkle.with_next(keyed.limit(0)).collect() == []
    languages = ["w", "_all", "c0", "c1", "_n", "W"]
    train = [(i, f"{x.strip('_')}sound house{i % 6}", x) for i, x in enumerate(languages * 4)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == sorted(languages)
    got = langid.identify(spark.createDataFrame([(1, "house2")], "doc_id long, text string"), model).first()
    assert 0 <= got["lang_score"] <= 1


def plain_language(train, texts, longest=4):
    """Word-first backoff, written out."""
    letters = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    words, grams, langs = {}, {}, sorted({g for _, g in train})
    for text, lang in train:
        for w in letters(text):
            words.setdefault(w, {}).setdefault(lang, 0)
            words[w][lang] += 1
    for w, by in words.items():
        padded = f"\x02{w}\x03"
        for n in range(1, longest + 1):
            for i in range(len(padded) - n + 1):
                for lang in by:
                    cell = grams.setdefault(padded[i : i + n], {})
                    cell[lang] = cell.get(lang, 0) + 1
    logs = {}
    for table, classes in ((words, [None]), (grams, range(1, longest + 1))):
        for n in classes:
            known = [k for k, by in table.items() if sum(by.values()) > 1 and (n is None or len(k) == n)]
            for lang in langs:
                total = sum(table[k].get(lang, 0) + 0.1 for k in known)
                for k in known:
                    logs[(n is None, k, lang)] = math.log((table[k].get(lang, 0) + 0.1) / total)
    known = {(kind, k) for kind, k, _ in logs}
    out = []
    for text in texts:
        found, score = letters(text), dict.fromkeys(langs, 0.0)
        for w in found:
            used = [(True, w)] if (True, w) in known else []
            padded = f"\x02{w}\x03"
            for n in range(longest, 0, -1):
                used = used or [(False, padded[i : i + n]) for i in range(len(padded) - n + 1) if (False, padded[i : i + n]) in known]
            for lang in langs:
                score[lang] += sum(logs[(*u, lang)] for u in used) / len(used) if used else 0.0
        best = min(langs, key=lambda g: -score[g])
        share = 1 / sum(math.exp(score[g] - score[best]) for g in langs)
        out.append((best, share) if found else ("und", 0.0))
    return out


def test_language_equals_plain_backoff(spark):
    from specgrade.llm import langid

    rng = random.Random(6)
    sounds = {"aa": "ka lo mi nu".split(), "bb": "st er un ka".split(), "cc": "qui lo ço éa".split()}
    word = lambda g: "".join(rng.choices(sounds[g], k=rng.choice([1, 2, 3])))
    train = [(" ".join(word(g) for _ in range(rng.choice([1, 5, 12]))), g) for g in sounds for _ in range(15)]
    texts = [" ".join(word(rng.choice(list(sounds))) for _ in range(rng.choice([0, 1, 4]))) for _ in range(60)] + ["zzz", "KALO, mi-nu! 12", "", "xka99lo"]
    model = langid.fit(spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(train)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, (lang, score) in enumerate(plain_language(train, texts)):
        assert got[i].lang_score == pytest.approx(score, rel=1e-4), texts[i]
        if score < 0.999 * 0.5 or score > 0.501:
            assert got[i].lang_pred == lang, texts[i]
