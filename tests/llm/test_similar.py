"""Jaccard join, components, exact top-k search."""

import random
import time
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from specgrade import session
from specgrade.llm import jaccard, topk
from specgrade.llm.components import components


def brute(rows, k, t):
    sets = {}
    for i, x in rows:
        w = (x or "").encode().lower().split()
        sets[i] = set() if not w else {tuple(w)} if len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    top = {i: i for i in sets}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if b < a and common and common >= t * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") + rng.choice("klmnopq") for _ in range(rng.choice([2, 5, 12, 40, 120]))) for _ in range(20)]
    rows = []
    for i in range(250):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        rows.append((i, " ".join(w)))
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "long word " * 20_000), (904, "LONG word " * 20_000)]


@pytest.mark.parametrize("words, threshold, load", [(3, Fraction(9, 10), 4_000_000), (5, Fraction(4, 5), 300), (2, Fraction(1, 2), 300)])
def test_groups_equal_brute_force(spark, monkeypatch, words, threshold, load):
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", load)
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(df, words=words, threshold=threshold).collect()}
    assert got == brute(rows, words, threshold)


def test_pairs_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", 400)
    rows = texts()
    pairs, members = jaccard.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), words=3, threshold=Fraction(4, 5))
    cls = {r.doc_id: r.cls for r in members.collect()}
    got = {tuple(r) for r in pairs.collect()}
    sets = {}
    for i, x in rows:
        w = (x or "").encode().lower().split()
        sets[i] = set() if not w else {tuple(w)} if len(w) < 3 else {tuple(w[j : j + 3]) for j in range(len(w) - 2)}
    assert set(cls) == {i for i in sets if sets[i]}
    want = set()
    for a in cls:
        for b in cls:
            common = len(sets[a] & sets[b])
            if b < a and common * 5 >= 4 * (len(sets[a]) + len(sets[b]) - common):
                if cls[a] == cls[b]:
                    assert sets[a] == sets[b]
                else:
                    want.add((min(cls[a], cls[b]), max(cls[a], cls[b])))
    assert got == want and len(want) > 20


def test_a_cluster_of_near_copies_is_one_group(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    _, _, found = jaccard._candidates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 3, Fraction(4, 5))
    assert found.select("grp").distinct().count() <= 3


def test_a_stored_table_leaves_no_shuffle_behind(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {f for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    before = shuffled()
    stored = session.materialise(spark.range(100).repartition(3, "id"), "rows")
    for _ in range(40):  # files go in the background
        if not shuffled() - before:
            break
        time.sleep(0.25)
    assert not shuffled() - before and stored.count() == 100


def test_groups_leave_no_sets_behind(spark, tmp_path, monkeypatch):
    rows = [r for r in texts() if r[0] < 60]
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    found = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=3, threshold=Fraction(9, 10))
    kept = {f.parent.name.rsplit("-", 1)[0] for f in tmp_path.rglob("*.parquet")}
    assert kept and not kept & {"sketch", "left", "sets", "pairs", "linked", "opened"}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(rows, 3, Fraction(9, 10))


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, "x"), (3, long + " end", "y"), (8, "start " + long, "z"), (9, "other", "x"), (None, long, "n"), (9, "other", "x"), (1, None, "x"), (2, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumn("_kept", F.lit(1)).withColumn("kept", F.lit(2))
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted([(r.doc_id, r.component_id) for r in kept.collect()], key=str) == sorted(
        [(3, "y"), (9, "x"), (9, "x"), (1, "x"), (2, "x"), (None, "n")], key=str
    )
    assert jaccard.similar_groups(df.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    rng.shuffle(edges)
    got = dict(tuple(r) for r in components(spark.createDataFrame([*edges, (7, 7), (None, 3)], "u long, v long")).collect())
    top = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(top)):
        for a, b in edges:
            if a != b:
                top[a] = top[b] = min(top[a], top[b])
    assert got == top


def best(rows, k):
    ok = [(i, np.floor(64 * np.array(x, np.float64)).astype(np.int64)) for i, x in rows if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)]
    out = []
    width = max([len(x) for _, x in ok], default=0)
    full = [np.pad(x, (0, width - len(x))) for _, x in ok]
    for a, (i, _) in enumerate(ok):
        if i % 5 == 0:
            ranked = sorted((-int(full[a] @ full[b]), j) for b, (j, _) in enumerate(ok) if b != a)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(ranked)]
    return sorted(out)


def vectors(name):
    rng = np.random.default_rng(1)
    if name == "odd":
        odd = [(i % 90, [1.0, 2.0]) for i in range(120)] + [(200 + i, None if i % 3 == 0 else [float("nan"), 1.0] if i % 3 == 1 else [None, 1.0]) for i in range(9)]
        return odd + [(300, [float("inf")]), (305, []), (310, [5.0]), (315, [1.0] * 3), (None, [1.0])] + [(400 + i, [-1.0, -2.0]) for i in range(30)]
    if name == "few":
        return [(0, [1.0]), (5, [2.0])]
    if name == "none":
        return []
    x = rng.normal(size=(300, 40))
    if name == "lengths":
        x *= rng.lognormal(0, 1, size=(300, 1))
    if name == "clusters":
        x = x[rng.integers(0, 8, 300)] + rng.normal(size=(300, 40)) * 0.05
    return [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("name", ["lengths", "clusters", "odd", "few", "none"])
def test_top_products(spark, name):
    rows = vectors(name)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as score", "1 as uid").repartition(3)
    got = topk.top_products(df, F.col("vec_id") % 5 == 0, k=7, bucket_rows=50, query_rows=20).collect()
    assert sorted(tuple(r) for r in got) == best(rows, 7)
