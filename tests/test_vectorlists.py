"""Lists with metric bounds against brute force; recall of the approximate search."""

import re

import numpy as np
import pytest

from specgrade.operators import vectorlists as vl


def frame(spark, x, name="id"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{name} long, embedding array<double>").repartition(4)


def clusters(rng, n, width=12, k=20, noise=0.15):
    return rng.normal(size=(k, width))[rng.integers(0, k, n)] + rng.normal(size=(n, width)) * noise


def brute(q, x, k, metric):
    out = {}
    for i, row in enumerate(q):
        score = np.round(np.sqrt(((x - row) ** 2).sum(1)), 12) if metric == "l2" else -np.round(x @ row, 12)
        out[i] = list(np.lexsort((np.arange(len(x)), score))[:k])
    return out


def hits(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["pos"]):
        out.setdefault(r["qid"], []).append(r["item_id"])
    return out


@pytest.mark.parametrize("metric", ["l2", "dot"])
@pytest.mark.parametrize("block", [16, 4096])
def test_exact_search_equals_brute_force(spark, metric, block):
    rng = np.random.default_rng(3)
    x = clusters(rng, 400)
    x = np.vstack([x, x[:5], np.zeros((1, 12)), x[:3] * 5])  # ties, a zero vector, long vectors
    q = np.vstack([clusters(rng, 30), x[:5], np.zeros((1, 12))])
    lists = vl.build(frame(spark, x), "id", block_rows=block)
    found = vl.nearest(frame(spark, q, "qid"), lists, 7, "qid", metric=metric)
    assert hits(found.rows) == brute(q, x, 7, metric)


def test_bounds_leave_most_blocks_closed(spark):
    rng = np.random.default_rng(5)
    x = clusters(rng, 1500, k=25, noise=0.05)
    lists = vl.build(frame(spark, x), "id", block_rows=32)
    found = vl.nearest(frame(spark, x[:40], "qid"), lists, 5, "qid")
    assert hits(found.rows) == brute(x[:40], x, 5, "l2")
    assert found.opened_share() < 0.3
    assert found.opened.groupBy("qid", *vl.PLACE).count().where("count > 1").count() == 0


def test_recall_of_probes(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    lists = vl.build(frame(spark, x), "id")
    want = brute(x[:60], x, 10, "dot")
    recall = lambda got: np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want])
    some = vl.nearest(frame(spark, x[:60], "qid"), lists, 10, "qid", metric="dot", probes=16)
    assert recall(hits(some.rows)) >= 0.9 and some.opened_share() < 0.7
    few = vl.nearest(frame(spark, x[:60], "qid"), lists, 10, "qid", metric="dot", probes=2)
    assert recall(hits(few.rows)) < recall(hits(some.rows))
    every = vl.nearest(frame(spark, x[:60], "qid"), lists, 10, "qid", metric="dot", probes=len(lists.centres))
    assert hits(every.rows) == want


def test_one_value_fills_the_index_and_empty_sides(spark):
    x = np.vstack([np.ones((300, 4)), np.eye(4)])
    lists = vl.build(frame(spark, x), "id", block_rows=20)
    assert hits(vl.nearest(frame(spark, x[:3], "qid"), lists, 4, "qid").rows) == brute(x[:3], x, 4, "l2")
    assert hits(vl.nearest(frame(spark, np.eye(4)[:1], "qid"), lists, 1000, "qid").rows) == brute(np.eye(4)[:1], x, 1000, "l2")
    none = frame(spark, x).limit(0)
    assert vl.nearest(frame(spark, x[:3], "qid"), vl.build(none, "id"), 4, "qid").rows.collect() == []
    assert vl.nearest(frame(spark, x[:1], "qid").limit(0), lists, 4, "qid").rows.collect() == []
    blank = spark.createDataFrame([(1, None)], "qid long, embedding array<double>")
    assert vl.nearest(blank, lists, 4, "qid").rows.collect() == []


def test_pairs_carry_no_vectors_and_lists_stay_few(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4500, 4))
    lists = vl.build(frame(spark, x), "id")
    assert len(lists.centres) <= 64
    found = vl.nearest(frame(spark, x[:50], "qid"), lists, 3, "qid", metric="dot")
    assert not [c for c, kind in found.opened.dtypes if kind.startswith("array")]
    assert hits(found.rows) == brute(x[:50], x, 3, "dot")


def test_default_lists_follow_blocks():
    assert [vl.default_lists(n) for n in (0, 1, 100, 4500, 100_000, 10_000_000)] == [1, 1, 10, 64, 64, 611]


def test_a_task_holds_few_scores_at_once():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from specgrade.operators import fewshot as fs

    rng = np.random.default_rng(1)
    asked = pd.DataFrame({"q": np.arange(3_000), "_q": list(rng.normal(size=(3_000, 16)))})
    x = rng.normal(size=(2_000, 16))
    held = pd.DataFrame({"i": np.arange(2_000)})
    tracemalloc.start()
    n = sum(len(fs.score_block(tile, ["q"], held, ["i"], x, 20, "dot")) for tile in fs.tiles(asked, len(x)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000
    # All scores are 48 MB, and several arrays of a tile live at once.
    assert peak < 25e6


@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_a_block_gives_its_best_rows_and_no_worse_than_the_bound(metric, monkeypatch):
    monkeypatch.setattr(vl, "TILE_ROWS", 16)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(150, 3)), 1)
    x[40:90] = x[3]  # many ties
    x[100] = np.nan
    q, k = np.vstack([x[:30], np.zeros((1, 3))]), 6
    dots = q @ x.T
    score = -dots if metric == "dot" else np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * dots, 0))
    order = [sorted(range(150), key=lambda j: (np.isnan(s[j]), np.round(s[j], 12), j))[:k] for s in score]
    ends = np.array([s[o[-1]] for s, o in zip(score, order)])
    for tau in (np.full(len(q), np.inf), ends, ends - 0.5):
        rows, at, dot, _ = vl.best_of_block(q, x, k, metric, -tau if metric == "dot" else tau)
        want = [(i, j) for i, o in enumerate(order) for j in o if score[i, j] <= tau[i] + 1e-9]
        assert [(i, j) for i, j in zip(rows.tolist(), at.tolist()) if score[i, j] <= tau[i] + 1e-9] == want
        assert len(rows) <= k * len(q) and np.allclose(dot, dots[rows, at])


def test_later_blocks_send_only_what_can_still_win(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 8))
    lists = vl.build(frame(spark, x, "id"), "id", lists=12, block_rows=25)
    sent, plain = [], vl._scan

    def scan(pairs, *args):
        sent.append((pairs, plain(pairs, *args)))
        return sent[-1][1]

    monkeypatch.setattr(vl, "_scan", scan)
    found = vl.nearest(frame(spark, x, "qid"), lists, 5, "qid", metric="dot")
    pairs, rows = sent[-1]
    assert 1000 < rows.count() < 0.4 * 5 * pairs.count()
    assert hits(found.rows) == brute(x, x, 5, "dot")


def test_unit_vectors_take_their_norm_once(spark):
    from pyspark.sql import functions as F
    from specgrade.functions.vectors import l2_normalize

    rows = [([3.0, 4.0],), ([],), (None,), ([0.0, 0.0],), ([2.0, None],)]
    unit = spark.createDataFrame(rows, "e array<float>").select(l2_normalize(F.col("e")).alias("u"))
    assert [r.u for r in unit.collect()] == [[0.6, 0.8], [], None, [0.0, 0.0], [2.0 / 1e-12, None]]
    # The body of a lambda runs for every component; the norm must stand outside.
    plan = unit._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"lambda \w+#\d+ / lambda \w+#\d+", plan), plan
