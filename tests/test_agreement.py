import pytest
from pyspark.sql import functions as F

from specgrade.operators import agreement as ag, canon
from specgrade.operators.classmetrics import confusion, kappa, pair_counts, per_class, summary
from specgrade.session import local_table


@pytest.fixture(scope="module")
def dimension(spark):
    traits = local_table(spark, [("margin", "entire|toothed", True), ("notes", "x", False)], "key string, canonical_values string, gradable boolean")
    aliases = local_table(spark, [("margin", "entero", "entire"), ("margin", "serrate", "toothed"), ("margin", "dentado", "toothed")], "trait string, alias string, token string")
    return canon.trait_dimension(traits, aliases)


CASES = [
    ("Entero", "entire"), ("toothed, serrate", "toothed"), ("toothed – serrate", "toothed"), ("entire to toothed", None), ("not toothed", None),
    ("[entire]", "entire"), ("N/A", None), (None, None), ("wavy", None), ("Dentado.", "toothed"),
]


def test_tokens(spark, dimension):
    df = spark.createDataFrame([(i, "margin", r) for i, (r, _) in enumerate(CASES)] + [(99, "notes", "x"), (98, "gone", "x")], "id int, trait string, raw string")
    got = {r["id"]: r["token"] for r in canon.to_tokens(df, dimension).collect()}
    assert got == {i: w for i, (_, w) in enumerate(CASES)}


def test_unmapped_values(spark, dimension):
    df = spark.createDataFrame([("margin", "wavy", 5), ("margin", "wavy", 3), ("margin", "n/a", 1), ("margin", "entire", 2)], "trait string, raw string, pos int")
    assert [tuple(r) for r in canon.unmapped_values(df, dimension, "pos").collect()] == [("margin", "wavy", 3, 2)]


def test_headers_match_by_prefix():
    got = canon.header_traits(["Márgen de la hoja (entero)", "Otro"], {"margin": "margen de la hoja"})
    assert got == {"Márgen de la hoja (entero)": "margin"}


def test_mode_ties_go_to_the_first_value(spark):
    data = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "y"), ("a", 4, "x"), ("b", 1, None), ("c", 1, None), ("c", 2, "z")]
    out = {r["k"]: r for r in ag.modal_values(spark.createDataFrame(data, "k string, pos int, v string"), "k", "v", "pos").collect()}
    assert (out["a"]["mode"], out["a"]["n_views"], out["a"]["n_present"], out["a"]["consistency"]) == ("x", 4, 4, 0.5)
    assert out["b"]["mode"] is None and out["b"]["n_present"] == 0
    assert out["c"]["mode"] == "z" and out["c"]["n_views"] == 2


@pytest.mark.parametrize(
    "pairs, want",
    [
        ([("a", "a")], None), ([("a", "a"), ("a", "a")], None), ([("a", "a"), ("a", "b")], 0.0), ([("a", "a"), ("b", "b")], 1.0),
        ([("a", "b"), ("b", "a")], -1.0), ([("a", "a"), ("b", "b"), ("a", "b"), ("b", "b")], 0.5),
    ],
)
def test_kappa_edges(spark, pairs, want):
    df = spark.createDataFrame(pairs, "x string, y string")
    assert kappa(pair_counts(df, [], "x", "y")).first()["cohen_kappa"] == (want if want is None else pytest.approx(want))


def test_axes_equal_pairwise_joins(spark):
    data = [(1, "m", "s", "a"), (1, "m", "t", "b"), (2, "m", "s", "a"), (2, "m", "t", None), (3, "m", "s", "c")]
    long = spark.createDataFrame(data, "specimen int, trait string, source string, token string")
    wide = ag.pair_axes(long, {"s_t": ("s", "t")}, ["specimen", "trait"])
    join = ag.pair_sources(long.where("source = 's'"), long.where("source = 't'"), ["specimen", "trait"])
    assert [tuple(r) for r in wide.select("specimen", "value_a", "value_b", "agree").collect()] == [(1, "a", "b", False)]
    assert join.count() == 1


@pytest.mark.parametrize("b_only, a_only, chi2, p", [(12, 2, 5.786, 0.0162), (16, 1, 11.529, 0.00069)])
def test_published_mcnemar_values(spark, b_only, a_only, chi2, p):
    data = [(True, False)] * a_only + [(False, True)] * b_only + [(True, True)] * 5
    out = ag.mcnemar(spark.createDataFrame(data, "a boolean, b boolean"), [], "a", "b", always_chi_square=True).first()
    assert out["chi2"] == pytest.approx(chi2, abs=5e-4) and out["p_value"] == pytest.approx(p, abs=5e-5)


def test_mcnemar_branches(spark):
    def p(a_only, b_only):
        data = [(True, False)] * a_only + [(False, True)] * b_only + [(True, True)]
        return ag.mcnemar(spark.createDataFrame(data, "a boolean, b boolean"), [], "a", "b").first()["p_value"]

    assert p(0, 0) is None
    assert p(0, 5) == pytest.approx(0.0625) and p(3, 3) == 1.0
    assert p(5, 20) == pytest.approx(0.00511, abs=1e-5)
    same = ag.mcnemar(spark.createDataFrame([(True, True)], "a boolean, b boolean"), [], "a", "b", always_chi_square=True).first()
    assert (same["p_value"], same["chi2"]) == (1.0, 0.0)


def test_triage_and_reasons(spark):
    data = [("a", 1.0, 0.5, 0.6), ("b", 0.6, 0.5, 0.5), ("c", 0.6, 0.5, 0.4), ("d", 0.6, None, 0.4), ("e", None, 0.5, 0.4)]
    df = spark.createDataFrame(data, "t string, m double, c double, b double")
    got = {r["t"]: (r["v"], r["w"]) for r in df.select("t", ag.triage(F.col("m"), F.col("c"), F.col("b")).alias("v"), ag.undecidable_reason(F.col("m"), F.col("c"), F.col("b")).alias("w")).collect()}
    assert [got[k][0] for k in "abcde"] == ["undecidable", "at_human_level", "model_gap", "undecidable", "undecidable"]
    assert (got["a"][1], got["d"][1], got["e"][1]) == ("single class", "no human ceiling", "no gradable annotations")


def test_metrics_with_unseen_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    rows = {r["label"]: r for r in per_class(df, "y", "p").collect()}
    assert rows["c"]["precision"] == 0 and rows["c"]["f1"] == 0 and rows["a"]["f1"] == pytest.approx(0.5)
    s = summary(df, "y", "p").first()
    assert (s["accuracy"], s["num_classes"]) == (0.5, 3) and s["micro_f1"] == 0.5
    assert s["macro_f1"] == pytest.approx((0.5 + 2 / 3 + 0) / 3)
    assert confusion(df, "y", "p", dense=True).count() == 9


def test_headroom_verdicts(spark):
    scores = spark.createDataFrame([("t", "ceiling", 0.8), ("t", "baseline", 0.78), ("u", "ceiling", 0.3), ("v", "ceiling", 0.8), ("v", "baseline", 0.4)], "trait string, axis string, cohen_kappa double")
    dist = spark.createDataFrame([("t", "s", 5), ("t", "s", 5), ("u", "s", 5), ("v", "s", 95), ("v", "s", 5)], "trait string, source string, n int")
    got = {r["trait"]: r["verdict"] for r in ag.headroom(scores, dist).collect()}
    assert got == {"t": "NO-GO", "u": "CAUTION", "v": "CAUTION"}


def test_cells_side_by_side_equal_long_modes_and_pairs(spark):
    import random

    rng = random.Random(3)
    cells = {("m", "x"): ["p", "q"], ("a", "x"): ["q", "p"], ("a", "y"): ["u", "v", "w"], ("m", "y"): ["u", "v", "w"]}
    rows = [(rng.randrange(40) if i % 3 else 0, i, *[rng.choice([*v, None]) for v in cells.values()]) for i in range(600)]
    wide = spark.createDataFrame(rows, "specimen long, pos long, c0 string, c1 string, c2 string, c3 string").repartition(5)
    long = spark.createDataFrame([(r[0], r[1], s, k, r[2 + i]) for r in rows for i, (s, k) in enumerate(cells)], "specimen long, pos long, source string, trait string, token string")
    coded = wide.select("specimen", "pos", ag.cell_code(cells, ["c0", "c1", "c2", "c3"]).alias("code"))
    found = ag.cell_modes(ag.code_counts(coded, "specimen", "pos"), cells, "specimen", "specimen")
    got = found.select("specimen", F.explode("cells").alias("c")).select("specimen", "c.source", "c.trait", "c.n_views", "c.n_present", "c.token", "c.n_mode")
    keys = ["specimen", "source", "trait"]
    want = ag.modal_values(long, keys, "token", "pos").select(*keys, "n_views", "n_present", "mode", "n_mode")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.withColumnRenamed("mode", "token").collect()))
    axes = {"m_a": ("m", "a")}
    pairs = ag.cell_pairs(found, cells, axes, "specimen")
    wanted = ag.pair_axes(want.withColumnRenamed("mode", "token"), axes, ["specimen", "trait"])
    columns = ["specimen", "axis", "trait", "value_a", "value_b", "agree"]
    assert sorted(map(tuple, pairs.select(*columns).collect())) == sorted(map(tuple, wanted.select(*columns).collect()))
    with pytest.raises(ValueError):
        ag.cell_code({("s", str(i)): list("abcdefghi") for i in range(20)}, [f"c{i}" for i in range(20)])


def test_rater_lines_are_shuffled_by_specimen_not_by_cell(spark):
    from specgrade.plans import agreement as pa
    from specgrade.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    lines = t.lineitem.count()
    assert pa.counts(t).agg(F.sum("n")).first()[0] == lines and pa.counts(t).count() <= lines
    plan = pa.trait_comparison(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 2 + plan.count("ReusedExchange")


def test_gradable_rows_are_counted_before_they_meet_the_traits(spark):
    from specgrade.plans import agreement as pa
    from specgrade.plans.registry import Tables

    df = pa.gradable_rows(Tables(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.index("Join Inner") < plan.index("Aggregate [source")
    assert {r.n for r in df.collect()} == {spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()}


def test_lines_are_dealt_before_they_are_counted(spark):
    from specgrade.plans import agreement as pa
    from specgrade.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.01")
    assert t.parts("lineitem", 7_000) == -(-t.lineitem.count() // 7_000)
    rows = spark.createDataFrame([(1, i, 5) for i in range(40)] + [(i, 0, 2) for i in range(40)], "specimen long, pos long, code long").repartition(4)
    counted = ag.code_counts(rows, "specimen", "pos", parts=3)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    dealt = plan.index("REPARTITION_BY_NUM")
    assert "HashAggregate" in plan[:dealt] and "HashAggregate" not in plan[dealt:]
    # A large group is as many pieces as tasks read it.
    got = counted.where("specimen = 1 and code = 5")
    assert 1 <= got.count() <= 4 and tuple(got.agg(F.sum("n"), F.min("first")).first()) == (40, 0)
    modes = pa.wide_modes(t)._jdf.queryExecution().executedPlan().toString()
    assert f"hashpartitioning(specimen#{modes.split('hashpartitioning(specimen#')[1].split(',')[0]}, {t.parts('lineitem', ag.ROWS_PER_TASK)}), REPARTITION_BY_NUM" in modes


def test_view_values_number_lines_before_cells_unfold(spark, tmp_path):
    import duckdb

    from specgrade.plans import agreement as pa
    from specgrade.plans.registry import REGISTRY, Tables

    # Lines in one place with different values, equal lines, and a group read by several tasks.
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(400)
    copies = lines.withColumn("l_quantity", F.lit(48.0)).union(lines).union(lines).union(lines.withColumn("l_orderkey", F.lit(1).cast("long")))
    copies.repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = pa.view_values(Tables(spark, str(tmp_path)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.execute(REGISTRY["view_values"].sql).fetchall()))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [specimen" in plan and "_ranges" not in plan
