import pytest
from pyspark.sql import functions as F

from specgrade.operators import grading as gr, identification as idn, matrix as mx, taxonomy as tx
from specgrade.session import local_table


def matrix_rows(spark, values):
    rows = [(t, o.split("__")[0], o, v) for t, o, v in values]
    return spark.createDataFrame(rows, "taxon string, category string, option_column string, value int")


def predict(spark, category, raw):
    df = spark.createDataFrame([("s", "t", category, raw)], "specimen string, taxon string, category string, raw string")
    return {r["option_column"]: r["predicted"] for r in gr.map_predictions(df, gr.rule_table(spark), ["specimen", "taxon"]).collect()}


def test_first_matching_rule_wins_and_unknown_is_null(spark):
    assert predict(spark, "leaf_margin", "Serrate to entire") == {"leaf_margin__entire": 1, "leaf_margin__toothed": 0, "leaf_margin__lobed": 0}
    assert set(predict(spark, "leaf_margin", "wavy").values()) == {None}
    assert set(predict(spark, "latex", "Not observed").values()) == {None}


@pytest.mark.parametrize(
    "raw, values, want",
    [
        ("present", [("latex__present", 1), ("latex__absent", 0)], {"latex__present": "correct"}),
        ("absent", [("latex__present", 1), ("latex__absent", 0)], {"latex__absent": "incorrect"}),
        ("not observed", [("latex__present", 1), ("latex__absent", 0)], {"latex__present": "skipped_not_observed", "latex__absent": "skipped_not_observed"}),
        ("", [("latex__present", 1), ("latex__absent", 0)], {"latex__present": "skipped_no_prediction", "latex__absent": "skipped_no_prediction"}),
        ("present", [("latex__present", None), ("latex__absent", None)], {"latex__present": "skipped_uncoded", "latex__absent": "skipped_uncoded"}),
        ("present", [("latex__present", 0), ("latex__absent", 0), ("latex__uncoded", 1)], {"latex__present": "skipped_uncoded", "latex__absent": "skipped_uncoded"}),
        ("present", [("latex__present", 1), ("latex__absent", None), ("latex__uncoded", 0)], {"latex__present": "correct", "latex__absent": "skipped_uncoded"}),
    ],
)
def test_verdicts(spark, raw, values, want):
    df = spark.createDataFrame([("s", "t", "latex", raw)], "specimen string, taxon string, category string, raw string")
    coded = gr.attach_matrix(df, matrix_rows(spark, [("t", o, v) for o, v in values]), "taxon")
    got = gr.grade_traits(gr.map_predictions(coded, gr.rule_table(spark), ["specimen", "taxon", "options", "uncoded"]))
    assert {r["option_column"]: r["verdict"] for r in got.collect()} == want


def test_merged_matrix_and_repeated_options(spark):
    df = spark.createDataFrame([("s", "t", "latex", "present")], "specimen string, taxon string, category string, raw string")
    values = [("latex__present__consensus", 1), ("latex__absent__consensus", 0), ("latex__present__consensus", 0), ("latex__present__one", 0), ("latex__absent", 1)]
    coded = gr.attach_matrix(df, matrix_rows(spark, [("t", o, v) for o, v in values]), "taxon", "__consensus")
    got = gr.grade_traits(gr.map_predictions(coded, gr.rule_table(spark), ["specimen", "taxon", "options", "uncoded"]))
    assert {r["option_column"]: r["verdict"] for r in got.collect()} == {"latex__present": "correct"}


@pytest.fixture(scope="module")
def records(spark):
    data = [
        ("S1", "A b", "arr__alt", "arr", 1.0, 1, "correct"), ("S2", "A b", "arr__alt", "arr", 0.0, 1, "incorrect"),
        ("S2", "A b", "arr__opp", "arr", 1.0, None, "skipped_no_prediction"), ("S3", "C d", "arr__opp", "arr", None, None, "skipped_uncoded"),
        ("S4", "C d", "arr__opp", "arr", 1.0, 1, "correct"), ("S5", "C d", "arr__alt", "arr", 1.0, 1, "correct"), ("S4", "C d", "arr__alt", "arr", 1.0, None, "skipped_not_observed"),
    ]
    return spark.createDataFrame(data, "specimen string, species string, option_column string, category string, ground_truth double, predicted int, verdict string")


def test_option_metrics_and_both_supports(records):
    got = {r["option_column"]: r for r in gr.option_accuracy(records, "specimen").collect()}
    alt = got["arr__alt"]
    assert (alt["n_correct"], alt["n_incorrect"], alt["support"], alt["recall"]) == (2, 1, 2, 1.0)
    assert alt["precision"] == pytest.approx(2 / 3) and alt["prevalence"] == pytest.approx(0.5)
    every = {r["option_column"]: r["support"] for r in gr.option_accuracy(records, "specimen", "all_options").collect()}
    assert every == {"arr__alt": 3, "arr__opp": 2}


def test_votes_and_species(records):
    cat = gr.category_accuracy(records, "specimen").first()
    assert (cat["n_correct"], cat["n_incorrect"], cat["n_skipped_uncoded"], cat["accuracy"]) == (3, 1, 1, 0.75)
    per = {r["species"]: r["accuracy"] for r in gr.category_accuracy(records, "specimen", "species").collect()}
    assert per == {"A b": 0.5, "C d": 1.0}


def test_consistency_tie_goes_to_the_first_specimen(records):
    got = {r["species"]: r for r in gr.species_consistency(records, "species", "specimen").collect()}
    assert (got["C d"]["mode_prediction"], got["C d"]["agreement"], got["C d"]["n_specimens"]) == ("arr__opp", 0.5, 3)
    assert got["A b"]["agreement"] == 1.0
    none = gr.species_consistency(records.where("specimen = 'S3'"), "species", "specimen").first()
    assert none["mode_prediction"] is None and none["agreement"] is None and none["n_agreeing"] == 0


def test_truth_drives_the_join(spark):
    truth = spark.createDataFrame([("s1", "m", "a | b", "multi_label"), ("s2", "m", "a", "exact")], "k string, trait string, truth string, match_type string")
    preds = spark.createDataFrame([("s1", "m", "B"), ("zz", "m", "a")], "k string, trait string, prediction string")
    scored = gr.score_predictions(truth, preds, ["k", "trait"])
    s = gr.trait_scores(scored, "trait").first()
    assert (s["n_exact_match"], s["n_abstention"], s["accuracy"], s["strict_accuracy"], s["n_multi_label_gt"]) == (1, 1, 1.0, 0.5, 1)
    labels = {(r["pred_label"], r["true_label"]) for r in gr.confusion_pairs(scored).collect()}
    assert labels == {("b", "b"), ("[abstain]", "a")}


def test_unpivot_truth_defaults(spark):
    wide = spark.createDataFrame([("s", "a | b", "multi_label", " "), ("t", "x", None, "y")], "k string, m string, m_match_type string, n string")
    got = {(r["k"], r["trait"]): r["match_type"] for r in gr.unpivot_truth(wide, "k", ["m", "n"]).collect()}
    assert got == {("s", "m"): "multi_label", ("t", "m"): "exact", ("t", "n"): "exact"}


def test_matrix_build_and_consensus(spark):
    species = spark.createDataFrame([(100,), (200,), (300,)], "taxon int")
    options = local_table(spark, [("habit", "habit__tree"), ("habit", "habit__shrub")], "category string, option_column string")
    one = mx.build_matrix(species, spark.createDataFrame([(100, "habit__tree"), (200, "habit__tree")], "taxon int, option_column string"), options, "taxon")
    wide = {r["taxon"]: r for r in mx.widen(one, "taxon", ["habit__tree", "habit__shrub", "habit__uncoded"]).collect()}
    assert tuple(wide[300])[1:] == (0, 0, 1) and tuple(wide[100])[1:] == (1, 0, 0)
    two = mx.build_matrix(species.where("taxon > 100"), spark.createDataFrame([(200, "habit__shrub")], "taxon int, option_column string"), options, "taxon")
    both = one.withColumn("source", F.lit("a")).unionByName(two.withColumn("source", F.lit("b")))
    got = {(r["taxon"], r["option_column"]): r["consensus"] for r in mx.consensus(both, "taxon").collect()}
    assert got[(200, "habit__tree")] == 1 and got[(200, "habit__shrub")] == 1 and got[(100, "habit__shrub")] == 0 and got[(300, "habit__tree")] is None
    assert {tuple(r) for r in mx.merge_report(both, "taxon").collect()} == {("a", 3, 3), ("b", 2, 3)}


def test_match_any(spark):
    m = matrix_rows(spark, [("t", "arr__alt", 1), ("t", "arr__opp", 1), ("t", "arr__uncoded", 0), ("u", "arr__alt", 0), ("u", "arr__opp", 0), ("u", "arr__uncoded", 1), ("v", "arr__alt", 1), ("v", "arr__opp", 0)])
    tokens = local_table(spark, [("position", "arr", "arr__alt", "alternate"), ("position", "arr", "arr__opp", "opposite")], "trait string, category string, option_column string, token string")
    allowed = mx.allowed_values(m, "taxon", tokens)
    assert {r["taxon"]: r["allowed"] for r in allowed.collect()} == {"t": ["alternate", "opposite"], "u": None, "v": ["alternate"]}
    values = spark.createDataFrame([("t", "position", "opposite"), ("u", "position", "opposite"), ("v", "position", "opposite"), ("v", "position", None)], "taxon string, trait string, token string")
    got = mx.match_any_accuracy(mx.match_any(values, allowed, ["taxon", "trait"]), "trait").first()
    assert (got["n_compared"], got["n_correct"], got["n_kappa"], got["cohen_kappa"]) == (2, 1, 1, None)


def test_identification_and_corrections(spark):
    rows = spark.createDataFrame(
        [("a1", "SR1", "Fab", "Inga", "hayesii", "fab ", "inga", "hayessi", 1), ("a1", "SR1", "Fab", "Inga", "hayesii", "X", "X", "X", 2), ("a2", "SR2", "Fab", "Inga", "vera", None, " ", None, 1), ("a3", "SR3", None, None, None, "Fab", None, None, 1)],
        "anonymous_id string, specimen_id string, true_family string, true_genus string, true_species string, pred_family string, pred_genus string, pred_species string, pos int",
    )
    firsts = idn.human_identifications(rows, "pos")
    assert [r["anonymous_id"] for r in firsts.collect()] == ["a1"]
    raw = spark.createDataFrame(
        [("SR1", "species", "hayessi", "hayesii", "typo", 1), ("SR1", "subspecies", "x", "y", "typo", 2), ("SR1", "genus", "x", "y", "guess", 3), ("SR9", "family", "x", "y", "variant", 4)],
        "specimen_id string, rank string, original string, canonical string, category string, pos int",
    )
    table = idn.corrections_table(raw, "pos")
    assert table.count() == 2
    graded = {r["rank"]: (r["raw_correct"], r["corrected"], r["credited_category"]) for r in idn.grade_with_corrections(firsts, table).collect()}
    assert graded == {"family": (True, True, None), "genus": (True, True, None), "species": (False, True, "typo")}
    originals = spark.createDataFrame([("SR1", "species", "other")], "specimen_id string, rank string, pred string")
    assert idn.stale_corrections(table, originals).count() == 2


def test_failed_stage_is_wrong_everywhere_but_counted(spark):
    rows = spark.createDataFrame(
        [("s1", "F", "G", "G e", "f", "g", "E", False, "test"), ("s2", "F", "G", "G e", "F", "G", "G e", True, "test"), ("s3", "F", "G", "G e", None, None, None, None, None)],
        "specimen_id string, true_family string, true_genus string, true_species string, pred_family string, pred_genus string, pred_species string, stage_error boolean, part string",
    )
    graded = idn.grade_identification(rows)
    assert [r["species_correct"] for r in graded.orderBy("specimen_id").collect()] == [True, False, False]
    m = {(r["part_name"], r["rank"]): r for r in idn.identification_metrics(graded, "part").collect()}
    assert (m[("all", "family")]["accuracy"], m[("all", "family")]["n_stage_error"], m[("test", "family")]["n_graded"]) == (0.5, 1, 1)


def test_synonyms_and_ids(spark):
    names = spark.createDataFrame(
        [(1, "Alpha beta", "Old one, Alpha beta , Old two", "Final name"), (2, "alpha beta", "ignored", ""), (3, "Gamma", "NA", "gamma"), (4, "Delta", None, "Old two")],
        "pos int, accepted string, syn string, final string",
    )
    bridge = tx.synonym_bridge(names, "accepted", "syn", "final", "pos")
    assert [(r["synonym"], r["match_method"]) for r in bridge.where("accepted = 'alpha beta'").orderBy("priority").collect()] == [("old one", "synonym"), ("old two", "synonym"), ("final name", "final_name")]
    wanted = spark.createDataFrame([("ALPHA beta",), ("Gamma",), ("delta",), ("none",)], "n string")
    ref = spark.createDataFrame([("Old Two",), ("final name",), ("GAMMA ",)], "r string")
    got = {r["n"]: (r["matched_name"], r["match_method"]) for r in tx.match_names(wanted, "n", ref, "r", bridge).collect()}
    assert got == {"ALPHA beta": ("old two", "synonym"), "Gamma": ("gamma", "direct"), "delta": ("old two", "final_name"), "none": (None, None)}
    catalog = spark.createDataFrame([("PPINGA1", "ing", 1), ("BARX2", "ppinga1", 2), ("x2", "zed", 3)], "id string, code string, pos int")
    aliases = tx.id_aliases(catalog, "id", "code", "pos")
    seen = spark.createDataFrame([("pp-inga.1",), ("INGA1",), (" x2 ",), ("ing",), ("ppinga1",), ("inga",)], "o string")
    got = {r["o"]: (r["target"], r["match"]) for r in tx.resolve_ids(seen, "o", aliases).collect()}
    assert got == {"pp-inga.1": ("PPINGA1", "punctuation"), "INGA1": ("PPINGA1", "exact"), " x2 ": ("x2", "exact"), "ing": ("PPINGA1", "exact"), "ppinga1": ("PPINGA1", "exact"), "inga": (None, "none")}


def test_label_ids_are_first_seen(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4)], "label string, pos int")
    assert {r["label"]: r["label_id"] for r in tx.label_ids(df, "label", "pos").collect()} == {"b": 0, "a": 1, "c": 2}


def test_sides_that_grow_with_the_input_are_not_broadcast(spark):
    from specgrade.plans import conditions as pc, grading as pg
    from specgrade.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    for df, column in ((pc.results(t), "c_custkey"), (pg.identifications(t), "c_custkey"), (pg.mapped(t), "options")):
        # The small tables of nations, regions, options and rules still travel whole.
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=merge" in plan and column in plan
    plan = pc.results(t)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [o_custkey" in plan


def test_matrix_of_one_split_is_dealt_out_and_unfolded_without_joins_of_options(spark):
    from specgrade.operators import matrix as mx
    from specgrade.plans import grading as pg
    from specgrade.plans.registry import Tables

    species = spark.createDataFrame([(1,), (1,), (2,), (None,)], "taxon long")
    members = spark.createDataFrame([(1, "a__x"), (1, "a__x"), (3, "a__x"), (2, "b__z"), (2, None)], "taxon long, option_column string")
    options = spark.createDataFrame([("a", "a__x"), ("a", "a__y"), ("b", "b__z")], "category string, option_column string")
    got = sorted(tuple(r) for r in mx.build_matrix(species, members, options, "taxon").where("taxon is not null").collect())
    one = [(1, "a", "a__uncoded", 0), *[(1, "a", "a__x", 1)] * 2, *[(1, "a", "a__y", 0)] * 2, (1, "b", "b__uncoded", 1), *[(1, "b", "b__z", 0)] * 2]
    two = [(2, "a", "a__uncoded", 1), (2, "a", "a__x", 0), (2, "a", "a__y", 0), (2, "b", "b__uncoded", 0), (2, "b", "b__z", 1)]
    assert got == one + two
    t = Tables(spark, "/root/testdata/sf0.1")
    plan = pg.matrix(t)._jdf.queryExecution().optimizedPlan().toString()
    assert f"RepartitionByExpression [taxon" in plan and plan.count("Join") == 2 and t.parts("part", 5_000) == 4
