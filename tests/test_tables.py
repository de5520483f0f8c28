import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from specgrade.operators import catalog as ct, conditions as cd, stages as st
from specgrade.session import new_path
from specgrade.sources import features as ft, tables as tb
from specgrade.streaming import progress as pg


def document(family, final, skipped=False, error=None, top=("Fab", "Mor"), image="/d/by_family/F/by_genus/G/by_species/e/S/1.jpg"):
    return {
        "image_paths": [image], "ground_truth": {"family": family},
        "stages": {
            "reasoning": {"skipped": skipped, "error": error, "data": {"classification": {"predicted_family": final, "predicted_genus": "g", "predicted_species": "G E"}}},
            "classification": {"skipped": False, "data": {"predictions_by_rank": {"family": [{"rank_value": v} for v in top]}}},
        },
    }


@pytest.fixture(scope="module")
def conditions(tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    docs = {
        ("A", "S1"): document("Fab", "Fab"), ("A", "S2"): document("Fab", "", top=("Mor", "Fab")), ("A", "S3"): document("", "Fab"),
        ("B", "S1"): document("Fab", "Mor"), ("B", "S2"): document("Fab", "Mor", error="timeout"),
    }
    for (c, s), doc in docs.items():
        folder = root / f"condition_{c}"
        folder.mkdir(exist_ok=True)
        (folder / f"{s}.json").write_text(json.dumps(doc, indent=1))
    (root / "condition_A" / "run_metadata.json").write_text("{}")
    (root / "condition_A" / "bad.json").write_text("{oops")
    return str(root)


def test_condition_results(spark, conditions):
    flat = cd.flatten_results(tb.read_condition_results(spark, conditions))
    assert sorted((r["condition"], r["specimen_id"]) for r in flat.collect()) == [("A", "S1"), ("A", "S2"), ("A", "S3"), ("B", "S1"), ("B", "S2")]
    acc = {r["condition"]: r for r in cd.accuracy_by_condition(flat).collect()}
    assert (acc["A"]["final_top1"], acc["A"]["visual_top1"], acc["A"]["visual_top3"], acc["A"]["n"]) == (0.5, 0.5, 1.0, 2)
    assert (acc["B"]["final_top1"], acc["B"]["n"]) == (0.5, 2)
    rank = {r["condition"]: r for r in cd.accuracy_by_rank(flat).collect()}
    # A blank reasoning family is kept in the three-rank table; genus and species ignore case.
    assert (rank["A"]["family"], rank["A"]["genus"], rank["A"]["species"]) == (0.5, 1.0, 1.0)
    paired = cd.paired_correctness(flat, "A", "B")
    assert {r["specimen_id"]: (r["a_correct"], r["b_correct"]) for r in paired.collect()} == {"S1": (True, False), "S2": (False, True)}
    assert {r["specimen_id"]: r["effect"] for r in cd.impact_cases(paired).collect()} == {"S1": "helped", "S2": "hurt"}


def test_sheets_keys_and_lists(spark, tmp_path):
    sheet = tmp_path / "sheet.csv"
    sheet.write_text("identificador_unico,vista,familia_prediccion,Márgen de la hoja (x)\nind1,v1, Fab ,entero\n,v2,,dentado\nind2,v1,, \nind3,v1,,dentado\n", encoding="utf-8")
    rows = tb.annotation_rows(tb.with_pos(tb.csv(spark, str(sheet))), "a", {"margin": "margen de la hoja"}, "identificador_unico", "vista")
    assert [(r["anonymous_id"], r["pred_family"], r["trait"], r["raw"]) for r in rows.orderBy("pos").collect()] == [("ind1", "Fab", "margin", "entero"), ("ind3", None, "margin", "dentado")]
    with pytest.raises(ValueError, match="vista2"):
        tb.annotation_rows(tb.with_pos(tb.csv(spark, str(sheet))), "a", {}, "identificador_unico", "vista2")
    key = tmp_path / "key.csv"
    key.write_text("anonymous_id,individual_code,family,genus,species\nind1,OLD,F,G,s\nind1,S1,F,G,s\n,S2,F,G,s\n")
    assert [(r["anonymous_id"], r["specimen_id"]) for r in tb.read_curator_key(spark, str(key)).collect()] == [("ind1", "S1")]
    assert {r[0] for r in tb.read_id_list(spark, str(key)).collect()} == {"OLD", "S1", "S2"}
    plain = tmp_path / "ids.txt"
    plain.write_text("b,1\n\n a \nb\n")
    assert [r[0] for r in tb.read_id_list(spark, str(plain)).orderBy("first_pos").collect()] == ["b", "a"]


def test_catalog_needs_its_columns(spark, tmp_path):
    bad = tmp_path / "c.csv"
    bad.write_text("FAMILY,GENUS\na,b\n")
    with pytest.raises(ValueError, match="SPECIES"):
        tb.read_catalog(spark, str(bad))


def test_images_expand_from_a_listing(spark, tmp_path):
    for name in ("i1/b.JPG", "i1/a.png", "i1/n.txt", "i2/x_12.jpg"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x")
    rows = [(f"{tmp_path}/i2", "Fab", "Inga_", "Vera", "Z9", 1), (f"{tmp_path}/i1", "Fab", "Ficus", "x", "Z1", 2), (f"{tmp_path}/gone", "M", "m", "m", "Z3", 3)]
    catalog = spark.createDataFrame(rows, "training_absolute_path string, FAMILY string, GENUS string, SPECIES string, ID_YPS string, pos long")
    files = tb.read_image_listing(spark, str(tmp_path))
    got = ct.expand_images(catalog, files, "species")
    assert {(r["label"], r["label_id"], r["image_path"].rsplit("/", 1)[1]) for r in got.collect()} == {("Inga vera", 0, "x_12.jpg"), ("Ficus x", 1, "a.png"), ("Ficus x", 1, "b.JPG")}
    assert ct.missing_directories(catalog, files).count() == 1
    assert {r[0] for r in files.select(tb.photo_number(F.col("path"))).collect()} == {None, 12}


def test_roles_number_training_images(spark):
    photos = spark.createDataFrame([("i", 1, 11, 200_000), ("i", 1, 12, 5), ("i", 1, 13, 200_000), ("i", 2, 21, 200_000), ("i", 2, 22, 200_000)], "ind string, obs int, photo int, length int")
    out = ct.image_roles(photos, "ind", "obs", "photo", F.col("obs") == 2, ct.valid_image(F.col("length")))
    assert [(r["photo"], r["role"], r["training_no"]) for r in out.orderBy("photo").collect()] == [
        (11, "training", 1), (12, "invalid", None), (13, "verification", None), (21, "verification", None), (22, "training", 2),
    ]


def test_file_check(spark):
    files = [("a", "jpg")] * 6 + [("a", "json")] * 7 + [("b", "jpg")] * 5 + [("b", "json")] * 6 + [("c", "jpg")]
    got = {r["o"]: r["status"] for r in ct.file_check(spark.createDataFrame(files, "o string, s string"), "o", "s").collect()}
    assert got == {"a": "complete", "b": "incomplete_set", "c": "unexpected_file_count"}


def test_answers_predictions_and_matrices(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"answers": {"k_S1": " ", "k_S2": "1. x: y"}, "processed_results": {"k_S1": {"answer": "2. x: z"}}}))
    from specgrade.operators.answers import resolve_answers

    assert {r["answer_key"]: r["text"] for r in resolve_answers(tb.read_answers(spark, [str(tmp_path / "a.json")])).collect()} == {"k_S1": "2. x: z", "k_S2": "1. x: y"}
    assert tb.read_old_predictions(spark, str(tmp_path / "a.json")).count() == 2
    for i, value in enumerate(("old", "new")):
        for sub, name in (("multi", "S1"), ("single/S2", "img_1")):
            folder = tmp_path / f"run{i}" / sub
            folder.mkdir(parents=True)
            (folder / f"{name}.json").write_text(json.dumps({"traits": {"margin": value}}))
    preds = tb.read_predictions(spark, [str(tmp_path / "run0"), str(tmp_path / "run1")])
    assert {(r["specimen_key"], r["image"], r["traits"]["margin"]) for r in preds.collect()} == {("S1", None, "new"), ("S2", "img_1", "new")}
    (tmp_path / "m.csv").write_text("scientific_name,habit__tree,habit__uncoded\nAlpha ,1,0\nnan,1,0\n")
    long = tb.read_matrices(spark, {"cl1": str(tmp_path / "m.csv")})
    assert {(r["scientific_name"], r["option_column"], r["value"], r["source"]) for r in long.collect()} == {("alpha", "habit__tree", 1.0, "cl1"), ("alpha", "habit__uncoded", 0.0, "cl1")}
    assert tb.matrix_suffix(["a__b__consensus"]) == "__consensus" and tb.matrix_suffix(["a__b"]) == ""


def test_result_tables_are_rounded(spark, tmp_path):
    df = spark.createDataFrame([("a", 1 / 3, ["x"])], "k string, v double, l array<string>")
    tb.write_tables({"t": df}, str(tmp_path), "csv")
    got = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/t").first()
    assert got["v"] == "0.3333" and got["l"] == '["x"]'
    tb.write_tables({"t": df}, str(tmp_path), "parquet", None)
    assert spark.read.parquet(f"{tmp_path}/t").first()["v"] == 1 / 3


def test_a_report_makes_what_its_tables_share_once(spark, monkeypatch):
    from specgrade.plans import conditions, grading, load_all
    from specgrade.plans.registry import Tables

    load_all()
    made = []
    for module, name in ((conditions, "latest_results"), (grading, "graded")):
        plain = getattr(module, name)
        monkeypatch.setattr(module, name, lambda t, name=name, plain=plain: made.append(name) or plain(t))
    report = ("condition_accuracy", "rank_accuracy", "category_accuracy", "species_accuracy")
    monkeypatch.setattr(conditions, "REPORT_TABLES", tuple(r for r in conditions.REPORT_TABLES if r[0] in report))
    assert conditions.result_tables(Tables(spark, "/root/testdata/sf0.001")).count() == 4
    assert sorted(made) == ["graded", "latest_results"]
    # Alone, a table is made from the input.
    assert grading.species_accuracy(Tables(spark, "/root/testdata/sf0.001")).count() == 50 and made.count("graded") == 2


def test_feature_cache_embeds_only_what_is_missing(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), spark.sparkContext.accumulator(0)

    def embed(batches):
        for pdf in batches:
            calls.add(len(pdf))
            yield pdf.assign(embedding=[[3.0, 4.0]] * len(pdf))

    schema = "path string, label string, embedding array<double>"
    first = spark.createDataFrame([("a", "x"), ("b", "x")], "path string, label string")
    ft.extend_cache(first, path, ["path", "label"], embed, schema)
    more = first.union(spark.createDataFrame([("c", "y")], "path string, label string"))
    cached = ft.extend_cache(more, path, ["path", "label"], embed, schema)
    assert calls.value == 3 and cached.count() == 3 and cached.first()["embedding"] == pytest.approx([0.6, 0.8])


def test_completeness(spark):
    files = spark.createDataFrame([("A", ""), ("A", "{bad"), ("A", "{}"), ("B", None)], "condition string, content string")
    got = {r["condition"]: tuple(r)[1:] for r in cd.completeness(cd.run_status(files), 5).collect()}
    assert got == {"A": (1, 1, 1, 3, 2), "B": (0, 0, 1, 1, 4)}
    plan = spark.createDataFrame([("A",), ("C",)], "condition string")
    got = {r["condition"]: tuple(r)[1:] for r in cd.completeness(cd.run_status(files), 5, conditions=plan).collect()}
    assert got == {"A": (1, 1, 1, 3, 2), "C": (0, 0, 0, 0, 5)}
    odd = [(i, t) for i, t in enumerate(['{"a":1}} junk', "{}{}", "[1],[2]", "[1]] x", '1, "k": 2', ' {"a": [1, "]"]} ', "null", " ", "3", '"x"', None])]
    read = cd.run_status(spark.createDataFrame(odd, "id int, content string")).collect()
    assert {r["id"] for r in read if r["status"] == "valid"} == {5, 6, 8, 9}
    stages = F.create_map(F.lit("s"), F.struct(F.lit(False).alias("skipped"), F.lit("boom").alias("error")))
    assert spark.range(1).select(cd.stage_failed(stages).alias("f")).first()["f"]


def test_stream_counts_a_resent_result_once(spark):
    folder = new_path(spark, "in")
    rows = [(i, "A", "valid", f"2024-01-01 00:{i:02d}:00") for i in range(20)]
    df = spark.createDataFrame(rows, "id int, condition string, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{folder}/a")
    df.where("id < 5").write.parquet(f"{folder}/b")
    late = [(30, "A", "error", "2020-01-01 00:00:00"), (3, "A", "error", "2025-01-01 00:00:00")]
    spark.createDataFrame(late, "id int, condition string, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{folder}/c")
    plan = spark.createDataFrame([("A",), ("B",)], "condition string")
    for files in (1, 50):
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).parquet(folder)
        got = {r["condition"]: tuple(r)[1:] for r in pg.progress(stream, 25, ["condition"], "ts", ["id"], plan).collect()}
        assert got == {"A": (20, 1, 0, 21, 4), "B": (0, 0, 0, 0, 25)}


def test_incremental_grading_is_idempotent(spark):
    folder, out, log = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "log")
    spark.range(10).write.parquet(f"{folder}/a")
    stream = lambda: spark.readStream.schema("id long").option("recursiveFileLookup", True).parquet(folder)
    grade = lambda b: b.withColumn("ok", F.col("id") > 4)
    pg.grade_incrementally(stream(), grade, ["id"], out, log)
    spark.range(5, 15).write.parquet(f"{folder}/b")
    pg.grade_incrementally(stream(), grade, ["id"], out, log)
    pg.grade_incrementally(stream(), grade, ["id"], out, f"{log}-lost")
    assert spark.read.parquet(out).count() == 15


def test_stages_isolate_errors(spark):
    def first(df):
        bad = F.col("id") == 1
        return df.select("id", F.when(~bad, "d").alias("data"), F.when(bad, "boom").alias("error"), F.lit(1.0).alias("elapsed_ms"))

    def second(df):
        return df.where("id < 3").select("id", F.lit("e").alias("data"), F.lit(None).cast("string").alias("error"), F.lit(2.0).alias("elapsed_ms"))

    out = st.run_stages(spark.range(4), "id", [st.Stage("one", first), st.Stage("two", second, ("one",)), st.Stage("three", second)], skip={"three"})
    got = {(r["id"], r["stage"]): (r["data"], r["skipped"], r["error"]) for r in st.stage_rows(out, "id").collect()}
    assert got[(0, "two")] == ("e", False, None) and got[(1, "one")] == (None, False, "boom")
    assert got[(1, "two")] == (None, False, "Missing required 'one' data") and got[(3, "two")][2] == "Stage two returned no result"
    assert got[(2, "three")] == (None, True, None)
    values = st.values_from_function(spark.range(2), "id", ["a", "b"], lambda k, t: t + pd.Series(k).astype(str))
    assert {tuple(r) for r in values.collect()} == {(0, "a", "a0"), (0, "b", "b0"), (1, "a", "a1"), (1, "b", "b1")}
