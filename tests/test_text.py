import pytest
from pyspark.sql import functions as F

from specgrade.functions import text as tx
from specgrade.operators import answers as an


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, want",
    [("Elíptica, oblanceolada.", "eliptica oblanceolada"), ("[entire]", "entire"), ("N/A", "n a"), (None, ""), ("  Leñoso \t(x) ", "lenoso x"), ("ﬁno ½", "fino 1⁄2"), ("Ǆ ệ", "dz e")],
)
def test_normalize(spark, raw, want):
    assert one(spark, tx.normalize(F.col("v")), v=raw) == want


@pytest.mark.parametrize(
    "raw, level, want, reasons",
    [
        ("fabaceae", "family", "Fabaceae", ["capitalization"]),
        ("Inga", "genus", "Inga", []),
        (" ", "species", "unknown_species", ["missing_value"]),
        (None, "family", "Unknown_Family", ["missing_value"]),
        ("Vera  (cf.)", "species", "vera_cf_", ["special_characters", "spaces_to_underscores", "multiple_underscores", "lowercase"]),
    ],
)
def test_normalize_taxon(spark, raw, level, want, reasons):
    got = one(spark, tx.normalize_taxon(F.col("v"), level), v=raw)
    assert got["normalized"] == want and [a["reason"] for a in got["actions"]] == reasons


def test_labels_and_slugs(spark):
    assert one(spark, tx.format_label(F.lit("A_b"), F.lit("Inga_"), F.lit("Vera_X"), "species")) == "Inga vera x"
    assert one(spark, tx.option_column(F.lit("Habit"), F.lit("epiphyte - hemiepiphyte"))) == "habit__epiphyte_hemiepiphyte"
    with pytest.raises(ValueError):
        tx.format_label(F.lit(""), F.lit(""), F.lit(""), "order")


@pytest.mark.parametrize(
    "pred, truth, want",
    [
        ("Entire (smooth).", "entire | toothed", "exact_match"), ("serrate", "toothed", "parent_match"), ("N/A", "entire", "abstention"),
        ("x", "", "no_ground_truth"), ("x", None, "no_ground_truth"), ("x", " | ", "no_ground_truth"), ("not observed", "absent", "parent_match"), ("lobed", "entire", "mismatch"),
    ],
)
def test_classify_prediction(spark, pred, truth, want):
    assert one(spark, tx.classify_prediction(F.col("p"), F.col("t")), p=pred, t=truth) == want


def test_names_and_paths(spark):
    assert one(spark, tx.last_token(F.lit("Acanthaceae_Aphelandra_scabra_SRAPHEDE2"))) == "SRAPHEDE2"
    assert one(spark, tx.after_segment(F.lit("/a/by_genus/Inga/by_species/vera/x.jpg"), "by_species")) == "vera"
    assert one(spark, tx.after_segment(F.lit("/a/b"), "by_species")) is None
    assert one(spark, tx.version_of(F.lit("cat_v2026-01-29_12K.csv"))) == "2026-01-29_v2026-01-29_12K"
    assert one(spark, tx.model_short_name(F.lit("maker/gpt-9-Instruct-FP8"))) == "GPT-9"
    assert one(spark, tx.model_short_name(F.lit("m"), {"m": "Model"})) == "Model"


def test_compose_query(spark):
    traits = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in (("a", " X "), ("b", "unclear"), ("c", ""))])
    assert one(spark, tx.compose_query(traits, "with {traits}!", "none")) == "with a: x!"
    assert one(spark, tx.compose_query(F.slice(traits, 2, 2), "with {traits}!", "none")) == "none"


def test_form_lines(spark):
    text = "A. Leaves\n7.\tLeaf margin (entire / toothed): entire (edges smooth)\n7. x: toothed: fine\n####\n25. y: z\n3. no value\nF. Notes:  kept (as is) "
    df = spark.createDataFrame([("k", text)], "key string, text string")
    got = {(r["section"], r["field"]): r["value"] for r in an.form_fields(df, "key").collect()}
    assert got == {("leaf_morphology", "margin"): "toothed: fine", ("leaf_complexity", "type"): "", ("notes", "notes"): "kept (as is)"}


@pytest.mark.parametrize(
    "raw, recovery",
    [
        ('{"a": 1}', "direct"), ('```json\n{"a": 1}\n```', "direct"), ('<think>{x</think>{"a": 1}', "direct"), ('x</think>\n{"a": 1}', "direct"),
        ('Answer {"a": 1} done', "extracted"), ('{"a": {"b": [1', "repaired"), ('{"a": 1,\n"b": 2,\n"c', "repaired"), ("nothing", "failed"), ("", "failed"),
    ],
)
def test_json_recovery(spark, raw, recovery):
    got = an.parse_json_answers(spark.createDataFrame([(raw,)], "text string")).first()
    assert got["recovery"] == recovery and (got["json"] is None) == (recovery == "failed")


def test_key_values(spark):
    raw = "plan</think>1. Leaf Type: a [NOTE]\nb\nleaf type: c:d\n####\nx: y"
    df = an.split_thinking(spark.createDataFrame([("s", raw)], "k string, text string"))
    assert df.first()["thinking"] == "plan"
    pairs = an.key_value_answers(df, "k")
    assert [(r["name"], r["value"]) for r in pairs.collect()] == [("leaf type", "c:d")]
    wide = an.wide_answers(pairs, df, "k", ["leaf type", "margin"]).first()
    assert wide["leaf type"] == "c:d" and wide["margin"] == ""


def test_answers_merge_and_ingest(spark):
    docs = spark.createDataFrame(
        [(0, {"F_G_s_X1": "1. a: one", "F_G_s_X2": " "}, {"F_G_s_X2": ("2. b: two",)}), (1, {"F_G_s_X1": "2. b: three"}, None)],
        "source_idx int, answers map<string,string>, processed map<string,struct<answer:string>>",
    )
    rows = an.resolve_answers(docs)
    merged = {r["answer_key"]: r["text"] for r in an.merge_answers(rows).collect()}
    assert merged == {"F_G_s_X1": "1. a: one\n2. b: three", "F_G_s_X2": "2. b: two"}
    got = {(r["specimen_id"], r["field"]): r["value"] for r in an.ingest_answers(rows).collect()}
    assert got == {("X1", "relative_position"): "one", ("X1", "spacing"): "three", ("X2", "spacing"): "two"}


KEY = """<html><p>Species Count: 1,234</p><div id="char18"><span class="dynamlang">Leaf Type?</span>
<div class="cs-div"><input type="checkbox" name="attr[]" value="3-1"> <span>Simple</span></div>
<div class="cs-div"><input type="checkbox" name="attr[]" value="3-2"><span>Com&amp;pound</span></div></div>
<div id="key-taxa"><div class="family-div">Fabaceae</div><div class="taxon-div"><a href="x?taxon=100&c=1"><i>Alpha beta</i> L.</a></div>
<div class="taxon-div"><a href="x?taxon=200">Gamma delta</a></div><div class="family-div">Moraceae</div><div class="taxon-div">no link</div>
<div class="taxon-div"><a href="x?taxon=300"><i>Ficus</i></a><a href="x?taxon=9">other</a></div></div><div class="taxon-div"><a href="x?taxon=1">out</a></div></html>"""


def test_key_page(spark):
    only_two = KEY.replace("taxon=100", "nothing").replace("taxon=300", "nothing")
    pages = spark.createDataFrame([(None, KEY), ("3-1", only_two), ("3-2", "<p>empty</p>")], "attr string, html string")
    parsed = an.parse_key_pages(pages)
    base = parsed.where("attr is null").first()
    assert base["species_count"] == 1234
    assert [(t["taxon_id"], t["scientific_name"], t["family"]) for t in base["taxa"]] == [
        (100, "Alpha beta", "Fabaceae"), (200, "Gamma delta", "Fabaceae"), (300, "Ficus", "Moraceae"),
    ]
    options = {r["option_column"] for r in an.filter_options(parsed.where("attr is null")).collect()}
    assert options == {"leaf_type__simple", "leaf_type__com_pound"}
    matrix = {(r["taxon_id"], r["option_column"]): r["value"] for r in an.matrix_from_pages(pages).collect()}
    assert matrix[(200, "leaf_type__simple")] == 1 and matrix[(100, "leaf_type__simple")] == 0
    assert matrix[(100, "leaf_type__uncoded")] == 1 and matrix[(200, "leaf_type__uncoded")] == 0


def test_odd_key_pages(spark):
    box = '<input type="checkbox" name="attr[]" value="{}">'
    odd = (
        '<div id="char5"><span class="dynamlang">Leaf Arrangement</span><div>' + box.format("5-1") + "</div><div>" + box.format("6-2") + "<span>two<wbr>parts</span></div></div>"
        '<div id="char6"><div>' + box.format("9-1") + '<span>nameless</span></div></div><div id="key-taxa"><source><wbr><div class="taxon-div"><a href="x?taxon=5"><i>A b</i></a></div></div>'
    )
    (page,) = an.parse_key_pages(spark.createDataFrame([(odd,)], "html string")).collect()
    assert [(o["category_id"], o["option_id"], o["label"]) for o in page["options"]] == [(5, 1, "option_1"), (6, 2, "twoparts")]
    assert [t["taxon_id"] for t in page["taxa"]] == [5]
    named = an.filter_options(an.parse_key_pages(spark.createDataFrame([(odd,)], "html string")))
    assert {r["option_column"] for r in named.collect()} == {"leaf_arrangement__option_1", "leaf_arrangement__twoparts"}


def test_json_cut_back_to_the_last_comma(spark):
    texts = ['{"a": 1, "b": "tex', '{"a":1}\n``` thanks', '{"a": "x{y", "b": 1}', '{"a": [1, 2, {"c": 3, "d', "no json"]
    rows = an.parse_json_answers(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")).collect()
    got = {r["id"]: (r["json"], r["recovery"]) for r in rows}
    assert got[0] == ('{"a": 1}', "repaired") and got[1] == ('{"a":1}', "extracted")
    assert got[2] == ('{"a": "x{y", "b": 1}', "direct") and got[3] == got[4] == (None, "failed")
