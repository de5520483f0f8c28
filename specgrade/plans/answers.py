"""Batch text work: model answers, HTML pages, retrieval texts and evidence documents.

Answers are composed from ``conversations`` and ``events``; key pages from ``pages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from specgrade.functions.text import compose_query
from specgrade.operators import answers as an, evidence as ev, fewshot as fs, retrieval as rt
from specgrade.plans import fewshot as pf
from specgrade.plans.agreement import rounded
from specgrade.plans.registry import Tables, query

# ---- answers -----------------------------------------------------------------------------

# A numbered form per conversation turn: three field lines, a noise line and the notes, which hold the whole text.
def forms(t: Tables) -> DataFrame:
    text = F.concat(
        (F.col("turn") + 1).cast("string"), F.lit(". Trait (a / b): "), "role", F.lit(" (said in turn "), "turn", F.lit(")\nnoise without number\n"),
        F.lit("7.  Margin: wavy: "), F.length("text").cast("string"), F.lit("\n99. Unknown: x\n\nF. Notes:  "),
        F.trim(F.replace("text", F.lit("\n"), F.lit(" "))), F.lit(" (kept)\n####"),
    )
    key = F.concat(F.lit("Fam_Gen_sp_S"), F.floor(F.col("conv_id") / 2))
    return t.conversations.select(F.concat(key.cast("string")).alias("answer_key"), F.col("conv_id").alias("doc"), F.col("turn").alias("source_idx"), text.alias("text"), "conv_id")


_FIELD = "['relative_position', 'spacing', 'type', 'compound_type', 'num_leaflets', 'leaflet_arrangement', 'margin', 'shape', 'apex', 'base', 'venation', 'secondary_veins']"
_SECTION = "['leaf_arrangement', 'leaf_arrangement', 'leaf_complexity', 'leaf_complexity', 'leaf_complexity', 'leaf_complexity', 'leaf_morphology', 'leaf_morphology', 'leaf_morphology', 'leaf_morphology', 'leaf_morphology', 'leaf_morphology']"
FIELDS = f"""fl AS (SELECT conv_id, turn, {_SECTION}[turn + 1] AS section, {_FIELD}[turn + 1] AS field, role AS value, 0 AS i FROM conversations
 UNION ALL SELECT conv_id, turn, 'leaf_morphology', 'margin', 'wavy: ' || length(text), 2 FROM conversations
 UNION ALL SELECT conv_id, turn, 'notes', 'notes', trim(replace(text, chr(10), ' ')) || ' (kept)', 5 FROM conversations)"""


@query(
    "form_fields",
    "R12",
    f"WITH {FIELDS} SELECT conv_id, section, field, arg_max(value, (turn, i)) AS value FROM fl GROUP BY ALL",
)
def form_fields(t: Tables) -> DataFrame:
    return an.form_fields(forms(t), "conv_id", "text", "source_idx")


@query(
    "morphology_records",
    "R12",
    f"""WITH {FIELDS}, v AS (SELECT conv_id, section, field, arg_max(value, (turn, i)) AS value FROM fl GROUP BY ALL)
SELECT conv_id, string_agg(field || '=' || value, ';' ORDER BY field) FILTER (section = 'leaf_morphology') AS leaf_morphology,
 coalesce(string_agg(field || '=' || value, ';' ORDER BY field) FILTER (section = 'leaf_arrangement'), '') AS leaf_arrangement, max(value) FILTER (section = 'notes') AS notes FROM v GROUP BY 1""",
)
def morphology_records(t: Tables) -> DataFrame:
    out = an.morphology_records(an.form_fields(forms(t), "conv_id", "text", "source_idx"), "conv_id")

    def text(c: str):
        return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias(c)

    return out.select("conv_id", text("leaf_morphology"), text("leaf_arrangement"), "notes")


@query(
    "ingested_answers",
    "A18 R17",
    f"""WITH {FIELDS}, own AS (SELECT conv_id // 2 AS s, max(conv_id) AS conv_id, count(DISTINCT conv_id) AS n_keys FROM conversations GROUP BY 1),
v AS (SELECT conv_id, section, field, arg_max(value, (turn, i)) AS value FROM fl GROUP BY ALL)
SELECT 'S' || s AS specimen_id, n_keys, section, field, value FROM own JOIN v USING (conv_id)""",
)
def ingested_answers(t: Tables) -> DataFrame:
    key = F.format_string("Fam_%06d_sp_S%d", F.col("conv_id"), F.floor(F.col("conv_id") / 2))
    return an.ingest_answers(forms(t).withColumn("answer_key", key)).select("specimen_id", "n_keys", "section", "field", "value")


@query(
    "merged_answers",
    "A17",
    """SELECT conv_id AS answer_key, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n_parts FROM (
 SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'Sys: ' || text ELSE text END AS text FROM conversations WHERE trim(text) <> '') GROUP BY 1""",
)
def merged_answers(t: Tables) -> DataFrame:
    # One document per turn number: its answers map holds every conversation of that turn.
    sys = F.col("role") == "system"
    rows = t.conversations.select(
        F.col("turn").alias("source_idx"),
        F.create_map(F.col("conv_id").cast("string"), F.when(sys, "  ").otherwise(F.col("text"))).alias("answers"),
        F.create_map(F.col("conv_id").cast("string"), F.struct(F.concat(F.lit("Sys: "), "text").alias("answer"))).alias("processed"),
    )
    out = an.merge_answers(an.resolve_answers(rows))
    return out.select(F.col("answer_key").cast("long").alias("answer_key"), "text", "n_parts")


@query(
    "json_answers",
    "R13",
    """SELECT event_id, CASE event_type WHEN 'error' THEN left(props, length(props) - 1) || '}' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN NULL ELSE props END ELSE props END AS json,
 CASE event_type WHEN 'click' THEN 'direct' WHEN 'view' THEN 'direct' WHEN 'signup' THEN 'extracted' WHEN 'error' THEN 'repaired' ELSE CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'direct' END END AS recovery FROM events""",
)
def json_answers(t: Tables) -> DataFrame:
    p, e = F.col("props"), F.col("event_type")
    text = (
        F.when(e == "click", F.concat(F.lit("<think>{a\nb</think> "), p))
        .when(e == "view", F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(e == "signup", F.concat(F.lit("The answer: "), p, F.lit(" as asked.")))
        .when(e == "error", F.expr("left(props, length(props) - 1)"))
        .otherwise(F.when(F.col("event_id") % 2 == 0, F.lit("no object here")).otherwise(F.concat(F.lit("left over</think>"), p)))
    )
    return an.parse_json_answers(t.spread("events", "event_id", "event_type", "props").select("event_id", text.alias("text"))).select("event_id", "json", "recovery")


# Answers as key: value lines; one line holds the whole text.
def kv_answers(t: Tables) -> DataFrame:
    last = F.when(F.col("turn") % 2 == 0, F.lit("\nleaf type: last [REPORT]")).otherwise("")
    text = F.concat(
        F.lit("<think>plan: "), "role", F.lit("</think>\n1. Leaf Type: "), "role", F.lit(" [NOTE]\nno colon here\nLength: "), F.length("text").cast("string"), F.lit(":"),
        F.col("turn").cast("string"), F.lit("\n3. Text: "), F.replace("text", F.lit("\n"), F.lit(" ")), last, F.lit("\n 2.1 Extra"), F.col("turn").cast("string"), F.lit(": y\n####\nLength: 0"),
    )
    return an.split_thinking(t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("specimen"), text.alias("text")))


@query(
    "key_value_answers",
    "R14",
    """SELECT conv_id || '-' || turn AS specimen, 'plan: ' || role AS thinking, CASE WHEN turn % 2 = 0 THEN 'last' ELSE role END AS "leaf type", length(text) || ':' || turn AS length, trim(replace(text, chr(10), ' ')) AS text, '' AS colour FROM conversations""",
)
def key_value_answers(t: Tables) -> DataFrame:
    rows = kv_answers(t)
    wide = an.wide_answers(an.key_value_answers(rows, "specimen"), rows, "specimen", ["leaf type", "length", "text", "colour"])
    return rows.select("specimen", "thinking").join(wide, "specimen")


@query(
    "unexpected_names",
    "R14 T5",
    "SELECT '1 extra' || turn AS name, count(*) AS n FROM conversations GROUP BY 1",
)
def unexpected_names(t: Tables) -> DataFrame:
    return an.unexpected_names(an.key_value_answers(kv_answers(t), "specimen"), ["leaf type", "length", "text", "colour"])


# ---- key pages ---------------------------------------------------------------------------


def key_pages(t: Tables) -> DataFrame:
    """Key pages made of the fetched ones: each navigation link becomes a taxon entry."""
    head = F.concat(
        F.lit('<p>Species Count: 1,'), F.format_string("%03d", F.col("page_id") % 1000), F.lit('</p><div id="char18"><span class="dynamlang">Leaf '), F.lit("Type?</span>"),
        F.lit('<div class="cs-div"><input type="checkbox" name="attr[]" value="70-1"><span>Very '), F.col("page_id").cast("string"), F.lit('</span></div></div><div id="key-taxa"><div class="family-div">Fam '),
        (F.col("page_id") % 7).cast("string"), F.lit("</div>"),
    )
    start = F.regexp_replace("html", r"(?s)^.*?<nav><ul>", "")
    nav = F.substring_index(start, "</ul></nav>", 1)
    taxa = F.regexp_replace(nav, r'<li><a href="[^"]*">([^<]*)</a></li>', '<div class="taxon-div"><a href="t.php?taxon=77"><i>$1</i> auth.</a></div>')
    rest = F.substring_index(start, "</ul></nav>", -1)
    return t.spread("pages", "page_id", "html", rows_per_task=200).select("page_id", "html", F.concat(head, taxa, F.lit("</div>"), rest).alias("key_html"))


NAV = """nav AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav><ul>(.*?)</ul></nav>', 1, 's'), '<a href="[^"]*">([^<]*)</a>', 1) AS names FROM pages)"""


@query(
    "key_page_taxa",
    "R15",
    f"""WITH {NAV} SELECT page_id, generate_subscripts(names, 1)::INT AS pos, 77::BIGINT AS taxon_id, trim(unnest(names)) AS scientific_name, 'Fam ' || page_id % 7 AS family FROM nav""",
)
def key_page_taxa(t: Tables) -> DataFrame:
    return an.listed_taxa(an.parse_key_pages(key_pages(t).drop("html"), "key_html"), "page_id")


@query(
    "key_page_options",
    "R15 R16",
    """SELECT page_id, 70 AS category_id, 1 AS option_id, 'Leaf Type' AS category, 'Very ' || page_id AS label, 1000 + page_id % 1000 AS species_count FROM pages""",
)
def key_page_options(t: Tables) -> DataFrame:
    parsed = an.parse_key_pages(key_pages(t).drop("html"), "key_html")
    return parsed.select("page_id", "species_count", F.explode("options").alias("o")).select(
        "page_id", "o.category_id", "o.option_id", "o.category", "o.label", "species_count"
    )


@query(
    "matrix_from_pages",
    "D28 D27",
    f"""WITH nav AS (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS names FROM pages), tx AS (SELECT page_id, abs(hash_id) AS taxon FROM (SELECT page_id, unnest(list_transform(names, lambda n: length(n))) AS hash_id FROM nav)),
base AS (SELECT DISTINCT taxon FROM tx WHERE page_id % 5 = 0), op(option_column, r) AS (VALUES ('tone__low', 1), ('tone__high', 2)),
val AS (SELECT taxon, option_column, max((m.page_id IS NOT NULL)::INT) AS value FROM base CROSS JOIN op LEFT JOIN (SELECT DISTINCT page_id % 5 AS page_id, taxon FROM tx) m ON m.taxon = base.taxon AND m.page_id = r GROUP BY ALL)
SELECT taxon::BIGINT AS taxon_id, 'tone' AS category, option_column, value FROM val UNION ALL SELECT taxon, 'tone', 'tone__uncoded', (max(value) = 0)::INT FROM val GROUP BY taxon""".replace("base.taxon AND m.page_id = r GROUP BY ALL", "base.taxon AND m.page_id = r GROUP BY base.taxon, option_column").replace("SELECT taxon, option_column, max(", "SELECT base.taxon AS taxon, option_column, max("),
)
def matrix_from_pages(t: Tables) -> DataFrame:
    # Each link of a page is an entry whose taxon id is the length of its name; pages 0, 5, 10 ... are unfiltered.
    names = F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    entries = F.array_join(
        F.transform(names, lambda n: F.concat(F.lit('<div class="taxon-div"><a href="?taxon='), F.length(n), F.lit('">'), n, F.lit("</a></div>"))), ""
    )
    options = '<div id="char3"><span class="dynamlang">Tone</span><div><input type="checkbox" name="attr[]" value="71-1"><span>Low</span></div><div><input type="checkbox" name="attr[]" value="71-2"><span>High</span></div></div>'
    attr = F.when(F.col("page_id") % 5 == 1, "71-1").when(F.col("page_id") % 5 == 2, "71-2").when(F.col("page_id") % 5 > 2, "none")
    pages = t.spread("pages", "page_id", "html", rows_per_task=200).select(attr.alias("attr"), F.concat(F.lit(options), F.lit('<div id="key-taxa">'), entries, F.lit("</div>")).alias("html"))
    return an.matrix_from_pages(pages)


# ---- descriptions and queries ------------------------------------------------------------


@query(
    "search_table",
    "A19",
    "SELECT lang AS taxon, source AS rank, text AS description FROM documents WHERE length(trim(text)) > 0",
)
def search_table(t: Tables) -> DataFrame:
    return rt.search_table(t.documents, "lang", "source", "text")


@query(
    "composed_queries",
    "R18",
    """SELECT l_orderkey, l_partkey, CASE WHEN l_returnflag = 'N' AND l_tax < 0.03 THEN 'tropical tree seedling' ELSE 'Tropical tree seedling with ' ||
 concat_ws(', ', CASE WHEN l_returnflag <> 'N' THEN 'flag: ' || lower(l_returnflag) END, CASE WHEN l_tax >= 0.03 THEN 'size: ' || CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END END) END AS query_text FROM lineitem""",
)
def composed_queries(t: Tables) -> DataFrame:
    traits = F.array(
        F.struct(F.lit("flag").alias("name"), F.when(F.col("l_returnflag") == "N", "Not observed").otherwise(F.col("l_returnflag")).alias("value")),
        F.struct(F.lit("size").alias("name"), F.when(F.col("l_tax") < 0.03, " ").when(F.col("l_quantity") > 25, "Large ").otherwise("small").alias("value")),
    )
    # Query template and fallback.
    text = compose_query(traits, "Tropical tree seedling with {traits}", "tropical tree seedling")
    return t.lineitem.select("l_orderkey", "l_partkey", text.alias("query_text"))


# ---- retrieval against predictions -------------------------------------------------------

NEIGHBOURS = f"""{pf.IMG}, {pf.PARTS}, {pf.POOLED}, {pf.MAJORITY.format(label='species')},
ul AS (SELECT vec_id, species, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM rec WHERE split_part = 'train'),
un AS (SELECT vec_id, sqrt(sum(v * v)) AS nrm FROM ul GROUP BY vec_id),
ns AS (SELECT individual_id, ul.vec_id, ul.species, sum(q * v / nrm) AS s FROM pool JOIN ul USING (d) JOIN un USING (vec_id) GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY individual_id ORDER BY round(s, 12) DESC, vec_id) AS pos FROM ns) WHERE pos <= 20),
sp_cen AS (WITH {pf.FIT.format(label='species')}, {pf.CENTER_POOLED}, {pf.SCORES} SELECT qid, lab, pos, p, l2, cos FROM rk)"""


def specimen_hits(t: Tables) -> DataFrame:
    """Twenty nearest train images per pooled test individual, by inner product."""
    def search() -> DataFrame:
        train = pf.unit_images(pf.train(t))
        return rt.search(pf.pooled_test(t), train, "individual_id", ["vec_id", "species"], 20, -1.0).select(
            "individual_id", "pos", F.col("item_vec_id").alias("vec_id"), F.col("item_species").alias("species"), "score"
        )

    return t.once("hits", search)


def specimen_truth(t: Tables) -> DataFrame:
    tests = pf.split_images(t).where("split_part = 'test'")
    return fs.majority_label(tests, "individual_id", "species", "vec_id").select("individual_id", F.col("species").alias("truth"))


def specimen_predictions(t: Tables) -> DataFrame:
    def classify() -> DataFrame:
        means, centroids = fs.centered_centroids(pf.train(t), "species")
        return fs.classify(fs.center(pf.pooled_test(t), means), centroids, "individual_id", "species", top_k=5)

    return t.once("specimen_predictions", classify)


@query(
    "retrieval_quality",
    "D21",
    f"""WITH {NEIGHBOURS}, f AS (SELECT t.individual_id, min(pos) AS r FROM truth t LEFT JOIN hits h ON h.individual_id = t.individual_id AND h.species = truth GROUP BY 1)
SELECT round(avg(coalesce(1 / r, 0)), 6) AS mrr, count(*) AS n, round(count(*) FILTER (r <= 1) / count(*), 6) AS recall_at_1, round(count(*) FILTER (r <= 3) / count(*), 6) AS recall_at_3,
 round(count(*) FILTER (r <= 5) / count(*), 6) AS recall_at_5, round(count(*) FILTER (r <= 10) / count(*), 6) AS recall_at_10, round(count(*) FILTER (r <= 20) / count(*), 6) AS recall_at_20 FROM f""",
)
def retrieval_quality(t: Tables) -> DataFrame:
    hits = specimen_hits(t).join(specimen_truth(t), "individual_id")
    return rounded(rt.retrieval_quality(hits, specimen_truth(t), "individual_id", "pos", F.col("species") == F.col("truth")))


CROSS = f"""{NEIGHBOURS}, h5 AS (SELECT individual_id, 'Sp' || species AS taxon, max(s) AS score FROM hits WHERE pos <= 10 GROUP BY ALL),
v5 AS (SELECT qid AS individual_id, 'SP' || lab AS label, p FROM sp_cen WHERE pos <= 5),
j AS (SELECT coalesce(h5.individual_id, v5.individual_id) AS individual_id, coalesce(taxon, label) AS taxon, score, p FROM h5 FULL JOIN v5 ON h5.individual_id = v5.individual_id AND lower(taxon) = lower(label)),
sg AS (SELECT *, CASE WHEN score IS NOT NULL AND p IS NOT NULL THEN CASE WHEN score >= 0.5 AND p >= 0.3 THEN 'strong' ELSE 'moderate' END WHEN score IS NOT NULL THEN 'rag_only' ELSE 'visual_only' END AS signal FROM j),
cr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY individual_id, signal IN ('strong', 'moderate'), signal ORDER BY greatest(coalesce(score, 0), coalesce(p, 0)) DESC, taxon) AS r FROM sg)
 WHERE signal IN ('strong', 'moderate') OR r <= 3)"""


def cross_rows(t: Tables) -> DataFrame:
    hits = specimen_hits(t).where("pos <= 10").withColumn("taxon", F.concat(F.lit("Sp"), "species"))
    preds = specimen_predictions(t).withColumn("rank_value", F.concat(F.lit("SP"), "rank_value"))
    return rt.cross_reference(hits, preds, "individual_id")


@query(
    "cross_reference",
    "J13",
    f"WITH {CROSS} SELECT individual_id, taxon, signal, round(coalesce(score, 0), 5) AS rag_score, round(coalesce(p, 0), 5) AS visual_softmax_score FROM cr",
)
def cross_reference(t: Tables) -> DataFrame:
    return rounded(cross_rows(t).drop("source"), 5)


@query(
    "accuracy_by_signal",
    "D22",
    f"""WITH {CROSS}, b AS (SELECT individual_id, max(CASE signal WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END) AS m FROM cr GROUP BY 1),
t1 AS (SELECT qid AS individual_id, lab FROM sp_cen WHERE pos = 1)
SELECT CASE m WHEN 3 THEN 'strong' WHEN 2 THEN 'moderate' ELSE 'divergent' END AS signal_group, count(*) AS n, count(*) FILTER (lab = truth) AS n_correct, round(count(*) FILTER (lab = truth) / count(*), 6) AS accuracy
FROM truth JOIN b USING (individual_id) JOIN t1 USING (individual_id) GROUP BY 1""",
)
def accuracy_by_signal(t: Tables) -> DataFrame:
    top1 = specimen_predictions(t).where("rank_position = 1").select("individual_id", "rank_value")
    grouped = rt.strongest_signal(cross_rows(t), specimen_truth(t).join(top1, "individual_id"), "individual_id")
    return rounded(rt.accuracy_by_signal(grouped, F.col("rank_value") == F.col("truth")))


# ---- evidence ----------------------------------------------------------------------------


def evidence_inputs(t: Tables) -> DataFrame:
    """One row per pooled individual with the fields the quality flags read."""
    top1 = specimen_predictions(t).where("rank_position = 1").select("individual_id", F.col("softmax_score").alias("top_score"), "margin")
    # The label that each image gets by itself.
    labels = pf.image_predictions(t).groupBy("individual_id").agg(F.collect_set(F.col("predicted").cast("string")).alias("image_labels"))
    # Trait counts come from the label numbers of the images.
    traits = pf.split_images(t).where("split_part = 'test'").groupBy("individual_id").agg(
        (F.count(F.lit(1)) + F.max("species")).alias("n_values"), F.max("species").alias("n_unclear")
    )
    k = F.col("individual_id")
    return (
        top1.join(labels, "individual_id").join(traits, "individual_id")
        .withColumn("hierarchy_note", F.when(k % 4 == 0, F.lit("note")))
        .withColumn("gate_flags", F.when(k % 3 == 0, F.array(F.lit("family_distance_exceeds_threshold"))))
    )


@query(
    "quality_flags",
    "R21",
    f"""WITH {NEIGHBOURS}, tp AS (SELECT a.qid AS individual_id, a.p AS p1, a.p - b.p AS margin FROM sp_cen a JOIN sp_cen b ON a.qid = b.qid AND a.pos = 1 AND b.pos = 2),
{pf.FIT.format(label='species')},
il AS (SELECT vec_id, individual_id, species, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM rec WHERE split_part = 'test'),
ix AS (SELECT vec_id, individual_id, species, d, v - mu AS x FROM il JOIN mu USING (d)), ino AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-12) AS nrm FROM ix GROUP BY 1),
isc AS (SELECT vec_id, individual_id, species, lab, sqrt(sum((x / nrm - c) * (x / nrm - c))) AS l2 FROM ix JOIN ino USING (vec_id) JOIN cen USING (d) GROUP BY ALL),
itop AS (SELECT * FROM isc QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(l2, 12), lab) = 1),
im AS (SELECT individual_id, count(*) + max(species) AS nv, max(species) AS nu, count(DISTINCT lab) AS nl, array_to_string(list_sort(list(DISTINCT lab::VARCHAR)), ', ') AS ls FROM itop GROUP BY 1)
SELECT individual_id, concat_ws(' ; ', CASE WHEN nu >= 5 THEN 'Low morphological quality: ' || nu || ' of ' || nv || ' traits are unclear/not observed' END,
 CASE WHEN p1 < 0.12 THEN 'Low classification similarity: top prediction captures only ' || printf('%.1f', 100 * p1) || '% of total similarity (threshold: 12.0%)' END,
 CASE WHEN margin < 0.1 THEN 'Low decision margin: ' || printf('%.3f', margin) || ' between top-1 and top-2' END,
 CASE WHEN nl > 1 THEN 'Per-image disagreement: images predict ' || nl || ' distinct labels (' || ls || ')' END,
 CASE WHEN individual_id % 4 = 0 THEN 'Hierarchical inconsistency: note' END, CASE WHEN individual_id % 3 = 0 THEN 'Out-of-distribution warning: family_distance_exceeds_threshold' END) AS flags
FROM tp JOIN im USING (individual_id)""",
)
def quality_flags(t: Tables) -> DataFrame:
    out = ev.quality_flags(evidence_inputs(t), 0.12)
    return out.select("individual_id", F.array_join("flags", " ; ").alias("flags"))


@query(
    "evidence_documents",
    "R22",
    f"""WITH {CROSS}, tr AS (SELECT individual_id, string_agg(CASE WHEN fn = 1 THEN chr(10) || '### Leaf Arrangement' || chr(10) || chr(10) ELSE '' END || '- **' || f || '**: ' || v, chr(10) ORDER BY fn) AS body FROM (
 SELECT individual_id, 1 AS fn, 'Relative Position' AS f, 'value ' || individual_id % 3 AS v FROM truth UNION ALL SELECT individual_id, 2, 'Spacing', 'unclear' FROM truth) GROUP BY 1),
pr AS (SELECT qid AS individual_id, string_agg(CASE WHEN a.pos = 1 THEN '### Species' || chr(10) || chr(10) || 'Decision margin: ' || printf('%.3f', a.p - (SELECT p FROM sp_cen b WHERE b.qid = a.qid AND b.pos = 2)) || chr(10) || chr(10) ELSE '' END
  || '- #' || a.pos || ': **' || lab || '** (similarity share: ' || printf('%.1f', 100 * p) || '%) | L2: ' || printf('%.3f', l2) || ', cosine: ' || printf('%.3f', cos), chr(10) ORDER BY a.pos) AS body FROM sp_cen a WHERE a.pos <= 5 GROUP BY 1),
li AS (SELECT individual_id, string_agg('- **' || species || '** (species, similarity: ' || printf('%.2f', s) || ')' || chr(10) || '  - ' || left(text, 200), chr(10) ORDER BY pos) AS body FROM hits JOIN documents ON doc_id = vec_id WHERE pos <= 3 AND text <> '' GROUP BY 1),
sg2 AS (SELECT individual_id, string_agg('- **' || taxon || '** [' || CASE signal WHEN 'strong' THEN 'STRONG CONVERGENCE' WHEN 'moderate' THEN 'MODERATE CONVERGENCE' WHEN 'rag_only' THEN 'Literature only' ELSE 'Visual only' END || '] (RAG: ' || printf('%.2f', coalesce(score, 0)) || ', Visual: ' || printf('%.1f', 100 * coalesce(p, 0)) || '%)', chr(10)
  ORDER BY list_position(['strong', 'moderate', 'rag_only', 'visual_only'], signal), taxon) AS body FROM cr GROUP BY 1)
SELECT individual_id, '# Evidence Summary' || chr(10) || chr(10) || '## Morphological Profile' || chr(10) || chr(10) || tr.body || chr(10) || chr(10) || '## Visual Classification (Multi-Rank)' || chr(10) || chr(10) || pr.body || chr(10) || chr(10)
 || '## Literature Evidence' || chr(10) || chr(10) || coalesce('### Matching Taxa (by trait similarity)' || chr(10) || chr(10) || li.body, 'No matching taxa found in literature.' || chr(10)) || chr(10) || chr(10) || '## Convergence Analysis' || chr(10) || chr(10) || sg2.body || chr(10) AS evidence_document
FROM tr JOIN pr USING (individual_id) LEFT JOIN li USING (individual_id) JOIN sg2 USING (individual_id)""",
)
def evidence_documents(t: Tables) -> DataFrame:
    specimens = specimen_truth(t).select("individual_id")
    k = F.col("individual_id")
    rows = F.array(
        F.struct(F.lit(1).alias("field_no"), F.lit("relative_position").alias("field"), F.concat(F.lit("value "), k % 3).alias("value")),
        F.struct(F.lit(2).alias("field_no"), F.lit("spacing").alias("field"), F.lit("unclear").alias("value")),
    )
    traits = specimens.select("individual_id", F.lit(1).alias("section_no"), F.lit("leaf_arrangement").alias("section"), F.explode(rows).alias("f")).select(
        "individual_id", "section_no", "section", "f.*"
    )
    preds = specimen_predictions(t).withColumn("rank_no", F.lit(1)).withColumn("rank", F.lit("species"))
    passages = t.documents.select(F.col("doc_id").alias("vec_id"), F.left("text", F.lit(200)).alias("description"))
    hits = (
        specimen_hits(t).where("pos <= 3").join(passages, "vec_id")
        .select("individual_id", "pos", F.col("species").cast("string").alias("taxon"), F.lit("species").alias("rank"), "score", "description")
    )
    return ev.evidence_documents(
        specimens, "individual_id", ev.trait_section(traits, "individual_id"), ev.prediction_section(preds, "individual_id"),
        ev.literature_section(hits, "individual_id"), ev.signal_section(cross_rows(t), "individual_id"),
    )
