"""Splits, sampling and few-shot classification over ``embeddings``.

The table stands for an image collection: ``vec_id`` is the image, five images in a row are
one individual, and the label nests into genus and family.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from specgrade.functions.vectors import l2_normalize
from specgrade.operators import classmetrics as cm, fewshot as fs, splitting as sp, vectorlists as vl
from specgrade.plans.registry import Tables, query

SEED = 42

IMG = """img AS (
  SELECT vec_id, embedding::DOUBLE[] AS embedding, vec_id // 5 AS individual_id,
         label AS species, label // 2 AS genus, label // 6 AS family
  FROM embeddings)"""

PARTS = f"""grp AS (SELECT DISTINCT individual_id FROM img),
pos AS (SELECT individual_id,
               row_number() OVER (ORDER BY md5(concat('{SEED}', ':', individual_id)), individual_id) AS rk,
               count(*) OVER () AS g FROM grp),
cut AS (SELECT *, ceil(0.15::DOUBLE * g) AS n_test FROM pos),
cut2 AS (SELECT *, ceil((0.15::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE)) * (g - n_test)) AS n_val FROM cut),
part AS (SELECT individual_id, CASE WHEN rk <= n_test THEN 'test' WHEN rk <= n_test + n_val THEN 'val'
                ELSE 'train' END AS split_part FROM cut2),
rec AS (SELECT img.*, split_part FROM img JOIN part USING (individual_id))"""

# One row per (vector, dimension); means and norms follow from plain aggregates.
UNIT_CENTROIDS = """tr AS (SELECT vec_id, {label} AS lab, embedding FROM rec WHERE split_part = 'train'),
tl AS (SELECT vec_id, lab, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM tr),
tn AS (SELECT vec_id, greatest(sqrt(sum(v * v)), 1e-12) AS nrm FROM tl GROUP BY vec_id),
cm AS (SELECT lab, d, avg(v / nrm) AS m FROM tl JOIN tn USING (vec_id) GROUP BY lab, d),
cn AS (SELECT lab, greatest(sqrt(sum(m * m)), 1e-12) AS nrm FROM cm GROUP BY lab),
cen AS (SELECT lab, d, m / nrm AS c FROM cm JOIN cn USING (lab))"""

POOLED = """el AS (SELECT vec_id, individual_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d
       FROM rec WHERE split_part = 'test'),
en AS (SELECT vec_id, greatest(sqrt(sum(v * v)), 1e-12) AS nrm FROM el GROUP BY vec_id),
pm AS (SELECT individual_id, d, avg(v / nrm) AS m FROM el JOIN en USING (vec_id) GROUP BY individual_id, d),
pn AS (SELECT individual_id, greatest(sqrt(sum(m * m)), 1e-12) AS nrm FROM pm GROUP BY individual_id),
pool AS (SELECT individual_id, d, m / nrm AS q FROM pm JOIN pn USING (individual_id))"""

# Centred classifier fitted on the train part for one label.
FIT = """tr AS (SELECT vec_id, {label} AS lab, embedding FROM rec WHERE split_part = 'train'),
tl AS (SELECT vec_id, lab, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM tr),
mu AS (SELECT d, avg(v) AS mu FROM tl GROUP BY d),
tc AS (SELECT vec_id, lab, d, v - mu AS x FROM tl JOIN mu USING (d)),
tn AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-12) AS nrm FROM tc GROUP BY vec_id),
sup AS (SELECT vec_id, lab, d, x / nrm AS c FROM tc JOIN tn USING (vec_id)),
cen AS (SELECT lab, d, avg(c) AS c FROM sup GROUP BY lab, d)"""

CENTER_POOLED = """qc AS (SELECT individual_id, d, q - mu AS x FROM pool JOIN mu USING (d)),
qn AS (SELECT individual_id, greatest(sqrt(sum(x * x)), 1e-12) AS nrm FROM qc GROUP BY individual_id),
qry AS (SELECT individual_id AS qid, d, x / nrm AS q FROM qc JOIN qn USING (individual_id))"""

CENTER_IMAGES = """ql AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d
       FROM rec WHERE split_part = '{part}'),
qc AS (SELECT vec_id, d, v - mu AS x FROM ql JOIN mu USING (d)),
qn AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-12) AS nrm FROM qc GROUP BY vec_id),
qry AS (SELECT vec_id AS qid, d, x / nrm AS q FROM qc JOIN qn USING (vec_id))"""

SCORES = """sc AS (SELECT qid, lab, sqrt(sum((q - c) * (q - c))) AS l2,
       sum(q * c) / greatest(sqrt(sum(q * q)) * sqrt(sum(c * c)), 1e-8) AS cos
       FROM qry JOIN cen USING (d) GROUP BY qid, lab),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(l2, 12), lab) AS pos,
       exp(-l2) / sum(exp(-l2)) OVER (PARTITION BY qid) AS p FROM sc)"""

MAJORITY = """lc AS (SELECT individual_id, {label} AS lab, count(*) AS n, min(vec_id) AS first
       FROM rec WHERE split_part = 'test' GROUP BY 1, 2),
truth AS (SELECT individual_id, lab AS truth, n_labels FROM (
       SELECT *, count(*) OVER (PARTITION BY individual_id) AS n_labels,
       row_number() OVER (PARTITION BY individual_id ORDER BY n DESC, first) AS r FROM lc) WHERE r = 1)"""


def images(t: Tables) -> DataFrame:
    return t.embeddings.select(
        "vec_id",
        "embedding",
        F.expr("vec_id div 5").alias("individual_id"),
        F.col("label").cast("long").alias("species"),
        F.expr("label div 2").alias("genus"),
        F.expr("label div 6").alias("family"),
    )


def split_images(t: Tables, seeds=SEED) -> DataFrame:
    name = f"split-{seeds}" if isinstance(seeds, int) else "split-" + "-".join(map(str, seeds))
    out = t.once(name, lambda: sp.group_split(images(t), seeds=seeds))
    return out.drop("seed") if isinstance(seeds, int) else out


def train(t: Tables) -> DataFrame:
    return split_images(t).where("split_part = 'train'")


def unit_images(df: DataFrame) -> DataFrame:
    return df.withColumn("embedding", l2_normalize(F.col("embedding")))


def pooled_test(t: Tables) -> DataFrame:
    return fs.pool(unit_images(split_images(t).where("split_part = 'test'")), "individual_id")


def ranks_long(df: DataFrame, *keep: str) -> DataFrame:
    """One row per record and rank."""
    ranks = F.array(
        *[F.struct(F.lit(r).alias("rank"), F.col(r).alias("label")) for r in ("family", "genus", "species")]
    )
    return df.select(*keep, F.explode(ranks).alias("_r")).select(*keep, "_r.rank", "_r.label")


def multirank_top(t: Tables, top_k: int = 3) -> DataFrame:
    support = ranks_long(train(t), "vec_id", "embedding")
    means, centroids = fs.centered_centroids(support, "label", "rank")
    every_rank = F.explode(F.array(*[F.lit(r) for r in ("family", "genus", "species")]))
    queries = pooled_test(t).select("individual_id", "embedding", every_rank.alias("rank"))
    return fs.classify(fs.center(queries, means, "rank"), centroids, "individual_id", "label", "rank", top_k)


@query(
    "centroid_baseline",
    "V12 V1 V2 V6 D6 A3",
    f"""WITH {IMG}, {PARTS}, {UNIT_CENTROIDS.format(label='family')}, {POOLED}, {MAJORITY.format(label='family')},
sc AS (SELECT individual_id, lab, sum(q * c) AS s FROM pool JOIN cen USING (d) GROUP BY individual_id, lab),
rk AS (SELECT individual_id, lab, row_number() OVER (PARTITION BY individual_id ORDER BY round(s, 12) DESC, lab) AS r FROM sc),
hit AS (SELECT t.individual_id, n_labels, max((r = 1 AND lab = truth)::INT) AS top1, max((r <= 5 AND lab = truth)::INT) AS top5
        FROM rk JOIN truth t USING (individual_id) GROUP BY 1, 2)
SELECT round(avg(top1), 6) AS accuracy, CASE WHEN (SELECT count(DISTINCT lab) FROM cen) >= 5 THEN round(avg(top5), 6) END AS top5_accuracy, count(*) AS num_test_individuals,
       count(*) FILTER (n_labels > 1) AS mixed_label_individuals,
       (SELECT count(*) FROM rec WHERE split_part = 'test') AS num_test_images,
       (SELECT count(*) FROM rec WHERE split_part = 'train') AS num_train_images,
       (SELECT count(DISTINCT lab) FROM cen) AS num_classes_in_train
FROM hit""",
)
def centroid_baseline(t: Tables) -> DataFrame:
    split = split_images(t)
    tests = split.where("split_part = 'test'")
    centroids = fs.unit_centroids(split.where("split_part = 'train'"), "family")
    truth = fs.majority_label(tests, "individual_id", "family", "vec_id")
    top = fs.nearest_items(
        fs.pool(unit_images(tests), "individual_id"), centroids, 5, "individual_id", "family", metric="dot"
    )
    hits = (
        top.join(truth, "individual_id")
        .groupBy("individual_id")
        .agg(
            F.max((F.col("pos") == 1) & (F.col("item_family") == F.col("family"))).alias("top1"),
            F.max(F.col("item_family") == F.col("family")).alias("top5"),
            F.first("mixed_labels").alias("mixed"),
        )
    )
    sizes = split.agg(
        F.struct(
            F.count(F.when(F.col("split_part") == "test", 1)).alias("test"),
            F.count(F.when(F.col("split_part") == "train", 1)).alias("train"),
            F.countDistinct(F.when(F.col("split_part") == "train", F.col("family"))).alias("classes"),
        )
    ).scalar()
    return hits.agg(
        F.round(F.avg(F.col("top1").cast("int")), 6).alias("accuracy"),
        F.round(F.avg(F.col("top5").cast("int")), 6).alias("_top5"),
        F.count(F.lit(1)).alias("num_test_individuals"),
        F.count(F.when(F.col("mixed"), 1)).alias("mixed_label_individuals"),
    ).select(
        "accuracy",
        # With fewer than five classes the first five hold every class.
        F.when(sizes["classes"] >= 5, F.col("_top5")).alias("top5_accuracy"),
        "num_test_individuals",
        "mixed_label_individuals",
        sizes["test"].alias("num_test_images"),
        sizes["train"].alias("num_train_images"),
        sizes["classes"].alias("num_classes_in_train"),
    )


@query(
    "unit_vectors",
    "V1 A20 A3",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS raw_norm,
  round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))), 1e-12))), 5) AS unit_sum,
  len(embedding)::INT AS dim FROM embeddings""",
)
def unit_vectors(t: Tables) -> DataFrame:
    from specgrade.functions.vectors import l2_norm

    unit = l2_normalize(F.col("embedding"))
    return t.embeddings.select(
        "vec_id",
        F.round(l2_norm(F.col("embedding")), 6).alias("raw_norm"),
        F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 5).alias("unit_sum"),
        F.size("embedding").alias("dim"),
    )


@query(
    "centered_centroids",
    "V2",
    f"""WITH {IMG}, {PARTS}, {FIT.format(label='species')}
SELECT lab::BIGINT AS label, (d - 1)::INT AS dim, round(c, 6) AS value,
  (SELECT count(*) FROM tr WHERE tr.lab = cen.lab) AS n_support FROM cen""",
)
def centered_centroids(t: Tables) -> DataFrame:
    _, fitted = fs.centered_centroids(train(t), "species")
    return fitted.select(F.col("species").alias("label"), F.posexplode("centroid").alias("dim", "value"), "n_support").select(
        "label", "dim", F.round("value", 6).alias("value"), "n_support"
    )


@query(
    "class_scores",
    "V3",
    f"""WITH {IMG}, {PARTS}, {FIT.format(label='species')}, {CENTER_IMAGES.format(part='test')}, {SCORES}
SELECT qid AS vec_id, pos::INT AS rank_position, lab AS rank_value, round(l2, 5) AS l2_distance, round(cos, 5) AS cosine_similarity,
  round(p, 5) AS softmax_score FROM rk""",
)
def class_scores(t: Tables) -> DataFrame:
    means, centroids = fs.centered_centroids(train(t), "species")
    tests = fs.center(split_images(t).where("split_part = 'test'"), means)
    out = fs.classify(tests, centroids, "vec_id", "species", top_k=None)
    return out.select(
        "vec_id", "rank_position", "rank_value",
        F.round("l2_distance", 5).alias("l2_distance"),
        F.round("cosine_similarity", 5).alias("cosine_similarity"),
        F.round("softmax_score", 5).alias("softmax_score"),
    )


@query(
    "nearest_support",
    "V4",
    f"""WITH {IMG}, {PARTS}, {FIT.format(label='species')}, {POOLED}, {CENTER_POOLED},
sc AS (SELECT qid, vec_id, lab, sqrt(sum((q - c) * (q - c))) AS l2, sum(q * c) AS cos FROM qry JOIN sup USING (d) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(l2, 12), vec_id) AS pos FROM sc)
SELECT qid AS individual_id, pos::INT AS pos, vec_id AS support_id, lab AS label, round(l2, 5) AS l2_distance, round(cos, 5) AS cosine
FROM rk WHERE pos <= 5""",
)
def nearest_support(t: Tables) -> DataFrame:
    support = train(t)
    means = fs.global_mean(support)
    lists = vl.build(fs.center(support, means), ["vec_id", "species"])
    found = vl.nearest(fs.center(pooled_test(t), means), lists, 5, "individual_id").rows
    return found.select(
        "individual_id", "pos", F.col("item_vec_id").alias("support_id"), F.col("item_species").alias("label"),
        F.round("l2_distance", 5).alias("l2_distance"), F.round("cosine", 5).alias("cosine"),
    )


@query(
    "similar_vectors",
    "V5",
    """WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
sc AS (SELECT a.vec_id, b.vec_id AS match_id, list_dot_product(a.e, b.e) / (a.n * b.n) AS s FROM u a, u b),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, match_id) AS pos FROM sc)
SELECT vec_id, pos::INT AS pos, match_id, round(s, 5) AS score FROM rk WHERE pos <= 10 AND s >= 0.2""",
)
def similar_vectors(t: Tables) -> DataFrame:
    from specgrade.operators.retrieval import search

    unit = unit_images(images(t))
    return search(unit, unit, "vec_id", "vec_id", top_k=10, min_similarity=0.2).select(
        "vec_id", "pos", F.col("item_vec_id").alias("match_id"), F.round("score", 5).alias("score")
    )


@query(
    "pooled_individuals",
    "V6",
    f"""WITH {IMG}, {PARTS}, {POOLED}
SELECT individual_id, (d - 1)::INT AS dim, round(q, 6) AS value,
 (SELECT count(*) FROM rec WHERE rec.individual_id = pool.individual_id) AS num_images FROM pool""",
)
def pooled_individuals(t: Tables) -> DataFrame:
    return pooled_test(t).select("individual_id", "num_images", F.posexplode("embedding").alias("dim", "value")).select(
        "individual_id", "dim", F.round("value", 6).alias("value"), "num_images"
    )


def _rank_union(template: str, columns: str) -> str:
    """The same SQL for each rank, stacked."""
    parts = [
        f"SELECT '{r}' AS rank, {columns} FROM ({template.format(label=r)})" for r in ("family", "genus", "species")
    ]
    return "\nUNION ALL ".join(parts)


@query(
    "rank_models",
    "V7",
    _rank_union(
        f"""WITH {IMG}, {PARTS}, {{FIT}} SELECT lab, round(sqrt(sum(c * c)), 6) AS centroid_norm,
 (SELECT count(*) FROM tr WHERE tr.lab = cen.lab) AS n_support FROM cen GROUP BY lab""".replace("{FIT}", FIT),
        "lab AS label, centroid_norm, n_support",
    ),
)
def rank_models(t: Tables) -> DataFrame:
    from specgrade.functions.vectors import l2_norm

    _, fitted = fs.centered_centroids(ranks_long(train(t), "vec_id", "embedding"), "label", "rank")
    return fitted.select("rank", "label", F.round(l2_norm(F.col("centroid")), 6).alias("centroid_norm"), "n_support")


@query(
    "train_set_mismatch",
    "V7",
    f"""WITH {IMG}, s AS (SELECT 'family' AS rank, 42 AS seed UNION ALL SELECT 'genus', 42 UNION ALL SELECT 'species', 7),
g AS (SELECT DISTINCT individual_id FROM img),
pos AS (SELECT rank, individual_id, row_number() OVER (PARTITION BY rank ORDER BY md5(concat(seed, ':', individual_id)), individual_id) AS rk,
  count(*) OVER (PARTITION BY rank) AS g FROM g, s),
cut AS (SELECT *, ceil(0.15::DOUBLE * g) AS n_test FROM pos),
tr AS (SELECT rank, individual_id FROM cut WHERE rk > n_test + ceil((0.15::DOUBLE / 0.85::DOUBLE) * (g - n_test)))
SELECT vec_id, count(*) AS n_ranks, string_agg(rank, ',' ORDER BY rank) AS ranks FROM img JOIN tr USING (individual_id)
GROUP BY vec_id HAVING count(*) < 3""",
)
def train_set_mismatch(t: Tables) -> DataFrame:
    ranks = F.when(F.col("seed") == 42, F.array(F.lit("family"), F.lit("genus"))).otherwise(F.array(F.lit("species")))
    splits = split_images(t, [42, 7]).select("vec_id", "split_part", F.explode(ranks).alias("rank"))
    return fs.train_set_mismatch(splits, "vec_id", "rank").select(
        "vec_id", "n_ranks", F.array_join("ranks", ",").alias("ranks")
    )


@query(
    "rank_predictions",
    "V8 T2",
    _rank_union(
        f"""WITH {IMG}, {PARTS}, {{FIT}}, {POOLED}, {CENTER_POOLED}, {SCORES},
m AS (SELECT *, p - lead(p) OVER (PARTITION BY qid ORDER BY pos) AS gap FROM rk)
SELECT *, CASE WHEN pos = 1 THEN round(coalesce(gap, 1.0), 5) END AS margin FROM m WHERE pos <= 3""".replace("{FIT}", FIT),
        """qid AS individual_id, pos::INT AS rank_position, lab AS rank_value, round(p, 5) AS softmax_score, round(l2, 5) AS l2_distance,
round(cos, 5) AS cosine_similarity, margin""",
    ),
)
def rank_predictions(t: Tables) -> DataFrame:
    return multirank_top(t, 3).select(
        "rank", "individual_id", "rank_position", "rank_value",
        *[F.round(c, 5).alias(c) for c in ("softmax_score", "l2_distance", "cosine_similarity", "margin")],
    )


VAL_TOP1 = f"""WITH {IMG}, {PARTS}, {FIT}, {CENTER_IMAGES.format(part='val')}, {SCORES}
SELECT qid, lab, l2, rec.{{label}} AS truth FROM rk JOIN rec ON rec.vec_id = qid WHERE pos = 1"""


@query(
    "distance_thresholds",
    "V9",
    f"""SELECT rank, coalesce(round(quantile_cont(CASE WHEN lab = truth THEN l2 END, 0.95), 5), 'inf'::DOUBLE) AS threshold
FROM ({_rank_union(VAL_TOP1, 'qid, lab, l2, truth')}) GROUP BY rank""",
)
def distance_thresholds(t: Tables) -> DataFrame:
    return _thresholds(t).select("rank", F.round("threshold", 5).alias("threshold"))


def _thresholds(t: Tables) -> DataFrame:
    means, centroids = fs.centered_centroids(ranks_long(train(t), "vec_id", "embedding"), "label", "rank")
    val = ranks_long(split_images(t).where("split_part = 'val'"), "vec_id", "embedding").withColumnRenamed("label", "truth")
    top1 = fs.classify(fs.center(val, means, "rank"), centroids, ["vec_id", "truth"], "label", "rank", 1)
    return fs.calibrate_thresholds(top1, "truth")


TEST_TOP1 = f"""WITH {IMG}, {PARTS}, {FIT}, {POOLED}, {CENTER_POOLED}, {SCORES}
SELECT qid, lab, l2, p FROM rk WHERE pos = 1"""


@query(
    "distribution_gate",
    "V10",
    f"""WITH th AS (SELECT rank, coalesce(quantile_cont(CASE WHEN lab = truth THEN l2 END, 0.95), 'inf'::DOUBLE) AS threshold
FROM ({_rank_union(VAL_TOP1, 'qid, lab, l2, truth')}) GROUP BY rank),
q AS ({_rank_union(TEST_TOP1, 'qid, lab, l2')})
SELECT rank, qid AS individual_id, lab AS rank_value, l2 <= threshold AS in_distribution,
 CASE WHEN NOT l2 <= threshold THEN rank || '_distance_exceeds_threshold' END AS flag FROM q JOIN th USING (rank)""",
)
def distribution_gate(t: Tables) -> DataFrame:
    return fs.distance_gate(multirank_top(t, 1), _thresholds(t)).select(
        "rank", "individual_id", "rank_value", "in_distribution", "flag"
    )


def parent_links(t: Tables) -> DataFrame:
    from specgrade.operators.taxonomy import parent_map

    return parent_map(images(t), "vec_id")


@query(
    "hierarchy_consistency",
    "V11",
    f"""WITH q AS ({_rank_union(TEST_TOP1, 'qid, lab')}),
w AS (SELECT qid, max(lab) FILTER (rank = 'family') AS family, max(lab) FILTER (rank = 'genus') AS genus, max(lab) FILTER (rank = 'species') AS species FROM q GROUP BY qid),
{IMG},
gf AS (SELECT genus, arg_max(family, vec_id) AS f FROM img GROUP BY genus),
sg AS (SELECT species, arg_max(genus, vec_id) AS g, arg_max(family, vec_id) AS f FROM img GROUP BY species),
c AS (SELECT w.qid, w.family, w.genus, w.species, coalesce(gf.f = w.family, true) AS a, coalesce(sg.g = w.genus, true) AS b, coalesce(sg.f = w.family, true) AS d
  FROM w LEFT JOIN gf ON gf.genus = w.genus LEFT JOIN sg ON sg.species = w.species)
SELECT qid AS individual_id, family, genus, species, a AS family_genus_agree, b AS species_genus_agree, d AS species_family_agree,
 a AND b AND d AS consistent, (NOT a)::INT + (NOT b)::INT + (NOT d)::INT AS n_notes FROM c""",
)
def hierarchy_consistency(t: Tables) -> DataFrame:
    out = fs.hierarchy_consistency(multirank_top(t, 1), parent_links(t), "individual_id")
    return out.withColumn("n_notes", F.size("notes")).drop("notes")


@query(
    "individual_split",
    "W1",
    f"""WITH {IMG}, {PARTS} SELECT vec_id, individual_id, split_part FROM rec""",
)
def individual_split(t: Tables) -> DataFrame:
    return split_images(t).select("vec_id", "individual_id", "split_part")


@query(
    "individual_split_seeds",
    "W1",
    """WITH g AS (SELECT DISTINCT o_custkey FROM orders), s AS (SELECT unnest([42, 7, 2024]) AS seed),
pos AS (SELECT seed, o_custkey, row_number() OVER (PARTITION BY seed ORDER BY md5(concat(seed, ':', o_custkey)), o_custkey) AS rk,
  count(*) OVER (PARTITION BY seed) AS g FROM g, s),
cut AS (SELECT *, ceil(0.15::DOUBLE * g) AS n_test FROM pos),
part AS (SELECT seed, o_custkey, CASE WHEN rk <= n_test THEN 'test' WHEN rk <= n_test + ceil((0.15::DOUBLE / 0.85::DOUBLE) * (g - n_test)) THEN 'val' ELSE 'train' END AS split_part FROM cut)
SELECT seed, split_part, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_individuals FROM orders JOIN part USING (o_custkey) GROUP BY 1, 2""",
)
def individual_split_seeds(t: Tables) -> DataFrame:
    split = sp.group_split(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", seeds=[42, 7, 2024])
    return split.groupBy("seed", "split_part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_custkey").alias("n_individuals")
    )


@query(
    "stratified_split",
    "W2",
    """WITH c AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label),
a AS (SELECT *, sum(size) OVER ()::DOUBLE AS total FROM c),
t AS (SELECT *, ceil(0.15::DOUBLE * total) AS n_test, size::DOUBLE / total * ceil(0.15::DOUBLE * total) AS ex FROM a),
t2 AS (SELECT *, floor(ex) + (row_number() OVER (ORDER BY round(ex - floor(ex), 9) DESC, label) <= n_test - sum(floor(ex)) OVER ())::INT AS q_test FROM t),
v AS (SELECT *, size - q_test AS rest, total - n_test AS rtotal FROM t2),
v1 AS (SELECT *, ceil((0.15::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE)) * rtotal) AS n_val FROM v),
v2 AS (SELECT *, rest / rtotal * n_val AS ex2 FROM v1),
v3 AS (SELECT *, floor(ex2) + (row_number() OVER (ORDER BY round(ex2 - floor(ex2), 9) DESC, label) <= n_val - sum(floor(ex2)) OVER ())::INT AS q_val FROM v2),
r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42', ':', vec_id)), vec_id) AS rk FROM embeddings)
SELECT vec_id, label, CASE WHEN rk <= q_test THEN 'test' WHEN rk <= q_test + q_val THEN 'val' ELSE 'train' END AS split_part
FROM r JOIN v3 USING (label)""",
)
def stratified_split(t: Tables) -> DataFrame:
    return sp.stratified_split(t.embeddings.select("vec_id", "label"), "label", "vec_id", seed=SEED)


@query(
    "support_set",
    "W3",
    f"""WITH {IMG}, {PARTS} SELECT species, vec_id, pos::INT AS support_pos FROM (
SELECT species, vec_id, row_number() OVER (PARTITION BY species ORDER BY md5(concat('42', ':', vec_id)), vec_id) AS pos
FROM rec WHERE split_part = 'train') WHERE pos <= 5""",
)
def support_set(t: Tables) -> DataFrame:
    return sp.support_set(train(t).select("vec_id", "species"), 5, "species", "vec_id", SEED)


@query(
    "episodes",
    "W4",
    """WITH c AS (SELECT label, unnest(range(20)) AS episode FROM (SELECT DISTINCT label FROM embeddings)),
d AS (SELECT label, episode FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY md5(concat('42', ':', episode, ':', label)), label) AS w FROM c) WHERE w <= 5),
r AS (SELECT episode, label, vec_id, row_number() OVER (PARTITION BY episode, label ORDER BY md5(concat('42', ':', episode, ':', vec_id)), vec_id) AS pos
  FROM embeddings JOIN d USING (label))
SELECT episode::INT AS episode, CASE WHEN pos <= 5 THEN 'support' ELSE 'query' END AS role, label, vec_id, pos::INT AS pos FROM r WHERE pos <= 20""",
)
def episodes(t: Tables) -> DataFrame:
    return sp.sample_episodes(t.embeddings, 20, n_way=5, k_shot=5, n_query=15, label="label", key="vec_id", seed=SEED)


@query(
    "sampled_individual",
    "W5",
    f"""WITH {IMG}, {PARTS} SELECT individual_id, 7 AS seed FROM (SELECT DISTINCT individual_id FROM rec WHERE split_part = 'test')
ORDER BY md5(concat('7', ':', individual_id)), individual_id LIMIT 1""",
)
def sampled_individual(t: Tables) -> DataFrame:
    return sp.sample_individual(split_images(t), "test", 7)


@query(
    "class_statistics",
    "D1",
    f"""WITH {IMG}, {PARTS}, c AS (SELECT split_part, species, count(*) AS n FROM rec GROUP BY 1, 2)
SELECT split_part, min(n) AS min_samples, max(n) AS max_samples, round(avg(n), 6) AS mean_samples, median(n) AS median_samples,
 round(stddev_pop(n), 6) AS std_samples, count(*) AS num_classes FROM c GROUP BY 1""",
)
def class_statistics(t: Tables) -> DataFrame:
    out = sp.class_statistics(split_images(t), "species")
    return out.withColumn("mean_samples", F.round("mean_samples", 6)).withColumn("std_samples", F.round("std_samples", 6))


@query(
    "shot_feasibility",
    "D1",
    f"""WITH {IMG}, {PARTS}, g AS (SELECT min(n) AS g FROM (SELECT species, count(*) AS n FROM rec WHERE split_part = 'train' GROUP BY 1))
SELECT k, g AS guaranteed, k <= g AS valid, CASE WHEN k > g THEN format('k={{}} exceeds the guaranteed k={{}}', k, g)
 WHEN k IN (1, 5, 10, 20, 50) THEN format('k={{}} is feasible and recommended', k) ELSE format('k={{}} is feasible', k) END AS message
FROM g, (SELECT unnest([1, 3, 5, 20, 40, 50]) AS k)""",
)
def shot_feasibility(t: Tables) -> DataFrame:
    return sp.shot_feasibility(split_images(t), [1, 3, 5, 20, 40, 50], "species")


@query(
    "small_classes",
    "D1",
    f"""WITH {IMG}, {PARTS}, c AS (SELECT individual_id // 2 AS cls, count(*) FILTER (split_part = 'train') AS train_samples,
 count(*) FILTER (split_part = 'val') AS val_samples, count(*) FILTER (split_part = 'test') AS test_samples FROM rec GROUP BY 1)
SELECT cls, train_samples, val_samples, test_samples, train_samples AS max_feasible_k FROM c
WHERE train_samples < (SELECT greatest(5, min(train_samples)) FROM c WHERE train_samples > 0)""",
)
def small_classes(t: Tables) -> DataFrame:
    return sp.small_classes(split_images(t).withColumn("cls", F.expr("individual_id div 2")), "cls")


GRID = f"""{IMG}, s AS (SELECT unnest([42, 7, 2024]) AS seed),
gg AS (SELECT DISTINCT individual_id FROM img),
pos AS (SELECT seed, individual_id, row_number() OVER (PARTITION BY seed ORDER BY md5(concat(seed, ':', individual_id)), individual_id) AS rk,
  count(*) OVER (PARTITION BY seed) AS g FROM gg, s),
cut AS (SELECT *, ceil(0.15::DOUBLE * g) AS n_test FROM pos),
part AS (SELECT seed, individual_id, CASE WHEN rk <= n_test THEN 'test' WHEN rk <= n_test + ceil((0.15::DOUBLE / 0.85::DOUBLE) * (g - n_test)) THEN 'val' ELSE 'train' END AS split_part FROM cut),
rec AS (SELECT * FROM img JOIN part USING (individual_id)),
sr AS (SELECT seed, vec_id, species AS lab, embedding, row_number() OVER (PARTITION BY seed, species ORDER BY md5(concat(seed, ':', vec_id)), vec_id) AS r
  FROM rec WHERE split_part = 'train'),
ks AS (SELECT unnest([1, 5, 10]) AS k),
tl AS (SELECT seed, k, vec_id, lab, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM sr JOIN ks ON r <= k),
mu AS (SELECT seed, k, d, avg(v) AS mu FROM tl GROUP BY ALL),
tc AS (SELECT seed, k, vec_id, lab, d, v - mu AS x FROM tl JOIN mu USING (seed, k, d)),
tn AS (SELECT seed, k, vec_id, greatest(sqrt(sum(x * x)), 1e-12) AS nrm FROM tc GROUP BY ALL),
cen AS (SELECT seed, k, lab, d, avg(x / nrm) AS c FROM tc JOIN tn USING (seed, k, vec_id) GROUP BY ALL),
ql AS (SELECT seed, k, vec_id, species AS truth, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM rec, ks WHERE split_part = 'test'),
qc AS (SELECT seed, k, vec_id, truth, d, v - mu AS x FROM ql JOIN mu USING (seed, k, d)),
qn AS (SELECT seed, k, vec_id, greatest(sqrt(sum(x * x)), 1e-12) AS nrm FROM qc GROUP BY ALL),
qry AS (SELECT seed, k, vec_id, truth, d, x / nrm AS q FROM qc JOIN qn USING (seed, k, vec_id)),
sc AS (SELECT seed, k, vec_id, truth, lab, sqrt(sum((q - c) * (q - c))) AS l2 FROM qry JOIN cen USING (seed, k, d) GROUP BY ALL),
rk2 AS (SELECT *, row_number() OVER (PARTITION BY seed, k, vec_id ORDER BY round(l2, 12), lab) AS pos FROM sc),
runs AS (SELECT seed, k, avg((pos = 1 AND lab = truth)::INT) * count(DISTINCT lab) AS accuracy,
  CASE WHEN count(DISTINCT lab) >= 5 THEN avg((pos <= 5 AND lab = truth)::INT) * count(DISTINCT lab) END AS top5_accuracy, count(DISTINCT vec_id) AS n FROM rk2 GROUP BY ALL)"""


def sweep_runs(t: Tables) -> DataFrame:
    """Accuracy per (seed, k): the whole grid in one job."""
    split = split_images(t, [42, 7, 2024])
    support = sp.support_set(split.where("split_part = 'train'"), 10, "species", "vec_id", F.col("seed"), by="seed")
    ks = F.explode(F.array(F.lit(1), F.lit(5), F.lit(10)))
    support = support.withColumn("k", ks).where("support_pos <= k")
    means, centroids = fs.centered_centroids(support, "species", ["seed", "k"])
    tests = split.where("split_part = 'test'").withColumn("k", ks)
    tests = fs.center(tests, means, ["seed", "k"]).withColumnRenamed("species", "truth")
    ranked = fs.classify(tests, centroids, ["vec_id", "truth"], "species", ["seed", "k"], 5)
    ranked = ranked.join(centroids.groupBy("seed", "k").agg(F.count(F.lit(1)).alias("classes")), ["seed", "k"])
    hit = F.col("rank_value") == F.col("truth")
    return (
        ranked.groupBy("seed", "k", "vec_id")
        .agg(
            F.max((hit & (F.col("rank_position") == 1)).cast("int")).alias("t1"),
            F.max(hit.cast("int")).alias("t5"),
            F.max("classes").alias("classes"),
        )
        .groupBy("seed", "k")
        .agg(F.avg("t1").alias("accuracy"), cm.top_k_share(F.col("t5"), F.col("classes"), 5).alias("top5_accuracy"), F.count(F.lit(1)).alias("n"))
    )


@query(
    "sweep_runs",
    "V13 V14",
    f"WITH {GRID} SELECT seed, k, round(accuracy, 6) AS accuracy, round(top5_accuracy, 6) AS top5_accuracy, n FROM runs",
)
def sweep_run_table(t: Tables) -> DataFrame:
    return sweep_runs(t).select(
        "seed", "k", F.round("accuracy", 6).alias("accuracy"), F.round("top5_accuracy", 6).alias("top5_accuracy"), "n"
    )


@query(
    "sweep_summary",
    "V14 D25 A22",
    f"""WITH {GRID}, a AS (SELECT k, count(*) AS num_seeds, avg(accuracy) AS m, stddev_samp(accuracy) AS sd, min(accuracy) AS lo, max(accuracy) AS hi,
  stddev_pop(accuracy) AS sdp FROM runs GROUP BY k)
SELECT k, num_seeds, round(m, 6) AS accuracy_mean, round(sd, 6) AS accuracy_std, round(4.302653 * sd / sqrt(num_seeds), 5) AS accuracy_ci,
 round(lo, 6) AS accuracy_min, round(hi, 6) AS accuracy_max, round(lead(m) OVER (ORDER BY k) - m, 6) AS gain_to_next FROM a""",
)
def sweep_summary(t: Tables) -> DataFrame:
    from specgrade.operators.reports import learning_curve

    return learning_curve(sweep_runs(t), "k", "accuracy", 6)


@query(
    "accuracy_verdicts",
    "R26",
    f"""WITH {GRID} SELECT seed, k, CASE WHEN accuracy >= CASE WHEN k >= 20 THEN 0.6 WHEN k >= 10 THEN 0.55 WHEN k >= 5 THEN 0.5 ELSE 0.4 END THEN 'excellent'
 WHEN accuracy >= CASE WHEN k >= 20 THEN 0.45 WHEN k >= 10 THEN 0.4 WHEN k >= 5 THEN 0.35 ELSE 0.25 END THEN 'good'
 WHEN accuracy >= CASE WHEN k >= 20 THEN 0.3 WHEN k >= 10 THEN 0.25 WHEN k >= 5 THEN 0.2 ELSE 0.15 END THEN 'moderate' ELSE 'below expectations' END AS assessment,
 round(accuracy * 10, 5) AS times_random,
 CASE WHEN top5_accuracy = 0 THEN 'not available' WHEN top5_accuracy - accuracy > 0.25 THEN 'significant gap' WHEN top5_accuracy - accuracy > 0.15 THEN 'moderate gap' ELSE 'small gap' END AS top5_gap
FROM runs""",
)
def accuracy_verdicts(t: Tables) -> DataFrame:
    from specgrade.operators.reports import accuracy_band, top5_band

    n_classes = images(t).agg(F.countDistinct("species")).scalar()
    return sweep_runs(t).select(
        "seed", "k",
        accuracy_band(F.col("accuracy"), F.col("k")).alias("assessment"),
        F.round(F.col("accuracy") * n_classes, 5).alias("times_random"),
        top5_band(F.col("accuracy"), F.col("top5_accuracy")).alias("top5_gap"),
    )


@query(
    "baseline_gains",
    "D44",
    f"""WITH {GRID}, b AS (SELECT * FROM (VALUES ('zero_shot', 0.08::DOUBLE), ('closed_set', 0.12::DOUBLE)) v(baseline, base)
 UNION ALL SELECT 'random', 1.0 / (SELECT count(DISTINCT label) FROM embeddings))
SELECT seed, k, baseline, round(100 * (accuracy - base) / base, 4) AS gain_percent FROM runs, b WHERE accuracy > base""",
)
def baseline_gains(t: Tables) -> DataFrame:
    from specgrade.operators.reports import baseline_gains as gains

    chance = 1.0 / images(t).agg(F.countDistinct("species")).scalar()
    return gains(sweep_runs(t), {"zero_shot": F.lit(0.08), "closed_set": F.lit(0.12), "random": chance}).select(
        "seed", "k", "baseline", F.round("gain_percent", 4).alias("gain_percent")
    )


@query(
    "embedding_map",
    "D34",
    """WITH e AS (SELECT vec_id, label // 2 AS genus, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
n AS (SELECT genus, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, genus) AS r FROM e GROUP BY genus),
l AS (SELECT x, y, CASE WHEN r <= 3 THEN genus::VARCHAR ELSE 'Other' END AS grp FROM e JOIN n USING (genus))
SELECT grp, count(*) AS n, round(median(x), 6) AS center_x, round(median(y), 6) AS center_y, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y,
 round(var_samp(x), 6) AS var_x, round(var_samp(y), 6) AS var_y, round(covar_samp(x, y), 6) AS cov_xy FROM l GROUP BY grp""",
)
def embedding_map(t: Tables) -> DataFrame:
    from specgrade.operators.reports import map_ellipses

    points = images(t).select(
        "genus", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")
    )
    out = map_ellipses(points, "genus", "x", "y", top=3)
    return out.select(
        "grp", "n", *[F.round(c, 6).alias(c) for c in ("center_x", "center_y", "mean_x", "mean_y", "var_x", "var_y", "cov_xy")]
    )


def _components_sql(steps: int = 13) -> str:
    """CTEs pc1 and pc2 (i, x): the first two eigenvectors of the covariance of ``el`` (vec_id, d, v).

    A matrix squared again and again tends to the projection on its first eigenvector.
    """

    def vector(p: str, start: str) -> str:
        squared = ", ".join(
            f"{p}{n + 1} AS MATERIALIZED (SELECT a.i, b.j, sum(a.x * b.x) AS x FROM {p}{n}n a JOIN {p}{n}n b ON a.j = b.i GROUP BY ALL), "
            f"{p}{n + 1}n AS MATERIALIZED (SELECT i, j, x / (SELECT sum(x) FROM {p}{n + 1} WHERE i = j) AS x FROM {p}{n + 1})"
            for n in range(steps)
        )
        last = f"{p}{steps}n"
        return f"""{p}0n AS MATERIALIZED (SELECT i, j, x / (SELECT sum(x) FROM {start} WHERE i = j) AS x FROM {start}), {squared},
{p} AS MATERIALIZED (SELECT i, x / sqrt(sum(x * x) OVER ()) AS x FROM {last} WHERE j = (SELECT arg_max(i, x) FROM {last} WHERE i = j))"""

    return f"""cov AS MATERIALIZED (SELECT a.d AS i, b.d AS j, covar_samp(a.v, b.v) AS x FROM el a JOIN el b USING (vec_id) GROUP BY ALL),
{vector('pc1', 'cov')}, lam AS (SELECT sum(a.x * cov.x * b.x) AS l FROM cov JOIN pc1 a ON a.i = cov.i JOIN pc1 b ON b.i = cov.j),
rest AS MATERIALIZED (SELECT cov.i, cov.j, cov.x - l * a.x * b.x AS x FROM cov JOIN pc1 a ON a.i = cov.i JOIN pc1 b ON b.i = cov.j CROSS JOIN lam), {vector('pc2', 'rest')}"""


@query(
    "principal_map",
    "D34",
    f"""WITH el AS MATERIALIZED (SELECT vec_id, label // 6 AS family, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings), {_components_sql()},
e AS (SELECT vec_id, family, sum(v * pc1.x) AS x, sum(v * pc2.x) AS y FROM el JOIN pc1 ON pc1.i = d JOIN pc2 ON pc2.i = d GROUP BY ALL)
SELECT family::VARCHAR AS grp, count(*) AS n, round(abs(median(x)), 5) AS center_x, round(abs(median(y)), 5) AS center_y, round(abs(avg(x)), 5) AS mean_x, round(abs(avg(y)), 5) AS mean_y,
 round(var_samp(x), 5) AS var_x, round(var_samp(y), 5) AS var_y, round(abs(covar_samp(x, y)), 5) AS cov_xy FROM e GROUP BY 1""",
)
def principal_map(t: Tables) -> DataFrame:
    """The map of the families in the plane of the principal components; a component has no sign, so no figure has one."""
    from specgrade.operators.reports import map_ellipses, principal_coordinates

    out = map_ellipses(principal_coordinates(images(t), "embedding"), "family", "x", "y", top=10)
    return out.select("grp", "n", *[F.round(F.abs(c), 5).alias(c) for c in ("center_x", "center_y", "mean_x", "mean_y", "var_x", "var_y", "cov_xy")])


@query(
    "partition_map",
    "J12",
    f"""WITH {IMG}, {PARTS} SELECT individual_id, arg_max(split_part, CASE split_part WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) AS split_part
FROM rec GROUP BY 1""",
)
def partition_map(t: Tables) -> DataFrame:
    from specgrade.operators.grading import partition_map as pm

    return pm(split_images(t), "individual_id")


@query(
    "test_individuals",
    "J17",
    f"""WITH {IMG}, {PARTS} SELECT individual_id, family, vec_id AS image, row_number() OVER (PARTITION BY individual_id ORDER BY vec_id) AS image_no,
 count(*) OVER (PARTITION BY individual_id) AS n_images FROM rec WHERE split_part = 'test'""",
)
def test_individuals(t: Tables) -> DataFrame:
    from specgrade.operators.catalog import images_of

    tests = split_images(t).where("split_part = 'test'").select("individual_id", "family", F.col("vec_id").alias("image"))
    return images_of(tests, "individual_id", "image")


@query(
    "rank_label_ids",
    "A5",
    "\nUNION ALL ".join(
        f"""SELECT '{r}' AS rank, l AS label, row_number() OVER (ORDER BY m) - 1 AS label_id FROM
 (SELECT {c} AS l, min(vec_id) AS m FROM embeddings GROUP BY 1)"""
        for r, c in (("family", "label // 6"), ("genus", "label // 2"), ("species", "label"))
    ),
)
def rank_label_ids(t: Tables) -> DataFrame:
    from specgrade.operators.taxonomy import label_ids

    return label_ids(ranks_long(images(t), "vec_id"), "label", "vec_id", by="rank").drop("first_pos")


@query(
    "taxonomy_map",
    "A6",
    f"""WITH {IMG} SELECT 'genus' AS child_rank, genus AS child, 'family' AS parent_rank, arg_max(family, vec_id) AS parent FROM img GROUP BY genus
UNION ALL SELECT 'species', species, 'genus', arg_max(genus, vec_id) FROM img GROUP BY species
UNION ALL SELECT 'species', species, 'family', arg_max(family, vec_id) FROM img GROUP BY species""",
)
def taxonomy_map(t: Tables) -> DataFrame:
    return parent_links(t)


@query(
    "feature_cache_gap",
    "A4",
    """SELECT e.vec_id, e.label FROM embeddings e
WHERE NOT EXISTS (SELECT 1 FROM embeddings c WHERE c.vec_id = e.vec_id AND c.label = e.label AND c.label < 6)""",
)
def feature_cache_gap(t: Tables) -> DataFrame:
    from specgrade.sources.features import missing_features

    cached = t.embeddings.where("label < 6").select("vec_id", "label")
    return missing_features(t.embeddings.select("vec_id", "label"), cached, ["vec_id", "label"])


@query(
    "feature_cache_refresh",
    "A4",
    """SELECT label + CASE WHEN label = 3 THEN 100 ELSE 0 END AS label, count(*) AS n, count(*) FILTER (label = 3) AS n_again,
 round(sum(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))), 1e-12)))), 4) AS total
FROM embeddings GROUP BY 1""",
)
def feature_cache_refresh(t: Tables) -> DataFrame:
    """A cache of all vectors; then one label is renamed, and only its rows are embedded again."""
    from uuid import uuid4

    from specgrade.session import new_path
    from specgrade.sources.features import FeatureCache, validity

    name = f"features_{uuid4().hex}"
    cache = FeatureCache(t.spark, name, new_path(t.spark, name), ("vec_id",), "vec_id bigint, label int, embedding array<double>", 8)
    rows = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    renamed = rows.withColumn("label", F.when(F.col("label") == 3, F.col("label") + 100).otherwise(F.col("label")))
    # The vectors of the table stand for what a model would make of the images.
    model = lambda batches: batches
    key = validity("model-1", True, "label")
    cache.extend(rows.withColumn("validity", key), model)
    now = renamed.withColumn("validity", key)
    again = cache.missing(now).select("vec_id", F.lit(1).alias("again"))
    counted = t.once("again", lambda: again)
    cache.extend(now, model)
    found = cache.lookup(now.select("vec_id", "label", "validity")).join(counted, "vec_id", "left")
    return found.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count("again").alias("n_again"),
        F.round(F.sum(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)), 4).alias("total"),
    )


@query(
    "image_predictions",
    "V8",
    f"""WITH {IMG}, {PARTS}, {FIT.format(label='species')}, {CENTER_IMAGES.format(part='test')}, {SCORES}
SELECT rk.qid AS vec_id, rec.individual_id, lab AS predicted FROM rk JOIN rec ON rec.vec_id = rk.qid WHERE pos = 1""",
)
def image_predictions(t: Tables) -> DataFrame:
    """The best class of each test image by itself."""
    means, centroids = fs.centered_centroids(train(t), "species")
    tests = fs.center(split_images(t).where("split_part = 'test'"), means)
    return fs.classify(tests, centroids, ["vec_id", "individual_id"], "species", top_k=1).select("vec_id", "individual_id", F.col("rank_value").alias("predicted"))


@query(
    "split_round_trip",
    "A7",
    f"""WITH {IMG}, {PARTS} SELECT split_part, species, count(*) AS n FROM rec GROUP BY ALL""",
)
def split_round_trip(t: Tables) -> DataFrame:
    from specgrade.session import new_path
    from specgrade.sources.features import load_split, save_split

    path = new_path(t.spark, "split")
    save_split(split_images(t, [SEED]).select("vec_id", "species", "split_part", "seed"), path, "species")
    return load_split(t.spark, path).groupBy("split_part", "species").agg(F.count(F.lit(1)).alias("n"))


@query(
    "evaluation_summary",
    "D5",
    f"""WITH {IMG}, {PARTS}, {FIT.format(label='species')}, {CENTER_IMAGES.format(part='test')}, {SCORES},
pr AS (SELECT rec.species AS a, rk.lab AS b FROM rk JOIN rec ON rec.vec_id = qid WHERE pos = 1),
lab AS (SELECT a AS l FROM pr UNION SELECT b FROM pr),
c AS (SELECT l, (SELECT count(*) FROM pr WHERE a = l) AS nt, (SELECT count(*) FROM pr WHERE b = l) AS np, (SELECT count(*) FROM pr WHERE a = l AND b = l) AS nb FROM lab),
m AS (SELECT *, coalesce(nb / nullif(np, 0), 0) AS p, coalesce(nb / nullif(nt, 0), 0) AS r, coalesce(2 * nb / nullif(np + nt, 0), 0) AS f FROM c)
SELECT round(sum(nb) / sum(nt), 6) AS accuracy, round(avg(f), 6) AS macro_f1, round(2 * sum(nb) / (sum(nt) + sum(np)), 6) AS micro_f1,
 round(sum(f * nt) / sum(nt), 6) AS weighted_f1, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall,
 sum(nt)::BIGINT AS num_samples, count(*) AS num_classes FROM m""",
)
def evaluation_summary(t: Tables) -> DataFrame:
    out = cm.summary(_test_predictions(t), "species", "rank_value")
    return out.select(
        *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "micro_f1", "weighted_f1", "macro_precision", "macro_recall")],
        "num_samples", "num_classes",
    )


def _test_predictions(t: Tables) -> DataFrame:
    means, centroids = fs.centered_centroids(train(t), "species")
    tests = fs.center(split_images(t).where("split_part = 'test'"), means)
    model = centroids.withColumnRenamed("species", "label")
    return fs.classify(tests, model, ["vec_id", "species"], "label", top_k=1)


@query(
    "support_correlation",
    "D32 R26",
    f"""WITH {IMG}, {PARTS}, {FIT.format(label='species')}, {CENTER_IMAGES.format(part='test')}, {SCORES},
pr AS (SELECT rec.species AS a, rk.lab AS b FROM rk JOIN rec ON rec.vec_id = qid WHERE pos = 1),
lab AS (SELECT a AS l FROM pr UNION SELECT b FROM pr),
c AS (SELECT l, (SELECT count(*) FROM pr WHERE a = l) AS nt, (SELECT count(*) FROM pr WHERE b = l) AS np, (SELECT count(*) FROM pr WHERE a = l AND b = l) AS nb FROM lab),
k AS (SELECT corr(nt, coalesce(2 * nb / nullif(np + nt, 0), 0)) AS r FROM c)
SELECT round(r, 5) AS correlation, CASE WHEN r > 0.3 THEN 'positive correlation' WHEN r > 0.1 THEN 'weak positive correlation'
 WHEN r > -0.1 THEN 'no correlation' ELSE 'weak negative correlation' END AS verdict FROM k""",
)
def support_correlation(t: Tables) -> DataFrame:
    from specgrade.operators.reports import support_correlation as corr

    out = corr(cm.per_class(_test_predictions(t), "species", "rank_value"))
    return out.withColumn("correlation", F.round("correlation", 5))
