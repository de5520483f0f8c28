"""Catalog building, id resolution and quality control.

Customers are specimens with a taxonomy (region, nation, segment); orders are observations and
their lines the photo files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from specgrade.functions import fixed_values as fv
from specgrade.functions.text import after_segment, format_label, last_token, literal_map, normalize_taxon, option_column, slug, version_of
from specgrade.operators import catalog as ct, reports, splitting as sp, taxonomy as tx
from specgrade.plans.registry import Tables, query
from specgrade.sources.tables import photo_number

CAT = """cat AS (SELECT c_custkey, c_name, r_name AS family, n_name AS genus, c_mktsegment AS species
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def catalog(t: Tables) -> DataFrame:
    return (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("ID_YPS"), "c_name",
            F.col("r_name").alias("FAMILY"), F.col("n_name").alias("GENUS"), F.col("c_mktsegment").alias("SPECIES"),
        )
    )


@query(
    "catalog_rows",
    "A1",
    f"WITH {CAT} SELECT c_custkey AS individual_id, family, genus, species, '/img/' || c_custkey AS training_absolute_path FROM cat",
)
def catalog_rows(t: Tables) -> DataFrame:
    from specgrade.functions.columns import require_columns

    rows = catalog(t).withColumn("training_absolute_path", F.concat(F.lit("/img/"), "ID_YPS"))
    return require_columns(rows, ct.CATALOG_COLUMNS, "catalog").select(
        F.col("ID_YPS").alias("individual_id"), F.col("FAMILY").alias("family"), F.col("GENUS").alias("genus"),
        F.col("SPECIES").alias("species"), "training_absolute_path",
    )


@query(
    "image_records",
    "A2",
    f"""WITH {CAT}, f AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN '.JPG' WHEN 'O' THEN '.png' ELSE '.txt' END AS suffix FROM orders),
l AS (SELECT replace(genus, '_', ' ') || ' ' || lower(species) AS label, min(c_custkey) AS m FROM cat WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1),
ids AS (SELECT label, row_number() OVER (ORDER BY m) - 1 AS label_id FROM l)
SELECT '/img/' || o_custkey || '/p_' || o_orderkey || suffix AS image_path, family, replace(genus, '_', ' ') AS genus, ids.label, ids.label_id, o_custkey::VARCHAR AS individual_id
FROM f JOIN cat ON o_custkey = c_custkey JOIN ids ON ids.label = replace(genus, '_', ' ') || ' ' || lower(species) WHERE suffix <> '.txt'""",
)
def image_records(t: Tables) -> DataFrame:
    suffix = F.when(F.col("o_orderstatus") == "F", ".JPG").when(F.col("o_orderstatus") == "O", ".png").otherwise(".txt")
    folder = F.concat(F.lit("/img/"), "o_custkey")
    files = t.orders.select(folder.alias("directory"), F.concat(folder, F.lit("/p_"), "o_orderkey", suffix).alias("path"))
    rows = catalog(t).withColumn("training_absolute_path", F.concat(F.lit("/img/"), "ID_YPS"))
    return ct.expand_images(rows, files, "species").select("image_path", "family", "genus", "label", "label_id", "individual_id")


@query(
    "missing_directories",
    "A2",
    "SELECT c_custkey AS individual_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey - o_custkey % 3 FROM orders)",
)
def missing_directories(t: Tables) -> DataFrame:
    files = t.orders.select(F.concat(F.lit("/img/"), F.col("o_custkey") - F.col("o_custkey") % 3).alias("directory"))
    rows = catalog(t).withColumn("training_absolute_path", F.concat(F.lit("/img/"), "ID_YPS"))
    return ct.missing_directories(rows, files).select(F.col("ID_YPS").alias("individual_id"))


@query(
    "requested_ids",
    "A13",
    "SELECT o_custkey::VARCHAR AS specimen_id, min(o_orderkey) AS first_pos FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
)
def requested_ids(t: Tables) -> DataFrame:
    line = F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.concat(F.lit(" "), "o_custkey", F.lit(" , x")))
    return ct.first_seen_ids(t.orders.select(line.alias("line"), "o_orderkey"), "line", "o_orderkey").select(
        "specimen_id", F.col("first_pos")
    )


@query(
    "taxon_labels",
    "R1",
    """SELECT p_partkey, trim(replace(' ' || p_name || '_', '_', ' ')) AS family, p_brand AS genus, trim(p_brand || ' ' || lower(replace(p_type || '_X', '_', ' '))) AS species FROM part""",
)
def taxon_labels(t: Tables) -> DataFrame:
    f, g, s = F.concat(F.lit(" "), "p_name", F.lit("_")), F.concat("p_brand", F.lit("_")), F.concat("p_type", F.lit("_X"))
    return t.part.select("p_partkey", *[format_label(f, g, s, r).alias(r) for r in fv.RANKS])


@query(
    "normalized_taxa",
    "R2",
    """WITH n AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '  ' WHEN p_size % 3 = 0 THEN p_name || '  (cf.)' ELSE p_name END AS name FROM part),
s AS (SELECT p_partkey, trim(name) AS s0, regexp_replace(trim(name), '[^a-zA-Z0-9\\s_-]', '_', 'g') AS s1 FROM n),
u AS (SELECT *, regexp_replace(replace(s1, ' ', '_'), '_+', '_', 'g') AS s3, replace(s1, ' ', '_') AS s2 FROM s)
SELECT p_partkey, CASE WHEN s0 = '' THEN 'Unknown_Genus' ELSE list_aggregate(list_transform(string_split(s3, '_'), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', '_') END AS genus,
 CASE WHEN s0 = '' THEN 'missing_value' ELSE concat_ws(',', CASE WHEN s1 <> s0 THEN 'special_characters' END, CASE WHEN s1 LIKE '% %' THEN 'spaces_to_underscores' END,
  CASE WHEN contains(s2, '__') THEN 'multiple_underscores' END, 'capitalization') END AS genus_actions,
 CASE WHEN s0 = '' THEN 'unknown_species' ELSE lower(s3) END AS species FROM u""",
)
def normalized_taxa(t: Tables) -> DataFrame:
    name = F.when(F.col("p_size") % 10 == 0, "  ").when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit("  (cf.)"))).otherwise(F.col("p_name"))
    rows = t.part.select("p_partkey", normalize_taxon(name, "genus").alias("g"), normalize_taxon(name, "species").alias("s"))
    return rows.select(
        "p_partkey", F.col("g.normalized").alias("genus"), F.array_join("g.actions.reason", ",").alias("genus_actions"),
        F.col("s.normalized").alias("species"),
    )


@query(
    "slugs",
    "R16",
    """SELECT p_partkey, trim(regexp_replace(lower(trim(p_brand || ' - ' || p_type || '!')), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
 trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') || '__' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS column_name FROM part""",
)
def slugs(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", slug(F.concat_ws("", "p_brand", F.lit(" - "), "p_type", F.lit("!"))).alias("slug"),
        option_column(F.col("p_brand"), F.col("p_name")).alias("column_name"),
    )


@query(
    "path_parts",
    "R17 A21",
    """SELECT page_id, nullif(split_part(split_part(url, '://', 2), '/', 2), '') AS lang, regexp_extract(url, '([^/_]*)$', 1) AS tail,
 CASE WHEN page_id % 2 = 0 THEN '2026-01-29_v2026-01-29_' || page_id || 'K' END AS version, CASE WHEN page_id % 3 = 0 THEN page_id END AS photo_id FROM pages""",
)
def path_parts(t: Tables) -> DataFrame:
    host = F.split(F.split("url", "://")[1], "/")[0]
    file = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("catalog_v2026-01-29_"), "page_id", F.lit("K.csv"))).otherwise(F.lit("catalog.csv"))
    photo = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/u/photo_"), "page_id", F.lit(".jpg"))).otherwise(F.lit("/u/photo.jpg"))
    tail = last_token(F.substring_index("url", "/", -1))
    return t.pages.select("page_id", "url", host.alias("host"), file.alias("file"), photo.alias("photo"), tail.alias("tail")).select(
        "page_id",
        F.expr("nullif(try_element_at(split(url, '/'), cast(array_position(split(url, '/'), host) + 1 as int)), '')").alias("lang"),
        "tail", version_of(F.col("file")).alias("version"), photo_number(F.col("photo")).alias("photo_id"),
    )


@query(
    "path_taxonomy",
    "R17",
    f"""WITH {CAT} SELECT c_custkey, genus AS genus, CASE WHEN c_custkey % 5 <> 0 THEN lower(species) END AS epithet FROM cat""",
)
def path_taxonomy(t: Tables) -> DataFrame:
    end = F.when(F.col("ID_YPS") % 5 != 0, F.concat(F.lit("/by_species/"), F.lower("SPECIES"))).otherwise("")
    path = F.concat(F.lit("/d/by_family/"), "FAMILY", F.lit("/by_genus/"), "GENUS", end)
    return catalog(t).select(
        F.col("ID_YPS").alias("c_custkey"), after_segment(path, "by_genus").alias("genus"), after_segment(path, "by_species").alias("epithet")
    )


@query(
    "file_checks",
    "R19",
    """WITH f AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'N') AS j, count(*) FILTER (l_returnflag = 'N') AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey, n AS n_files, j AS n_jpg, s AS n_json, CASE WHEN n = 13 AND j = 6 AND s = 7 THEN 'complete' WHEN n = 11 AND j = 5 AND s = 6 THEN 'incomplete_set'
 ELSE 'unexpected_file_count' END AS status FROM f""",
)
def file_checks(t: Tables) -> DataFrame:
    files = t.lineitem.select("l_orderkey", F.when(F.col("l_returnflag") == "N", "json").otherwise("jpg").alias("suffix"))
    return ct.file_check(files, "l_orderkey", "suffix")


@query(
    "image_sizes",
    "R19",
    """SELECT l_returnflag, count(*) FILTER (l_extendedprice * 200 BETWEEN 102400 AND 10485760) AS n_valid, count(*) AS n FROM lineitem GROUP BY 1""",
)
def image_sizes(t: Tables) -> DataFrame:
    ok = ct.valid_image(F.col("l_extendedprice") * 200)
    return t.lineitem.groupBy("l_returnflag").agg(F.count(F.when(ok, 1)).alias("n_valid"), F.count(F.lit(1)).alias("n"))


@query(
    "habit_flags",
    "R20",
    "SELECT l_linestatus, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS liana, 'Unknown' AS forest, count(*) AS n FROM lineitem GROUP BY 1",
)
def habit_flags(t: Tables) -> DataFrame:
    habit = F.when(F.col("l_linestatus") == "O", "Climbing").otherwise("Shrubby")
    flag = F.coalesce(literal_map(fv.HABIT_FLAG)[habit], F.lit(0))
    return t.lineitem.groupBy("l_linestatus", flag.alias("liana"), F.lit("Unknown").alias("forest")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "delivery_checks",
    "R27",
    """SELECT o_custkey, count(*) AS n_images, count(*) + 4 AS n_delivered, count(*) + 4 > 15 AS over_budget FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1""",
)
def delivery_checks(t: Tables) -> DataFrame:
    images = t.orders.select("o_custkey", F.col("o_orderkey").alias("image"))
    return ct.delivery_check(images, t.lineitem.select(F.col("l_orderkey").alias("image")), "o_custkey", "image", 4, 15)


BRIDGE = """acc AS (SELECT lower(p_name) AS accepted, min(p_partkey) AS k FROM part GROUP BY 1),
br AS (SELECT accepted, unnest([lower(p_brand), 'x ' || lower(p_type), lower(p_type)]) AS synonym, unnest(['synonym', 'synonym', 'final_name']) AS method, unnest([1, 2, 3]) AS priority
 FROM acc JOIN part ON p_partkey = k)"""


def bridge(t: Tables) -> DataFrame:
    rows = t.part.select(
        F.concat(F.lit(" "), F.initcap("p_name")).alias("accepted_name"),
        F.concat_ws(", ", "p_brand", F.concat(F.lit("X "), "p_type"), "p_name").alias("synonyms"), F.col("p_type").alias("final_name"), "p_partkey",
    )
    return tx.synonym_bridge(rows, "accepted_name", "synonyms", "final_name", "p_partkey")


@query(
    "synonym_bridge",
    "J2",
    f"WITH {BRIDGE} SELECT accepted, synonym, method AS match_method, priority FROM br",
)
def synonym_bridge(t: Tables) -> DataFrame:
    return bridge(t)


MATCHED = f"""{BRIDGE}, ref AS (SELECT DISTINCT lower(p_name) AS n FROM part WHERE p_size > 48 UNION SELECT lower(p_brand) FROM part WHERE p_size = 1 UNION SELECT lower(p_type) FROM part WHERE p_type = 'PROMO'),
cand AS (SELECT accepted, accepted AS c, 'direct' AS method, 0 AS priority FROM acc UNION ALL SELECT accepted, synonym, method, priority FROM br),
hit AS (SELECT accepted, arg_min(c, priority) AS matched_name, arg_min(method, priority) AS match_method FROM cand JOIN ref ON n = c GROUP BY 1)"""


def reference_names(t: Tables) -> DataFrame:
    p = t.part
    return (
        p.where("p_size > 48").select(F.upper("p_name").alias("name"))
        .union(p.where("p_size = 1").select("p_brand"))
        .union(p.where("p_type = 'PROMO'").select("p_type"))
    )


@query(
    "synonym_matches",
    "J2",
    f"WITH {MATCHED} SELECT p_partkey, matched_name, match_method FROM part LEFT JOIN hit ON accepted = lower(p_name)",
)
def synonym_matches(t: Tables) -> DataFrame:
    wanted = t.part.select("p_partkey", "p_name")
    return tx.match_names(wanted, "p_name", reference_names(t), "name", bridge(t)).select("p_partkey", "matched_name", "match_method")


@query(
    "overlap_specimens",
    "J3",
    f"""WITH {MATCHED}, s AS (SELECT l_suppkey AS specimen_id, arg_min(l_partkey, (l_orderkey, l_linenumber, l_partkey)) AS k, count(*) AS n_images FROM lineitem GROUP BY 1)
SELECT specimen_id, p_name AS scientific_name, matched_name, match_method, n_images FROM s JOIN part ON p_partkey = k JOIN hit ON accepted = lower(p_name)""",
)
def overlap_specimens(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("specimen_id"), F.col("p_name").alias("scientific_name"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("pos"),
    )
    images = t.lineitem.select(F.col("l_suppkey").alias("specimen_id"))
    out = ct.overlap_specimens(rows, images, reference_names(t), "name", bridge(t), "specimen_id", "pos")
    return out.select("specimen_id", "scientific_name", "matched_name", "match_method", "n_images")


@query(
    "specimens_by_id",
    "J4",
    """WITH w AS (SELECT o_custkey + 700 AS id, min(o_orderkey) AS first_pos FROM orders GROUP BY 1)
SELECT id AS specimen_id, first_pos, c_name, c_custkey IS NOT NULL AS found FROM w LEFT JOIN customer ON c_custkey = id""",
)
def specimens_by_id(t: Tables) -> DataFrame:
    wanted = t.orders.groupBy((F.col("o_custkey") + 700).alias("specimen_id")).agg(F.min("o_orderkey").alias("first_pos"))
    return ct.specimens_by_id(wanted, t.customer.select(F.col("c_custkey").alias("specimen_id"), "c_name"), "specimen_id")


@query(
    "resolved_ids",
    "J5",
    """WITH a AS (SELECT alias, arg_max(target, (isid, p, step)) AS target FROM (
 SELECT lower(c_name) AS alias, c_name AS target, 1 AS isid, c_custkey AS p, 0 AS step FROM customer
 UNION ALL SELECT lower(c_mktsegment), c_name, 0, -c_custkey, 2 FROM customer) GROUP BY alias),
o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ' ' || upper(c_name) || ' ' WHEN 'O' THEN 'BUILD-ING.' || '' ELSE replace(c_name, '#', '-#') END AS observed
 FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, coalesce(e.target, c.target) AS target, CASE WHEN e.target IS NOT NULL THEN 'exact' WHEN c.target IS NOT NULL THEN 'punctuation' ELSE 'none' END AS match
FROM o LEFT JOIN a e ON e.alias = lower(trim(observed)) LEFT JOIN a c ON c.alias = regexp_replace(lower(trim(observed)), '[._-]', '', 'g')""",
)
def resolved_ids(t: Tables) -> DataFrame:
    aliases = tx.id_aliases(t.customer, "c_name", "c_mktsegment", "c_custkey")
    observed = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), F.upper("c_name"), F.lit(" ")))
        .when(F.col("o_orderstatus") == "O", "BUILD-ING.")
        .otherwise(F.replace("c_name", F.lit("#"), F.lit("-#")))
    )
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", observed.alias("observed"))
    return tx.resolve_ids(rows, "observed", aliases).select("o_orderkey", "target", "match")


PHOTOS = """ph AS (SELECT l_orderkey, (l_linenumber::BIGINT * 10000000 + l_partkey) * 100000 + l_suppkey AS pos, CASE WHEN l_tax < 0.01 THEN NULL ELSE l_returnflag END AS family,
 l_linestatus AS genus, l_quantity > 25 AS climb FROM lineitem)"""


def photo_rows(t: Tables) -> DataFrame:
    from specgrade.plans.agreement import POS

    return t.lineitem.select(
        "l_orderkey", F.expr(POS).alias("pos"), F.when(F.col("l_tax") >= 0.01, F.col("l_returnflag")).alias("family"),
        F.col("l_linestatus").alias("genus"), F.when(F.col("l_quantity") > 25, "Climbing").otherwise("Freestanding").alias("habit"),
    )


@query(
    "individuals",
    "D29",
    f"""WITH {PHOTOS} SELECT l_orderkey, arg_min(family, pos) AS family, arg_min(genus, pos) AS genus, arg_min(climb, pos)::INT AS "LIANA", 'Unknown' AS "FOREST"
FROM ph WHERE family IS NOT NULL GROUP BY 1""",
)
def individuals(t: Tables) -> DataFrame:
    out = ct.individuals_from_photos(photo_rows(t), "l_orderkey", "pos", ["family", "genus"], "habit")
    return out.select("l_orderkey", "family", "genus", "LIANA", "FOREST")


@query(
    "inconsistent_individuals",
    "D29",
    f"WITH {PHOTOS} SELECT l_orderkey FROM ph WHERE family IS NOT NULL GROUP BY 1 HAVING count(DISTINCT family) > 1 OR count(DISTINCT genus) > 1",
)
def inconsistent_individuals(t: Tables) -> DataFrame:
    return ct.inconsistent_individuals(photo_rows(t), "l_orderkey", ["family", "genus"])


@query(
    "image_roles",
    "W6",
    """WITH p AS (SELECT l_suppkey AS individual_id, l_orderkey AS observation, (l_linenumber::BIGINT * 10000000 + l_partkey) * 100000 + l_suppkey AS photo, l_tax > 0.01 AS ok, l_discount, l_extendedprice FROM lineitem),
i AS (SELECT *, row_number() OVER (PARTITION BY observation ORDER BY photo, l_extendedprice, l_discount) AS photo_no, count(*) OVER (PARTITION BY observation) AS n_photos FROM p),
r AS (SELECT *, CASE WHEN NOT ok THEN 'invalid' WHEN photo_no = CASE WHEN observation % 2 = 0 THEN 1 ELSE n_photos END THEN 'verification' ELSE 'training' END AS role FROM i)
SELECT individual_id, observation, photo, photo_no, role, CASE WHEN role = 'training' THEN row_number() OVER (PARTITION BY individual_id, role ORDER BY observation, photo_no) END AS training_no FROM r""",
)
def image_roles(t: Tables) -> DataFrame:
    from specgrade.plans.agreement import POS

    photos = t.lineitem.select(
        F.col("l_suppkey").alias("individual_id"), F.col("l_orderkey").alias("observation"), F.expr(POS).alias("photo"), "l_tax"
    )
    out = ct.image_roles(photos, "individual_id", "observation", "photo", F.col("observation") % 2 == 0, F.col("l_tax") > 0.01)
    return out.select("individual_id", "observation", "photo", "photo_no", "role", "training_no")


@query(
    "order_shard",
    "W7",
    """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE (r - 1) % 12 = 3 ORDER BY o_orderkey LIMIT 500""",
)
def order_shard(t: Tables) -> DataFrame:
    return sp.shard(t.orders.select("o_orderkey"), "o_orderkey", 3, 12, 500)


OBS = """ob AS (SELECT o_orderkey, o_totalprice > 5000 AS has_metadata, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN ' ' ELSE 'x' END AS individual_id, o_custkey % 7 <> 0 AS has_taxonomy,
 count(l_orderkey) AS n_photos, count(*) FILTER (l_tax < 0.01) AS n_bad,
 CASE WHEN count(l_orderkey) = 5 THEN 'incomplete_set' WHEN count(l_orderkey) = 4 THEN 'complete' ELSE 'unexpected_file_count' END AS status
 FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
iss AS (SELECT o_orderkey, u.s AS severity, u.t AS issue_type, u.p AS can_process FROM (SELECT o_orderkey, unnest([
 CASE WHEN status = 'incomplete_set' THEN {'s': 'INFO', 't': 'INCOMPLETE_SET', 'p': true} END,
 CASE WHEN status = 'unexpected_file_count' THEN {'s': 'WARNING', 't': 'UNEXPECTED_FILE_COUNT', 'p': true} END,
 CASE WHEN NOT has_metadata THEN {'s': 'ERROR', 't': 'NO_METADATA', 'p': false} WHEN individual_id = ' ' THEN {'s': 'ERROR', 't': 'NO_ID', 'p': false}
  WHEN NOT has_taxonomy THEN {'s': 'ERROR', 't': 'MISSING_TAXONOMY', 'p': false} WHEN n_photos = 0 THEN {'s': 'ERROR', 't': 'NO_IMAGES', 'p': false}
  WHEN n_photos < 4 THEN {'s': 'WARNING', 't': 'INSUFFICIENT_IMAGES', 'p': false} WHEN n_bad > 0 THEN {'s': 'WARNING', 't': 'CORRUPTED_IMAGE', 'p': true} END]) AS u FROM ob) WHERE u IS NOT NULL)"""


def observations(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_tax") < 0.01, 1)).alias("bad")
    )
    n = F.coalesce("n", F.lit(0))
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", "o_custkey",
        (F.col("o_totalprice") > 5000).alias("has_metadata"),
        F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "F"), " ").otherwise("x").alias("individual_id"),
        (F.col("o_custkey") % 7 != 0).alias("has_taxonomy"),
        n.alias("n_photos"), F.coalesce("bad", F.lit(0)).alias("n_bad"),
        F.when(n == 5, "incomplete_set").when(n == 4, "complete").otherwise("unexpected_file_count").alias("status"),
    )


@query("observation_issues", "D30", f"WITH {OBS} SELECT o_orderkey, severity, issue_type, can_process FROM iss")
def observation_issues(t: Tables) -> DataFrame:
    return ct.observation_issues(observations(t), "o_orderkey").drop("action_needed")


@query(
    "issue_summary",
    "D30",
    f"WITH {OBS} SELECT severity, issue_type, count(*) AS n_issues, count(*) FILTER (can_process) AS n_usable FROM iss GROUP BY ALL",
)
def issue_summary(t: Tables) -> DataFrame:
    return ct.issue_summary(ct.observation_issues(observations(t), "o_orderkey")).drop("action_needed")


@query(
    "individual_catalog",
    "D31",
    f"""WITH {CAT}, o AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1),
n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT c_custkey, k AS observation, family, genus, species, 'by_family/' || family || '/by_genus/' || genus || '/by_species/' || species || '/' || c_custkey AS training_path,
 coalesce(n, 0) - 1 AS training_image_count, coalesce(n, 0) AS total_image_count, coalesce(n, 0) - 1 >= 3 AS has_minimum_images
FROM o JOIN cat ON o_custkey = c_custkey LEFT JOIN n ON l_orderkey = k""",
)
def individual_catalog(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = (
        t.orders.join(catalog(t), F.col("o_custkey") == F.col("ID_YPS"))
        .join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("ID_YPS").alias("c_custkey"), F.col("o_orderkey").alias("observation"), F.col("FAMILY").alias("family"),
            F.col("GENUS").alias("genus"), F.col("SPECIES").alias("species"), F.coalesce("n", F.lit(0)).alias("n_images"), "o_orderdate",
        )
    )
    out = ct.individual_catalog(rows, "c_custkey", F.struct("o_orderdate", "observation"), ["family", "genus", "species"])
    return out.orderBy("family", "genus", "species", "c_custkey").select(
        "c_custkey", "observation", "family", "genus", "species", "training_path", "training_image_count", "total_image_count", "has_minimum_images"
    )


@query(
    "family_sizes",
    "D33",
    f"""WITH {CAT}, s AS (SELECT genus, count(*) AS n_images, count(DISTINCT o_custkey) AS n_individuals FROM orders JOIN cat ON o_custkey = c_custkey GROUP BY 1)
SELECT genus, n_images, n_individuals, row_number() OVER (ORDER BY n_images DESC, genus) <= 10 AS is_top FROM s""",
)
def family_sizes(t: Tables) -> DataFrame:
    rows = t.orders.join(catalog(t), F.col("o_custkey") == F.col("ID_YPS")).select(F.col("GENUS").alias("genus"), "o_custkey")
    return reports.group_sizes(rows, "genus", "o_custkey", 10)


@query(
    "transfer_summary",
    "D43",
    """SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
 round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate FROM events""",
)
def transfer_summary(t: Tables) -> DataFrame:
    manifest = t.events.select(F.when(F.col("event_type") != "error", "success").otherwise("failed").alias("status"))
    return ct.transfer_summary(manifest, "status").withColumn("success_rate", F.round("success_rate", 6))


@query(
    "failed_transfers",
    "D43",
    "SELECT user_id, count(*) AS n_failed FROM events WHERE event_type = 'error' GROUP BY 1",
)
def failed_transfers(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_failed"))
