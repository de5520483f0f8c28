"""Readers with explicit schemas and the named result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from specgrade.functions import fixed_values as fv
from specgrade.functions.columns import not_blank, require_columns
from specgrade.operators.canon import header_traits
from specgrade.operators.catalog import CATALOG_COLUMNS
from specgrade.operators.conditions import RESULT_SCHEMA
from specgrade.operators.matrix import unpivot_matrix

ANSWER_SCHEMA = "answers map<string,string>, processed_results map<string,struct<answer:string>>"


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with header; all columns are text unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.csv(path, schema=schema) if schema else reader.csv(path)


def with_pos(df: DataFrame) -> DataFrame:
    """Position of a row in its file, where no column gives an order.

    Within one file the generated id grows along the file, which is all that first-seen rules
    need. It is not a dense number.
    """
    return df.withColumn("pos", F.monotonically_increasing_id())


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return with_pos(require_columns(csv(spark, path), CATALOG_COLUMNS, "catalog"))


def read_image_listing(spark: SparkSession, root: str) -> DataFrame:
    """(directory, path, length) of the files below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    path = F.regexp_replace("path", "^file:/+", "/")
    return files.select(F.regexp_replace(path, "/[^/]*$", "").alias("directory"), path.alias("path"), "length")


def photo_number(path: Column) -> Column:
    """Photo id of ``name_<id>.jpg``; null for other names."""
    found = F.regexp_extract(path, r"[^/_]*_(\d+)\.jpg$", 1)
    return F.when(found != "", found.cast("long"))


def read_observations(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Observation metadata documents with user and observation taken from the path."""
    docs = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/*/observation_metadata.json")
    parts = F.split(F.input_file_name(), "/")
    return docs.withColumn("username", F.element_at(parts, -3)).withColumn("observation_id", F.element_at(parts, -2))


def read_results(spark: SparkSession, folder: str, schema: str = RESULT_SCHEMA, multiline: bool = True) -> DataFrame:
    """One row per result document; metadata files and unreadable documents are left out.

    ``multiline`` reads one document per file; without it, one document per line.
    """
    raw = (
        spark.read.schema(f"{schema}, _corrupt string")
        .option("multiLine", multiline)
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(folder)
    )
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    named = raw.withColumn("_file", name).where("_file <> 'run_metadata'").where("_corrupt is null")
    return named.withColumn("specimen_id", F.coalesce("specimen_id", "_file")).drop("_corrupt", "_file")


def read_condition_results(spark: SparkSession, root: str, schema: str = RESULT_SCHEMA, multiline: bool = True) -> DataFrame:
    """Results of all conditions; the condition is the suffix of ``condition_<name>`` folders."""
    condition = F.regexp_extract(F.input_file_name(), r"/condition_([^/]+)/", 1)
    return read_results(spark, f"{root}/condition_*", schema, multiline).withColumn("condition", condition)


def read_run_metadata(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(f"{folder}/run_metadata.json")


def read_ground_truth(spark: SparkSession, path: str, traits: list[str], key: str = "specimen_key") -> DataFrame:
    from specgrade.operators.grading import unpivot_truth

    return unpivot_truth(csv(spark, path), key, traits)


def read_predictions(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Predictions in the ``multi`` and ``single`` layouts, and the old one-file layout.

    (specimen_key, image, trait map, layout); of several folders the later wins per specimen
    and image.
    """
    tagged = None
    for i, folder in enumerate(folders):
        docs = (
            spark.read.schema("specimen_key string, traits map<string,string>")
            .option("multiLine", True)
            .option("recursiveFileLookup", True)
            .json(folder)
        )
        path = F.input_file_name()
        single = F.regexp_extract(path, r"/single/([^/]+)/([^/]+)\.json$", 1)
        rows = docs.select(
            F.coalesce("specimen_key", F.when(single != "", single), F.regexp_extract(path, r"([^/]+)\.json$", 1)).alias("specimen_key"),
            F.when(single != "", F.regexp_extract(path, r"/single/([^/]+)/([^/]+)\.json$", 2)).alias("image"),
            "traits",
            F.lit(i).alias("_source"),
        ).where("traits is not null")
        tagged = rows if tagged is None else tagged.unionByName(rows)
    return tagged.groupBy("specimen_key", "image").agg(F.max_by("traits", "_source").alias("traits"))


def read_old_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Old layout: one file with a specimen -> answer map, returned as (answer_key, answer)."""
    docs = spark.read.schema(ANSWER_SCHEMA).option("multiLine", True).json(path)
    return docs.select(F.explode("answers").alias("answer_key", "answer"))


def read_answers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_idx, answers, processed) of answer files, in the given order."""
    out = None
    for i, path in enumerate(paths):
        doc = spark.read.schema(ANSWER_SCHEMA).option("multiLine", True).json(path)
        rows = doc.select(F.lit(i).alias("source_idx"), "answers", F.col("processed_results").alias("processed"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_matrices(spark: SparkSession, files: dict[str, str], key: str = "scientific_name") -> DataFrame:
    """Long matrix of several sources (slug -> file); names lower-case, blank names dropped."""
    out = None
    for slug, path in sorted(files.items()):
        wide = csv(spark, path).withColumn(key, F.lower(F.trim(key))).where(not_blank(F.col(key)) & (F.col(key) != "nan"))
        long = unpivot_matrix(wide, key, slug)
        out = long if out is None else out.unionByName(long)
    return out


def matrix_suffix(columns: list[str]) -> str:
    """``__consensus`` when the matrix is a merged one, else empty."""
    return "__consensus" if any(c.endswith("__consensus") for c in columns) else ""


def source_label(path: Column) -> Column:
    """Short label of a matrix file: merged, its ``cl<number>`` part, else the stem cut to 20."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    number = F.regexp_extract(F.lower(stem), r"(?:^|_)(cl\d+)(?:_|$)", 1)
    return (
        F.when(F.lower(stem).contains("merged"), "merged")
        .when(number != "", number)
        .otherwise(F.substring(stem, 1, 20))
    )


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    from specgrade.operators.identification import corrections_table

    return corrections_table(with_pos(csv(spark, path)), "pos")


def read_curator_key(spark: SparkSession, path: str) -> DataFrame:
    from specgrade.operators.identification import curator_key

    rows = csv(spark, path).withColumnRenamed("individual_code", "specimen_id")
    return curator_key(with_pos(rows), "pos")


def annotation_rows(sheet: DataFrame, annotator: str, prefixes: dict[str, str], id_col: str, view_col: str) -> DataFrame:
    """Sheet to long rows (annotator, anonymous_id, view_id, pos, identity columns, trait, raw).

    Trait columns are found by header prefix; rows with a blank id or view and blank cells drop
    out.
    """
    require_columns(sheet, [id_col, view_col], f"{annotator} sheet")
    traits = header_traits([c for c in sheet.columns if c != "pos"], prefixes)
    identity = {}
    for out, start in (("pred_family", "familia"), ("pred_genus", "genero"), ("pred_species", "especie")):
        column = next((c for c in sheet.columns if c.lower().startswith(start)), None)
        identity[out] = F.when(not_blank(F.col(f"`{column}`")), F.trim(F.col(f"`{column}`"))) if column else F.lit(None).cast("string")
    cells = F.array(*[F.struct(F.lit(k).alias("trait"), F.trim(F.col(f"`{c}`")).alias("raw")) for c, k in traits.items()])
    rows = sheet.where(not_blank(F.col(id_col)) & not_blank(F.col(view_col))).select(
        F.lit(annotator).alias("annotator"), F.trim(id_col).alias("anonymous_id"), F.trim(view_col).alias("view_id"), "pos",
        *[v.alias(k) for k, v in identity.items()], F.explode(cells).alias("c"),
    )
    return rows.select(*[c for c in rows.columns if c != "c"], "c.trait", "c.raw").where(not_blank(F.col("raw")))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids in first-seen order from a curator key or a plain list."""
    from specgrade.operators.catalog import first_seen_ids

    lines = with_pos(spark.read.text(path))
    first = spark.read.text(path).limit(1).collect()
    if first and "individual_code" in first[0][0]:
        keyed = with_pos(csv(spark, path))
        return first_seen_ids(keyed, "individual_code", "pos")
    return first_seen_ids(lines, "value", "pos")


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "csv", digits: int | None = 4) -> None:
    """Write named result tables as csv, json or parquet; doubles are rounded."""
    for name, df in tables.items():
        if digits is not None:
            df = df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
        if fmt == "csv":
            flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
            df.select(*flat).write.mode("overwrite").option("header", True).option("escape", "\"").csv(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")


def read_trait_dimension(spark: SparkSession, traits: str, aliases: str) -> DataFrame:
    """Trait dimension with vocabularies from two CSV files."""
    from specgrade.operators.canon import trait_dimension

    rows = csv(spark, traits).withColumn("gradable", F.lower("gradable").isin("true", "1", "yes"))
    return trait_dimension(rows, csv(spark, aliases))


def image_suffix_ok(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*fv.IMAGE_SUFFIXES)
