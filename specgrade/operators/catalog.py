"""Catalog building and quality control of observation exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from specgrade.functions import fixed_values as fv
from specgrade.functions.columns import not_blank
from specgrade.functions.text import format_label, literal_map, taxon_text
from specgrade.operators.ranking import ordered_rank
from specgrade.operators.taxonomy import encode, label_ids, match_names

# Required catalog columns, size limits of an image, minimum training images.
CATALOG_COLUMNS = ("training_absolute_path", "FAMILY", "GENUS", "SPECIES")
MIN_BYTES, MAX_BYTES = 100 * 1024, 10 * 1024 * 1024
MIN_TRAINING_IMAGES = 3


def expand_images(catalog: DataFrame, files: DataFrame, rank: str, pos: str = "pos") -> DataFrame:
    """One row per image file of each catalog row, with taxonomy and first-seen label ids.

    ``files`` is a listing (directory, path). Catalog rows whose directory is not listed drop
    out; ids count every label with a listed directory.
    """
    labelled = catalog.select(
        F.col("training_absolute_path").alias("directory"),
        pos,
        taxon_text(F.col("FAMILY")).alias("family"),
        taxon_text(F.col("GENUS")).alias("genus"),
        format_label(F.col("FAMILY"), F.col("GENUS"), F.col("SPECIES"), "species").alias("species"),
        F.col("ID_YPS").cast("string").alias("individual_id"),
        format_label(F.col("FAMILY"), F.col("GENUS"), F.col("SPECIES"), rank).alias("label"),
    )
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    listed = labelled.join(files.select("directory").distinct(), "directory", "left_semi")
    images = files.where(suffix.isin(*fv.IMAGE_SUFFIXES)).select("directory", F.col("path").alias("image_path"))
    records = listed.join(images, "directory")
    return encode(records, label_ids(listed, "label", pos), "label")


def missing_directories(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Catalog rows without any listed file."""
    return catalog.join(
        files.select(F.col("directory").alias("training_absolute_path")).distinct(), "training_absolute_path", "left_anti"
    )


def images_of(images: DataFrame, individual: str, image: str) -> DataFrame:
    """Images of each individual in order: position and count instead of one long list."""
    return ordered_rank(images, individual, image, rank="image_no", total="n_images")


def overlap_specimens(
    catalog: DataFrame, images: DataFrame, reference: DataFrame, reference_name: str, bridge: DataFrame, key: str, pos: str
) -> DataFrame:
    """Specimens (first catalog row per id) that match the reference and have images."""
    first = catalog.groupBy(key).agg(F.min_by(F.struct(*[c for c in catalog.columns if c != key]), pos).alias("_r")).select(key, "_r.*")
    named = match_names(first, "scientific_name", reference, reference_name, bridge).where("matched_name is not null")
    counts = images.groupBy(key).agg(F.count(F.lit(1)).alias("n_images"))
    return named.join(counts, key)


def specimens_by_id(requested: DataFrame, specimens: DataFrame, key: str) -> DataFrame:
    """Requested ids in order with ``found``; the specimens columns are null when absent."""
    return requested.join(specimens.withColumn("found", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def first_seen_ids(lines: DataFrame, value: str, pos: str) -> DataFrame:
    """Distinct non-blank ids with their first position."""
    clean = F.trim(F.split(F.trim(value), ",")[0])
    return (
        lines.select(clean.alias("specimen_id"), pos)
        .where(F.col("specimen_id") != "")
        .groupBy("specimen_id")
        .agg(F.min(pos).alias("first_pos"))
    )


def individuals_from_photos(photos: DataFrame, key: str, pos: str, taxonomy: list[str], habit: str | None = None) -> DataFrame:
    """First photo row per individual; rows without taxonomy are dropped."""
    complete = photos.dropna(subset=[key, *taxonomy])
    rest = [c for c in photos.columns if c != key]
    out = complete.groupBy(key).agg(F.min_by(F.struct(*rest), pos).alias("_r")).select(key, "_r.*")
    if habit:
        out = out.withColumn("LIANA", F.coalesce(literal_map(fv.HABIT_FLAG)[F.col(habit)], F.lit(0))).withColumn(
            "FOREST", F.lit("Unknown")
        )
    return out


def inconsistent_individuals(photos: DataFrame, key: str, taxonomy: list[str]) -> DataFrame:
    """Individuals with more than one value in any taxonomy column.

    Min and max decide it, so nothing is collected per individual.
    """
    differs = [F.min(c) != F.max(c) for c in taxonomy]
    cond = differs[0]
    for d in differs[1:]:
        cond = cond | d
    complete = photos.dropna(subset=[key, *taxonomy])
    return complete.groupBy(key).agg(F.coalesce(cond, F.lit(False)).alias("_bad")).where("_bad").select(key)


def valid_image(length: Column) -> Column:
    return length.between(MIN_BYTES, MAX_BYTES)


def image_roles(
    photos: DataFrame,
    individual: str | list[str],
    observation: str,
    photo: str,
    first_position: Column,
    valid: Column,
) -> DataFrame:
    """Verification or training role per photo and the running number of training images.

    Per observation the first or the last photo verifies. Invalid photos keep their index but
    get no role. The running number counts an individual's training images in (observation,
    photo) order, cut into observation ranges.
    """
    indexed = ordered_rank(photos.withColumn("_valid", valid), [observation], photo, rank="photo_no", total="n_photos")
    target = F.when(first_position, F.lit(1)).otherwise(F.col("n_photos"))
    role = F.when(~F.col("_valid"), "invalid").when(F.col("photo_no") == target, "verification").otherwise("training")
    roles = indexed.withColumn("role", role).drop("_valid")
    training = ordered_rank(
        roles.where("role = 'training'"), individual, observation, [F.col("photo_no")], "training_no"
    )
    rest = roles.where("role <> 'training'").withColumn("training_no", F.lit(None).cast("long"))
    return training.unionByName(rest)


def file_check(files: DataFrame, observation: str, suffix: str) -> DataFrame:
    """File counts per observation: complete, incomplete_set or unexpected_file_count."""
    jpg, js, n = F.count(F.when(F.col(suffix) == "jpg", 1)), F.count(F.when(F.col(suffix) == "json", 1)), F.count(F.lit(1))
    status = (
        F.when((n == 13) & (jpg == 6) & (js == 7), "complete")
        .when((n == 11) & (jpg == 5) & (js == 6), "incomplete_set")
        .otherwise("unexpected_file_count")
    )
    return files.groupBy(observation).agg(n.alias("n_files"), jpg.alias("n_jpg"), js.alias("n_json"), status.alias("status"))


def _issue(cond: Column, severity: str, kind: str, action: str, usable: bool) -> Column:
    return F.when(
        cond,
        F.struct(
            F.lit(severity).alias("severity"), F.lit(kind).alias("issue_type"),
            F.lit(action).alias("action_needed"), F.lit(usable).alias("can_process"),
        ),
    )


def observation_issues(observations: DataFrame, key: str) -> DataFrame:
    """Issue rows per observation.

    Reads (has_metadata, individual_id, has_taxonomy, n_photos, n_bad, status). The first
    blocking issue ends the checks of an observation.
    """
    meta, ident = F.col("has_metadata"), not_blank(F.col("individual_id"))
    taxon, n = F.col("has_taxonomy"), F.col("n_photos")
    passed = meta & ident & taxon
    few = passed & (n > 0) & (n - 1 < MIN_TRAINING_IMAGES)
    issues = F.array(
        _issue(F.col("status") == "incomplete_set", "INFO", "INCOMPLETE_SET", "Expected variation - can still process", True),
        _issue(F.col("status") == "unexpected_file_count", "WARNING", "UNEXPECTED_FILE_COUNT", "Verify download completed successfully", True),
        _issue(~meta, "ERROR", "NO_METADATA", "Check if file was downloaded correctly", False),
        _issue(meta & ~ident, "ERROR", "NO_ID", "Add an ID to the observation description", False),
        _issue(meta & ident & ~taxon, "ERROR", "MISSING_TAXONOMY", "Add this ID to the species CSV file", False),
        _issue(passed & (n == 0), "ERROR", "NO_IMAGES", "Check if images were downloaded correctly", False),
        _issue(few, "WARNING", "INSUFFICIENT_IMAGES", "Capture more images for this individual", False),
        _issue(passed & (n - 1 >= MIN_TRAINING_IMAGES) & (F.col("n_bad") > 0), "WARNING", "CORRUPTED_IMAGE", "Re-download or recapture this image", True),
    )
    return observations.select(key, F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("i")).select(key, "i.*")


def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "issue_type", "action_needed").agg(
        F.count(F.lit(1)).alias("n_issues"), F.count(F.when(F.col("can_process"), 1)).alias("n_usable")
    )


def individual_catalog(observations: DataFrame, key: str, order: Column, taxonomy: list[str]) -> DataFrame:
    """Catalog row per individual: the last observation wins."""
    rest = [c for c in observations.columns if c != key]
    latest = observations.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")
    path = F.concat_ws(
        "/", F.lit("by_family"), taxonomy[0], F.lit("by_genus"), taxonomy[1], F.lit("by_species"), taxonomy[2], F.col(key).cast("string")
    )
    return latest.select(
        "*",
        path.alias("training_path"),
        (F.col("n_images") - 1).alias("training_image_count"),
        F.lit(1).alias("verification_image_count"),
        F.col("n_images").alias("total_image_count"),
        (F.col("n_images") - 1 >= MIN_TRAINING_IMAGES).alias("has_minimum_images"),
    )


def delivery_check(images: DataFrame, listing: DataFrame, key: str, image: str, exemplars: int, budget: int) -> DataFrame:
    """Images that exist per specimen and whether they exceed the budget with the exemplars."""
    present = images.join(listing.select(image).distinct(), image, "left_semi")
    n = F.count(F.lit(1))
    return present.groupBy(key).agg(
        n.alias("n_images"), (n + exemplars).alias("n_delivered"), (n + exemplars > budget).alias("over_budget")
    )


def transfer_summary(manifest: DataFrame, status: str, ok: str = "success") -> DataFrame:
    n, good = F.count(F.lit(1)), F.count(F.when(F.col(status) == ok, 1))
    return manifest.agg(
        n.alias("total"), good.alias("succeeded"), (n - good).alias("failed"),
        F.coalesce(F.try_divide(good.cast("double"), n), F.lit(0.0)).alias("success_rate"),
    )
