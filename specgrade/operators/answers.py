"""Batch parsing of model answers and fetched HTML pages held in tables."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from specgrade.functions import fixed_values as fv
from specgrade.functions.columns import names, not_blank
from specgrade.functions.text import is_json, last_token, slug, strip_justification

END_MARK = "####"


def resolve_answers(documents: DataFrame, source: str = "source_idx") -> DataFrame:
    """Usable answer text per (source, key) from answer documents.

    Documents hold ``answers map<string,string>`` and ``processed map<string,struct<answer>>``;
    the answer wins, the processed text stands in, blank text drops out.
    """
    rows = documents.select(source, "processed", F.explode("answers").alias("answer_key", "text"))
    alt = F.try_element_at(F.col("processed"), F.col("answer_key"))["answer"]
    text = F.when(not_blank(F.col("text")), F.col("text")).when(not_blank(alt), alt)
    return rows.select("answer_key", source, text.alias("text")).where("text is not null")


def merge_answers(rows: DataFrame, key: str = "answer_key", source: str = "source_idx", text: str = "text") -> DataFrame:
    """Texts of a key joined by newline in source order; blank texts drop out.

    A key occurs once per source, so a merged text has at most as many parts as there are
    sources.
    """
    usable = rows.where(not_blank(F.col(text)))
    per_source = usable.groupBy(key, source).agg(F.max(text).alias("_t"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(source).alias("s"), F.col("_t").alias("t"))))
    return per_source.groupBy(key).agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias(text), F.count(F.lit(1)).alias("n_parts")
    )


def answer_lines(answers: DataFrame, key: str | list[str], text: str = "text", order: str | None = None) -> DataFrame:
    """Non-blank lines (key, line_no, line). With ``order`` several texts per key read as one."""
    rows = answers.select(
        *names(key), *([order] if order else []), F.posexplode(F.split(text, "\n")).alias("_i", "_line")
    )
    at = F.struct(*([F.col(order)] if order else []), F.col("_i")).alias("line_no")
    return rows.select(*names(key), at, F.trim("_line").alias("line")).where("line <> ''")


def form_fields(answers: DataFrame, key: str | list[str], text: str = "text", order: str | None = None) -> DataFrame:
    """Numbered form lines to (key, section, field, value); a later line wins.

    Unknown numbers are ignored. The notes line is returned as section 'notes'.
    """
    lines = answer_lines(answers, key, text, order)
    note = F.regexp_extract("line", r"^F\.\s*Notes:\s*(.*)", 1)
    is_note = F.col("line").rlike(r"^F\.\s*Notes:")
    number = F.try_to_number(F.substring(F.regexp_extract("line", r"^(\d+)\.", 1), 1, 9), F.lit("999999999"))
    rest = F.regexp_replace("line", r"^\d+\.\s*", "")
    after = F.when(rest.contains(":"), F.regexp_replace(rest, r"^[^:]*:", "")).otherwise("")
    field = F.try_element_at(
        F.array(*[F.struct(F.lit(s).alias("section"), F.lit(f).alias("field")) for s, f in fv.FORM_FIELDS.values()]),
        F.when(number.between(1, len(fv.FORM_FIELDS)), number.cast("int")),
    )
    target = F.when(is_note, F.struct(F.lit("notes").alias("section"), F.lit("notes").alias("field"))).otherwise(field)
    value = F.when(is_note, F.trim(note)).otherwise(strip_justification(after))
    known = lines.select(*names(key), "line_no", target.alias("_t"), value.alias("value")).where("_t is not null")
    return known.groupBy(*names(key), "_t.section", "_t.field").agg(F.max_by("value", "line_no").alias("value"))


def morphology_records(fields: DataFrame, key: str | list[str]) -> DataFrame:
    """Wide record per key: one map of fields per section, and the notes."""
    sections = sorted({s for s, _ in fv.FORM_FIELDS.values()})
    return fields.groupBy(*names(key)).agg(
        *[
            F.map_from_entries(
                F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("field", "value"))))
            ).alias(s)
            for s in sections
        ],
        F.max(F.when(F.col("section") == "notes", F.col("value"))).alias("notes"),
    )


def ingest_answers(answers: DataFrame, source: str = "source_idx") -> DataFrame:
    """Answers to (specimen_id, section, field, value); the later key of a specimen wins.

    The specimen id is the text after the last underscore of the key. Lines of several sources
    are read in source order without building the joined text.
    """
    owners = answers.where(not_blank(F.col("text"))).groupBy(last_token(F.col("answer_key")).alias("specimen_id")).agg(
        F.max("answer_key").alias("answer_key"), F.countDistinct("answer_key").alias("n_keys")
    )
    fields = form_fields(answers, "answer_key", "text", source)
    return owners.join(fields, "answer_key").select("specimen_id", "answer_key", "n_keys", "section", "field", "value")


# ---- JSON answers ------------------------------------------------------------------------


def strip_thinking(text: Column) -> Column:
    """Remove complete thinking blocks; after a lone closing tag keep what follows."""
    cut = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    at = F.instr(cut, "</think>")
    return F.when(at > 0, F.substring(cut, at + F.lit(len("</think>")), F.length(cut))).otherwise(cut)


def strip_fence(text: Column) -> Column:
    """Drop the lines of a code fence that opens the text."""
    body = F.regexp_replace(text, r"^```[^\n]*\n?", "")
    return F.when(text.startswith("```"), F.regexp_replace(body, r"\n?[ \t]*```\s*$", "")).otherwise(text)


def _balance(text: Column, opening: str, closing: str) -> Column:
    def n(c: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))

    return n(opening) - n(closing)


def _repair(text: Column) -> Column:
    """Close a truncated object: drop broken trailing lines, then append the open brackets."""
    start = F.instr(text, "{")
    body = F.rtrim(F.regexp_replace(F.substring(text, start, F.length(text)), r"\s+$", ""), F.lit(","))
    lines = F.split(body, "\n")
    good = F.transform(lines, lambda x, i: F.when((i == 0) | x.rlike(r"[,}\]\"']\s*$"), i + 1).otherwise(0))
    kept = F.array_join(F.slice(lines, 1, F.array_max(good)), "\n")
    kept = F.rtrim(F.regexp_replace(kept, r"\s+$", ""), F.lit(","))
    braces, brackets = _balance(kept, "{", "}"), _balance(kept, "[", "]")
    closed = F.concat(kept, F.repeat(F.lit("]"), F.greatest(brackets, F.lit(0))), F.repeat(F.lit("}"), F.greatest(braces, F.lit(0))))
    open_ = (_balance(text, "{", "}") > 0) | (_balance(text, "[", "]") > 0)
    return F.when((start > 0) & open_, closed)


def parse_json_answers(answers: DataFrame, text: str = "text") -> DataFrame:
    """Add ``json`` (valid JSON text or null) and ``recovery``.

    Tried in turn: the cleaned text, the outermost object in it, a closed truncation, and the
    truncation cut back to its last comma. A text counts only if nothing follows its value.
    """
    cleaned = F.trim(F.col("_c"))
    outer = F.regexp_extract(F.col("_c"), r"(?s)\{.*\}", 0)
    fixed = _repair(F.col("_c"))
    shorter = _repair(F.regexp_extract(F.col("_c"), r"(?s)^(.*),", 1))
    steps = answers.withColumn("_c", strip_fence(F.trim(strip_thinking(F.col(text)))))

    def attempt(candidate: Column, name: str, then: Column) -> Column:
        """The candidate if it is valid; it is built and parsed once, and ``then`` only if it is not."""
        return F.element_at(F.transform(F.array(candidate), lambda c: F.when(is_json(c), F.struct(c.alias("json"), F.lit(name).alias("recovery"))).otherwise(then)), 1)

    result = F.struct(F.lit(None).cast("string").alias("json"), F.lit("failed").alias("recovery"))
    for candidate, name in ((shorter, "repaired"), (fixed, "repaired"), (outer, "extracted"), (cleaned, "direct")):
        result = attempt(candidate, name, result)
    return steps.withColumn("_c", result).select(*answers.columns, F.col("_c.json").alias("json"), F.col("_c.recovery").alias("recovery"))


# ---- key: value answers ------------------------------------------------------------------


def split_thinking(answers: DataFrame, text: str = "text") -> DataFrame:
    """Columns ``thinking`` and ``answer``; the answer ends at the end mark."""
    at = F.instr(text, "</think>")
    t = F.col(text)
    thinking = F.when(at > 0, F.trim(F.replace(F.substring(t, F.lit(1), at - 1), F.lit("<think>"), F.lit("")))).otherwise("")
    answer = F.when(at > 0, F.substring(t, at + F.lit(len("</think>")), F.length(t))).otherwise(t)
    return answers.withColumn("thinking", thinking).withColumn("answer", F.trim(F.substring_index(answer, END_MARK, 1)))


def key_value_answers(answers: DataFrame, key: str | list[str], text: str = "answer", order: str | None = None) -> DataFrame:
    """``key: value`` lines to (key, name, value): numbering cut, names lower-case, last wins."""
    lines = answer_lines(answers, key, text, order).where(F.col("line").contains(":"))
    raw = F.trim(F.substring_index("line", ":", 1))
    name = F.lower(F.when(raw.contains("."), F.trim(F.regexp_replace(raw, r"^[^.]*\.", ""))).otherwise(raw))
    value = F.trim(F.regexp_replace(F.trim(F.regexp_replace("line", "^[^:]*:", "")), r"\[NOTE\]|\[REPORT\]", ""))
    return (
        lines.select(*names(key), "line_no", name.alias("name"), value.alias("value"))
        .groupBy(*names(key), "name")
        .agg(F.max_by("value", "line_no").alias("value"))
    )


def wide_answers(pairs: DataFrame, specimens: DataFrame, key: str, expected: list[str]) -> DataFrame:
    """One row per specimen with every expected name, blank when absent."""
    wide = pairs.groupBy(key).pivot("name", expected).agg(F.first("value"))
    return specimens.select(key).join(wide, key, "left").na.fill("", expected)


def unexpected_names(pairs: DataFrame, expected: list[str]) -> DataFrame:
    return pairs.where(~F.col("name").isin(*expected)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# ---- HTML key pages ----------------------------------------------------------------------

# Element ids and classes of a key page, and stable names of known categories.
TAXA_ID, FAMILY_CLASS, TAXON_CLASS, NAME_CLASS = "key-taxa", "family-div", "taxon-div", "dynamlang"
KNOWN_CATEGORIES = {
    1: "habit", 2: "latex", 3: "leaf_type", 5: "leaf_arrangement", 6: "leaf_margin", 7: "stipules",
    10: "flower_symmetry", 14: "ovary_placement", 15: "carpel_number", 17: "sex", 18: "fruit",
    25: "armature", 50: "leaf_punctations", 60: "glands_on_blade_or_petiole",
}
# The elements that HTML never closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _KeyPage(HTMLParser):
    """Collects the taxon list and the filter options of one key page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.taxa: list[tuple] = []
        self.options: list[tuple] = []
        self._stack: list[tuple[str, str]] = []  # (tag, role)
        self._open: Counter[str] = Counter()  # open tags, and roles after a colon
        self._family = ""
        self._text: dict[str, list[str]] = {}
        self._taxon_id: int | None = None
        self._group = ""
        self._group_options: list[tuple[int, int, str]] = []
        self._option: tuple[int, int] | None = None

    def _inside(self, role: str) -> bool:
        return self._open[f":{role}"] > 0

    def _end_option(self, label: str = "") -> None:
        """Keep the option at hand; one without a label is named by its number."""
        if self._option:
            self._group_options.append((*self._option, label or f"option_{self._option[1]}"))
        self._option = None

    def end_group(self) -> None:
        """Keep the options of a named group, with the category of its first one."""
        self._end_option()
        if self._group:
            self.options += [(c, o, self._group, label, self._group_options[0][0]) for c, o, label in self._group_options]
        self._group, self._group_options = "", []

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        role = ""
        if tag == "div" and a.get("id") == TAXA_ID:
            role = "taxa"
        elif tag == "div" and self._stack and self._stack[-1][1] == "taxa":
            role = "family" if FAMILY_CLASS in classes else "taxon" if TAXON_CLASS in classes else ""
            self._text, self._taxon_id = {}, None
        elif tag == "div" and re.match(r"char\d+$", a.get("id", "")):
            role, self._group, self._group_options = "group", "", []
        elif tag == "a" and "href" in a and self._inside("taxon") and "link" not in self._text:
            found = re.search(r"taxon=(\d+)", a["href"])
            self._taxon_id = int(found.group(1)) if found else None
            role, self._text["link"] = "link", []
        elif tag == "i" and self._inside("link") and "name" not in self._text:
            role, self._text["name"] = "name", []
        elif tag == "span" and self._inside("group"):
            if NAME_CLASS in classes and not self._group:
                role, self._text["group"] = "group_name", []
            elif self._option:
                role, self._text["option"] = "option", []
        elif tag == "input" and self._inside("group") and a.get("type") == "checkbox" and a.get("name") == "attr[]":
            self._end_option()
            found = re.match(r"(\d+)-(\d+)", a.get("value", ""))
            self._option = (int(found.group(1)), int(found.group(2))) if found else None
        if tag not in VOID:
            self._stack.append((tag, role))
            self._open.update((tag, f":{role}"))

    def handle_data(self, data: str) -> None:
        for role, slot in (("family", "family"), ("link", "link"), ("name", "name"), ("group_name", "group"), ("option", "option")):
            if self._inside(role):
                self._text.setdefault(slot, []).append(data.strip())

    def handle_endtag(self, tag: str) -> None:
        if not self._open[tag]:
            return
        while self._stack:
            top, role = self._stack.pop()
            self._open.subtract((top, f":{role}"))
            if role == "family":
                self._family = "".join(self._text.get("family", []))
            elif role == "taxon" and self._taxon_id is not None:
                name = "".join(self._text.get("name") or self._text.get("link", []))
                self.taxa.append((len(self.taxa) + 1, self._taxon_id, name, self._family))
            elif role == "group_name":
                self._group = "".join(self._text.get("group", [])).rstrip("?").strip()
            elif role == "option":
                self._end_option("".join(self._text.get("option", [])))
            elif role == "group":
                self.end_group()
            if top == tag:
                return


_TAXA = {"pos": T.IntegerType(), "taxon_id": T.LongType(), "scientific_name": T.StringType(), "family": T.StringType()}
_OPTIONS = {"category_id": T.IntegerType(), "option_id": T.IntegerType(), "category": T.StringType(), "label": T.StringType(), "group_id": T.IntegerType()}
_ARROW = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.StringType(): pa.string()}
# Pages that are parsed at once: what they list leaves the task before the next ones are read.
PAGES_AT_ONCE = 100


def _key_page(html: str | None) -> tuple[list[dict], list[dict]]:
    page = _KeyPage()
    page.feed(html or "")
    page.close()
    page.end_group()
    return [dict(zip(_TAXA, t)) for t in page.taxa], [dict(zip(_OPTIONS, o)) for o in page.options]


def parse_key_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``taxa``, ``options`` and ``species_count`` to fetched pages."""
    count = F.replace(F.regexp_extract(html, r"Species Count:\s*([\d,]+)", 1), F.lit(","), F.lit(""))
    kept = [c for c in pages.columns if c != html]
    rows = pages.select(
        *kept, F.coalesce(F.when(count != "", count).cast("long"), F.lit(0).cast("long")).alias("species_count"), F.col(html).alias("_html")
    )
    lists = {"taxa": _TAXA, "options": _OPTIONS}
    made = [T.StructField(n, T.ArrayType(T.StructType([T.StructField(k, v) for k, v in f.items()]))) for n, f in lists.items()]
    types = [pa.list_(pa.struct([(k, _ARROW[v]) for k, v in f.items()])) for f in lists.values()]
    schema = T.StructType([*rows.drop("_html").schema.fields, *made])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(start, PAGES_AT_ONCE)
                found = [_key_page(text) for text in part.column(part.num_columns - 1).to_pylist()]
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], schema.fieldNames())

    return rows.mapInArrow(parse, schema).select(*kept, "taxa", "options", "species_count")


def listed_taxa(parsed: DataFrame, *keep: str) -> DataFrame:
    return parsed.select(*keep, F.explode("taxa").alias("t")).select(*keep, "t.*")


def filter_options(parsed: DataFrame, known: dict[int, str] | None = KNOWN_CATEGORIES) -> DataFrame:
    """Distinct (category_id, option_id, category, option_column).

    A group whose first option belongs to a known category has its name, any other its own.
    """
    rows = parsed.select(F.explode("options").alias("o")).select("o.*").distinct()
    name = slug(F.col("category"))
    if known:
        name = F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col("group_id")], name)
    return rows.select(
        "category_id", "option_id", name.alias("category"), F.concat(name, F.lit("__"), slug(F.col("label"))).alias("option_column")
    )


def matrix_from_pages(pages: DataFrame, attr: str = "attr", known: dict[int, str] | None = KNOWN_CATEGORIES) -> DataFrame:
    """Matrix from one unfiltered page (null ``attr``) and one page per option."""
    from specgrade.operators.matrix import build_matrix

    parsed = parse_key_pages(pages)
    base = parsed.where(F.col(attr).isNull())
    options = filter_options(base, known)
    species = listed_taxa(base).groupBy("taxon_id").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    code = F.concat_ws("-", "category_id", "option_id").alias(attr)
    members = listed_taxa(parsed.where(F.col(attr).isNotNull()), attr).join(options.select(code, "option_column"), attr)
    return build_matrix(species, members, options.select("category", "option_column"), "taxon_id")
