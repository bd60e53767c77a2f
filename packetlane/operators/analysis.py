"""Rows of analysed pages, what a reviewer is shown of them, how a run's answers turned out, and which workbook file a name means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlane.functions.text import make_ref
from packetlane.operators.regions import inside_root
from packetlane.operators.review import stripped

#: What a reading may carry beside its text, by the name it has in rows of pages.
READING = {"ocr_mean_score": ("mean_score", "double"), "ocr_confidence_source": ("confidence_source", "string"), "ocr_text_source": ("text_source", "string"), "ocr_workflow": ("workflow", "string"), "ocr_needs_human_review": ("needs_review", "boolean"), "ocr_selected_model": ("model", "string"), "ocr_selected_stage_index": ("stage_index", "int")}
#: Settings of a region that stay with its row until texts are cleaned at the end of a run; `strip_internal` takes them away.
SETTINGS = ("llm_field_data_type", "llm_validation_rules", "llm_prompt_instruction", "llm_prompt_override", "postprocess_passes", "output_regex")
# Extensions of workbooks, in the order in which they are tried.
WORKBOOKS = (".xlsm", ".xlsx", ".xltm", ".xltx")


def _filled(c: Column) -> Column:
    """Trimmed text, null if there is none."""
    return F.when(stripped(c) != "", stripped(c))


def page_rows(texts: DataFrame, answers: DataFrame, settings: DataFrame, keys: list[str]) -> DataFrame:
    """One table of text and mcq rows of pages: keys, name, kind, text, scores of the reading, review_ref, and settings of the region with a leading underscore.

    keys: columns of a run, an item and a page, in the order of review references; a blank run has none. texts: keys, form_type, side, name, text,
    score, min_score, label and those of READING that it has. answers: keys, name (or question), answer. settings: form_type, side, name and
    those of SETTINGS that it has; of regions with the same name the last by value counts. Texts and answers never meet, so only the settings
    are joined, by form, side and name; a form that holds most rows is split by adaptive execution.
    """
    own = [c for c in SETTINGS if c in settings.columns]
    one = settings.groupBy("form_type", "side", "name").agg(F.max(F.struct(*[_filled(F.col(c)).alias(f"_{c}") for c in own])).alias("__s")) if own else None
    ref = lambda kind: F.when(F.coalesce(F.col(keys[0]).cast("string"), F.lit("")) != "", make_ref(*map(F.col, keys), F.col("name"), F.lit(kind)))
    score = F.round(F.coalesce("score", "min_score"), 6)
    extra = {out: (F.col(c) if c in texts.columns else F.lit(None)).cast(t) for out, (c, t) in READING.items()}
    extra["ocr_mean_score"] = F.round(extra["ocr_mean_score"], 6)
    rows = texts.join(one, ["form_type", "side", "name"], "left") if one is not None else texts
    read = rows.select(*keys, "name", F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), score.alias("ocr_confidence_score"), F.lower("label").alias("ocr_confidence_label"), *[c.alias(n) for n, c in extra.items()], ref("text").alias("review_ref"), *[F.col(f"__s._{c}").alias(f"_{c}") for c in own])
    named = answers if "name" in answers.columns else answers.withColumnRenamed("question", "name")
    marked = named.select(*keys, "name", F.lit("mcq").alias("kind"), F.coalesce("answer", F.lit("")).alias("text"), ref("mcq").alias("review_ref"))
    return read.unionByName(marked, allowMissingColumns=True)


def strip_internal(rows: DataFrame) -> DataFrame:
    """Rows without what was only carried along."""
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def review_context(pending: DataFrame, items: DataFrame, schemas: DataFrame, keys: list[str], root: str) -> DataFrame:
    """Each pending row with the page image that shows it (`page`, absolute, inside root), its form's `side`, and `problem` where it can't be shown.

    pending: keys, kind, page_in_pair, name. items: keys, form_type, page_odd, page_even, page_odd_mcq, page_even_mcq (paths; one row each).
    schemas: form_type, side of forms that have regions. Ids stand on the odd page and need no schema.
    """
    forms = schemas.select("form_type", "side").distinct().withColumn("__schema", F.lit(True))
    kind = F.lower(F.coalesce("kind", F.lit("")))
    odd = F.coalesce(_filled(F.col("page_in_pair")), F.lit("odd")) == "odd"
    side = F.when(kind != "id", F.when(odd, "a").otherwise("b"))
    path = F.when((kind == "id") | odd, F.col("page_odd")).otherwise(F.col("page_even"))
    drawn = F.when(kind == "mcq", _filled(F.when(odd, F.col("page_odd_mcq")).otherwise(F.col("page_even_mcq"))))
    met = pending.join(items.withColumn("__item", F.lit(True)), keys, "left").withColumns({"side": side, "page": inside_root(F.coalesce(drawn, path), root)})
    met = met.join(forms, ["form_type", "side"], "left")
    problem = (
        F.when(~kind.isin("id", "text", "mcq"), "unsupported kind")
        .when(F.col("__item").isNull(), "item_index out of range")
        .when(F.col("page").isNull(), "no page image")
        .when((kind != "id") & F.col("__schema").isNull(), "no regions of this form and side")
    )
    known = F.when(problem.isNull(), F.col("page"))
    return met.withColumns({"problem": problem, "page": known}).select(*pending.columns, "side", "page", "problem")


def outcomes(rows: DataFrame, keys: list[str], outcome: str, order: str, shown: list[str], example_of: str = "invalid_json", examples: int = 3) -> DataFrame:
    """keys, outcome, n and, for one outcome, its first rows as examples. Counting combines before the shuffle; the examples are cut per task before they meet."""
    counts = rows.groupBy(*keys, outcome).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(order)
    first = rows.where(F.col(outcome) == example_of).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= examples)
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__k", F.struct(*shown).alias("e")))).alias("__e"))
    out = counts.join(listed, keys, "left")
    return out.select(*keys, outcome, "n", F.when(F.col(outcome) == example_of, F.transform("__e", lambda e: e["e"])).alias("examples"))


def resolve_workbooks(names: DataFrame, files: DataFrame) -> DataFrame:
    """names (name, others) with the `file` that each one means, null if none.

    files: folder ('' for those that lie directly in the root), file. A name with a workbook's extension is that file; else name and each extension
    in order; else a file or stem that differs only by case, by lowered name; else the first by lowered name of the folder called so. Lookups are
    equal joins on lowered names, never comparisons of all files with all names.
    """
    suffix = F.lower(F.regexp_extract("file", r"(\.[^.]*)\z", 1))
    books = files.withColumns({"folder": F.coalesce("folder", F.lit("")), "__x": suffix}).where(suffix.isin(*WORKBOOKS)).withColumn("__stem", F.regexp_replace("file", r"\.[^.]*\z", ""))
    top = books.where("folder = ''")
    keys = F.array_distinct(F.array(F.lower("file"), F.lower("__stem")))
    direct = top.select(F.explode(keys).alias("__key"), "file", "__stem", "__x", F.lit(None).cast("string").alias("folder"))
    nested = books.where("folder <> ''").select(F.lower("folder").alias("__key"), F.concat_ws("/", "folder", "file").alias("file"), "__stem", "__x", "folder")
    met = names.select("name").distinct().withColumn("__key", F.lower("name")).join(direct.unionByName(nested), "__key")
    tried = F.array_position(F.array(*map(F.lit, WORKBOOKS)), F.regexp_extract("file", r"(\.[^.]*)\z", 1))
    rank = (
        F.when(F.col("folder") == F.col("name"), F.struct(F.lit(3).alias("a"), F.lit(0).cast("long").alias("b"), F.lower("file").alias("c"), F.col("file").alias("file")))
        .when(F.col("folder").isNotNull(), None)
        .when(F.col("file") == F.col("name"), F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), F.lit("").alias("c"), F.col("file").alias("file")))
        .when((F.col("__stem") == F.col("name")) & (tried > 0), F.struct(F.lit(1).alias("a"), tried.cast("long").alias("b"), F.lit("").alias("c"), F.col("file").alias("file")))
        .otherwise(F.struct(F.lit(2).alias("a"), F.lit(0).cast("long").alias("b"), F.lower("file").alias("c"), F.col("file").alias("file")))
    )
    best = met.withColumn("__r", rank).where("__r IS NOT NULL").groupBy("name").agg(F.min("__r").alias("__r"))
    return names.join(best.select("name", F.col("__r.file").alias("file")), "name", "left")
