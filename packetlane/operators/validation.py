"""Checks of column mappings: rules of single rows as one array of issues (no shuffle), rules of whole mappings by grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types of mapping rows, transforms, and what comments may name.
TYPES = ("direct", "lookup", "static", "multi_column")
TRANSFORMS = ("", "none", "upper", "lower", "number", "date")
RANKS = {"error": 0, "warning": 1, "info": 2}
COLUMN = "[A-Z]{1,3}"
OPTIONAL = ("if other, please describe", "if other please describe")


def _clean(c: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _is_column(c: Column) -> Column:
    return c.rlike(rf"\A(?:{COLUMN})\z")


def destinations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, column and choice (null but for the columns of choices; empty for the one of no answer) that each mapping row writes."""
    kind = F.lower(_clean("type"))
    none = F.lit(None).cast("string")
    target = lambda c, choice: F.struct(F.upper(F.trim(c)).alias("column"), choice.cast("string").alias("choice"))
    choices = F.transform(F.coalesce(F.map_entries("choices"), F.array().cast("array<struct<key:string,value:string>>")), lambda e: target(F.coalesce(e["value"], F.lit("")), e["key"]))
    several = F.concat(choices, F.array(target(_clean("no_answer"), F.lit(""))))
    one = F.array(target(_clean("column"), none))
    every = F.when(kind == "multi_column", several).when(kind.isin(*TYPES), one).otherwise(F.array().cast("array<struct<column:string,choice:string>>"))
    return rows.select(*keys, "row", F.explode(F.filter(every, lambda x: x["column"] != "")).alias("d")).select(*keys, "row", "d.*")


def row_issues(rows: DataFrame, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """keys, severity, message, row. rows: keys, row, type, source, column, transform, map, choices, no_answer, mark. known: keys, source."""
    kind, source, column = F.lower(_clean("type")), _clean("source"), F.upper(_clean("column"))
    issue = lambda when, severity, *message: F.when(when, F.struct(F.lit(severity).alias("severity"), F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message]).alias("message")))
    valid = kind.isin(*TYPES)
    named = valid & (kind != "static")
    has = F.lit(True)
    if known is not None:
        rows = rows.withColumn("__source", source).join(known.select(*keys, F.col("source").alias("__source"), F.lit(True).alias("__known")).distinct(), [*keys, "__source"], "left").drop("__source")
        has = F.coalesce("__known", F.lit(False))
    single = kind.isin("direct", "lookup", "static")
    transform = F.lower(_clean("transform"))
    empty = lambda m: F.coalesce(F.size(m) < 1, F.lit(True))
    bad_choices = F.transform(F.filter(F.map_entries("choices"), lambda e: ~_is_column(F.upper(F.trim(F.coalesce(e["value"], F.lit("")))))), lambda e: F.struct(F.lit("error").alias("severity"), F.concat(F.lit("Invalid choice column for "), e["key"], F.lit(": "), F.upper(F.trim(F.coalesce(e["value"], F.lit(""))))).alias("message")))
    found = F.array_compact(
        F.array(
            issue(~valid, "error", "Unknown mapping type: ", F.when(kind == "", "(blank)").otherwise(kind)),
            issue(named & (source == ""), "error", "Missing source"),
            issue(named & (source != "") & ~has, "warning", "Source not found in regions or reserved fields: ", source),
            issue(single & (column == ""), "error", "Missing target column"),
            issue(single & (column != "") & ~_is_column(column), "error", "Invalid column: ", column),
            issue((kind == "direct") & ~transform.isin(*TRANSFORMS), "warning", "Unrecognized transform: ", transform),
            issue((kind == "lookup") & empty("map"), "error", "lookup rows need a map"),
            issue((kind == "multi_column") & empty("choices"), "error", "multi_column rows need choices"),
            issue((kind == "multi_column") & (F.coalesce("mark", F.lit("")) == ""), "warning", "multi_column row has no mark"),
        )
    )
    found = F.when(kind == "multi_column", F.concat(found, F.coalesce(bad_choices, F.array().cast("array<struct<severity:string,message:string>>")))).otherwise(found)
    return rows.select(*keys, "row", F.explode(found).alias("i")).select(*keys, "i.*", F.col("row").cast("long").alias("row"))


def mapping_issues(rows: DataFrame, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """All issues of mappings: those of rows, columns that several rows write, sources that several rows use."""
    nowhere = F.lit(None).cast("long").alias("row")
    columns = destinations(rows, keys).groupBy(*keys, "column").agg(F.array_sort(F.collect_set(F.col("row").cast("long"))).alias("rows")).where(F.size("rows") > 1)
    twice = columns.select(*keys, F.lit("warning").alias("severity"), F.concat(F.lit("Column "), "column", F.lit(" is written by rows "), F.array_join(F.transform("rows", lambda r: r.cast("string")), ", ")).alias("message"), nowhere)
    kind = F.lower(_clean("type"))
    uses = rows.where(kind.isin(*TYPES) & (kind != "static")).groupBy(*keys, _clean("source").alias("source")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = uses.select(*keys, F.lit("info").alias("severity"), F.concat(F.lit("Source "), "source", F.lit(" is used "), F.col("n").cast("string"), F.lit(" times")).alias("message"), nowhere)
    return row_issues(rows, keys, known).unionByName(twice).unionByName(often)


def issue_order() -> list[Column]:
    """Errors first, then by row (whole mappings last), then by message."""
    rank = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    return [F.coalesce(F.try_element_at(rank, F.col("severity")), F.lit(len(RANKS))), F.col("row").asc_nulls_last(), F.col("message")]


def issue_stats(issues: DataFrame, keys: list[str]) -> DataFrame:
    """errors, warnings, infos and ok of each mapping with issues."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return issues.groupBy(*keys).agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos")).withColumn("ok", F.col("errors") == 0)


def required_columns(headers: DataFrame) -> DataFrame:
    """Columns with a header that is not optional. headers: sheet, column, header (text of its cells joined)."""
    text = F.lower(_clean("header"))
    optional = F.lit(False)
    for marker in OPTIONAL:
        optional = optional | F.contains(text, F.lit(marker))
    return headers.where((text != "") & ~optional).select("sheet", "column", "header")


def header_text(cells: DataFrame, last_row: int) -> DataFrame:
    """sheet, column, header: what stands above the data, from top to bottom."""
    full = cells.where((F.col("row") <= last_row) & (_clean("value") != ""))
    return full.groupBy("sheet", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", _clean("value").alias("v")))), lambda x: x["v"]), " ").alias("header"))


def uncovered(required: DataFrame, written: DataFrame, shown: int = 25) -> DataFrame:
    """sheet, n, first_columns: required columns that no row of the sheet's mapping writes; the first ones by letter are named. written: sheet, column."""
    gone = required.join(written.select("sheet", "column").distinct(), ["sheet", "column"], "left_anti")
    names = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(F.length("column").alias("l"), "column"))), 1, shown), lambda x: x["column"])
    return gone.groupBy("sheet").agg(F.count(F.lit(1)).alias("n"), names.alias("first_columns"))
