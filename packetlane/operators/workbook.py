"""Workbooks of a run: cells of all its sheets as one long table, and files made of them.

A book is what one run fills; a sheet has ROWS rows at most by its format, and one with more is an error, so what is grouped by book and form stays bounded.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetlane.functions.text import column_letters, column_number, norm_ws, original_sheet_name
from packetlane.operators.mapping import WRITES, item_answers, item_writes, last_writes
from packetlane.sources.xlsx import book

#: Rows of a sheet, by its format.
ROWS = 1_048_576
KEYS = ["book", "item_index"]


def sheet_items(items: DataFrame, sheets: DataFrame) -> DataFrame:
    """Adds sheet, row and sheet_position to items (book, item_index, variant, form_type). Items without a form, or of a form without a sheet, go.

    sheets: form_type, sheet, start_row. A form's sheet stands where its first item is among the items of its book, its twin (variant 1) half a place behind.
    """
    of = Window.partitionBy("book", "form_type", "variant")
    placed = items.where("form_type <> ''").join(sheets.select("form_type", "sheet", "start_row"), "form_type")
    row = F.col("start_row") + F.row_number().over(of.orderBy("item_index")) - 1
    placed = placed.withColumn("row", F.when(row <= ROWS, row).otherwise(F.raise_error(F.concat(F.lit("more than a sheet's rows in "), F.col("sheet")))))
    position = F.min("item_index").over(of) + F.col("variant") / 2
    return placed.withColumns({"sheet_position": position, "sheet": F.when(F.col("variant") == 1, original_sheet_name(F.col("form_type"))).otherwise(F.col("sheet"))})


def sheet_places(answers: DataFrame, sheets: DataFrame) -> DataFrame:
    """book, form_type and place: the number of a form's sheet in its book, from 1, in the order of the first items of forms (then by form).

    Only firsts of forms go on from the scan and are counted by book; a book has as many as there are forms with a sheet.
    """
    forms = answers.select("book", "item_index", norm_ws(F.coalesce("form_type", F.lit(""))).alias("form_type")).where("form_type <> ''")
    first = forms.join(sheets.select("form_type").distinct(), "form_type", "left_semi").groupBy("book", "form_type").agg(F.min("item_index").alias("first"))
    return first.select("book", "form_type", F.row_number().over(Window.partitionBy("book").orderBy(F.asc_nulls_last("first"), "form_type")).alias("place"))


def fill_workbook(answers: DataFrame, entries: DataFrame, sheets: DataFrame, *, original: DataFrame | None = None, stamps: DataFrame | None = None, headers: DataFrame | None = None, hidden: DataFrame | None = None, numbered: bool = False) -> DataFrame:
    """All cells of a run's books: book, sheet, sheet_position, row, column, value. answers: book, item_index and those of `mapping.fill_cells`; entries as there.

    original: answers as they were read; each form that was filled then has a second sheet behind the first. stamps: form_type, column, value of the row that
    every data row starts from. headers: form_type, row, column, value of cells above the data. hidden: form_type, column of columns
    that are never written. numbered: sheet_position counts the sheets of a book from 1, in place of the first item of each, which joins the items with
    their sheets' numbers. Answers of both sheets go through together: one exchange by item, one by sheet.
    """
    every = answers.withColumn("variant", F.lit(0))
    if original is not None:
        every = every.unionByName(original.withColumn("variant", F.lit(1)), allowMissingColumns=True)
    items = item_answers(every, [*KEYS, "variant"])
    if numbered:  # only forms with a main sheet have a place
        places = sheet_places(answers, sheets).select(F.col("book").alias("__book"), F.col("form_type").alias("__form"), "place")
        of_sheet = F.col("book").eqNullSafe(F.col("__book")) & (F.col("form_type") == F.col("__form"))  # a book without a name keeps its sheets
        items = sheet_items(items.join(places, of_sheet).drop("__book", "__form"), sheets).withColumn("sheet_position", F.col("place") + F.col("variant") / 2).drop("place")
    else:
        items = sheet_items(items, sheets)
        if original is not None:  # a twin has a sheet to stand behind
            main = F.max(F.when(F.col("variant") == 0, 1)).over(Window.partitionBy("book", "form_type"))
            first = F.min(F.when(F.col("variant") == 0, F.col("item_index"))).over(Window.partitionBy("book", "form_type"))
            items = items.withColumns({"__main": main, "sheet_position": first + F.col("variant") / 2}).where("__main = 1").drop("__main")
    rows = item_writes(items, entries)
    if hidden is not None:
        closed = hidden.groupBy("form_type").agg(F.collect_set("column").alias("closed"))
        rows = rows.join(closed, "form_type", "left").withColumn("writes", F.filter("writes", lambda w: ~F.array_contains(F.coalesce("closed", F.array().cast("array<string>")), w["column"]))).drop("closed")
    if stamps is not None:
        under = stamps.groupBy("form_type").agg(F.collect_list(F.struct("column", "value")).cast(WRITES).alias("under"))
        rows = rows.join(under, "form_type", "left").withColumn("writes", F.concat(F.coalesce("under", F.array().cast(WRITES)), "writes")).drop("under")
    keys = ["book", "form_type", "variant", "sheet", "sheet_position", "row"]
    if headers is not None:
        # the first row of a sheet brings its headers
        above = headers.groupBy("form_type").agg(F.collect_list(F.struct(F.col("row").cast("long").alias("row"), "column", "value")).alias("above"))
        of_first = F.when(F.row_number().over(Window.partitionBy("book", "form_type", "variant").orderBy("row")) == 1, F.col("above"))
        rows = rows.join(above, "form_type", "left").withColumn("above", of_first)
        own = F.transform("writes", lambda w: F.struct(F.col("row").cast("long").alias("row"), w["column"].alias("column"), w["value"].alias("value")))
        wide = rows.withColumn("all", F.concat(F.coalesce("above", F.array().cast("array<struct<row:bigint,column:string,value:string>>")), own))
        flat = wide.select(*[k for k in keys if k != "row"], F.posexplode("all").alias("turn", "w"))
        cells = flat.groupBy(*[k for k in keys if k != "row"], F.col("w.row").alias("row"), F.col("w.column").alias("column")).agg(F.max_by("w.value", "turn").alias("value"))
    else:
        cells = last_writes(rows, keys)
    return cells.select("book", "sheet", "sheet_position", "row", "column", "value")


def hide_columns(cells: DataFrame, hidden: DataFrame) -> DataFrame:
    """Cells that are in no hidden column. hidden: sheet, first, last (letters; last may be null)."""
    span = hidden.select("sheet", column_number(F.col("first")).alias("low"), column_number(F.coalesce("last", "first")).alias("high"))
    columns = span.select("sheet", F.explode(F.sequence("low", "high")).alias("n")).select("sheet", column_letters(F.col("n")).alias("column"))
    return cells.join(columns.distinct(), ["sheet", "column"], "left_anti")


def workbooks(cells: DataFrame) -> DataFrame:
    """book and content: one xlsx file for each book, its sheets in their order."""

    def build(t: pd.DataFrame) -> pd.DataFrame:
        sheets = [(name, [(int(r), c, v) for r, c, v in zip(g["row"], g["column"], g["value"], strict=True)]) for (_, name), g in t.groupby(["sheet_position", "sheet"], sort=True)]
        return pd.DataFrame({"book": [t["book"].iloc[0]], "content": [book(sheets)]})

    return cells.select(F.col("book").cast("string").alias("book"), "sheet", F.col("sheet_position").cast("double").alias("sheet_position"), F.col("row").cast("long").alias("row"), "column", "value").groupBy("book").applyInPandas(build, "book string, content binary")


def row_bounds(cells: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """The last row with any value, and the last with an id, of each sheet."""
    full = F.coalesce(norm_ws(F.col("value")), F.lit("")) != ""
    return cells.groupBy(*keys).agg(F.max(F.when(full, F.col("row"))).alias("last_row"), F.max(F.when(full & (F.col("column") == id_column), F.col("row"))).alias("last_id_row"))
