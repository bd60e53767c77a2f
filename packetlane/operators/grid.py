"""Structure of sheets: what merged ranges cover, and the grid of headers that a mapping shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlane.functions.text import column_letters, norm_ws


def in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], row: str = "row", col: str = "col") -> DataFrame:
    """Each point (keys, row, col) with each box (keys, row1, col1, row2, col2) of the same keys that holds it.

    Boxes are sorted into size classes by the powers of two of their height and width. A box stands in the buckets of its own class that it touches,
    four at most, and a point looks into one bucket of each class that there is, so neither large nor many boxes are spread over
    many buckets. The exact test decides.
    """
    size = lambda a, b: F.ceil(F.log2(F.greatest(F.lit(1.0), F.col(b).cast("double") - F.col(a).cast("double")))).cast("int")
    bucket = lambda x, k: F.floor(x / F.pow(F.lit(2.0), k)).cast("long")
    both = lambda a, b, k: F.array_distinct(F.array(bucket(F.col(a), F.col(k)), bucket(F.col(b), F.col(k))))
    sized = boxes.where("row1 <= row2 and col1 <= col2").withColumns({"__h": size("row1", "row2"), "__w": size("col1", "col2")})
    classes = sized.agg(F.coalesce(F.collect_set(F.struct("__h", "__w")), F.array()).alias("__classes"))  # one row, a few hundred classes at most
    placed = sized.withColumn("__r", F.explode(both("row1", "row2", "__h"))).withColumn("__c", F.explode(both("col1", "col2", "__w")))
    looking = points.crossJoin(F.broadcast(classes)).withColumn("__k", F.explode("__classes"))
    looking = looking.withColumns({"__h": F.col("__k.__h"), "__w": F.col("__k.__w"), "__r": bucket(F.col(row), F.col("__k.__h")), "__c": bucket(F.col(col), F.col("__k.__w"))}).drop("__classes", "__k")
    found = looking.join(placed, [*keys, "__h", "__w", "__r", "__c"])
    return found.where(F.col(row).between(F.col("row1"), F.col("row2")) & F.col(col).between(F.col("col1"), F.col("col2"))).drop("__h", "__w", "__r", "__c")


def merged_cover(cells: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """Texts spread over merged ranges: keys, row, col and text of every cell that a range covers, from the range's first cell; other cells keep theirs.

    cells: keys, row, col, text. merges: keys, row1, col1, row2, col2. Ranges of a sheet don't overlap by its format; where they do, the one that starts first counts.
    """
    head = cells.select(*keys, F.col("row").alias("row1"), F.col("col").alias("col1"), F.col("text"))
    spread = merges.select(*keys, "row1", "col1", "row2", "col2").join(head, [*keys, "row1", "col1"], "left")
    spread = spread.withColumn("row", F.explode(F.sequence("row1", "row2"))).withColumn("col", F.explode(F.sequence("col1", "col2")))
    covered = spread.groupBy(*keys, "row", "col").agg(F.min(F.struct("row1", "col1", "text")).alias("m"))
    return cells.select(*keys, "row", "col", F.col("text").alias("own")).join(covered, [*keys, "row", "col"], "full_outer").select(*keys, "row", "col", F.when(F.col("m").isNotNull(), F.col("m.text")).otherwise(F.col("own")).alias("text")).where("text is not null")


def sheet_columns(cells: DataFrame, merges: DataFrame, columns: DataFrame, keys: list[str], start_row: int = 4) -> DataFrame:
    """keys, col, column (letters), headers (texts above start_row from the top, merged ones spread, repeats once), start_value, width and hidden of each column that has a cell or a width."""
    spread = merged_cover(cells.where(F.col("row") < start_row), merges.where(F.col("row1") < start_row), keys)
    above = spread.where((F.col("row") < start_row) & (norm_ws(F.col("text")) != "")).groupBy(*keys, "col").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row", norm_ws(F.col("text")).alias("text")))), lambda x: x["text"])).alias("headers"))
    first = cells.where(F.col("row") == start_row).groupBy(*keys, "col").agg(F.max("text").alias("start_value"))
    wide = columns.select(*keys, F.explode(F.sequence("col1", "col2")).alias("col"), "width", "hidden").groupBy(*keys, "col").agg(F.max("width").alias("width"), F.max("hidden").alias("hidden"))
    out = above.join(first, [*keys, "col"], "full_outer").join(wide, [*keys, "col"], "full_outer")
    return out.select(*keys, "col", column_letters(F.col("col")).alias("column"), F.coalesce("headers", F.array().cast("array<string>")).alias("headers"), "start_value", "width", F.coalesce("hidden", F.lit(False)).alias("hidden"))


#: Rows of a sheet that a grid shows above its first row of data.
HEADER_ROWS = (1, 2)


def sheet_grid(known: DataFrame, mapped: DataFrame, cells: DataFrame, merges: DataFrame, keys: list[str], start_row: int = 4) -> DataFrame:
    """Cells of the grid: keys, col, row, value, kind, mapped, range, colspan, rowspan, hidden.

    known: keys, col of the sheet's columns. mapped: keys, col that a mapping writes. A grid shows mapped columns and their neighbours on both sides that
    the sheet has, all columns if none is mapped. A merged range that starts in the header rows stands in its first visible
    column, as wide as the visible columns that it covers; its other cells are hidden. merges: keys, pos, row1, col1, row2, col2, range; later ones count.
    """
    near = mapped.select(*keys, F.explode(F.array(F.col("col") - 1, F.col("col") + 1)).alias("col")).join(known.select(*keys, "col").distinct(), [*keys, "col"], "left_semi")
    some = mapped.select(*keys, "col").unionByName(near).distinct()
    visible = some.unionByName(known.select(*keys, "col").distinct().join(mapped.select(*keys).distinct(), keys, "left_anti"))
    rows = sorted({*HEADER_ROWS, start_row})
    last = max(HEADER_ROWS)
    heads = merges.where(F.col("row1").isin(*HEADER_ROWS) & (F.col("row2") >= F.col("row1"))).withColumn("row2", F.least("row2", F.lit(last)))
    over = in_boxes(visible.select(*keys, "col", F.explode(F.array(*map(F.lit, HEADER_ROWS))).alias("row")), heads, keys)
    of = Window.partitionBy(*keys, "pos")
    start = F.min("col").over(of)
    over = over.withColumns({"__start": start, "colspan": F.size(F.collect_set("col").over(of)), "rowspan": F.col("row2") - F.col("row1") + 1})
    info = over.where((F.col("col") != F.col("__start")) | (F.col("row") == F.col("row1")))
    first = F.col("col") == F.col("__start")
    cell = F.struct("pos", "range", F.when(first, F.col("colspan")).alias("colspan"), F.when(first, F.col("rowspan")).alias("rowspan"), (~first).alias("hidden"))
    info = info.groupBy(*keys, "col", "row").agg(F.max(cell).alias("m"))
    shown = visible.select(*keys, "col", F.explode(F.array(*map(F.lit, rows))).alias("row"))
    texts = cells.where(F.col("row").isin(*rows)).groupBy(*keys, "col", "row").agg(F.max("text").alias("value"))
    marked = mapped.select(*keys, "col", F.lit(True).alias("__mapped")).distinct()
    out = shown.join(texts, [*keys, "col", "row"], "left").join(info, [*keys, "col", "row"], "left").join(marked, [*keys, "col"], "left")
    data = F.col("row") == start_row
    return out.select(*keys, "col", "row", F.coalesce("value", F.lit("")).alias("value"), F.when(data, "data").otherwise("header").alias("kind"), (data & F.coalesce("__mapped", F.lit(False))).alias("mapped"), F.col("m.range").alias("range"), "m.colspan", "m.rowspan", F.coalesce("m.hidden", F.lit(False)).alias("hidden"))
