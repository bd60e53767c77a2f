"""Spreadsheet rows from declarative column mappings, and checks of mappings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlane.functions.text import norm_ws, parse_date, parse_number, strip_control

TRANSFORMS = {"upper": F.upper, "lower": F.lower, "number": parse_number, "date": lambda c: F.coalesce(F.date_format(parse_date(c), "yyyy-MM-dd"), c)}


def lookup(raw: Column, table: Column, default: Column) -> Column:
    """A mapped value that is empty counts as missing; then the raw key; then the default."""
    lower = F.try_element_at(table, F.lower(F.trim(raw)))
    return F.coalesce(F.when(lower != "", lower), F.try_element_at(table, raw), default)


def entry_value(raw: Column, transform: str | None) -> Column:
    """Unknown transforms leave the text as it is."""
    return TRANSFORMS[transform](raw) if transform in TRANSFORMS else raw


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv]).cast("map<string,string>") if d else F.create_map().cast("map<string,string>")


def row_cells(entries: list[dict], source: dict[str, Column]) -> dict[str, Column]:
    """Cells by column letter from mapping entries (static, direct, lookup, multi_column); later entries overwrite earlier ones.

    source: the columns that entries may name. A missing source writes nothing; an unknown type is an error.
    """
    cells: dict[str, Column] = {}

    def write(column: str, value: Column):
        value = strip_control(value)
        cells[column] = F.coalesce(value, cells[column]) if column in cells else value

    none = F.lit(None).cast("string")
    for e in entries:
        kind = e["type"]
        raw = source.get(e.get("source", ""), none)
        if kind == "static":
            write(e["column"], F.lit(str(e["value"])))
        elif kind == "direct":
            write(e["column"], entry_value(raw, e.get("transform")))
        elif kind == "lookup":
            default = F.lit(e["default"]) if "default" in e else none
            write(e["column"], F.when(raw.isNotNull(), lookup(raw, _map(e["map"]), default)))
        elif kind == "multi_column":
            mark, target = F.lit(e.get("mark", "Yes")), chosen(raw, _map(e["choices"]))
            for column in dict.fromkeys(e["choices"].values()):
                write(column, F.when(target == column, mark).otherwise(F.lit(e["blank"]) if "blank" in e else none))
            if "no_answer" in e:
                write(e["no_answer"], F.when(raw.isNull(), mark))
        else:
            raise ValueError(f"unknown mapping type {kind!r}")
    return cells


def fill_rows(items: DataFrame, keys: list[str], entries: list[dict], source: dict[str, Column]) -> DataFrame:
    """One row for each item: its keys and a column for each cell. No shuffle: cells are expressions."""
    return items.select(*keys, *[v.alias(k) for k, v in sorted(row_cells(entries, source).items())])


#: Columns of a table of entries, beside form_type and entry_pos; those that it lacks are null, a missing type is direct.
ENTRY = {"type": "string", "column": "string", "source": "string", "transform": "string", "value": "string", "map": "map<string,string>", "default": "string", "choices": "map<string,string>", "mark": "string", "blank": "string", "no_answer": "string"}
WRITES = "array<struct<column:string,value:string>>"
# Names that stand for a field of the item, whatever its answers are called.
ITEM_SOURCES = ("id", "form_type", "page_odd", "page_even")


def chosen(raw: Column, choices: Column) -> Column:
    """The column of an answer: by its lowered text, then by the text as it is; empty columns count as missing."""
    named = lambda key: F.when(F.try_element_at(choices, key) != "", F.try_element_at(choices, key))
    return F.coalesce(named(F.lower(F.trim(raw))), named(raw))


def entry_writes(e: Column, raw: Column) -> Column:
    """What one entry of a table writes, in order: an array of column and value. raw: the text of its source, or null."""
    none = F.array().cast(WRITES)
    cell = lambda column, value: F.struct(column.alias("column"), strip_control(value).alias("value"))
    one = lambda column, value: F.when(value.isNotNull() & (F.coalesce(column, F.lit("")) != ""), F.array(cell(column, value))).otherwise(none)
    kind, transform = F.lower(F.trim(F.coalesce(e["type"], F.lit("direct")))), F.lower(F.trim(e["transform"]))
    direct = reduce(lambda v, t: F.when(transform == t, TRANSFORMS[t](raw)).otherwise(v), TRANSFORMS, raw)
    mark = F.coalesce(e["mark"], F.lit("Yes"))
    blanks = F.when(e["blank"].isNull() | e["choices"].isNull(), none).otherwise(F.transform(F.map_values(e["choices"]), lambda c: cell(c, e["blank"])))
    marked = F.when(raw.isNull(), one(e["no_answer"], mark)).otherwise(one(chosen(raw, e["choices"]), mark))
    unknown = F.when(raw.isNull(), none).otherwise(F.raise_error(F.concat(F.lit("unknown mapping type "), kind)).cast(WRITES))
    sourced = F.when(kind == "direct", one(e["column"], direct)).when(kind == "lookup", F.when(raw.isNull(), none).otherwise(one(e["column"], lookup(raw, e["map"], e["default"]))))
    sourced = sourced.when(kind == "multi_column", F.concat(blanks, marked)).otherwise(unknown)
    return F.when(kind == "static", one(e["column"], e["value"])).when(F.coalesce(e["source"], F.lit("")) == "", none).otherwise(sourced)


def item_answers(answers: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each item: keys, form_type, its item-level fields and a map of its answers' texts.

    The first answer of a name counts. A blank one is missing, but an answer of kind `text` is then an empty text. One exchange, by item.
    """
    form = norm_ws(F.coalesce("form_type", F.lit("")))
    trimmed = lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    text = trimmed(F.coalesce("text", F.lit("")))
    kind = F.lower(F.trim("kind")) if "kind" in answers.columns else F.lit("")
    level = [c for c in ITEM_SOURCES if c in answers.columns and c not in (*keys, "form_type")]
    rows = answers.withColumn("form_type", form).select(*keys, "form_type", *level, "pos", trimmed(F.col("name")).alias("name"), F.when((text != "") | F.coalesce(kind == "text", F.lit(False)), text).alias("text"))
    first = rows.repartition(*keys, "form_type").groupBy(*keys, "form_type", "name").agg(F.min(F.struct("pos", "text")).alias("a"), *[F.max(c).alias(c) for c in level])
    texts = F.map_from_entries(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "a.text"))))  # as many as an item has fields
    return first.groupBy(*keys, "form_type").agg(texts.alias("answers"), *[F.max(c).cast("string").alias(c) for c in level])


def form_entries(entries: DataFrame) -> DataFrame:
    """form_type and its entries in order, one row for each form."""
    entries = entries.withColumnRenamed("name", "source") if "source" not in entries.columns else entries
    columns = [(F.col(c) if c in entries.columns else F.lit(None)).cast(t).alias(c) for c, t in ENTRY.items()]
    rows = entries.select("form_type", F.struct(F.col("entry_pos").cast("long").alias("entry_pos"), *columns).alias("e"))
    placed = F.array_sort(F.collect_list("e"), lambda x, y: F.when(x["entry_pos"] < y["entry_pos"], -1).when(x["entry_pos"] > y["entry_pos"], 1).otherwise(0))
    return rows.groupBy("form_type").agg(placed.alias("entries"))


def item_writes(items: DataFrame, entries: DataFrame) -> DataFrame:
    """items of `item_answers` with what all entries of their form write, in order. Forms are few, items many: no exchange of items where Spark finds the entries small."""
    has = set(items.columns)

    def writes(e: Column) -> Column:
        raw = F.try_element_at("answers", e["source"])
        for c in ITEM_SOURCES:
            raw = F.when(e["source"] == c, F.trim(c) if c in has else F.lit(None).cast("string")).otherwise(raw)
        return entry_writes(e, raw)

    out = items.join(form_entries(entries), "form_type", "left")
    return out.withColumn("writes", F.coalesce(F.flatten(F.transform("entries", writes)), F.array().cast(WRITES))).drop("entries")


def last_writes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, column and value from rows with `writes`: later writes of a cell stand."""
    flat = rows.select(*keys, F.posexplode("writes").alias("turn", "w"))
    return flat.groupBy(*keys, F.col("w.column").alias("column")).agg(F.max_by("w.value", "turn").alias("value"))


def fill_cells(answers: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, column and value from long tables. answers: keys, form_type, name, text, pos, and kind, id, page_odd, page_even where it has them.

    entries: form_type, entry_pos, source (or name) and those of ENTRY. Cells are grouped in the partitions that items are in.
    """
    return last_writes(item_writes(item_answers(answers, keys), entries), [*keys, "form_type"]).drop("form_type")


def in_ranges(rows: DataFrame, ranges: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """Range join: a range stands in the two buckets or fewer of its own size class that it can touch, so wide ranges make no more rows than narrow ones.

    Size classes are powers of two; a row looks into one bucket of each class that ranges have (64 at most), then the exact test decides.
    """
    span = F.greatest(F.lit(1.0), F.col(high).cast("double") - F.col(low).cast("double"))
    sized = ranges.where(F.col(low) <= F.col(high)).withColumn("__c", F.ceil(F.log2(span)).cast("int"))
    classes = sized.agg(F.coalesce(F.collect_set("__c"), F.array()).alias("__classes"))  # one row
    bucket = lambda c, k: F.floor(c / F.pow(F.lit(2.0), k))
    placed = sized.withColumn("__b", F.explode(F.array_distinct(F.array(bucket(F.col(low), F.col("__c")), bucket(F.col(high), F.col("__c"))))))
    looking = rows.crossJoin(F.broadcast(classes)).withColumn("__c", F.explode("__classes")).withColumn("__b", bucket(F.col(value), F.col("__c"))).drop("__classes")
    return looking.join(placed, ["__c", "__b"]).where(F.col(value).between(F.col(low), F.col(high))).drop("__b", "__c")


def issues(*rules: tuple[DataFrame, str, str, str]) -> DataFrame:
    """Rows of (rows with a column `subject`, code, severity, message) in one table."""
    parts = [rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col("subject").cast("string").alias("subject"), F.lit(message).alias("message")) for rows, code, severity, message in rules]
    return reduce(DataFrame.unionByName, parts)


def missing(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known."""
    return rows.join(known.select(key).distinct(), key, "left_anti")
