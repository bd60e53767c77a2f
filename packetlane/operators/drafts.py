"""Mappings before they are used: proposed ones made regular, a preview of what each row writes, and the workbook columns they reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlane.functions.comments import template_pairs
from packetlane.functions.text import float_text
from packetlane.operators.mapping import chosen
from packetlane.operators.validation import TYPES

_HEAD = "sheet string, start_row string, mappings string"
_PAIR = "key string, value string, column string"
_ROW = "type string, source string, column string, transform string, map_entries array<string>, default string, choices array<string>, mark string, no_answer string, blank string, value string"
# What stands in a preview for the answers and for the placeholders of comments.
SAMPLES = {"id": "601034A", "form_type": "6post", "page_odd": "1", "page_even": "1"}
DROP_INS = {"{ocr_confidence}": "high (0.980)", "{ocr_confidence_score}": "0.980", "{ocr_confidence_label}": "high", "{file_name}": "sample.pdf", "{pdf_stem}": "sample", "{pdf_pages}": "1-2", "{page_numbers}": "1-2", "{page_odd}": "1", "{page_even}": "2"}


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _object(c: Column) -> Column:
    return F.coalesce(F.startswith(F.ltrim(c), F.lit("{")) & F.try_parse_json(c).isNotNull(), F.lit(False))


def proposed_entries(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """answers (form_type, fallback_sheet, fallback_start_row, JSON text, others) with `sheet`, `start_row`, `entries` and `problem`.

    `problem` is null, or says what makes the answer unusable; `entries` is then null. Entries are structs in order: row, type, source, column,
    transform, map, default, choices, mark, no_answer, blank, value; fields that a type doesn't have are null. Of equal keys the last counts.
    No shuffle: an answer is one row throughout.
    """
    a = answers.withColumn("__h", F.from_json(F.when(_object(F.col(answer)), F.col(answer)), _HEAD))
    a = a.withColumn("__rows", F.from_json(F.when(F.startswith(F.col("__h.mappings"), F.lit("[")), F.col("__h.mappings")), "array<string>"))
    a = a.withColumn("__rows", F.transform("__rows", lambda r, k: F.struct((k + 1).alias("row"), _object(r).alias("whole"), F.from_json(F.when(_object(r), r), _ROW).alias("r"))))
    kind = lambda r: F.lower(_text(r["r"]["type"]))

    def wrong(r: Column) -> Column:
        label = F.concat(F.lit("Generated row "), r["row"].cast("string"))
        return F.when(~r["whole"], F.concat(label, F.lit(" is not an object."))).when(~kind(r).isin(*TYPES), F.concat(label, F.lit(" has invalid type '"), kind(r), F.lit("'.")))

    first = F.get(F.filter(F.transform("__rows", wrong), lambda m: m.isNotNull()), 0)
    problem = F.when(~_object(F.col(answer)) | F.col(answer).isNull(), "Generated result must be a JSON object.").when(F.coalesce(F.size("__rows"), F.lit(0)) < 1, "Generated mapping has no rows.").otherwise(first)

    def last_of(pairs: Column, value) -> Column:
        """A map in order of first keys with the last value of each."""
        kept = F.filter(F.transform(pairs, lambda p: F.struct(_text(p["key"]).alias("k"), value(p).alias("v"))), lambda p: p["k"] != "")
        keys = F.array_distinct(F.transform(kept, lambda p: p["k"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(kept, lambda p: p["k"] == k), -1)["v"].alias("value"))))

    def entry(r: Column) -> Column:
        e, t = r["r"], kind(r)
        pairs = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.from_json(F.when(_object(p), p), _PAIR)), lambda p: p.isNotNull())
        of = lambda types, c: F.when(t.isin(*types), c)
        empty_null = lambda c: F.when(c != "", c)
        fields = {
            "row": r["row"], "type": t, "source": of(("direct", "lookup", "multi_column"), _text(e["source"])), "column": of(("direct", "lookup", "static"), F.upper(_text(e["column"]))),
            "transform": of(("direct",), empty_null(F.lower(_text(e["transform"])))), "map": of(("lookup",), last_of(pairs(e["map_entries"]), lambda p: p["value"])), "default": of(("lookup",), e["default"]),
            "choices": of(("multi_column",), last_of(F.filter(pairs(e["choices"]), lambda p: _text(p["column"]) != ""), lambda p: F.upper(_text(p["column"])))), "mark": of(("multi_column",), F.coalesce(empty_null(e["mark"]), F.lit("Yes"))),
            "no_answer": of(("multi_column",), empty_null(F.upper(_text(e["no_answer"])))), "blank": of(("multi_column",), e["blank"]), "value": of(("static",), e["value"]),
        }
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    out = a.withColumns({"problem": problem, "sheet": F.coalesce(F.when(F.col("__h.sheet") != "", F.col("__h.sheet")), F.col("fallback_sheet"))})
    start = F.col("__h.start_row").try_cast("int")
    out = out.withColumns({"start_row": F.coalesce(F.when(start != 0, start), F.col("fallback_start_row")), "entries": F.when(F.col("problem").isNull(), F.transform("__rows", entry))})
    return out.drop("__h", "__rows", answer, "fallback_sheet", "fallback_start_row")


def preview_transform(raw: Column, transform: Column) -> Column:
    """upper, lower, or number: a whole number without its point, a fraction as it reads, anything else as it is."""
    kind, n = F.lower(F.trim(transform)), F.trim(raw).try_cast("double")
    number = F.when(n == F.floor(n), n.cast("decimal(38,0)").cast("string")).otherwise(float_text(n))
    return F.when(kind == "upper", F.upper(raw)).when(kind == "lower", F.lower(raw)).when(kind == "number", F.coalesce(number, raw)).otherwise(raw)


def sample(source: Column) -> Column:
    """What a preview shows as a field's answer: fixed ones for the fields of an item, `a` for question numbers, else the name."""
    out = F.when(source.rlike(r"\A\d+\z"), "a").otherwise(F.concat(F.lit("sample "), source))
    for name, text in SAMPLES.items():
        out = F.when(source == name, text).otherwise(out)
    return F.when(source != "", out).otherwise("")


def preview_comment(comment: Column, kind: Column, source: Column, raw: Column, value: Column) -> Column:
    """A comment's text (plain, or a JSON object with text, template or comment, and replacements) with all placeholders filled by samples."""
    whole = _object(comment)
    named = F.coalesce(*[F.when(F.get_json_object(comment, f"$.{k}") != "", F.get_json_object(comment, f"$.{k}")) for k in ("text", "template", "comment")], F.lit(""))
    own = F.coalesce(F.when(whole, template_pairs(F.get_json_object(comment, "$.replacements"))), F.array().cast("array<struct<k:string,v:string>>"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    fixed = [F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in [("{value}", empty(value)), ("{raw}", empty(raw)), ("{source}", source), ("{type}", empty(kind)), *[(k, F.lit(v)) for k, v in DROP_INS.items()]]]
    filled = F.aggregate(F.concat(own, F.array(*fixed)), F.when(whole, named).otherwise(empty(comment)), lambda text, p: F.replace(text, p["k"], empty(p["v"])))
    return F.when(F.contains(comment, F.lit("{")), F.trim(filled)).otherwise(F.trim(empty(comment)))


def preview_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, column, source, raw, value and comment: what each mapping row would write for a sample answer. Rows of unknown types show nothing."""
    kind, source = F.lower(_text(F.col("type"))), _text(F.col("source"))
    raw = F.when(kind == "static", "").otherwise(sample(source))
    found = F.coalesce(F.try_element_at("map", F.lower(F.trim(raw))), F.try_element_at("map", raw), F.col("default"), F.lit(""))
    value = F.when(kind == "static", F.coalesce("value", F.lit(""))).when(kind == "direct", preview_transform(raw, F.coalesce("transform", F.lit("")))).when(kind == "lookup", found).otherwise(F.coalesce("mark", F.lit("Yes")))
    column = F.when(kind == "multi_column", F.coalesce(chosen(raw, F.col("choices")), F.col("no_answer"), F.lit(""))).otherwise(F.coalesce("column", F.lit("")))
    shown = rows.where(kind.isin(*TYPES)).withColumns({"__raw": raw, "__value": value, "__source": F.when(kind == "static", "").otherwise(source), "__column": column})
    said = preview_comment(F.col("comment"), F.col("type"), F.col("__source"), F.when(kind == "static", F.col("__value")).otherwise(F.col("__raw")), F.col("__value"))
    return shown.select(*keys, "row", F.col("__column").alias("column"), F.when(kind == "static", "static").otherwise(F.col("__source")).alias("source"), F.col("__raw").alias("raw"), F.col("__value").alias("value"), said.alias("comment"))


def reached_columns(columns: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of workbooks and those that mappings name, one row each: what columns holds, `mapped`, and `rows` of mappings that miss the workbook.

    columns: keys, column, others; targets: keys, row, column (as validation.destinations gives them). A workbook without any known column
    has none that could be missed. Both sides are grouped before they meet, so a column that very many rows name is one row.
    """
    named = targets.select(*keys, F.upper(F.trim("column")).alias("column"), "row").where("column <> ''").groupBy(*keys, "column").agg(F.array_sort(F.collect_set("row")).alias("__rows"))
    known = columns.withColumn("column", F.upper(F.trim("column"))).where("column <> ''").withColumn("__known", F.lit(True))
    books = known.select(*keys).distinct().withColumn("__book", F.lit(True))
    met = known.join(named, [*keys, "column"], "full").join(books, keys, "left")
    missed = F.col("__known").isNull() & F.col("__book").isNotNull()
    return met.withColumns({"mapped": F.col("__rows").isNotNull(), "missed_rows": F.when(missed, F.col("__rows"))}).drop("__rows", "__known", "__book")
