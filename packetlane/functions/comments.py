"""What cell comments and cell colours are made of, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetlane.functions.text import heat_color, norm_ws

FUSION = "paddle_vlm_fusion"  # fixed value: the workflow whose comments show both readings


def _blank(c: Column) -> Column:
    return norm_ws(F.coalesce(c, F.lit("")))


def comment_raw(kind: Column, value: Column, page_text: Column, line_text: Column, workflow: Column, text_source: Column, fused: Column) -> Column:
    """The evidence behind a cell: of text fields what the readers read, by workflow or source; of others the value itself."""
    page, line = _blank(page_text), _blank(line_text)
    known = lambda *cs: F.coalesce(*[F.when(c != "", c) for c in cs], value)
    flow, source = F.lower(_blank(workflow)), F.lower(_blank(text_source))
    both = F.concat(F.lit("'"), line, F.lit("' + '"), page, F.lit("' = '"), F.coalesce(fused, value, F.lit("")), F.lit("'"))
    text = F.when(flow == FUSION, both).when(source == "paddle", known(line)).when(source.isin("vision", "vlm"), known(page)).otherwise(known(page, line))
    return F.when(F.lower(_blank(kind)) == "text", text).otherwise(value)


def source_file_name(*candidates: Column, stem: Column | None = None) -> Column:
    """The last part of the first path that is not blank, else the stem."""
    names = [F.when(F.coalesce(c, F.lit("")) != "", F.regexp_extract(c, r"([^/]*)/*\z", 1)) for c in candidates]
    return F.coalesce(*names, *([F.trim(stem)] if stem is not None else []), F.lit(""))


def text_score(kind: Column, *scores: Column) -> Column:
    """The first usable score of a text field, held to [0, 1]; null for other fields."""
    usable = [F.when(~F.isnan(s.try_cast("double")), s.try_cast("double")) for s in scores]
    return F.when(F.lower(_blank(kind)) == "text", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(*usable))))


def heat_fill(enabled: Column, kind: Column, *scores: Column) -> Column:
    """A cell's colour, where colours are on and the field has a score."""
    return F.when(enabled, heat_color(text_score(kind, *scores)))


def template_pairs(spec: Column) -> Column:
    """Replacements of a comment's template, from JSON: an object, or a list of objects with find (key, from) and replace (value, to)."""
    as_map = F.from_json(F.when(F.startswith(F.trim(spec), F.lit("{")), spec), "map<string,string>")
    rows = F.from_json(F.when(F.startswith(F.trim(spec), F.lit("[")), spec), "array<map<string,string>>")
    of = lambda m, *keys: F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in keys])
    pairs = F.filter(F.transform(rows, lambda m: F.struct(of(m, "find", "key", "from").alias("k"), F.coalesce(of(m, "replace", "value", "to"), F.lit("")).alias("v"))), lambda p: F.coalesce(p["k"], F.lit("")) != "")
    return F.coalesce(F.map_entries(as_map).cast("array<struct<k:string,v:string>>"), pairs)
