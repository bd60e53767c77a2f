"""Repair of semi-structured answers: strict JSON first, then a ladder of patterns; Arrow UDFs only for brace scanning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlane.functions.text import NULL_WORDS, blank_to_null


def fenced(c: Column) -> Column:
    """The inside of the first fenced block, else the text."""
    inside = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(inside != "", inside).otherwise(c)


def json_part(c: Column) -> Column:
    """The part of a text that is JSON: a fenced block, the whole text, or the span from the first brace to the last; else null."""
    span = F.regexp_extract(c, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull(), x) for x in (F.trim(c), F.trim(fenced(c)), F.when(span != "", span))])


def parse_jsonish(c: Column) -> Column:
    """VARIANT of the part of a text that is JSON."""
    return F.parse_json(json_part(c))


def malformed_value(c: Column) -> Column:
    """The value of a broken one-key object: a missing colon, a bare value, single quotes, or `key: value`."""
    t = fenced(c)
    patterns = (r"\{\s*\"[^\":]*\"\s+\"([^\"]*)\"\s*\}", r"\{\s*\"[^\":]*:?\s*\"?\s*:\s*\"([^\"]*)\"\s*\}", r"\{\s*\"[^\":]*:\s*\"([^\"]*)\"", r"\{\s*\"[^\"]*\"\s*:\s*([^\"\s,{}\[\]][^,{}\[\]]*?)\s*\}", r"\{\s*'[^']*'\s*:\s*'([^']*)'\s*\}", r"\A\s*[A-Za-z][^:{}\n]*:\s*([^{}\n]+?)\s*\z")
    return F.coalesce(*[F.when(t.rlike(p), F.regexp_extract(t, p, 1)) for p in patterns])


# Keys of an answer that are no text.
NOT_TEXT = ("confidence", "confidence_score", "confidence_label", "needs_human_review")


def scalars(members: Column) -> Column:
    """(key, value) of the members of a map of VARIANT, in their order, that are truth values, numbers or texts with more than blanks."""
    kind = lambda v: F.schema_of_variant(v)
    text = F.transform(F.map_entries(members), lambda e: F.struct(e["key"].alias("key"), F.when(~kind(e["value"]).rlike(r"\A(?:OBJECT|ARRAY|VOID)"), F.variant_get(e["value"], "$", "string")).alias("value")))
    return F.filter(text, lambda e: e["value"].rlike(r"(?U)\S"))


def first_scalar_of(members: Column) -> Column:
    """Text of the first scalar of an object: detected_text and text before others, NOT_TEXT never; members in the order of the document."""
    every = scalars(members)
    first = lambda wanted: F.try_element_at(F.filter(every, wanted), F.lit(1))["value"]
    named = [first(lambda e: e["key"] == "detected_text"), first(lambda e: e["key"] == "text")]
    return F.coalesce(*named, first(lambda e: ~e["key"].isin(*NOT_TEXT)))


def first_scalar(c: Column) -> Column:
    """Of the object in a text, else null."""
    return first_scalar_of(F.from_json(F.regexp_extract(json_part(c), r"(?s)\A\s*(\{.*)", 1), "map<string,variant>"))


def scalar_text(c: Column) -> Column:
    """Of the object in a text, empty if it has none, repaired only where no object is found, else null; null words become empty text."""
    is_object = F.coalesce(F.startswith(json_part(c), F.lit("{")), F.lit(False))
    got = F.trim(F.when(is_object, F.coalesce(first_scalar(c), F.lit(""))).otherwise(malformed_value(c)))
    return F.when(F.lower(got).isin(*NULL_WORDS), "").otherwise(got)


def conforming(c: Column) -> Column:
    """Whether a text is a JSON object with one scalar, or null."""
    v = F.try_parse_json(c)
    m = F.from_json(F.to_json(v), "map<string,string>")
    return F.coalesce((F.size(m) == 1) & ~F.map_values(m)[0].rlike(r"\A[\[{]"), blank_to_null(c).isNull())


def objects_in(text: str) -> list[tuple[int, int]]:
    """(start, end) of each complete top-level object in a text; braces in strings don't count."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, ch in enumerate(text):
        if quoted:
            escaped, quoted = (ch == "\\" and not escaped), not (ch == '"' and not escaped)
        elif ch == '"' and depth:
            quoted = True
        elif ch == "{":
            start = i if depth == 0 else start
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append((start, i + 1))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_blocks(s: pd.Series) -> pd.Series:
    """All complete objects of a text."""
    return s.map(lambda t: None if t is None else [t[a:b] for a, b in objects_in(t)])
