"""Proposed mappings, previews and doubts on rows that are worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from packetlane.functions import meta as M
from packetlane.operators import drafts


@pytest.mark.parametrize(
    ("answer", "problem"),
    [
        (None, "Generated result must be a JSON object."),
        ("[]", "Generated result must be a JSON object."),
        ("{broken", "Generated result must be a JSON object."),
        ('{"mappings": []}', "Generated mapping has no rows."),
        ('{"mappings": {"type": "static"}}', "Generated mapping has no rows."),
        ('{"mappings": [{"type": "static"}, 7]}', "Generated row 2 is not an object."),
        ('{"mappings": [{"column": "A"}, 7]}', "Generated row 1 has invalid type ''."),
    ],
)
def test_unusable_proposals(spark, answer, problem):
    row = drafts.proposed_entries(spark.createDataFrame([("f", "S", 4, answer)], "form_type string, fallback_sheet string, fallback_start_row int, answer string")).first()
    assert (row["problem"], row["entries"], row["form_type"]) == (problem, None, "f")


def test_proposal(spark):
    rows = [
        {"type": "LOOKUP", "source": " 7 ", "column": "b", "map_entries": [{"key": "k", "value": 1}, 5, {"key": "", "value": "x"}, {"key": "k", "value": None}, {"key": "z", "value": ""}], "default": 0, "transform": "upper"},
        {"type": "multi_column", "source": "8", "column": "Q", "choices": [{"key": "a", "column": " c "}, {"key": "b"}, {"key": "a", "column": "d"}], "blank": "", "no_answer": " "},
        {"type": "static", "source": "s", "column": None, "value": 2026},
    ]
    answer = json.dumps({"sheet": "", "start_row": 6, "mappings": rows})
    got = drafts.proposed_entries(spark.createDataFrame([("f", "S", 4, answer)], "form_type string, fallback_sheet string, fallback_start_row int, answer string")).first()
    assert (got["problem"], got["sheet"], got["start_row"]) == (None, "S", 6)
    lookup, several, static = (e.asDict() for e in got["entries"])
    assert lookup == {"row": 1, "type": "lookup", "source": "7", "column": "B", "transform": None, "map": {"k": None, "z": ""}, "default": "0", "choices": None, "mark": None, "no_answer": None, "blank": None, "value": None}
    assert (several["choices"], several["mark"], several["blank"], several["no_answer"], several["column"]) == ({"a": "D"}, "Yes", "", None, None)
    assert (static["source"], static["column"], static["value"]) == (None, "", "2026")


def test_preview_transform(spark):
    d = spark.createDataFrame([("1", "number"), (" 2.50 ", "Number"), ("1e3", "number"), ("x", "number"), ("Ab", " upper"), ("Ab", "lower"), ("Ab", "other"), (None, "upper")], "x string, t string")
    assert [r["v"] for r in d.select(drafts.preview_transform(F.col("x"), F.col("t")).alias("v")).collect()] == ["1", "2.5", "1000", "x", "AB", "ab", "Ab", None]


def test_doubts(spark):
    cases = {'{"self_evaluation": {"ambiguities": "7"}}': True, '{"self_evaluation": {"ambiguities": "[]"}}': True, '{"self_evaluation": {"ambiguities": []}}': False, '{"self_evaluation": [1]}': False, "{}": False, "no": False, '{"self_evaluation": {"reason_for_confidence": "cut off"}}': True, '{"self_evaluation": {"missing_regions": {"a": 1}}}': False}
    d = spark.createDataFrame([(c,) for c in [*cases, None]], "c string")
    assert {r["c"]: r["u"] for r in d.select("c", M.uncertain(F.col("c")).alias("u")).collect()} == cases | {None: False}


def test_books_without_columns_miss_none(spark):
    columns = spark.createDataFrame([("x", "a", 5)], "book string, column string, width int")
    targets = spark.createDataFrame([("x", "b", 2), ("x", "B ", 1), ("x", " A", 1), ("y", "c", 3), ("x", " ", 9)], "book string, column string, row int")
    got = {(r["book"], r["column"]): (r["width"], r["mapped"], r["missed_rows"]) for r in drafts.reached_columns(columns, targets, ["book"]).collect()}
    assert got == {("x", "A"): (5, True, None), ("x", "B"): (None, True, [1, 2]), ("y", "C"): (None, True, None)}
