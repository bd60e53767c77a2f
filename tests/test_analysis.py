"""Rows of pages, their review, outcomes and names of workbooks on cases at the edge of each rule."""

from packetlane.operators import analysis


def test_page_rows(spark):
    texts = spark.createDataFrame(
        [("r", 1, "odd", "f", "a", "x", "t", 0.12345678, 0.5, "HIGH", True), ("", 1, "odd", "f", "b", "x", None, None, 0.5, None, None), (None, 2, "odd", None, "a", None, "u", None, None, None, None)],
        "run string, item int, page string, form_type string, side string, name string, text string, score double, min_score double, label string, needs_review boolean",
    )
    answers = spark.createDataFrame([("r", 1, "odd", "1", None), ("r", 1, "odd", "1", "b")], "run string, item int, page string, question string, answer string")
    settings = spark.createDataFrame([("f", "a", "x", " \\d "), ("f", "a", "x", " "), (None, "a", None, "no")], "form_type string, side string, name string, output_regex string")
    rows = analysis.page_rows(texts, answers, settings, ["run", "item", "page"])
    got = sorted(((r["kind"], r["text"], r["ocr_confidence_score"], r["review_ref"], r["_output_regex"], r["ocr_needs_human_review"]) for r in rows.collect()), key=repr)
    assert got == sorted([("text", "t", 0.123457, "r|1|odd|x|text", "\\d", True), ("text", "", 0.5, None, None, None), ("text", "u", None, None, None, None), ("mcq", "", None, "r|1|odd|1|mcq", None, None), ("mcq", "b", None, "r|1|odd|1|mcq", None, None)], key=repr)
    assert not [c for c in analysis.strip_internal(rows).columns if c.startswith("_")]
    bare = analysis.page_rows(texts.limit(0), answers.limit(0), settings.drop("output_regex"), ["run", "item", "page"])
    assert bare.count() == 0 and set(bare.columns) == set(rows.columns) - {"_output_regex"}


def test_review_context(spark):
    items = spark.createDataFrame([(1, "7", "a.png", "b.png", " ", "bm.png"), (2, None, "/etc/a.png", None, None, None)], "item int, form_type string, page_odd string, page_even string, page_odd_mcq string, page_even_mcq string")
    schemas = spark.createDataFrame([("7", "a"), ("7", "b")], "form_type string, side string")
    rows = [(k, *r) for k, r in enumerate([(1, "id", "even"), (1, "mcq", None), (1, "MCQ", "even"), (1, "text", "even"), (2, "id", ""), (3, "id", ""), (1, None, ""), (None, "text", "odd")])]
    pending = spark.createDataFrame(rows, "k int, item int, kind string, page_in_pair string")
    got = {r["k"]: (r["page"], r["side"], r["problem"]) for r in analysis.review_context(pending, items, schemas, ["item"], "/data").collect()}
    assert got == {
        0: ("/data/a.png", None, None), 1: ("/data/a.png", "a", None), 2: ("/data/bm.png", "b", None), 3: ("/data/b.png", "b", None),
        4: (None, None, "no page image"), 5: (None, None, "item_index out of range"), 6: (None, "a", "unsupported kind"), 7: (None, "a", "item_index out of range"),
    }


def test_outcomes(spark):
    rows = spark.createDataFrame([("m", "invalid_json", k, f"t{k}") for k in (5, 1, 3, 2)] + [("m", None, 9, ""), ("n", "unchanged", 1, "")], "model string, outcome string, k int, text string")
    got = {(r["model"], r["outcome"]): (r["n"], r["examples"] and [tuple(e) for e in r["examples"]]) for r in analysis.outcomes(rows, ["model"], "outcome", "k", ["k", "text"]).collect()}
    assert got == {("m", "invalid_json"): (4, [(1, "t1"), (2, "t2"), (3, "t3")]), ("m", None): (1, None), ("n", "unchanged"): (1, None)}
    assert analysis.outcomes(rows.limit(0), ["model"], "outcome", "k", ["k"]).count() == 0


def test_resolve_workbooks(spark):
    files = spark.createDataFrame([("", "B.xlsx"), ("", "b.XLSX"), (None, "a.xltx"), ("", "a.xlsx"), ("", "A.xlsm"), ("", "c.pdf"), ("Old", "z.xlsx"), ("Old", "Y.xlsm"), ("old", "x.xlsx"), ("a", "q.xlsx")], "folder string, file string")
    names = spark.createDataFrame([(n,) for n in ("a", "A", "a.xltx", "A.XLSX", "b", "b.XLSX", "c", "c.pdf", "Old", "OLD", "", None, "a")], "name string")
    got = {r["name"]: r["file"] for r in analysis.resolve_workbooks(names, files).collect()}
    assert got == {"a": "a.xlsx", "A": "A.xlsm", "a.xltx": "a.xltx", "A.XLSX": "a.xlsx", "b": "B.xlsx", "b.XLSX": "b.XLSX", "c": None, "c.pdf": None, "Old": "Old/Y.xlsm", "OLD": None, "": None, None: None}
    assert analysis.resolve_workbooks(names, files).count() == 13
