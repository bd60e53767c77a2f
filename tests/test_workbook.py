import io
import os
import zipfile

import pytest
from oracle import same_rows
from pyspark.sql import functions as F

from packetlane.functions import meta as M
from packetlane.operators import grid, normalize, pages, regions, validation, workbook
from packetlane.plans import catalog, forms
from packetlane.sources import xlsx


def test_books_of_several_sheets(spark, tmp_path):
    cells = spark.createDataFrame([("x", "Two", 2.0, 4, "B", "<b>"), ("x", "One", 1.0, 1, "AA", "far"), ("x", "One", 1.0, 1, "B", "near"), ("y", "Only", 1.0, 3, "A", None)], "book string, sheet string, sheet_position double, row int, column string, value string")
    got = {r.book: bytes(r.content) for r in workbook.workbooks(cells).collect()}
    assert set(got) == {"x", "y"}
    with zipfile.ZipFile(io.BytesIO(got["x"])) as z:
        assert list(xlsx.sheet_parts(z)) == ["One", "Two"]
    assert list(xlsx.cells(io.BytesIO(got["x"]), " two ")) == [[None, "<b>"]]
    assert next(iter(xlsx.cells(io.BytesIO(got["x"]))))[1] == "near" and next(iter(xlsx.cells(io.BytesIO(got["x"]))))[26] == "far"
    with pytest.raises(ValueError, match="no sheet"):
        list(xlsx.cells(io.BytesIO(got["x"]), "three"))
    (tmp_path / "x.xlsx").write_bytes(got["x"])
    spark.dataSource.register(xlsx.XlsxSource)
    assert spark.read.format("xlsx").option("sheet", "One").load(str(tmp_path)).columns[1] == "near"


def test_overwrite_and_empty_folder(spark, tmp_path):
    spark.dataSource.register(xlsx.XlsxSource)
    df = spark.createDataFrame([("1",)], "k string")
    for mode, n in (("append", 1), ("append", 2), ("overwrite", 1)):
        df.coalesce(1).write.format("xlsx").mode(mode).save(str(tmp_path / "out"))
        assert spark.read.format("xlsx").load(str(tmp_path / "out")).count() == n
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no xlsx file"):
        spark.read.format("xlsx").load(str(tmp_path / "none")).count()


def test_sheets_of_any_entries(spark, monkeypatch):
    answers = spark.createDataFrame([("x", 1, "f", "q", "a", 0), ("x", 2, "f", "q", None, 0)], "book string, item_index int, form_type string, name string, text string, pos int")
    sheets = spark.createDataFrame([("f", "F", 2)], "form_type string, sheet string, start_row int")
    entries = spark.createDataFrame([("f", 0, "strange", "q", "A")], "form_type string, entry_pos int, type string, source string, column string")
    with pytest.raises(Exception, match="unknown mapping type strange"):
        workbook.fill_workbook(answers, entries, sheets).collect()
    direct = entries.withColumn("type", F.lit("direct"))
    assert [tuple(r) for r in workbook.fill_workbook(answers, direct, sheets).collect()] == [("x", "F", 1.0, 2, "A", "a")]
    asked = answers.withColumn("kind", F.lit("text"))
    assert sorted(tuple(r)[3:] for r in workbook.fill_workbook(asked, direct, sheets).collect()) == [(2, "A", "a"), (3, "A", "")]
    # answers as read, of a form that has no sheet otherwise, make none
    assert workbook.fill_workbook(answers.where("false"), direct, sheets, original=answers).count() == 0
    monkeypatch.setattr(workbook, "ROWS", 2)
    with pytest.raises(Exception, match="more than a sheet's rows in F"):
        workbook.fill_workbook(asked, direct, sheets).collect()


def test_sheets_are_numbered_in_their_book(spark, tmp_path):
    # a status without a sheet takes no number; a book with one sheet, one with equal first orders, one with keys beyond exact doubles, one without a name
    orders = [(5, 1, "F"), (3, 1, "O"), (1, 1, "P"), (9, 1, "O"), (7, 2, "F"), (8, 3, "O"), (8, 3, "F"), (2**60 + 1, 4, "F"), (2**60, 4, "O"), (4, 5, "P"), (-2, 6, "O"), (-3, 6, "F")]
    table = spark.createDataFrame([(*o, "1-URGENT") for o in orders], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    table.toPandas().to_parquet(tmp_path / "orders.parquet")
    df = forms.workbook_cells(spark, str(tmp_path))
    done, open_ = ("Done", "F (Original)"), ("Open", "O (Original)")
    books = {1: [open_, done], 2: [done], 3: [done, open_], 4: [open_, done], 6: [done, open_]}
    want = {(b, name, place + half / 2) for b, pairs in books.items() for place, pair in enumerate(pairs, 1) for half, name in enumerate(pair)}
    assert {tuple(r) for r in df.select("book", "sheet", "sheet_position").collect()} == want
    same_rows(df, catalog.SQL["workbook_cells"], tmp_path)
    answers = spark.createDataFrame([(None, 7, " g ", "q", "a", 0), (None, 2, "f", "q", "b", 0)], "book string, item_index int, form_type string, name string, text string, pos int")
    sheets = spark.createDataFrame([("f", "F", 2), ("g", "G", 2)], "form_type string, sheet string, start_row int")
    entries = spark.createDataFrame([("f", 0, "q", "A"), ("g", 0, "q", "A")], "form_type string, entry_pos int, source string, column string")
    filled = workbook.fill_workbook(answers, entries, sheets, original=answers, numbered=True)
    assert sorted(tuple(r)[1:] for r in filled.collect()) == [("F", 1.0, 2, "A", "b"), ("G", 2.0, 2, "A", "a"), ("f (Original)", 1.5, 2, "A", "b"), ("g (Original)", 2.5, 2, "A", "a")]


def test_workbook_plan(spark, data):
    from packetlane.plans import forms

    plan = forms.workbook_types(spark, str(data))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 16
    assert plan.count("customer.parquet") <= 2 * 2


def test_commit_leaves_the_old_or_the_new(tmp_path, monkeypatch):
    folder = str(tmp_path / "out")
    seen = lambda: sorted(r[0] for f in xlsx.XlsxSource({"path": folder}).files() for r in list(xlsx.cells(f))[1:])
    writer = lambda overwrite: xlsx.XlsxWriter({"path": folder}, ["k"], overwrite)
    writer(False).commit([writer(False).write([("old",)])])
    lost = writer(True).write([("lost",)])  # an attempt that never commits
    assert seen() == ["old"]
    new = [writer(True).write([(v,)]) for v in ("new", "newer")]
    for broken in ("replace", "remove"):

        def stop(*a, real=getattr(os, broken)):
            if "part-" in str(a[-1]):
                raise KeyboardInterrupt
            return real(*a)

        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            m.setattr(xlsx.os, broken, stop)
            writer(True).commit(new)
        assert seen() == (["old"] if broken == "replace" else ["new", "newer"])
    writer(False).abort([lost])
    assert not [n for n in os.listdir(folder) if n.endswith(".tmp")]


def test_structure_of_files(spark, tmp_path):
    sheets = [("One", [(1, "A", "top"), (2, "A", "left"), (2, "B", "right"), (4, "A", "<5>"), (4, "C", "z")]), ("Two", [(1, "B", "x")])]
    (tmp_path / "b.xlsx").write_bytes(xlsx.book(sheets, {"One": ([(1, 2, 12.5, False), (3, 4, None, True)], ["A1:B1", "C1:D3"])}))
    spark.dataSource.register(xlsx.XlsxStructure)
    got = spark.read.format("xlsx_structure").load(str(tmp_path))
    assert {(r.sheet, r.row1, r.col1, r.text) for r in got.where("kind = 'cell'").collect()} == {(s, r, xlsx.number(c), v) for s, cells in sheets for r, c, v in cells}
    assert sorted(tuple(r) for r in got.where("kind = 'merge'").select("sheet", "row1", "col1", "row2", "col2", "text").collect()) == [("One", 1, 1, 1, 2, "A1:B1"), ("One", 1, 3, 3, 4, "C1:D3")]
    assert sorted((r.col1, r.col2, r.width, r.hidden) for r in got.where("kind = 'column'").collect()) == [(1, 2, 12.5, False), (3, 4, None, True)]
    part = lambda kind, *c: got.where(f"kind = '{kind}'").select("sheet", *c)
    cells = part("cell", F.col("row1").alias("row"), F.col("col1").alias("col"), "text")
    columns = grid.sheet_columns(cells, part("merge", "row1", "col1", "row2", "col2"), part("column", "col1", "col2", "width", "hidden"), ["sheet"]).where("sheet = 'One'")
    assert [tuple(r)[2:] for r in columns.orderBy("col").collect()] == [("A", ["top", "left"], "<5>", 12.5, False), ("B", ["top", "right"], None, 12.5, False), ("C", [], "z", None, True), ("D", [], None, None, True)]
    shared = tmp_path / "s.xlsx"
    with zipfile.ZipFile(tmp_path / "b.xlsx") as a, zipfile.ZipFile(shared, "w") as z:
        for n in a.namelist():
            body = a.read(n)
            z.writestr(n, body.replace(b'<c r="A1" t="inlineStr"><is><t xml:space="preserve">top</t></is></c>', b'<c r="A1" t="s"><v>1</v></c>'))
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>no</t></si><si><r><t>to</t></r><r><t>p!</t></r></si></sst>')
    assert next(x for x in xlsx.structure(shared) if x[2] == "cell")[7] == "top!"


def test_hidden_columns_and_bounds(spark):
    cells = spark.createDataFrame([("S", 1, "A", "x"), ("S", 9, "AB", " "), ("S", 5, "AB", "y"), ("S", 2, "B", "1234567A")], "sheet string, row int, column string, value string")
    hidden = spark.createDataFrame([("S", "AA", "AC"), ("S", "A", None), ("T", "B", "B")], "sheet string, first string, last string")
    assert [r.column for r in workbook.hide_columns(cells, hidden).collect()] == ["B"]
    assert tuple(workbook.row_bounds(cells, ["sheet"], "B").first()) == ("S", 5, 2)


def test_batch_normalize_by_clusters(spark):
    from difflib import SequenceMatcher

    values = ["Riverside"] * 3 + ["Lakeview"] * 2 + ["Rivrside", "Riversde School", "lakeviev", "school", "zzz", "12-3", "n/a", "Lakeview"]
    rows = spark.createDataFrame([(i, "6pre", "school", "text", v) for i, v in enumerate(values)] + [(99, "6pre", "other", "text", "Rivrside"), (100, "7pre", "school", "text", "kept")], "position int, form_type string, name string, kind string, text string")
    enabled = spark.createDataFrame([("6pre", "school", None), ("7pre", "school", "casual")], "form_type string, name string, mode string")
    proposals = spark.createDataFrame([("6pre", "school", 1, '{"zzz": 5}'), ("6pre", "school", 2, '{"zzz": "zz top"}'), ("7pre", "school", 1, '{"nothing": "x"}')], "form_type string, name string, attempt int, answer string")
    got = {r.position: (r.normalized, r.reason) for r in normalize.batch_normalize(rows, enabled, proposals).collect()}
    sig = lambda s: "".join(c for c in s.lower() if c.isalpha())

    def want(v):
        if v in ("school", "n/a"):
            return v, "empty_normalized"
        scores = [(SequenceMatcher(None, sig(v), sig(c)).ratio(), c) for c in ("Riverside", "Lakeview")] if sig(v) else [(0, v)]
        score, c = max(scores, key=lambda x: x[0])
        new = c if score >= 0.72 or (len(sig(v)) >= 3 and (sig(v) in sig(c) or sig(c) in sig(v))) else "zz top" if v == "zzz" else v
        return new, "unchanged" if new == v else "applied"

    assert {i: got[i] for i in range(len(values))} == {i: want(v) for i, v in enumerate(values)}
    assert got[99] == ("Rivrside", "not_enabled") and got[100] == ("kept", "no_valid_response")


def test_settings(spark):
    row = spark.createDataFrame([('{"a": {"x": 1}, "b": 2}', '{"a": {"y": 3}, "c": null}', "x ```json\n{\"a\": 1} ``` {b} {", "`'v',")], "base string, over string, answer string, quoted string")
    m = lambda c: F.transform_values(F.from_json(c, "map<string,variant>"), lambda _, v: F.to_json(v))
    got = row.select(M.merge_params(m("base"), m("over")).alias("merged"), M.json_candidates(F.col("answer")).alias("c"), M.strip_malformed(F.col("quoted")).alias("q"), M.format_override(F.lit(" json ")).alias("f"), M.format_override(F.lit("[1]")).alias("g"), M.normalize_parsed(F.lit('{"a": "", "b": "y"}')).alias("n")).first()
    assert got.merged["a"] == '{"x":1,"y":3}' and got.merged["b"] == "2"
    assert got.c[0] == '{"a": 1}' and got.c[-1] == "{" and "{b}" in got.c and len(got.c) == 4
    assert (got.q, got.f, got.g, got.n["detected_text"]) == ("v", "json", None, "y")


def test_coverage_of_required_columns(spark):
    cells = spark.createDataFrame([("S", 1, "A", "Id"), ("S", 2, "A", "code"), ("S", 1, "B", "Age; if other, please describe"), ("S", 1, "C", "Name"), ("S", 9, "D", "data")], "sheet string, row int, column string, value string")
    required = validation.required_columns(validation.header_text(cells, 3))
    assert {r.column: r.header for r in required.collect()} == {"A": "Id code", "C": "Name"}
    assert tuple(validation.uncovered(required, spark.createDataFrame([("S", "A")], "sheet string, column string")).first()) == ("S", 1, ["C"])


def test_small_region_and_page_operators(spark):
    row = spark.createDataFrame([(["1.4", "2", "5.6", "9"], ["1", "2", "1", "9"], "a/../b", "in/x.png", "/root/other")], "a array<string>, b array<string>, c string, d string, e string")
    got = row.select(regions.corner_box(F.col("a")).alias("a"), regions.corner_box(F.col("b")).alias("b"), *[regions.inside_root(F.col(k), "/root/run/").alias(k + k) for k in "cde"], regions.top_rows(F.lit(100), F.lit(0.0)).alias("t")).first()
    assert tuple(got.a) == (1, 2, 6, 9) and got.b is None and (got.cc, got.dd, got.ee, got.t) == (None, "/root/run/in/x.png", None, 1)
    names = spark.createDataFrame([(n,) for n in ("zeta", "12", "2b", "2", "id", "Alpha", "10a")], "s string")
    assert [r.s for r in names.orderBy(*pages.source_order("s")).collect()] == ["id", "2", "12", "2b", "10a", "Alpha", "zeta"]
    parts = spark.createDataFrame([("f", "a", " x "), ("f", "b", ""), ("g", "a", "y")], "form_type string, side string, name string")
    assert {(r.form_type, r.source) for r in pages.source_catalog(parts).collect()} == {("f", s) for s in ("x", *pages.RESERVED_SOURCES)}
    assert ("g", "y") in {tuple(r) for r in pages.source_catalog(parts, lenient=True).collect()}
    trace = spark.createDataFrame([("p1:r2:x",), ("p12:r2:x",), ("q",)], "n string")
    assert [r.n for r in pages.prefix_slice(trace, "n", [12, 3]).collect()] == ["p12:r2:x"]
    files = spark.createDataFrame([("t/6pre_A.png",), ("t/6pre_b.png",), ("t/x y.png",), ("t/a.jpg",)], "path string")
    assert [r.form_type for r in pages.expected_forms(files).collect()] == ["6pre"]
