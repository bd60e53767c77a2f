from pyspark.sql import functions as F

from packetlane.operators import compare, mapping, normalize, pages, readings, regions, review


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_forward_fill(spark):
    df = spark.createDataFrame([(0, "8post"), (1, None), (2, "6pre"), (3, None)], "pair int, form string").withColumn("k", F.lit(1))
    got = pages.forward_fill(df, ["k"], ["pair"], F.col("form"), F.col("pair"))
    assert rows(got.select("pair", "filled", "filled_from"), "pair") == [(0, "8post", 0), (1, "8post", 0), (2, "6pre", 2), (3, "6pre", 2)]
    leading = pages.forward_fill(spark.createDataFrame([(0, None), (1, "7pre")], "pair int, form string").withColumn("k", F.lit(1)), ["k"], ["pair"], F.col("form"), F.col("pair"))
    assert rows(leading.select("pair", "filled"), "pair") == [(0, None), (1, "7pre")]
    assert rows(pages.fill_counts(leading, ["k"], F.col("form")), "k") == [(1, 0, 1)]


def test_manifest(spark):
    m = spark.createDataFrame([("1", "3", 0), ("2", None, 1), ("x", "9", 2), ("1", "4", 3), ("0", "1", 4)], "merged_page string, source_page string, pos int")
    assert rows(pages.clean_manifest(m, "pos").select("merged_page", "source_page"), "merged_page") == [(1, 4), (2, 2)]


def test_region_kinds(spark):
    r = spark.createDataFrame([(n,) for n in ("id", "1", "1a", "1b", "2", "3")], "name string").withColumn("s", F.lit(1))
    got = dict(rows(regions.region_kinds(r, ["s"]).select("name", "kind"), "name"))
    assert got == {"id": "text", "1": "mcq", "1a": "mcq_choice", "1b": "mcq_choice", "2": "text", "3": "text"}


def test_argmax_ties_and_threshold(spark):
    s = spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0), (2, "a", 0.0)], "q int, choice string, score double")
    assert rows(regions.argmax_choice(s, ["q"]).select("q", "answer"), "q") == [(1, "a"), (2, "")]


def test_boxes(spark):
    df = spark.createDataFrame([(5.0, 9.0, 1.0, 2.0)], "a double, b double, c double, d double")
    assert tuple(df.select(regions.box_from_corners(*map(F.col, "abcd"))).first()[0]) == (1.0, 2.0, 4.0, 7.0)
    assert df.select(regions.box_from_corners(F.col("a"), F.col("b"), F.col("a"), F.col("d"))).first()[0] is None


def test_normalize(spark):
    v = spark.createDataFrame([("f", "Value One"), ("f", "Value One"), ("f", "Valu One"), ("f", "Other"), ("g", "12-34"), ("g", "12-34")], "field string, v string")
    counts = normalize.value_counts(v, ["field"], F.col("v"))
    top = normalize.repeated_canonicals(counts, ["field"])
    assert rows(top.select("field", "value"), "field") == [("f", "Value One")]
    for method in ("ratio", "levenshtein"):
        best = normalize.assign_clusters(counts, top, ["field"], method)
        assert rows(best.select("value", "canonical"), "value") == [("Valu One", "Value One"), ("Value One", "Value One")]
    done = normalize.apply_map(v, best, ["field"], "v", spark.createDataFrame([("f",)], "field string"))
    assert set(rows(done.select("v", "normalized", "reason"), "v")) == {("Value One", "Value One", "unchanged"), ("Valu One", "Value One", "applied"), ("Other", "Other", "unchanged"), ("12-34", "12-34", "not_enabled")}


def test_dominant_reasons(spark):
    c = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 1), ("b", "y", 1), ("c", "12-34", 5)], "f string, value string, n long")
    assert rows(normalize.dominant(c, ["f"]).select("f", "value", "reason"), "f") == [("a", "x", "dominant"), ("b", "x", "too_few"), ("c", "12-34", "structured_id")]


def test_corrections(spark):
    r = spark.createDataFrame([("k1", "old"), ("k2", "old"), ("k3", "old")], "ref string, text string")
    c = spark.createDataFrame([("k1", "first", "done", 0), ("k1", "last", "done", 1), ("k2", " ", "done", 0), ("k3", "new", "Cancelled", 0)], "ref string, corrected string, status string, pos int")
    assert rows(review.apply_corrections(r, c, ["ref"], "text", "pos").select("ref", "text"), "ref") == [("k1", "last"), ("k2", "old"), ("k3", "old")]


def test_mapping_entries(spark):
    df = spark.createDataFrame([(1, "Yes", ""), (2, None, "7")], "id int, q string, n string")
    source = {"q": F.col("q"), "n": F.col("n")}
    entries = [
        {"type": "multi_column", "source": "q", "choices": {"yes": "A", "no": "B"}, "mark": "x", "no_answer": "C"},
        {"type": "lookup", "source": "q", "column": "D", "map": {"yes": "", "Yes": "raw"}, "default": "d"},
        {"type": "direct", "source": "n", "column": "E", "transform": "number"},
        {"type": "direct", "source": "unknown", "column": "F"},
        {"type": "static", "column": "G", "value": "=1+1"},
    ]
    wide = mapping.fill_rows(df, ["id"], [{"type": "multi_column", "source": "q", "choices": {"Yes": "A", "YES": "B"}}, {"type": "direct", "source": "n", "column": "C", "transform": "none such"}, {"type": "static", "column": "D", "value": "a\x01b"}], source)
    assert rows(wide, "id") == [(1, "Yes", None, "", "ab"), (2, None, None, "7", "ab")]
    assert rows(mapping.fill_rows(df, ["id"], entries, source), "id") == [(1, "x", None, None, "raw", "", None, "=1+1"), (2, None, None, "x", None, "7", None, "=1+1")]


def test_compare(spark):
    a = spark.createDataFrame([(1, "x", "c"), (1, "5", "d"), (2, "y", "c")], "k int, value string, column string")
    b = spark.createDataFrame([(1, "x", "c"), (1, "5", "d"), (3, "z", "c")], "k int, value string, column string")
    m = compare.cell_metrics(compare.cell_pairs(a, b, ["k"])).first()
    assert (m.compared, m.exact, m.miss, m.overfill) == (4, 2, 1, 1)


def test_melt_by_type(spark):
    row = spark.sql("SELECT 1 AS k, 5.0D AS a, 0.1D + 0.2D AS b, 1e20D AS c, 1.5e-7D AS d, true AS e, ' 5.0  x ' AS f, DATE'2024-02-01' AS g, TIMESTAMP'2024-02-01 10:00:00' AS h, CAST(NULL AS DOUBLE) AS i, 5 AS j, 123456789012345.5D AS l")
    got = {r.column: r.value for r in compare.melt(row, ["k"], [c for c in row.columns if c != "k"]).collect()}
    assert got == {"a": "5", "b": "0.3", "c": "1e+20", "d": "1.5e-07", "e": "TRUE", "f": "5.0 x", "g": "2024-02-01", "h": "2024-02-01", "i": "", "j": "5", "l": "1.23456789012e+14"}


def test_strategies(spark):
    p = spark.createDataFrame([(1, "a", 0.95, "b"), (2, "a", 0.5, "b"), (3, None, None, "b"), (4, "a", 0.5, None)], "id int, a_text string, a_score double, b_text string").withColumn("b_score", F.lit(None).cast("double"))
    pick = lambda s: [r.text for r in readings.choose_reading(p, s).orderBy("id").collect()]
    assert pick("fallback") == ["a", "b", "b", "a"]
    assert pick("first_only") == ["a", "a", "", "a"]
    assert pick("second_with_first_score") == ["b", "b", "b", "a"]
    assert len(pick("fusion")) == 4


def test_results_do_not_depend_on_partitions(spark):
    v = spark.createDataFrame([("f", f"v{i % 7}") for i in range(100)], "field string, v string")
    got = {str(rows(normalize.dominant(normalize.value_counts(v.repartition(n), ["field"], F.col("v")), ["field"]), "field")) for n in (1, 4, 16)}
    assert len(got) == 1


def test_containing_passages_of_any_length_at_any_place(spark):
    long = "the quick brown fox jumps over the lazy dog, again and again, until the night comes"
    passages = ["fox", "é b", long, '"' + long, "ick" + long[7:] + " x", "x" * 70, "-", "", None, " lead", "tail ", "a\nb", "😀 z", "éa " + long]
    texts = [None, "", "a fox", 'He said ("' + long + '") once', "qu" + long, "tr" + "ick" + long[7:] + " x", "y" * 9 + "x" * 70, "é b", "blé bé", "no lead", "  tail  ", "a\nbc", "w😀 zz", "éa " + long, "(éa " + long]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    want = {(i, j) for i, x in enumerate(texts) for j, p in enumerate(passages) if x is not None and p is not None and p in x}
    got = [(r.doc_id, r.item_id) for r in compare.containing(docs, items).collect()]
    assert len(got) == len(want) and set(got) == want
    assert compare.containing(docs, items.limit(0)).count() == 0


def test_range_join_of_any_width(spark):
    ranges = [(0, 10**9, "wide"), (5, 5, "point"), (-7, -3, "below"), (100, 131, "some"), (9, 2, "none")]
    r = spark.createDataFrame(ranges, "low long, high long, name string")
    values = [-8, -7, -3, 0, 5, 99, 100, 131, 132, 10**9, 10**9 + 1]
    got = mapping.in_ranges(spark.createDataFrame([(v,) for v in values], "v long"), r, "v", "low", "high")
    want = sorted((v, n) for v in values for low, high, n in ranges if low <= v <= high)
    assert sorted((x.v, x.name) for x in got.collect()) == want
    assert mapping.in_ranges(spark.createDataFrame([(1,)], "v long"), r.limit(0), "v", "low", "high").count() == 0


def test_first_of_each_key_of_one_kind(spark):
    df = spark.createDataFrame([("a", 2, "text", "x"), ("a", 1, "text", "y"), ("a", 3, "mcq", "z"), ("a", 4, "mcq", None), ("b", 1, None, "n")], "k string, o int, kind string, v string")
    assert sorted((r.k, r.o) for r in review.keep_first(df, ["k"], ["o"], "text").collect()) == [("a", 1), ("a", 3), ("a", 4), ("b", 1)]
