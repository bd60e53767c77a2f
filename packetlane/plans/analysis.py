"""Queries of analysed pages, their review and the outcome of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlane.operators import analysis
from packetlane.plans.catalog import query, t


@query("""SELECT 'run' AS run, l_orderkey AS item, CASE WHEN l_linenumber % 2 = 1 THEN 'odd' ELSE 'even' END AS page, 'q' || l_linenumber AS name, 'text' AS kind, coalesce(CASE WHEN l_returnflag <> 'A' THEN l_shipmode END, '') AS text, round(coalesce(CASE WHEN l_returnflag = 'R' THEN l_discount::DOUBLE END, l_tax::DOUBLE), 6) AS score,
  'run|' || l_orderkey || '|' || CASE WHEN l_linenumber % 2 = 1 THEN 'odd' ELSE 'even' END || '|q' || l_linenumber || '|text' AS ref, CASE WHEN l_linenumber < 4 AND l_linestatus = 'O' THEN '[A-Z]+' END AS rule FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem)
  UNION ALL SELECT CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'run' END, o_orderkey, 'odd', '1', 'mcq', CASE WHEN o_orderstatus = 'F' THEN '' ELSE lower(o_orderstatus) END, NULL, CASE WHEN o_orderstatus <> 'P' THEN 'run|' || o_orderkey || '|odd|1|mcq' END, NULL FROM orders""")
def page_rows(spark, d):
    """Texts of lines and choices of orders as rows of their pages, with settings of the regions they were read from."""
    n = F.col("l_linenumber")
    page = F.when(n % 2 == 1, "odd").otherwise("even")
    texts = t(spark, d, "lineitem").select(F.lit("run").alias("run"), F.col("l_orderkey").alias("item"), page.alias("page"), F.col("l_linestatus").alias("form_type"), F.lit("a").alias("side"), F.concat(F.lit("q"), n).alias("name"), F.when(F.col("l_returnflag") != "A", F.col("l_linestatus")).alias("text"), F.when(F.col("l_returnflag") == "R", F.col("l_discount").cast("double")).alias("score"), F.col("l_tax").cast("double").alias("min_score"), F.lit("HIGH").alias("label"))
    status = F.col("o_orderstatus")
    marks = t(spark, d, "orders").select(F.when(status == "P", "").otherwise("run").alias("run"), F.col("o_orderkey").alias("item"), F.lit("odd").alias("page"), F.lit("1").alias("question"), F.when(status != "F", F.lower(status)).alias("answer"))
    settings = spark.createDataFrame([("O", "a", f"q{k}", " [A-Z]+ ") for k in (1, 2, 3)] + [("F", "a", "q1", " ")], "form_type string, side string, name string, output_regex string")
    got = analysis.page_rows(texts, marks, settings, ["run", "item", "page"])
    return got.select("run", "item", "page", "name", "kind", "text", F.col("ocr_confidence_score").alias("score"), F.col("review_ref").alias("ref"), F.col("_output_regex").alias("rule"))


@query("""WITH p AS (SELECT l_orderkey + CASE WHEN l_returnflag = 'N' AND l_linenumber = 5 THEN 1000000000 ELSE 0 END AS item, l_linenumber AS n, l_partkey, l_suppkey, CASE l_returnflag WHEN 'R' THEN 'text' WHEN 'A' THEN 'MCQ' ELSE CASE WHEN l_linenumber = 7 THEN 'other' ELSE 'id' END END AS kind, CASE WHEN l_linenumber % 2 = 1 THEN 'odd' ELSE 'even' END AS page_in_pair FROM lineitem),
  m AS (SELECT p.*, o_orderkey, o_orderstatus AS f, CASE WHEN kind = 'id' OR page_in_pair = 'odd' THEN 'odd' ELSE 'even' END AS w, CASE WHEN kind NOT IN ('id', 'other') THEN CASE page_in_pair WHEN 'odd' THEN 'a' ELSE 'b' END END AS s FROM p LEFT JOIN orders ON o_orderkey = item),
  g AS (SELECT *, CASE WHEN kind = 'other' THEN 'unsupported kind' WHEN o_orderkey IS NULL THEN 'item_index out of range' WHEN f = 'P' AND w = 'even' AND kind <> 'MCQ' THEN 'no page image' WHEN kind <> 'id' AND NOT (f = 'O' OR (f = 'F' AND s = 'a')) THEN 'no regions of this form and side' END AS problem FROM m)
  SELECT item, n, l_partkey, l_suppkey, kind, problem, CASE WHEN problem IS NULL THEN '/data/' || o_orderkey || '/' || w || CASE WHEN kind = 'MCQ' THEN '_mcq' ELSE '' END || '.png' END AS page FROM g""")
def review_context(spark, d):
    """Lines as pending rows with the image of their order's page; some have no item, image, schema or a known kind."""
    n, f = F.col("l_linenumber"), F.col("l_returnflag")
    key = F.col("l_orderkey") + F.when((f == "N") & (n == 5), 1000000000).otherwise(0)
    kind = F.when(f == "R", "text").when(f == "A", "MCQ").otherwise(F.when(n == 7, "other").otherwise("id"))
    pending = t(spark, d, "lineitem").select(key.alias("item"), n.alias("n"), "l_partkey", "l_suppkey", kind.alias("kind"), F.when(n % 2 == 1, "odd").otherwise("even").alias("page_in_pair"))
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    path = lambda name: F.concat(k.cast("string"), F.lit(f"/{name}.png"))
    items = t(spark, d, "orders").select(k.alias("item"), status.alias("form_type"), path("odd").alias("page_odd"), F.when(status == "P", F.concat(F.lit("../"), path("even"))).otherwise(path("even")).alias("page_even"), path("odd_mcq").alias("page_odd_mcq"), path("even_mcq").alias("page_even_mcq"))
    schemas = spark.createDataFrame([("O", "a"), ("O", "b"), ("F", "a"), ("F", "a")], "form_type string, side string")
    return analysis.review_context(pending, items, schemas, ["item"], "/data").select("item", "n", "l_partkey", "l_suppkey", "kind", "problem", "page")


@query("""WITH r AS (SELECT o_custkey % 50 AS model, o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'invalid_json' WHEN 'O' THEN 'unchanged' ELSE 'other_text' END AS outcome FROM orders), e AS (SELECT model, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS first FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY o_orderkey) AS k FROM r WHERE outcome = 'invalid_json') WHERE k <= 3 GROUP BY 1)
  SELECT model, outcome, n, CASE WHEN outcome = 'invalid_json' THEN first END AS first FROM (SELECT model, outcome, count(*) AS n FROM r GROUP BY ALL) LEFT JOIN e USING (model)""")
def outcome_counts(spark, d):
    """How the answers of each model turned out, with the first three that are no JSON."""
    s = F.col("o_orderstatus")
    rows = t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("model"), "o_orderkey", F.when(s == "P", "invalid_json").when(s == "O", "unchanged").otherwise("other_text").alias("outcome"))
    got = analysis.outcomes(rows, ["model"], "outcome", "o_orderkey", ["o_orderkey"])
    return got.select("model", "outcome", "n", F.when(F.col("examples").isNotNull(), F.concat_ws(",", F.transform("examples", lambda e: e["o_orderkey"].cast("string")))).alias("first"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_name || '.xlsx' WHEN 1 THEN c_name || '.xltm' WHEN 2 THEN c_name || '.XLSX' WHEN 3 THEN c_name || '/a.xlsx' END AS file FROM customer""")
def resolve_workbooks(spark, d):
    """Files that customers' names mean: by name, by extension in order, by case, by folder, or none."""
    k, n = F.col("c_custkey") % 6, F.col("c_name")
    c = t(spark, d, "customer")
    one = lambda folder, name: F.struct(folder.alias("folder"), name.alias("file"))
    top, with_ = F.lit(""), lambda x: F.concat(n, F.lit(x))
    made = F.when(k == 0, F.array(one(top, with_(".xlsx")), one(top, with_(".xlsm")))).when(k == 1, F.array(one(top, with_(".xltx")), one(top, with_(".xltm")), one(n, F.lit("a.xlsx")))).when(k == 2, F.array(one(top, with_(".XLSX")), one(top, with_(".pdf"))))
    made = made.when(k == 3, F.array(one(n, F.lit("b.xlsx")), one(n, F.lit("a.xlsx")))).otherwise(F.array(one(top, with_(".csv")), one(F.upper(with_("x")), F.lit("a.xlsx"))))
    names = c.select("c_custkey", F.when(k == 0, with_(".xlsx")).when(k == 2, F.upper(n)).otherwise(n).alias("name"))
    return analysis.resolve_workbooks(names, c.select(F.inline(made))).select("c_custkey", "file")
