"""Queries of mappings before use: proposals made regular, previews, workbook columns that are reached."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from packetlane.functions import meta as M
from packetlane.operators import drafts
from packetlane.plans.catalog import query, t

_ROWS = """i AS (SELECT l_orderkey AS k, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r, l_returnflag AS f, l_linestatus AS s, CAST(l_quantity AS INTEGER) AS q FROM lineitem)"""


def _entries(spark, d):
    """A proposed mapping row of each line: types by line number, the seventh of an unknown one."""
    n, f, s = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_linestatus")
    pair = lambda k, v, c: F.struct(k.alias("key"), v.alias("value"), c.alias("column"))
    none = F.lit(None).cast("string")
    row = {
        "type": F.when(n.isin(1, 5), " Direct").when(n.isin(2, 6), "lookup").when(n == 3, "multi_column").when(n == 4, "STATIC").otherwise("sum"),
        "source": F.concat(F.lit(" q"), n), "column": F.lower(f), "transform": F.when(n == 5, " UPPER ").otherwise(""),
        "map_entries": F.when(n.isin(2, 6), F.array(pair(F.lit(" x "), f, none), pair(F.lit(" "), s, none), pair(F.lit("x"), F.when(n == 6, s).otherwise(f), none))),
        "default": F.when(n == 6, s), "choices": F.when(n == 3, F.array(pair(F.lit("a"), none, F.lower(s)), pair(F.lit("b"), none, F.lit("  ")), pair(F.lit("c "), none, f))),
        "mark": F.when(f == "R", "X").otherwise(""), "no_answer": F.when(n == 3, F.lower(f)), "blank": F.when(f == "A", ""), "value": F.when(n == 4, s),
    }
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct(n.alias("n"), "l_partkey", "l_suppkey").alias("place"), F.struct(*[c.alias(x) for x, c in row.items()]).alias("e"))


@query(f"""WITH {_ROWS}, bad AS (SELECT k, min(r) AS r FROM i WHERE n = 7 GROUP BY 1), h AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus ELSE 'fallback' END AS sheet, CASE WHEN o_orderkey % 2 = 0 AND o_custkey <> 0 THEN o_custkey ELSE 4 END AS start_row, o_orderkey % 16 = 1 AS broken FROM orders),
  p AS (SELECT h.*, CASE WHEN broken THEN 'Generated result must be a JSON object.' WHEN h.k NOT IN (SELECT k FROM i) THEN 'Generated mapping has no rows.' WHEN bad.k IS NOT NULL THEN 'Generated row ' || bad.r || ' has invalid type ''sum''.' END AS problem FROM h LEFT JOIN bad ON bad.k = h.k)
  SELECT p.k, CASE WHEN broken THEN 'fallback' ELSE sheet END AS sheet, CASE WHEN broken THEN 4 ELSE start_row END::BIGINT AS start_row, problem, r AS row, CASE WHEN n IN (1, 5) THEN 'direct' WHEN n IN (2, 6) THEN 'lookup' WHEN n = 3 THEN 'multi_column' WHEN n = 4 THEN 'static' END AS type,
  CASE WHEN n <> 4 THEN 'q' || n END AS source, CASE WHEN n <> 3 THEN f END AS "column", CASE WHEN n = 5 THEN 'upper' END AS transform, CASE n WHEN 2 THEN f WHEN 6 THEN s END AS x, CASE WHEN n IN (2, 6) THEN 1 END::BIGINT AS keys, CASE WHEN n = 6 THEN s END AS "default",
  CASE WHEN n = 3 THEN s || '|' || f END AS choices, CASE WHEN n = 3 THEN CASE f WHEN 'R' THEN 'X' ELSE 'Yes' END END AS mark, CASE WHEN n = 3 THEN f END AS no_answer, CASE WHEN n = 3 AND f = 'A' THEN '' END AS blank, CASE WHEN n = 4 THEN s END AS value
  FROM p LEFT JOIN i ON i.k = p.k AND problem IS NULL""")
def proposed_entries(spark, d):
    """Orders as proposed mappings with their lines as rows; some are no objects, have no rows or a row of an unknown type."""
    lines = _entries(spark, d).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("place", "e"))).alias("rows"))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_custkey").join(lines, "k", "left")
    k = F.col("k")
    body = F.to_json(F.struct(F.when(k % 3 == 0, F.col("o_orderstatus")).when(k % 3 == 1, "").alias("sheet"), F.when(k % 2 == 0, F.col("o_custkey")).otherwise(0).alias("start_row"), F.transform("rows", lambda r: r["e"]).alias("mappings")))
    answers = o.select("k", F.when(k % 16 == 1, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body).alias("answer"), F.lit("fallback").alias("fallback_sheet"), F.lit(4).alias("fallback_start_row"))
    got = drafts.proposed_entries(answers).select("k", "sheet", F.col("start_row").cast("long").alias("start_row"), "problem", F.explode_outer("entries").alias("e"))
    m = F.col("e.map")
    return got.select("k", "sheet", "start_row", "problem", F.col("e.row").cast("long").alias("row"), *[F.col(f"e.{c}").alias(c) for c in ("type", "source", "column", "transform", "default", "mark", "no_answer", "blank", "value")], F.try_element_at(m, F.lit("x")).alias("x"), F.when(m.isNotNull(), F.size(m)).cast("long").alias("keys"), F.concat_ws("|", F.map_values("e.choices")).alias("__c")).withColumn("choices", F.when(F.col("type") == "multi_column", F.col("__c"))).drop("__c")


@query(f"""WITH {_ROWS}, v AS (SELECT *, CASE n WHEN 1 THEN 'id' WHEN 2 THEN q::VARCHAR WHEN 3 THEN q::VARCHAR WHEN 5 THEN 'page_odd' ELSE 'f' || q END AS source, CASE WHEN n = 4 THEN '' WHEN n = 1 THEN '601034A' WHEN n IN (2, 3) THEN 'a' WHEN n = 5 THEN '1' ELSE 'sample f' || q END AS raw FROM i WHERE n < 7),
  w AS (SELECT *, CASE n WHEN 1 THEN lower(raw) WHEN 2 THEN CASE f WHEN 'R' THEN 'hit' ELSE s END WHEN 3 THEN 'Yes' WHEN 4 THEN s WHEN 5 THEN '1' ELSE CASE f WHEN 'R' THEN '' ELSE s END END AS value FROM v)
  SELECT k, r AS row, CASE n WHEN 3 THEN CASE f WHEN 'R' THEN 'RA' ELSE 'none' END ELSE f END AS "column", CASE n WHEN 4 THEN 'static' ELSE source END AS source, raw, value, CASE n % 3 WHEN 0 THEN value || '/' || raw || '/' || source WHEN 1 THEN 'seen ' || value || ' high (0.980)' ELSE '' END AS comment FROM w""")
def preview_rows(spark, d):
    """What lines as mapping rows would write for sample answers, with their comments."""
    n, f, q = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_quantity").cast("int").cast("string")
    rows = t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.struct(n.alias("n"), "l_partkey", "l_suppkey").alias("row"), n.alias("n"), f.alias("column"), F.col("l_linestatus").alias("s"), f.alias("f"),
        F.when(n.isin(1, 5), "direct").when(n.isin(2, 6), " Lookup").when(n == 3, "multi_column").when(n == 4, "static").otherwise("other").alias("type"),
        F.when(n == 1, " id").when(n.isin(2, 3), q).when(n == 5, "page_odd").otherwise(F.concat(F.lit("f"), q)).alias("source"), F.when(n == 1, "lower").when(n == 5, "number").alias("transform"),
        F.when((n == 2) & (f == "R"), F.create_map(F.lit("a"), F.lit("hit"))).alias("map"), F.when(n.isin(2, 6) & (f != "R"), F.col("l_linestatus")).alias("default"), F.when((n == 3) & (f == "R"), F.create_map(F.lit("a"), F.lit("RA"))).alias("choices"), F.lit("none").alias("no_answer"), F.lit(None).cast("string").alias("mark"), F.col("l_linestatus").alias("value"),
        F.when(n % 3 == 0, '{"template": "V/{raw}/{source} ", "replacements": {"V": "{value}"}}').when(n % 3 == 1, " seen {value} {ocr_confidence}").alias("comment"),
    )
    numbered = rows.withColumn("row", F.row_number().over(Window.partitionBy("k").orderBy("row")).cast("long"))
    return drafts.preview_rows(numbered, ["k"])


@query("""WITH c AS (SELECT DISTINCT CASE WHEN l_suppkey % 5 = 0 THEN -l_suppkey ELSE l_suppkey END AS book, chr(65 + CAST(l_quantity AS INTEGER) % 26) AS "column" FROM lineitem), g AS (SELECT l_suppkey AS book, chr(CAST(65 + l_partkey % 26 AS INTEGER)) AS "column", list_sort(list(DISTINCT l_linenumber)) AS rows FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
  SELECT coalesce(c.book, g.book) AS book, coalesce(c."column", g."column") AS "column", g.book IS NOT NULL AS mapped, CASE WHEN c.book IS NULL AND g.book IN (SELECT book FROM c) THEN array_to_string(rows, ',') END AS missed FROM c FULL JOIN g ON c.book = g.book AND c."column" = g."column" """)
def reached_columns(spark, d):
    """Columns of suppliers' books, those that returned lines name, and which of these the book doesn't have; every fifth book goes by another number there."""
    li, book = t(spark, d, "lineitem"), F.col("l_suppkey").alias("book")
    letter = lambda c: F.chr((65 + c % 26).cast("long"))
    other = F.when(F.col("l_suppkey") % 5 == 0, -F.col("l_suppkey")).otherwise(F.col("l_suppkey")).alias("book")
    columns = li.select(other, letter(F.col("l_quantity").cast("int")).alias("column")).distinct()
    targets = li.where("l_returnflag = 'R'").select(book, F.lower(letter(F.col("l_partkey"))).alias("column"), F.col("l_linenumber").alias("row"))
    got = drafts.reached_columns(columns, targets, ["book"])
    return got.select("book", "column", "mapped", F.when(F.col("missed_rows").isNotNull(), F.concat_ws(",", F.col("missed_rows").cast("array<string>"))).alias("missed"))


@query("SELECT o_orderkey, o_orderkey % 7 IN (0, 1, 3, 5) AS uncertain FROM orders")
def uncertain_answers(spark, d):
    """Notes of readers about themselves: lists with a text, texts, words of doubt in a reason."""
    k, s = F.col("o_orderkey") % 7, F.col("o_orderstatus")
    note = F.when(k == 0, F.concat(F.lit('{"ambiguities": ["", "'), s, F.lit('"]}'))).when(k == 1, F.concat(F.lit('{"missing_regions": "'), s, F.lit('"}'))).when(k == 2, '{"ambiguities": [" "], "legibility_issues": " ", "missing_regions": 7}')
    note = note.when(k == 3, F.concat(F.lit('{"reason_for_confidence": "Slightly BLURred '), s, F.lit('"}'))).when(k == 4, '"faint"').when(k == 5, '{"legibility_issues": [null, 0], "reason_for_confidence": null}').otherwise('{"reason_for_confidence": "clear"}')
    return t(spark, d, "orders").select("o_orderkey", M.uncertain(F.concat(F.lit('{"self_evaluation": '), note, F.lit("}"))).alias("uncertain"))
