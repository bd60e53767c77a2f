"""Queries of form handling: ids, labels, clean-up across a run, review and its corrections, sheets and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlane.functions import comments as C
from packetlane.functions import header as H
from packetlane.functions import labels as L
from packetlane.functions import meta as M
from packetlane.functions import scanner
from packetlane.functions import text as X
from packetlane.operators import compare, grid, lineage, normalize, readings, review, validation, workbook
from packetlane.plans.catalog import query, t
from packetlane.streaming import packets


def case(k, values, otherwise=None):
    """The value of each remainder."""
    return F.coalesce(*[F.when(k == i, v) for i, v in enumerate(values) if v is not None], *([otherwise] if otherwise is not None else []))


@query(r"""WITH x AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN lpad(c_custkey::VARCHAR, 7, '0') || 'a' WHEN 1 THEN ' id ' || translate(lpad(c_custkey::VARCHAR, 7, '0'), '0158', 'OISB') || 'B' WHEN 2 THEN c_mktsegment WHEN 3 THEN 'no. ' || lpad(c_custkey::VARCHAR, 7, '0') || ' A' WHEN 4 THEN '-- ..' WHEN 5 THEN c_name || ' 1234567B' END AS x FROM customer),
  s AS (SELECT c_custkey, upper(trim(x)) AS s FROM x),
  m AS (SELECT c_custkey, regexp_replace(translate(replace(regexp_extract(s, '([0-9OQDILSBG ]{7})([AB])', 1), ' ', ''), 'OQDILSBG', '00011586'), '[^0-9]', '', 'g') AS digits, regexp_extract(s, '([0-9OQDILSBG ]{7})([AB])', 2) AS tail, regexp_replace(translate(s, 'OQDILSG', '0001156'), '[^A-Z0-9]', '', 'g') AS loose FROM s),
  i AS (SELECT c_custkey, CASE WHEN length(digits) = 7 THEN digits || tail WHEN regexp_extract(loose, '[0-9]{7}[AB]') <> '' THEN regexp_extract(loose, '[0-9]{7}[AB]') WHEN loose <> '' THEN left(loose, 16) END AS id FROM m)
  SELECT c_custkey, id, regexp_full_match(id, '[0-9]{7}[AB]') AS valid FROM i""")
def record_ids(spark, d):
    k = F.col("c_custkey")
    seven = F.lpad(k.cast("string"), 7, "0")
    x = case(k % 7, [F.concat(seven, F.lit("a")), F.concat(F.lit(" id "), F.translate(seven, "0158", "OISB"), F.lit("B")), F.col("c_mktsegment"), F.concat(F.lit("no. "), seven, F.lit(" A")), F.lit("-- .."), F.concat("c_name", F.lit(" 1234567B"))])
    return t(spark, d, "customer").select("c_custkey", H.normalize_id(x).alias("id")).withColumn("valid", X.valid_id(F.col("id")))


_PRIORITY = "CASE WHEN c_custkey % 4 = 1 THEN lpad(c_custkey::VARCHAR, 7, '0') || 'A' WHEN c_custkey % 4 = 2 THEN lpad(c_custkey::VARCHAR, 7, '1') || 'B' WHEN c_custkey % 4 = 3 THEN '7654321A' END"


@query(f"""SELECT c_custkey, {_PRIORITY} AS id, CASE c_custkey % 5 WHEN 0 THEN '8post' WHEN 1 THEN '7pre' WHEN 2 THEN '6pre' WHEN 3 THEN 'hpost' END AS form_type FROM customer""")
def header_fields(spark, d):
    """The answer of the last stage, the top level and the text read beside it, in the order of their weight."""
    k = F.col("c_custkey")
    seven = lambda p: F.lpad(k.cast("string"), 7, p)
    stage = F.struct(F.struct(F.when(k % 4 == 1, F.concat(seven("0"), F.lit("A"))).alias("id"), F.when(k % 5 == 0, "8TH grade POST-assessment").alias("detected_text"), F.when(k % 5 == 2, "6pre").otherwise("none").alias("form_type")).alias("parsed"))
    none = F.lit(None).cast("string")
    first = F.struct(F.struct(F.lit("x").alias("id"), none.alias("detected_text"), none.alias("form_type")).alias("parsed"))
    raw = F.to_json(F.struct(F.array(first, stage).alias("stages"), F.when(k % 4 == 2, F.concat(seven("1"), F.lit("b"))).alias("id"), F.when(k % 5 == 1, "7th grade pre assessment").alias("detected_text"), F.when(k % 5 == 3, "hpost").alias("form_type")))
    got = H.header_fields(raw, F.when(k % 4 == 3, "read 7654321A there").otherwise("nothing"))
    return t(spark, d, "customer").select("c_custkey", got.alias("h")).select("c_custkey", "h.*")


@query("""SELECT o_orderkey, pos - 1 AS position, id FROM (SELECT o_orderkey, unnest(CASE o_orderkey % 4 WHEN 0 THEN [o_orderstatus] WHEN 1 THEN [o_orderkey::VARCHAR, o_custkey::VARCHAR] WHEN 2 THEN [o_orderkey::VARCHAR, NULL, o_custkey::VARCHAR] ELSE [] END) AS id, generate_subscripts(CASE o_orderkey % 4 WHEN 0 THEN [o_orderstatus] WHEN 1 THEN [o_orderkey::VARCHAR, o_custkey::VARCHAR] WHEN 2 THEN [o_orderkey::VARCHAR, NULL, o_custkey::VARCHAR] ELSE [] END, 1) AS pos FROM orders)""")
def batch_answers(spark, d):
    one = lambda c: F.concat(F.lit('{"id":"'), F.col(c).cast("string"), F.lit('"}'))
    a, b = one("o_orderkey"), one("o_custkey")
    text = case(F.col("o_orderkey") % 4, [one("o_orderstatus"), F.concat(F.lit('{"results": ['), a, F.lit(", 7, "), b, F.lit("]}")), F.concat(F.lit("["), a, F.lit(', {"results": []}, {"results": ['), b, F.lit("]}]"))], F.lit("[1, 2]"))
    rows = t(spark, d, "orders").select("o_orderkey", F.posexplode(H.coerce_batch(text)).alias("position", "answer"))
    return rows.select("o_orderkey", F.col("position").cast("long").alias("position"), F.get_json_object("answer", "$.id").alias("id"))


@query("""SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'Name of Teacher: ' || s_name WHEN 1 THEN 'Record ID: ' || s_suppkey WHEN 2 THEN 'Today''s Date: 9/27/16' WHEN 3 THEN '27. What is your age? ' || s_suppkey WHEN 4 THEN 'a: ' || s_name ELSE '' END AS label,
  CASE s_suppkey % 6 WHEN 0 THEN 'Name of Teacher:' WHEN 1 THEN 'Record ID:' WHEN 2 THEN 'Today''s Date:' WHEN 3 THEN '27. What is your age?' ELSE '' END AS prompt,
  CASE s_suppkey % 6 WHEN 0 THEN s_name WHEN 1 THEN s_suppkey::VARCHAR WHEN 2 THEN '9/27/16' WHEN 3 THEN s_suppkey::VARCHAR WHEN 4 THEN 'a: ' || s_name ELSE '' END AS tail,
  CASE s_suppkey % 6 WHEN 0 THEN 'teacher' WHEN 1 THEN 'id' WHEN 2 THEN 'date' WHEN 3 THEN 'age' ELSE '' END AS kind, s_suppkey % 6 = 5 AS weak FROM supplier""")
def label_parts(spark, d):
    n, k = F.col("s_name"), F.col("s_suppkey")
    x = case(k % 6, [F.concat("s_name", F.lit("  name of  teacher :")), F.concat(F.lit("`json` recordid:"), k), F.lit("Date 9/27/16, today"), F.concat(F.lit("27. What is your  age? "), k), F.concat(F.lit("a :"), n)], F.lit(" ``` "))
    s = t(spark, d, "supplier").select("s_suppkey", L.canonical_label(x).alias("label"))
    s = s.withColumn("p", L.split_prompt(F.col("label")))
    return s.select("s_suppkey", "label", "p.prompt", "p.tail", L.prompt_kind(F.col("p.prompt")).alias("kind"), X.low_signal(F.col("label")).alias("weak"))


_FORMS = ("7post", "8pre", "6pre")
_ROWS = """r AS (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN '7post' WHEN 1 THEN '8pre' ELSE '6pre' END AS form_type, CASE c_custkey % 4 WHEN 0 THEN '21' WHEN 1 THEN 'school' WHEN 2 THEN 'teacher' ELSE 'age' END AS name,
  CASE WHEN c_custkey % 7 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 11 = 0 THEN 'N/A' WHEN c_custkey % 13 = 0 THEN '' ELSE c_mktsegment END AS text, CASE WHEN c_custkey % 17 = 0 THEN 'mcq' ELSE 'text' END AS kind FROM customer)"""


@query(f"""WITH {_ROWS}, e AS (SELECT * FROM (VALUES ('7post', '21', 'casual'), ('7post', 'school', 'consensus'), ('8pre', 'school', 'consensus'), ('8pre', 'teacher', 'casual')) e(form_type, name, mode)),
  live AS (SELECT r.*, mode FROM r JOIN e USING (form_type, name) WHERE kind = 'text' AND text <> ''),
  c AS (SELECT form_type, name, text, count(*) AS n, min(c_custkey) AS first FROM live GROUP BY ALL),
  g AS (SELECT form_type, name, sum(n) AS total, arg_min(text, (-n, first)) AS top, max(n) AS n FROM c GROUP BY 1, 2),
  m AS (SELECT l.*, CASE WHEN mode = 'consensus' AND g.n >= greatest(2, least(3, ceil(total * 0.12))) AND lower(top) <> 'n/a' THEN top WHEN text = 'N/A' THEN '' WHEN text = 'building' THEN 'BUILDING' WHEN text = 'MACHINERY' AND l.name = '21' THEN 'could have made this better: Machines' ELSE text END AS made FROM live l JOIN g USING (form_type, name)),
  f AS (SELECT *, CASE WHEN name = '21' AND made LIKE 'could have%' THEN 'Machines' ELSE made END AS new FROM m)
  SELECT r.c_custkey, CASE WHEN f.new IS NULL OR (f.new = '' AND f.name <> '21') THEN r.text ELSE f.new END AS normalized,
  CASE WHEN r.kind <> 'text' THEN 'not_text' WHEN e.mode IS NULL THEN 'not_enabled' WHEN r.text = '' THEN 'empty' WHEN f.new = '' AND f.name = '21' THEN 'applied' WHEN f.new = '' THEN 'empty_normalized' WHEN f.new = r.text THEN 'unchanged' ELSE 'applied' END AS reason
  FROM r LEFT JOIN e USING (form_type, name) LEFT JOIN f ON f.c_custkey = r.c_custkey""")
def batch_normalize(spark, d):
    """Fields cleaned across a run by two modes; the first answer of each field is no object and is passed over. The third mode is held against difflib by a test."""
    k, m = F.col("c_custkey"), F.col("c_mktsegment")
    text = F.when(k % 7 == 0, F.lower(m)).when(k % 11 == 0, "N/A").when(k % 13 == 0, "").otherwise(m)
    rows = t(spark, d, "customer").select("c_custkey", case(F.col("c_nationkey") % 3, list(map(F.lit, _FORMS))).alias("form_type"), case(k % 4, [F.lit("21"), F.lit("school"), F.lit("teacher")], F.lit("age")).alias("name"), text.alias("text"), F.when(k % 17 == 0, "mcq").otherwise("text").alias("kind"))
    enabled = spark.createDataFrame([("7post", "21", "strict"), ("7post", "school", "consensus"), ("8pre", "school", "Consensus "), ("8pre", "teacher", "conservative")], "form_type string, name string, mode string")
    same = ", ".join(f'"{s}": "{s}"' for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"))
    answer = F.when(F.col("name") == "21", f'{{{same}, "building": "BUILDING", "N/A": null, "MACHINERY": "could have made this better: Machines"}}').otherwise(f'{{{same}, "MACHINERY": "MACHINERY", "building": " BUILDING", "N/A": "none"}}')
    proposals = enabled.select("form_type", "name", F.explode(F.array(F.struct(F.lit(1).alias("attempt"), F.lit("[]").alias("answer")), F.struct(F.lit(2).alias("attempt"), answer.alias("answer")))).alias("p")).select("form_type", "name", "p.*")
    return normalize.batch_normalize(rows, enabled, proposals, position="c_custkey").select("c_custkey", "normalized", "reason")


@query("""SELECT o_orderkey AS item_index, '__id__' AS name, 'id' AS kind, CASE WHEN o_orderkey % 3 = 0 THEN '1234567A' ELSE o_orderkey::VARCHAR END AS text_current, 'run|' || o_orderkey || '|_|__id__|id' AS review_ref FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0
  UNION ALL SELECT l_orderkey, name, 'text', max(l_linestatus), 'run|' || l_orderkey || '|' || page || '|' || name || '|text' FROM (SELECT l_orderkey, l_linestatus, 'f' || l_linenumber AS name, CASE WHEN l_linenumber % 2 = 0 THEN 'b' ELSE 'unknown' END AS page FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS k FROM lineitem WHERE CASE WHEN l_returnflag = 'R' THEN true WHEN l_returnflag = 'A' THEN false ELSE l_discount < 0.05 END) WHERE k = 1) GROUP BY ALL
  UNION ALL SELECT l_orderkey, 'm' || l_linenumber, 'mcq', '', 'run|' || l_orderkey || '|a|m' || l_linenumber || '|mcq' FROM lineitem WHERE l_linenumber % 3 = 0""")
def pending_review(spark, d):
    o, line = F.col("o_orderkey"), t(spark, d, "lineitem")
    items = t(spark, d, "orders").select(o.alias("item_index"), F.when(o % 3 == 0, " 1234567A").otherwise(o.cast("string")).alias("id"), F.when(o % 5 == 0, 0.5).alias("id_score"), F.when(o % 7 == 0, True).alias("id_flag"))
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    head = [F.col("l_orderkey").alias("item_index"), F.struct("l_partkey", "l_suppkey").alias("place")]
    texts = line.select(*head, F.when(n % 2 == 0, "b").otherwise("").alias("page_in_pair"), F.concat(F.lit("f"), n).alias("name"), F.lit("Text").alias("kind"), F.col("l_linestatus").alias("text"), F.when(F.col("l_discount") < 0.05, 0.5).otherwise(0.99).alias("score"), F.when(flag == "R", True).when(flag == "A", False).alias("flag"))
    marks = line.select(*head, F.lit("a").alias("page_in_pair"), F.concat(F.lit("m"), n).alias("name"), F.lit("mcq").alias("kind"), F.when(n % 3 == 0, " ").otherwise("a").alias("text"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("flag"))
    rows = texts.unionByName(marks).withColumns({"position": F.col("place.l_partkey") * 1_000_000 + F.col("place.l_suppkey"), "ref": F.lit(None).cast("string")})
    return review.pending(items, rows, "run").select("item_index", "name", "kind", "text_current", "review_ref")


@query("""SELECT l_orderkey AS item_index, l_linenumber AS position, CASE WHEN l_linenumber % 4 = 0 THEN 'by ref' WHEN l_linenumber % 4 = 1 AND l_orderkey % 2 = 0 AND l_linenumber = (SELECT min(k.l_linenumber) FROM lineitem k WHERE k.l_orderkey = l.l_orderkey AND k.l_linenumber % 4 = 1) THEN 'by name' ELSE l_linestatus END AS text, l_orderkey % 2 = 0 AS corrected_item FROM lineitem l""")
def corrected_rows(spark, d):
    line, n = t(spark, d, "lineitem"), F.col("l_linenumber")
    rows = line.select(F.col("l_orderkey").alias("item_index"), n.alias("position"), F.concat(F.lit("f"), n % 4).alias("name"), F.lit("text").alias("kind"), F.lit("a").alias("page_in_pair"), F.col("l_linestatus").alias("text"), F.concat("l_orderkey", F.lit("|"), n).alias("ref"))
    items = rows.select("item_index").distinct().withColumn("id", F.lit("old"))
    null = F.lit(None).cast("string")
    entry = lambda src, **c: src.select("item_index", *[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in c.items()])
    by_ref = entry(rows.where("position % 4 = 0"), kind="text", review_ref=F.col("ref"), name="lost", page_in_pair=null, corrected=" by ref\t", status="done", position=F.col("position"))
    by_name = entry(items.where("item_index % 2 = 0"), kind="TEXT", review_ref="gone", name="f1", page_in_pair="", corrected="by name", status=null, position=F.lit(100))
    never = entry(items, kind="text", review_ref=null, name="f2", page_in_pair=null, corrected="no", status="SKIPPED", position=F.lit(101)).unionByName(entry(items, kind="text", review_ref=null, name="f2", page_in_pair="z", corrected="no", status="done", position=F.lit(102)))
    ids = entry(items.where("item_index % 2 = 0"), kind="id", review_ref=null, name=null, page_in_pair=null, corrected="new1 ", status="done", position=F.lit(103))
    fixed, out = review.correct_items(items, rows, by_ref.unionByName(by_name).unionByName(never).unionByName(ids))
    return out.join(fixed.select("item_index", (F.col("id") == "NEW1").alias("corrected_item")), "item_index").select("item_index", "position", "text", "corrected_item")


@query("""WITH i AS (SELECT o_custkey AS book, o_orderkey, o_orderstatus AS f, trim(o_orderpriority) AS p, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus IN ('F', 'O')),
  s AS (SELECT book, f, row_number() OVER (PARTITION BY book ORDER BY first, f)::DOUBLE AS pos FROM (SELECT book, f, min(o_orderkey) AS first FROM i GROUP BY book, f)),
  c AS (SELECT i.book, f, pos, CASE f WHEN 'F' THEN k + 3 ELSE k + 2 END AS row, unnest(CASE f WHEN 'F' THEN ['B', 'C', 'D'] ELSE ['A'] END) AS col, unnest(CASE f WHEN 'F' THEN [p, o_orderkey::VARCHAR, 'stamp'] ELSE [upper(p)] END) AS value, unnest(CASE f WHEN 'F' THEN [p || '?', o_orderkey::VARCHAR || '?', 'stamp'] ELSE [upper(p) || '?'] END) AS raw FROM i JOIN s USING (book, f)),
  h AS (SELECT book, f, pos, 1 AS row, 'A' AS col, 'head' AS value FROM s WHERE f = 'O')
  SELECT book, CASE f WHEN 'F' THEN 'Done' ELSE 'Open' END AS sheet, pos AS sheet_position, row, col AS "column", value FROM c UNION ALL SELECT book, f || ' (Original)', pos + 0.5, row, col, raw FROM c
  UNION ALL SELECT book, 'Open', pos, row, col, value FROM h UNION ALL SELECT book, 'O (Original)', pos + 0.5, row, col, value FROM h""")
def workbook_cells(spark, d):
    """A book for each customer, with a sheet and its twin for each status that has a sheet."""
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("item_index"), F.col("o_orderstatus").alias("form_type"), F.explode(F.array(F.struct(F.lit("priority").alias("name"), F.col("o_orderpriority").alias("text")), F.struct(F.lit("total").alias("name"), F.col("o_orderkey").cast("string").alias("text")))).alias("a"))
    answers = o.select("book", "item_index", "form_type", "a.*", F.lit(0).alias("pos"))
    entries = spark.createDataFrame([("F", "priority", "B", None, 0), ("F", "total", "C", "number", 1), ("O", "priority", "A", "upper", 0)], "form_type string, name string, column string, transform string, entry_pos int")
    sheets = spark.createDataFrame([("F", "Done", 4), ("O", "Open", 3)], "form_type string, sheet string, start_row int")
    stamps = spark.createDataFrame([("F", "D", "stamp"), ("F", "B", "under")], "form_type string, column string, value string")
    headers = spark.createDataFrame([("O", 1, "A", "head"), ("P", 1, "A", "never")], "form_type string, row int, column string, value string")
    original = answers.withColumn("text", F.concat("text", F.lit("?")))
    cells = workbook.fill_workbook(answers, entries, sheets, original=original, stamps=stamps, headers=headers, numbered=True)
    return cells.select("book", "sheet", F.col("sheet_position").cast("double").alias("sheet_position"), F.col("row").cast("long").alias("row"), "column", "value")


_WRITTEN = """i AS (SELECT c_nationkey AS book, c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN '7pre' WHEN 1 THEN '8post' ELSE ' none' END AS form, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS seg,
    CASE c_custkey % 5 WHEN 0 THEN ' BUILDING ' WHEN 1 THEN 'Machinery' WHEN 2 THEN ' ' ELSE 'other' END AS answer, round(c_acctbal)::BIGINT AS bal, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'id' || c_custkey END AS id FROM customer),
  n AS (SELECT *, row_number() OVER (PARTITION BY book, form ORDER BY k) + CASE form WHEN '7pre' THEN 3 ELSE 1 END AS row, min(k) OVER (PARTITION BY book, form)::DOUBLE AS pos FROM i WHERE form <> ' none'),
  w AS (SELECT book, form, pos, row, k, unnest(CASE form WHEN '7pre' THEN [(-1, 'G', 'stamp'), (-1, 'A', 'under'), (0, 'A', CASE WHEN id IS NOT NULL THEN id END), (1, 'B', CASE WHEN seg <> '' THEN lower(seg) ELSE '' END),
      (2, 'C', CASE trim(lower(seg)) WHEN 'building' THEN 'B' WHEN 'machinery' THEN 'raw' WHEN '' THEN 'other' ELSE 'other' END), (3, 'D', 'No'), (3, 'E', 'No'), (4, CASE trim(lower(answer)) WHEN 'building' THEN 'D' WHEN 'machinery' THEN 'E' WHEN '' THEN 'F' END, 'x'), (5, 'G', CASE WHEN k % 2 = 0 THEN bal::VARCHAR END)]
    ELSE [(0, 'A', '2026'), (1, 'A', CASE WHEN seg <> '' THEN seg END), (2, 'B', CASE trim(answer) WHEN 'Machinery' THEN 'Yes' END), (3, 'C', form)] END) AS w FROM n),
  h AS (SELECT DISTINCT book, form, pos, 1 AS row, 'A' AS col, 'head' AS value FROM n WHERE form = '7pre'),
  c AS (SELECT book, form, pos, row, w[2] AS col, arg_max(w[3], w[1]) AS value FROM w WHERE w[2] IS NOT NULL AND w[3] IS NOT NULL GROUP BY ALL UNION ALL SELECT * FROM h)"""


@query(f"""WITH {_WRITTEN} SELECT book, CASE form WHEN '7pre' THEN 'Seven' ELSE 'Eight' END AS sheet, pos AS sheet_position, row, col AS "column", value FROM c
  UNION ALL SELECT book, '7th Pre Data (Original)', pos + 0.5, row, col, value FROM c WHERE form = '7pre'""")
def workbook_types(spark, d):
    """Sheets by entries of every type: later writes over earlier ones, blanks, no answer, item fields, a stamp row, a column that is never written."""
    k = F.col("c_custkey")
    form = case(k % 3, [F.lit("7pre"), F.lit(" 8post ")], F.lit(" "))
    field = lambda name, kind, text, pos=0: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), text.alias("text"), F.lit(pos).alias("pos"))
    segment = F.when(k % 7 != 0, F.concat(F.lit("  "), "c_mktsegment")).otherwise(" ")
    answer = case(k % 5, [F.lit(" BUILDING "), F.lit("Machinery"), F.lit(" ")], F.lit("other"))
    balance = F.when(k % 2 == 0, F.round("c_acctbal").cast("bigint").cast("string"))
    fields = F.array(field(" seg ", "Text", segment), field("seg", "text", F.lit("late"), 1), field("mcq", "mcq", answer), field("bal", "mcq", balance), field("seg2", "mcq", segment), field("id", "text", F.lit("never")))
    answers = t(spark, d, "customer").select(F.col("c_nationkey").alias("book"), k.alias("item_index"), form.alias("form_type"), F.when(k % 11 != 0, F.concat(F.lit("id"), k)).alias("id"), F.inline(fields))
    e = lambda form, pos, type_, **given: (form, pos, type_, *[given.get(c) for c in ("column", "source", "transform", "value", "map", "default", "choices", "mark", "blank", "no_answer")])
    seven, eight = "7pre", "8post"
    entries = spark.createDataFrame([
        e(seven, 0, "direct", column="A", source="id"), e(seven, 1, "Direct", column="B", source="seg", transform="lower"),
        e(seven, 2, "lookup", column="C", source="seg", map={"building": "B", "machinery": "", "MACHINERY": "raw"}, default="other"),
        e(seven, 3, "multi_column", source="mcq", choices={"building": "D", "machinery": "E"}, mark="x", blank="No", no_answer="F"),
        e(seven, 5, "direct", column="G", source="bal", transform="number"), e(seven, 6, "direct", column="H", source="seg"), e(seven, 7, "other", source="nothing"),
        e(eight, 0, "static", column="A", value="20\x0726"), e(eight, 1, "direct", column="A", source="seg2", transform="unknown"),
        e(eight, 2, "multi_column", source="mcq", choices={"Machinery": "B", "Building": "B", "other": ""}), e(eight, 3, "direct", column="C", source="form_type"),
    ], "form_type string, entry_pos int, type string, column string, source string, transform string, value string, map map<string,string>, default string, choices map<string,string>, mark string, blank string, no_answer string")
    sheets = spark.createDataFrame([(seven, "Seven", 4), (eight, "Eight", 2)], "form_type string, sheet string, start_row int")
    stamps = spark.createDataFrame([(seven, "G", "stamp"), (seven, "A", "under")], "form_type string, column string, value string")
    headers = spark.createDataFrame([(seven, 1, "A", "head"), ("6pre", 1, "A", "never")], "form_type string, row int, column string, value string")
    hidden = spark.createDataFrame([(seven, "H")], "form_type string, column string")
    original = answers.where(F.trim("form_type") == seven)
    cells = workbook.fill_workbook(answers, entries, sheets, original=original, stamps=stamps, headers=headers, hidden=hidden)
    return cells.select("book", "sheet", F.col("sheet_position").cast("double").alias("sheet_position"), F.col("row").cast("long").alias("row"), "column", "value")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus WHEN l_returnflag = 'A' THEN '''line'' + ''page'' = ''' || l_linestatus || '''' WHEN l_returnflag = 'R' THEN 'line' ELSE 'page' END AS raw,
  CASE WHEN l_linenumber % 2 = 1 THEN least(1.0, l_discount * 20) END AS score, 'scan_' || l_orderkey || '.pdf' AS file FROM lineitem""")
def comment_sources(spark, d):
    kind = F.when(F.col("l_linenumber") % 2 == 0, "mcq").otherwise("Text")
    flag, s = F.col("l_returnflag"), F.col("l_linestatus")
    raw = C.comment_raw(kind, s, F.lit(" page "), F.lit("line"), F.when(flag == "A", "paddle_vlm_fusion"), F.when(flag == "R", "paddle").otherwise("vlm"), F.lit(None).cast("string"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"), C.text_score(kind, F.lit("x"), F.col("l_discount") * 20).alias("score"), C.source_file_name(F.lit(""), F.concat(F.lit("in/scan_"), "l_orderkey", F.lit(".pdf"))).alias("file"))


_MAPPED = """r AS (SELECT p_brand AS form, p_partkey AS row, ['direct', 'lookup', 'static', 'multi_column', 'other'][p_size % 5 + 1] AS type, CASE WHEN p_size % 7 = 0 THEN '' ELSE 's' || p_size % 11 END AS source, CASE WHEN p_size % 6 = 0 THEN '' WHEN p_size % 8 = 0 THEN 'A1' ELSE chr((65 + p_partkey % 26)::INTEGER) END AS col, CASE WHEN p_size % 3 = 0 THEN 'twist' ELSE 'upper' END AS transform FROM part)"""


@query(f"""WITH {_MAPPED},
  d AS (SELECT form, row, col FROM r WHERE type IN ('direct', 'lookup', 'static') AND col <> '' UNION ALL SELECT form, row, 'X' FROM r WHERE type = 'multi_column' UNION ALL SELECT form, row, col FROM r WHERE type = 'multi_column' AND col <> '')
  SELECT form, 'error' AS severity, 'Unknown mapping type: other' AS message, row FROM r WHERE type = 'other'
  UNION ALL SELECT form, 'error', 'Missing source', row FROM r WHERE type NOT IN ('other', 'static') AND source = ''
  UNION ALL SELECT form, 'warning', 'Source not found in regions or reserved fields: ' || source, row FROM r WHERE type NOT IN ('other', 'static') AND source IN ('s9', 's10')
  UNION ALL SELECT form, 'error', 'Missing target column', row FROM r WHERE type IN ('direct', 'lookup', 'static') AND col = ''
  UNION ALL SELECT form, 'error', 'Invalid column: A1', row FROM r WHERE type IN ('direct', 'lookup', 'static') AND col = 'A1'
  UNION ALL SELECT form, 'warning', 'Unrecognized transform: twist', row FROM r WHERE type = 'direct' AND transform = 'twist'
  UNION ALL SELECT form, 'error', 'lookup rows need a map', row FROM r WHERE type = 'lookup' AND transform = 'twist'
  UNION ALL SELECT form, 'warning', 'multi_column row has no mark', row FROM r WHERE type = 'multi_column'
  UNION ALL SELECT form, 'error', 'Invalid choice column for b: ' || col, row FROM r WHERE type = 'multi_column' AND col IN ('', 'A1')
  UNION ALL SELECT form, 'warning', 'Column ' || col || ' is written by rows ' || string_agg(row::VARCHAR, ', ' ORDER BY row), NULL FROM (SELECT DISTINCT form, row, col FROM d) GROUP BY form, col HAVING count(*) > 1
  UNION ALL SELECT form, 'info', 'Source ' || source || ' is used ' || count(*) || ' times', NULL FROM r WHERE type NOT IN ('other', 'static') GROUP BY form, source HAVING count(*) > 1""")
def mapping_validation(spark, d):
    """Each brand is a form's mapping, each part a row of it."""
    size, k = F.col("p_size"), F.col("p_partkey")
    column = F.when(size % 6 == 0, "").when(size % 8 == 0, "a1 ").otherwise(F.chr(65 + k % 26))
    none = F.lit(None).cast("string")
    twist = size % 3 == 0
    rows = t(spark, d, "part").select(
        F.col("p_brand").alias("form"), k.alias("row"), case(size % 5, list(map(F.lit, ("direct", " Lookup", "static", "multi_column"))), F.lit("other")).alias("type"), F.when(size % 7 == 0, none).otherwise(F.concat(F.lit("s"), size % 11)).alias("source"), column.alias("column"),
        F.when(twist, "Twist").otherwise("upper").alias("transform"), F.when(~twist, F.create_map(F.lit("a"), F.lit("b"))).alias("map"), F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), column).alias("choices"), none.alias("no_answer"), F.lit("").alias("mark"),
    )
    known = rows.select("form").distinct().select("form", F.explode(F.array(*[F.lit(f"s{i}") for i in range(9)])).alias("source"))
    return validation.mapping_issues(rows, ["form"], known).select("form", "severity", "message", "row")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'postprocess_passes' WHEN 1 THEN 'legacy_llm_passes' WHEN 2 THEN 'legacy_llm_prompt_override' WHEN 3 THEN 'postprocess_passes' ELSE 'none' END AS source,
  CASE event_id % 6 WHEN 0 THEN 'llm:' || event_type || ':m1,code:x = 1:' WHEN 1 THEN 'llm:' || event_type || ':' WHEN 2 THEN 'llm:' || event_type || ':' ELSE '' END AS steps, CASE event_id % 6 WHEN 0 THEN 'm1' WHEN 1 THEN 'base' WHEN 2 THEN 'base' END AS model FROM events""")
def region_passes(spark, d):
    e, k = F.col("event_type"), F.col("event_id") % 6
    modern = F.concat(F.lit('[{"prompt": "'), e, F.lit('", "model": "m1"}, {"type": "code", "snippet": "x = 1"}, {"type": "code"}, 7, " "]'))
    entry = lambda when, key, value: F.when(when, F.struct(F.lit(key).alias("key"), value.alias("value")))
    meta = F.map_from_entries(F.array_compact(F.array(entry(k == 0, "postprocess_passes", modern), entry(k == 1, "llm_passes", F.concat(F.lit('["'), e, F.lit('"]'))), entry(k < 4, "llm_prompt_override", e), entry(k == 3, "postprocess_passes", F.lit('"no list"')))))
    got = t(spark, d, "events").select("event_id", M.passes(meta).alias("p"))
    steps = F.array_join(F.transform("p.passes", lambda s: F.concat_ws(":", s["type"], s["body"], F.coalesce(s["model"], F.lit("")))), ",")
    return got.select("event_id", "p.source", steps.alias("steps"), M.first_model(F.col("p.passes"), F.lit("base"), F.array(F.lit("m1"), F.lit("m2"))).alias("model"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN event_type WHEN 2 THEN event_type WHEN 3 THEN '' WHEN 4 THEN 'raw text' WHEN 5 THEN 'fallback' ELSE '' END AS text, event_id % 7 IN (1, 2, 3, 6) AS single, event_id % 5 = 0 AS uid, event_id % 11 = 3 AS echo,
  CASE WHEN event_id % 3 = 0 THEN 'REVIEW_REQUIRED' WHEN event_id % 3 = 1 THEN 'NO_ACCEPTED_STAGE' WHEN event_id % 2 = 0 THEN 'AUTO_ACCEPTED' ELSE 'ACCEPTED_EMPTY_TEXT' END AS status,
  CASE event_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'unchanged' WHEN 3 THEN 'header_cleanup' ELSE 'other_text' END AS outcome FROM events""")
def answer_shapes(spark, d):
    e, i = F.col("event_type"), F.col("event_id")
    k = i % 7
    parsed = F.when(k == 1, F.concat(F.lit('{"detected_text": " '), e, F.lit('", "x": 1}'))).when(k == 2, F.concat(F.lit('{"age": "'), e, F.lit('"}'))).when(k == 3, '{"detected_text": null}').when(k == 6, '{"a": "N/A"}').when(k != 0, '{"a": 1, "b": 2}')
    raw = F.when(k == 4, " raw  text ").otherwise("")
    uid = F.when(i % 5 == 0, F.concat(F.lit("p1:r"), i, F.lit(":name "))).otherwise(F.concat(F.lit("p1:r"), i))
    echo = M.echoes_number(F.lit("12"), F.when(i % 11 == 3, " 12").otherwise("13"), F.concat(F.lit("112 3"), e))
    given = F.when(i % 5 == 3, "Optional question : more").otherwise(F.concat(F.lit(" a  "), e))
    answer = F.when(i % 5 != 0, F.when(i % 5 == 2, F.concat(F.lit("a "), e)).otherwise("b"))
    return t(spark, d, "events").select("event_id", M.detected_text(parsed, raw, F.lit("fallback")).alias("text"), F.coalesce(M.single_output(parsed)["found"], F.lit(False)).alias("single"), M.internal_uid(uid).alias("uid"), echo.alias("echo"), M.overall_status(i % 3 == 0, i % 3 == 2, F.when(i % 2 == 0, "x").otherwise(" ")).alias("status"), M.classify_output(given, answer, i % 5 != 1).alias("outcome"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN 'x y' WHEN l_linenumber % 3 = 0 THEN l_linenumber::VARCHAR WHEN l_orderkey % 2 = 0 THEN l_orderkey::VARCHAR WHEN l_orderkey % 3 = 0 THEN '77' ELSE '' END AS final,
  CASE WHEN l_linenumber % 5 = 0 OR l_linenumber % 3 = 0 THEN 'first' WHEN l_orderkey % 2 = 0 THEN 'sharp' ELSE 'last' END AS used_step, l_linenumber % 5 = 0 OR l_linenumber % 3 = 0 OR l_orderkey % 2 = 0 OR l_orderkey % 3 = 0 AS matched,
  NOT (l_linenumber % 5 = 0 OR l_linenumber % 3 = 0 OR l_orderkey % 2 = 0 OR l_orderkey % 3 = 0) AS cleared FROM lineitem""")
def regex_retries(spark, d):
    """Texts that fail their pattern are replaced by later readings until one fits."""
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    uid = F.concat_ws(":", o, n, "l_partkey", "l_suppkey").alias("uid")
    line = t(spark, d, "lineitem").select(o, n, uid)
    rows = line.select("l_orderkey", "l_linenumber", "uid", F.when(n % 5 == 0, " x  y").when(n % 3 == 0, n.cast("string")).otherwise("none").alias("text"), F.when(n % 5 != 0, "[0-9]+").alias("pattern"))
    tries = F.array(F.struct(F.lit("sharp").alias("step"), F.when(o % 2 == 0, o.cast("string")).otherwise("no").alias("text")), F.struct(F.lit("last").alias("step"), F.when(o % 3 == 0, " 77").otherwise("bad").alias("text")), F.struct(F.lit("unknown").alias("step"), F.lit("1").alias("text")))
    attempts = line.select("uid", F.explode(tries).alias("a")).select("uid", "a.*")
    return readings.retry_rounds(rows, attempts, ["sharp", "last"]).select("l_orderkey", "l_linenumber", "final", "used_step", "matched", "cleared")


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 9 AS g, c_name AS n, c_mktsegment AS s FROM customer)
  SELECT k AS c_custkey, CASE g WHEN 0 THEN regexp_replace(n, '[^0-9]', '', 'g') WHEN 1 THEN s WHEN 2 THEN CASE WHEN k % 2 = 0 THEN n ELSE '' END WHEN 3 THEN '' WHEN 4 THEN '' WHEN 5 THEN 'true' WHEN 6 THEN '' WHEN 7 THEN n ELSE '7' END AS result,
    CASE g WHEN 6 THEN 'legacy_llm_prompt_override' WHEN 7 THEN 'none' WHEN 8 THEN 'legacy_llm_passes' ELSE 'postprocess_passes' END AS pass_source,
    CASE g WHEN 0 THEN 'code:0:true:,code:0:true:' WHEN 1 THEN 'm1:1:true:' WHEN 2 THEN CASE WHEN k % 2 = 0 THEN 'm0:4:false:' ELSE 'm0:2:true:' END WHEN 3 THEN 'm0:1:true:numeric_roi_name_echo' WHEN 4 THEN 'm0:1:true:output_regex_mismatch,m0:0:false:'
      WHEN 5 THEN 'code:0:false:,m0:1:true:,code:0:true:' WHEN 6 THEN 'm0:1:true:internal_uid' WHEN 7 THEN '' ELSE 'm0:1:true:' END AS trace FROM c""")
def text_passes(spark, d):
    """Each customer's text through passes of its own: named steps, models that answer in several shapes, retries, rejected answers."""
    k, n = F.col("c_custkey"), F.col("c_name")
    g = k % 9
    llm, step = '{"type": "llm", "prompt": "p"}', '{"type": "code", "code": "%s"}'
    lists = [f'[{step % "upper"}, {step % "digits"}]', '[{"type": "llm", "prompt": "p", "model": "m1"}]', f"[{llm}]", f"[{llm}]", f"[{llm}, {llm}]", f'[{step % "no such"}, {llm}, {step % "lower"}]']
    settings = F.map_from_entries(F.array_compact(F.array(
        F.when(g < 6, F.struct(F.lit("postprocess_passes").alias("key"), case(g, list(map(F.lit, lists))).alias("value"))),
        F.when(g == 6, F.struct(F.lit("llm_prompt_override").alias("key"), F.lit("fix it").alias("value"))),
        F.when(g == 8, F.struct(F.lit("llm_passes").alias("key"), F.lit('["fix it"]').alias("value"))),
        F.when(g == 4, F.struct(F.lit("output_regex").alias("key"), F.lit("[A-Z]+").alias("value"))),
        F.when(g.isin(3, 8), F.struct(F.lit("roi_name").alias("key"), F.lit("7").alias("value"))),
    )))
    rows = t(spark, d, "customer").select(k.alias("uid"), F.lit("field").alias("name"), F.when(g == 8, F.concat(n, F.lit(" 7 "))).otherwise(F.concat(F.lit("  "), n)).alias("text"), settings.alias("meta"))
    tried = lambda p, a, raw: F.struct(F.lit(p).alias("pass"), F.lit(a).alias("attempt"), raw.alias("raw"))
    answer = case(g, [F.lit(None).cast("string"), F.concat(F.lit('Here: {"date": "  '), "c_mktsegment", F.lit(' "} and {"more": 1}')), F.lit("no json"), F.lit('{"detected_text": 7}'), F.lit('{"detected_text": "abc"}'), F.lit('```json\n{"x": true}\n```'), F.lit('{"detected_text": "p1:r2:x"}'), F.lit('{"never": "asked"}')], F.lit('{"a": 1, "detected_text": "7"}'))
    again = F.when((g == 2) & (k % 2 == 1), "null").otherwise('{"a": 1, "b": 2}')
    tries = F.array(tried(2, 1, F.when(g == 5, answer)), tried(1, 1, answer), *[tried(1, a, again) for a in (2, 3, 4, 5)], tried(9, 1, answer))
    responses = t(spark, d, "customer").select(k.alias("uid"), F.inline(tries)).where("raw is not null")
    out = readings.postprocess(rows, responses, fallback_model="m0", supported=("m0", "m1"))
    told = F.array_join(F.transform("trace", lambda x: F.concat_ws(":", F.coalesce(x["model"], x["type"]), x["attempts"], x["parsed_ok"], F.coalesce(x["rejection"], F.lit("")))), ",")
    return out.select(F.col("uid").alias("c_custkey"), "result", "pass_source", told.alias("trace"))


_LIKERT = ("Agree", "strongly  disagree", "TRUE", "7th Grade", "girl", "")
_REPORT = f"""o AS (SELECT o_orderkey AS k, o_orderstatus AS st, trim(o_orderpriority) AS pr, {list(_LIKERT)!r}[o_orderkey % 6 + 1] AS li FROM orders),
  a AS (SELECT CASE st WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS sheet, k AS row, CASE WHEN k % 23 = 0 THEN '' ELSE lpad((CASE WHEN k % 19 = 0 THEN k + 1 ELSE k END)::VARCHAR, 7, '0') || 'A' END AS id, chr((97 + k % 10)::INTEGER) AS mcq, regexp_replace(li, ' +', ' ', 'g') AS likert, pr AS text FROM o),
  b AS (SELECT k AS row, CASE WHEN k % 29 = 0 THEN '' WHEN k % 13 = 0 THEN 'X' || k WHEN k % 31 = 0 THEN '0000001A' ELSE lpad(k::VARCHAR, 7, '0') || 'A' END AS id, CASE WHEN k % 5 = 0 THEN chr((97 + (k + 1) % 10)::INTEGER) WHEN k % 5 = 1 THEN chr((65 + k % 10)::INTEGER) ELSE chr((97 + k % 10)::INTEGER) END AS mcq,
    CASE WHEN k % 4 = 0 THEN '' ELSE regexp_replace(li, ' +', ' ', 'g') END AS likert, CASE WHEN k % 7 = 0 THEN st WHEN k % 7 = 1 THEN '' ELSE lower(pr) END AS text FROM o),
  f AS (SELECT id, arg_min([mcq, likert, text], (sheet, row)) AS c, count(*) AS hits FROM a WHERE id <> '' GROUP BY id),
  m AS (SELECT b.row, unnest(['mcq', 'likert', 'text']) AS col, unnest(f.c) AS t, unnest([b.mcq, b.likert, b.text]) AS p FROM b JOIN f USING (id) WHERE b.id <> ''),
  x AS (SELECT *, lower(t) AS lt, lower(p) AS lp FROM m WHERE t <> '' OR p <> ''),
  v AS (SELECT lower(u) AS u, CASE WHEN regexp_full_match(lower(u), '[a-h]') THEN 'letter' WHEN lower(u) IN ('true', 'false') THEN 'boolean' WHEN lower(u) IN ('agree', 'strongly disagree') THEN 'likert' WHEN lower(u) = '7th grade' THEN 'grade' WHEN lower(u) = 'girl' THEN 'gender' END AS kind, u <> '' AND regexp_matches(u, '[A-Za-z]') AS letters FROM (SELECT DISTINCT unnest([lower(t), lower(p)]) AS u FROM x)),
  y AS (SELECT x.*, coalesce(vt.kind, vp.kind) AS kind, (vt.kind IS NULL AND vt.letters) OR (vp.kind IS NULL AND vp.letters) AS lk FROM x JOIN v vt ON vt.u = lt JOIN v vp ON vp.u = lp)"""
_COUNTS = """count(*) AS compared, count(*) FILTER (t = p) AS exact, count(*) FILTER (p = '') AS miss, count(*) FILTER (t = '') AS overfill, count(kind) AS categorical, count(kind) FILTER (lt = lp) AS categorical_exact, count(*) FILTER (lk) AS text_like, count(*) FILTER (lk AND lt = lp) AS text_exact,
  avg(1 - levenshtein(lt, lp)::DOUBLE / greatest(length(lt), length(lp), 1)) FILTER (lk) AS similarity, count(*) FILTER (t = p) / count(*) AS accuracy"""
_COUNTED = ("compared", "exact", "miss", "overfill", "categorical", "categorical_exact", "text_like", "text_exact", "similarity", "accuracy")
_IDS = ("truth_rows", "test_rows", "found", "unique_found", "truth_ids", "test_ids", "truth_ids_repeated", "truth_duplicates", "test_duplicates", "truth_valid", "test_valid", "not_found", "precision", "recall", "truth_valid_rate", "test_valid_rate", "f1")


def _sheets(spark, d):
    k, st, pr = F.col("o_orderkey"), F.col("o_orderstatus"), F.trim("o_orderpriority")
    letter = lambda n, base: F.chr((n % 10 + base).cast("int"))
    o, li = t(spark, d, "orders"), F.array(*map(F.lit, _LIKERT))[(k % 6).cast("int")]
    seven = lambda n: F.concat(F.lpad(n.cast("string"), 7, "0"), F.lit("a"))
    truth = o.select(F.when(st == "F", 1).when(st == "O", 2).otherwise(3).alias("sheet"), k.alias("row"), F.when(k % 23 != 0, seven(F.when(k % 19 == 0, k + 1).otherwise(k))).alias("id"), letter(k, 97).alias("mcq"), li.alias("likert"), pr.alias("text"))
    test = o.select(F.lit(1).alias("sheet"), k.alias("row"), F.when(k % 29 == 0, " ").when(k % 13 == 0, F.concat(F.lit("x"), k)).when(k % 31 == 0, "0000001A").otherwise(seven(k)).alias("id"), F.when(k % 5 == 0, letter(k + 1, 97)).when(k % 5 == 1, letter(k, 65)).otherwise(letter(k, 97)).alias("mcq"), F.when(k % 4 != 0, li).alias("likert"), F.when(k % 7 == 0, st).when(k % 7 == 1, "").otherwise(F.lower(pr)).alias("text"))
    columns = ["mcq", "likert", "text"]
    return (*[compare.sheet_rows(x, columns, "id", ["sheet", "row"]) for x in (truth, test)], columns)


@query(f"""WITH {_REPORT}, c AS (SELECT 'all' AS scope, '' AS name, {_COUNTS} FROM y UNION ALL SELECT 'column', col, {_COUNTS} FROM y GROUP BY col UNION ALL SELECT 'type', kind, {_COUNTS} FROM y WHERE kind IS NOT NULL GROUP BY kind),
  i AS (SELECT coalesce(a, 0) AS a, coalesce(b, 0) AS b, regexp_full_match(id, '[0-9]{{7}}[AB]')::INTEGER AS valid FROM (SELECT id, count(*) AS a FROM a WHERE id <> '' GROUP BY 1) FULL JOIN (SELECT upper(id) AS id, count(*) AS b FROM b WHERE id <> '' GROUP BY 1) USING (id)),
  j AS (SELECT sum(a) AS truth_rows, sum(b) AS test_rows, sum(b) FILTER (a > 0) AS found, count(*) FILTER (a > 0 AND b > 0) AS unique_found, count(*) FILTER (a > 0) AS truth_ids, count(*) FILTER (b > 0) AS test_ids, count(*) FILTER (a > 1) AS truth_ids_repeated, sum(greatest(0, a - 1)) AS truth_duplicates, sum(greatest(0, b - 1)) FILTER (a > 0) AS test_duplicates, sum(a * valid) AS truth_valid, sum(b * valid) FILTER (a > 0) AS test_valid FROM i),
  k AS (SELECT *, test_rows - found AS not_found, found / test_rows AS precision, unique_found / truth_ids AS recall, truth_valid / truth_rows AS truth_valid_rate, test_valid / found AS test_valid_rate FROM j), l AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM k),
  z AS ({" UNION ALL ".join(f"SELECT scope, name, '{m}' AS metric, {m}::DOUBLE AS value FROM c" for m in _COUNTED)} UNION ALL {" UNION ALL ".join(f"SELECT 'ids', '', '{m}', {m}::DOUBLE FROM l" for m in _IDS)} UNION ALL SELECT 'all', '', 'macro_accuracy', avg(accuracy) FROM c WHERE scope = 'column')
  SELECT scope, name, metric, round(value, 6) AS value FROM z WHERE value IS NOT NULL""")
def compare_report(spark, d):
    """Every metric of a comparison with all sheets of the truth, by id."""
    truth, test, columns = _sheets(spark, d)
    return compare.report(truth, test, columns).withColumn("value", F.round("value", 6))


@query(f"""WITH {_REPORT}, e AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY row) AS rank FROM y WHERE t <> p), c AS (SELECT lt, lp, count(*) AS n FROM y WHERE kind = 'letter' AND t <> '' AND p <> '' AND lt <> lp GROUP BY ALL ORDER BY n DESC, lt, lp LIMIT 10)
  SELECT col AS "column", rank::BIGINT AS rank, row AS "row", t AS truth, p AS test FROM e WHERE rank <= 3 UNION ALL SELECT 'letter', n, NULL, lt, lp FROM c""")
def compare_examples(spark, d):
    """The first differing cells of each column, and the most frequent confusions of letters."""
    truth, test, columns = _sheets(spark, d)
    cells = compare.compared_cells(compare.matched_rows(truth, test), columns)
    first = compare.mismatch_examples(cells).select("column", F.col("rank").cast("long").alias("rank"), F.col("place.row").alias("row"), "truth", "test")
    return first.unionByName(compare.letter_confusions(cells).select(F.lit("letter").alias("column"), F.col("n").alias("rank"), F.lit(None).cast("long").alias("row"), "truth", "test"))


_GRAPH = """r AS (SELECT p_brand AS form, p_partkey AS row, ['direct', 'lookup', 'static', 'multi_column', 'other'][p_size % 5 + 1] AS type, CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size % 7 = 1 THEN 'id' ELSE 's' || p_size % 11 END AS source, CASE WHEN p_size % 6 = 0 THEN '' ELSE chr((65 + p_partkey % 26)::INTEGER) END AS col FROM part),
  s AS (SELECT form, 's' || i AS source, 'roi:' || side || ':s' || i AS id FROM (SELECT DISTINCT p_brand AS form FROM part), (SELECT unnest(range(9)) AS i), (SELECT unnest(['a', 'b']) AS side) WHERE side = 'a' OR i % 3 = 0),
  k AS (SELECT form, chr((65 + i)::INTEGER) AS col FROM (SELECT DISTINCT p_brand AS form FROM part WHERE p_brand <> 'Brand#11'), (SELECT unnest(range(20)) AS i)),
  d AS (SELECT form, row, col, '' AS choice FROM r WHERE type IN ('direct', 'lookup', 'static') AND col <> '' UNION ALL SELECT form, row, 'X', 'a' FROM r WHERE type = 'multi_column' UNION ALL SELECT form, row, col, 'b' FROM r WHERE type = 'multi_column' AND col <> ''),
  e AS (SELECT form, 'static:' || row AS source, 'map:' || row AS target, row FROM r WHERE type = 'static' UNION ALL SELECT form, 'virtual:id', 'map:' || row, row FROM r WHERE type <> 'static' AND source = 'id' UNION ALL SELECT r.form, s.id, 'map:' || row, row FROM r JOIN s ON r.form = s.form AND r.source = s.source WHERE type <> 'static'),
  x AS (SELECT e.form, e.source, d.col, row, d.choice FROM e JOIN d USING (form, row))"""


def _mapping(spark, d):
    size, k = F.col("p_size"), F.col("p_partkey")
    none = F.lit(None).cast("string")
    column = F.when(size % 6 == 0, " ").otherwise(F.chr(97 + k % 26))
    rows = t(spark, d, "part").select(F.col("p_brand").alias("form"), k.alias("row"), case(size % 5, list(map(F.lit, ("direct", " Lookup", "static", "multi_column"))), F.lit("other")).alias("type"), F.when(size % 7 == 0, none).when(size % 7 == 1, "id").otherwise(F.concat(F.lit("s"), size % 11)).alias("source"), column.alias("column"), F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), column).alias("choices"), none.alias("no_answer"))
    forms = rows.select("form").distinct()
    region = F.explode(F.array(*[F.struct(F.lit(f"s{i}").alias("source"), F.lit(f"roi:{side}:s{i}").alias("id")) for i in range(9) for side in ("a", "b") if side == "a" or i % 3 == 0]))
    sources = forms.select("form", region.alias("r")).select("form", "r.*")
    columns = forms.where("form <> 'Brand#11'").select("form", F.explode(F.array(*[F.lit(chr(65 + i)) for i in range(20)])).alias("column"))
    return rows, sources, columns


@query(f"""WITH {_GRAPH} SELECT form, source AS "from", 'cell:' || col AS "to", row, choice FROM x""")
def lineage_direct(spark, d):
    """Regions, fields and values of each form, and the columns that they fill."""
    rows, sources, _ = _mapping(spark, d)
    edges = lineage.direct_edges(lineage.mapping_graph(rows, ["form"], sources), ["form"])
    return edges.select("form", F.col("source").alias("from"), F.concat(F.lit("cell:"), "column").alias("to"), "row", "choice")


@query(f"""WITH {_GRAPH}, n AS (SELECT form, id, 'region' AS kind FROM s UNION ALL SELECT form, 'virtual:' || f, 'item_field' FROM (SELECT DISTINCT form FROM r), (SELECT unnest(['id', 'form_type', 'page_odd', 'page_even']) AS f) UNION ALL SELECT form, 'static:' || row, 'static' FROM r WHERE type = 'static' UNION ALL SELECT form, 'map:' || row, 'mapping' FROM r UNION ALL SELECT form, 'col:' || col, 'column' FROM (SELECT form, col FROM d UNION SELECT form, col FROM k)),
  m AS (SELECT form, source AS id FROM e UNION SELECT form, 'col:' || col FROM d)
  SELECT form, id, kind, kind IN ('static', 'mapping') OR m.id IS NOT NULL AS mapped FROM n LEFT JOIN m USING (form, id)""")
def lineage_nodes(spark, d):
    rows, sources, columns = _mapping(spark, d)
    return lineage.graph_nodes(rows, ["form"], sources, columns, lineage.mapping_graph(rows, ["form"], sources))


@query(f"""WITH {_GRAPH} SELECT form, 'error' AS severity, 'unknown_mapping_type' AS code, row, 'type other of row ' || row || ' is unknown' AS message FROM r WHERE type = 'other'
  UNION ALL SELECT form, 'error', 'missing_source', row, 'row ' || row || ' names a source that no region has: ' || source FROM r WHERE type <> 'static' AND source NOT IN ('', 'id') AND NOT EXISTS (SELECT 1 FROM s WHERE s.form = r.form AND s.source = r.source)
  UNION ALL SELECT form, 'error', 'missing_source_field', row, 'row ' || row || ' names no source' FROM r WHERE type <> 'static' AND source = ''
  UNION ALL SELECT form, 'warning', 'missing_destination', row, 'row ' || row || ' names no column' FROM r WHERE type = 'other' OR type IN ('direct', 'lookup') AND col = ''
  UNION ALL SELECT form, 'error', 'missing_column', row, 'row ' || row || ' writes to a column that the sheet lacks: ' || col FROM d WHERE form <> 'Brand#11' AND NOT EXISTS (SELECT 1 FROM k WHERE k.form = d.form AND k.col = d.col)""")
def lineage_issues(spark, d):
    rows, sources, columns = _mapping(spark, d)
    return lineage.graph_issues(rows, ["form"], sources, columns)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS source, 'o' || o_orderkey AS target FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT 'p' || p_partkey, p_brand FROM part UNION SELECT 'p' || p_partkey, 'p' || p_partkey // 3 FROM part WHERE p_partkey % 50 = 0 AND p_partkey // 3 > 0),
  r(source, target) AS (SELECT source, target FROM e WHERE source LIKE 'c%' UNION SELECT r.source, e.target FROM r JOIN e ON r.target = e.source WHERE r.target LIKE 'o%' OR r.target LIKE 'p%') SELECT source, target FROM r WHERE target LIKE 'Brand%'""")
def lineage_reach(spark, d):
    """From customers to brands, over orders and parts, some of which lead to other parts."""
    o, li, p = t(spark, d, "orders"), t(spark, d, "lineitem"), t(spark, d, "part")
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    third = F.floor(F.col("p_partkey") / 3)
    tables = [
        o.select(name("c", "o_custkey").alias("source"), name("o", "o_orderkey").alias("target")),
        li.select(name("o", "l_orderkey").alias("source"), name("p", "l_partkey").alias("target")),
        p.select(name("p", "p_partkey").alias("source"), F.col("p_brand").alias("target")),
        p.where((F.col("p_partkey") % 50 == 0) & (third > 0)).select(name("p", "p_partkey").alias("source"), F.concat(F.lit("p"), third.cast("string")).alias("target")),
    ]
    edge = reduce(DataFrame.unionByName, tables)
    return lineage.contracted(edge, F.substring("node", 1, 1).isin("o", "p")).where("source like 'c%'")


_SHEET = """l AS (SELECT l_suppkey AS sheet, l_orderkey AS k, l_linenumber AS n, l_quantity::INTEGER AS q, l_returnflag AS f, l_linestatus || l_partkey AS m, l_partkey AS pk FROM lineitem),
  c AS (SELECT sheet, (n - 1) % 4 + 1 AS row, q AS col, max(m) AS text FROM l GROUP BY ALL),
  g AS (SELECT sheet, k * 1000000 + n * 100000 + pk % 100000 AS pos, 1 + k % 3 AS row1, q AS col1, 1 + k % 3 + n % 3 AS row2, q + (k % 5) * (n % 4) AS col2, k || ':' || n || ':' || pk AS range FROM l WHERE n IN (2, 3))"""


def _sheet(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("sheet"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("n"), F.col("l_quantity").cast("int").alias("q"), F.col("l_returnflag").alias("f"), F.concat("l_linestatus", F.col("l_partkey").cast("string")).alias("m"), F.col("l_partkey").alias("pk"))
    cells = li.groupBy("sheet", ((F.col("n") - 1) % 4 + 1).cast("int").alias("row"), F.col("q").alias("col")).agg(F.max("m").alias("text"))
    k, n, q = F.col("k"), F.col("n"), F.col("q")
    third = (1 + k % 3).cast("int")
    merges = li.where(n.isin(2, 3)).select("sheet", (k * 1000000 + n * 100000 + F.col("pk") % 100000).alias("pos"), third.alias("row1"), q.alias("col1"), (third + n % 3).alias("row2"), (q + (k % 5) * (n % 4)).cast("int").alias("col2"), F.concat(k, F.lit(":"), n, F.lit(":"), "pk").alias("range"))
    return li, cells, merges


@query(f"WITH {_SHEET} SELECT c.sheet, c.row, c.col, pos, range FROM c JOIN g ON c.sheet = g.sheet AND c.row BETWEEN row1 AND row2 AND c.col BETWEEN col1 AND col2")
def box_join(spark, d):
    """Cells of each sheet and the ranges that hold them."""
    _, cells, merges = _sheet(spark, d)
    return grid.in_boxes(cells, merges, ["sheet"]).select("sheet", "row", "col", "pos", "range")


@query(f"""WITH {_SHEET}, s AS (SELECT g.sheet, unnest(range(g.row1, g.row2 + 1)) AS row, g.row1, g.col1, g.col2, c.text FROM g LEFT JOIN c ON c.sheet = g.sheet AND c.row = g.row1 AND c.col = g.col1), u AS (SELECT sheet, row, unnest(range(col1, col2 + 1)) AS col, row1, col1, text FROM s),
  v AS (SELECT sheet, row, col, arg_min(coalesce(text, '-'), (row1, col1)) AS text FROM u GROUP BY ALL), w AS (SELECT coalesce(c.sheet, v.sheet) AS sheet, coalesce(c.row, v.row) AS row, coalesce(c.col, v.col) AS col, CASE WHEN v.text IS NULL THEN c.text ELSE nullif(v.text, '-') END AS text FROM c FULL JOIN v ON c.sheet = v.sheet AND c.row = v.row AND c.col = v.col)
  SELECT sheet, row::INTEGER AS row, col::INTEGER AS col, text FROM w WHERE text IS NOT NULL""")
def merged_cover(spark, d):
    """Texts spread over merged ranges."""
    _, cells, merges = _sheet(spark, d)
    return grid.merged_cover(cells, merges, ["sheet"])


@query(f"""WITH {_SHEET}, p AS (SELECT DISTINCT sheet, col FROM c), m AS (SELECT DISTINCT sheet, q AS col FROM l WHERE k % 200 = 1 AND sheet % 4 <> 0), z AS (SELECT * FROM m UNION SELECT p.* FROM p JOIN m ON p.sheet = m.sheet AND abs(p.col - m.col) = 1 UNION SELECT * FROM p WHERE sheet NOT IN (SELECT sheet FROM m)),
  b AS (SELECT g.sheet, pos, range, row1, least(row2, 2) AS row2, z.col, min(z.col) OVER w AS start, count(*) OVER w AS colspan FROM g JOIN z ON g.sheet = z.sheet AND z.col BETWEEN col1 AND col2 WHERE row1 IN (1, 2) WINDOW w AS (PARTITION BY g.sheet, pos)),
  x AS (SELECT sheet, col, r AS row, pos, range, CASE WHEN col = start THEN colspan END AS colspan, CASE WHEN col = start THEN row2 - row1 + 1 END AS rowspan, col <> start AS hidden FROM b, (SELECT unnest([1, 2]) AS r) WHERE r BETWEEN row1 AND row2 AND (col <> start OR r = row1)),
  i AS (SELECT sheet, col, row, max(pos) AS pos FROM x GROUP BY ALL)
  SELECT z.sheet, z.col, r.row, coalesce(c.text, '') AS value, CASE r.row WHEN 4 THEN 'data' ELSE 'header' END AS kind, r.row = 4 AND m.col IS NOT NULL AS mapped, x.range, x.colspan, x.rowspan, coalesce(x.hidden, false) AS hidden
  FROM z CROSS JOIN (SELECT unnest([1, 2, 4]) AS row) r LEFT JOIN c ON c.sheet = z.sheet AND c.col = z.col AND c.row = r.row LEFT JOIN m ON m.sheet = z.sheet AND m.col = z.col LEFT JOIN i ON i.sheet = z.sheet AND i.col = z.col AND i.row = r.row LEFT JOIN x ON x.sheet = i.sheet AND x.col = i.col AND x.row = i.row AND x.pos = i.pos""")
def sheet_grid(spark, d):
    """Visible columns of each sheet with headers, merged ranges and what a mapping fills."""
    li, cells, merges = _sheet(spark, d)
    mapped = li.where("k % 200 = 1 and sheet % 4 <> 0").select("sheet", F.col("q").alias("col")).distinct()
    return grid.sheet_grid(cells.select("sheet", "col").distinct(), mapped, cells, merges, ["sheet"])


@query("""WITH e AS (SELECT user_id, arg_min(props, (ts, event_id)) AS first, arg_min(event_id, (ts, event_id)) AS id FROM events GROUP BY 1)
  SELECT user_id::VARCHAR AS request, CASE user_id % 3 WHEN 2 THEN 'malformed_json_object' ELSE 'json_object' END AS mode, CASE user_id % 3 WHEN 0 THEN first WHEN 1 THEN 'note { ' || first ELSE '{"id" "' || id || '"}' END AS kept, CASE user_id % 3 WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS chunks FROM e""")
def stopped_answers(spark, d):
    """Each user's events as an answer in pieces, cut where its first object is complete, or broken beyond repair by more text."""
    e = t(spark, d, "events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "props")).alias("e")).select("user_id", "e.*")
    piece = lambda n, text: F.struct(F.lit(n).alias("seq"), text.alias("text"))
    k, p = F.col("user_id") % 3, F.col("props")
    halves = [F.substring(p, 1, 4), F.concat(F.expr("substring(props, 5)"), F.lit(' and {"k": "more"}'))]
    parts = F.when(k == 0, F.array(*map(piece, (0, 1), halves))).when(k == 1, F.array(piece(2, halves[1]), piece(0, F.lit("note { ")), piece(1, halves[0]))).otherwise(F.array(piece(1, F.lit("} late")), piece(0, F.concat(F.lit('{"id" "'), F.col("event_id"), F.lit('"} {')))))
    return packets.stopped(e.select(F.col("user_id").alias("request"), F.inline(parts))).select("request", "mode", "kept", "chunks")


@query("""SELECT o_orderkey, pos, value FROM (SELECT o_orderkey, unnest(CASE o_orderkey % 4 WHEN 0 THEN [(0, o_custkey::VARCHAR), (1, 'b')] WHEN 1 THEN [(0, o_orderstatus)] WHEN 2 THEN [(0, 'True')] ELSE [] END) AS b, b[1]::INTEGER AS pos, b[2] AS value FROM orders)""")
def json_blocks(spark, d):
    """Objects with any text in orders' notes, as a lateral table function."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    note = case(k, [F.concat(F.lit('a {"n": '), c, F.lit('} }{ {"confidence": 1, "z": "b"} {')), F.concat(F.lit('{"x": {"y": "'), "o_orderstatus", F.lit('"}, "e": " ", "l": [{}]}')), F.lit('{"q": "}{", "text": true} {"never')], F.lit("{ no } {1}"))
    rows = t(spark, d, "orders").select("o_orderkey", note.alias("note"))
    return rows.lateralJoin(scanner.JsonBlocks(F.col("note").outer())).select("o_orderkey", "pos", "value")
