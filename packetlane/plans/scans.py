"""Queries of scanned pages: images that are derived from keys by md5, sixteen pixels a row, so that SQL can restate them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from packetlane.functions import header as H
from packetlane.operators import marks, reuse
from packetlane.plans.catalog import query, t
from packetlane.sources import versions
from packetlane.store import shared_folder

_REGIONS = [
    ("7", "a", "1", "a", 0, 0, 4, 4), ("7", "a", "1", "b", 5, 0, 4, 4), ("7", "a", "1", "c", 10, 1, 9, 4), ("7", "a", "2", "a", 0, 8, 3, 3), ("7", "a", "2", "b", 8, 8, 3, 3),
    ("7", "b", "3", "a", 2, 2, 3, 4), ("7", "b", "3", "b", 9, 2, 3, 4), ("8", "a", "1", "a", 0, 0, 4, 4), ("8", "a", "1", "b", 5, 0, 4, 4), ("6", "b", "9", "d", 1, 1, 5, 5),
]
_VALUES = ", ".join(str(r) for r in _REGIONS)
_PIXEL = "('0x' || substr(md5(concat({key}, ':', y)), 2 * x + 1, 2))::INTEGER"
_PAGE = """p AS (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN '7' WHEN 1 THEN '8' WHEN 2 THEN '6' ELSE '9' END AS form_type, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS side, c_custkey % 11 = 5 AS missing FROM customer),
  r(form_type, side, question, letter, rx, ry, rw, rh) AS (VALUES """ + _VALUES + """), g AS (SELECT y, x FROM (SELECT unnest(range(16)) AS y), (SELECT unnest(range(16)) AS x))"""


def _image(key):
    """Sixteen rows of sixteen pixels from md5 of the key and the row."""
    return F.unhex(F.concat(*[F.md5(F.concat(key, F.lit(f":{y}"))) for y in range(16)]))


def _pages(spark, d):
    k = F.col("c_custkey")
    form = F.when(F.col("c_nationkey") % 4 == 0, "7").when(F.col("c_nationkey") % 4 == 1, "8").when(F.col("c_nationkey") % 4 == 2, "6").otherwise("9")
    pixels = F.when(k % 11 != 5, _image(k.cast("string")))
    return t(spark, d, "customer").select(k, form.alias("form_type"), F.when(k % 2 == 0, "a").otherwise("b").alias("side"), pixels.alias("pixels"), F.lit(16).alias("width"), F.lit(16).alias("height"))


def _regions(spark):
    r = spark.createDataFrame(_REGIONS, "form_type string, side string, question string, letter string, x int, y int, w int, h int")
    return r.withColumns({"name": F.concat("question", "letter"), "image_width": F.lit(16), "image_height": F.lit(16)})


@query(f"""WITH {_PAGE}, b AS (SELECT *, greatest(rx - 1, 0) AS x1, greatest(ry - 1, 0) AS y1, least(rx + rw + 1, 16) AS x2, least(ry + rh + 1, 16) AS y2 FROM r WHERE form_type <> '8'),
  s AS (SELECT b.form_type, b.side, question, letter, y, x, 1 - {_PIXEL.format(key="b.form_type || b.side")} / 255.0::DOUBLE AS printed FROM b JOIN g ON x >= x1 AND x < x2 AND y >= y1 AND y < y2),
  m AS (SELECT c_custkey, question, letter, sum(exp(-5 * printed) * greatest(1 - {_PIXEL.format(key="c_custkey")} / 255.0::DOUBLE - printed - 0.05, 0) ** 3) AS score FROM p JOIN s USING (form_type, side) WHERE NOT missing GROUP BY ALL),
  w AS (SELECT c_custkey, question, arg_max(letter, score) AS letter, max(score) AS score FROM m GROUP BY 1, 2)
  SELECT c_custkey, q.question, CASE WHEN score > 0.5 THEN w.letter ELSE '' END AS answer, round(score, 4) AS best FROM p JOIN (SELECT DISTINCT form_type, side, question FROM r) q USING (form_type, side) LEFT JOIN w USING (c_custkey, question)""")
def mark_answers(spark, d):
    """Choices of each page by what was added to its form's template; form 8 has no template, form 9 no regions."""
    forms = _regions(spark).where("form_type <> '8'").select("form_type", "side").distinct()
    templates = forms.withColumns({"pixels": _image(F.concat("form_type", "side")), "width": F.lit(16), "height": F.lit(16)})
    got = marks.mark_answers(_pages(spark, d), _regions(spark), templates, accept=0.5, pad=1, sigma=0.0)
    return got.select("c_custkey", "question", "answer", F.round(F.array_max(F.map_values("scores")), 4).alias("best"))


@query(f"""WITH {_PAGE}, a AS (SELECT DISTINCT form_type, side, question || letter AS name FROM r UNION ALL SELECT '7', 'a', '5h' UNION ALL SELECT '9', 'b', '1a'),
  b AS (SELECT *, least(rw, 16 - rx) AS bw, least(rh, 16 - ry) AS bh FROM r),
  c AS (SELECT b.form_type, b.side, question || letter AS name, y, x, least(1, sqrt((x - rx - (bw - 1) / 2) ** 2 + (y - ry - (bh - 1) / 2) ** 2) / sqrt(((bw - 1) / 2) ** 2 + ((bh - 1) / 2) ** 2) / 0.3) ** 2 AS weight FROM b JOIN g ON x >= rx AND x < rx + bw AND y >= ry AND y < ry + bh),
  m AS (SELECT c_custkey, name, avg(1 - {_PIXEL.format(key="c_custkey")} / 255.0::DOUBLE) AS flat, avg(weight * (1 - {_PIXEL.format(key="c_custkey")} / 255.0::DOUBLE)) AS graduated FROM p JOIN c USING (form_type, side) WHERE NOT missing GROUP BY ALL)
  SELECT c_custkey, name, round(coalesce(flat, 0), 6) AS flat, round(coalesce(graduated, 0), 6) AS graduated, coalesce(flat >= CASE WHEN name LIKE '%b' THEN 0.55 WHEN name LIKE '%a' THEN 0.5 ELSE 0.15 END, false) AS filled FROM p JOIN a USING (form_type, side) LEFT JOIN m USING (c_custkey, name)""")
def filled_marks(spark, d):
    """Regions asked of each page: filled by mean darkness; pages without pixels and names without a region are not filled."""
    regions = _regions(spark)
    asked = regions.select("form_type", "side", "name").union(spark.createDataFrame([("7", "a", "5h"), ("9", "b", "1a")], "form_type string, side string, name string"))
    got = marks.filled_marks(_pages(spark, d), regions, asked, thresholds={"a": 0.5, "b": 0.55})
    return got.select("c_custkey", "name", F.round("flat", 6).alias("flat"), F.round("graduated", 6).alias("graduated"), "filled")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '8TH GRADE PRE-ASSESSMENT ' || o_custkey WHEN 1 THEN '7TH FIFI PRE-ASSESS' WHEN 2 THEN '6 TH 2IV POST' WHEN 3 THEN 'T GRADE HIGH SCHOOL POST' ELSE o_orderstatus END AS norm,
  CASE o_orderkey % 5 WHEN 0 THEN '8pre' WHEN 1 THEN '7pre' WHEN 2 THEN '6post' WHEN 3 THEN 'hpost' END AS form_type FROM orders""")
def header_compat(spark, d):
    """Headers in raised, circled, full-width and ligature letters, combining marks and Roman numerals."""
    k, n = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    wide = F.translate(n, "0123456789", "０１２３４５６７８９")
    x = F.when(k == 0, F.concat(F.lit("8ᵗʰ ｇｒａｄｅ　ⓟⓡⓔ－assessment "), wide)).when(k == 1, "⑦ᵀᴴ ﬁﬁ pre-assess").when(k == 2, "６ 𝐭𝐡 ²Ⅳ post").when(k == 3, "T\u0301 e\u0301 Grade ℌigh school post").otherwise(F.col("o_orderstatus"))
    return t(spark, d, "orders").select("o_orderkey", H.normalize_header(x).alias("norm"), H.infer_form_type(x).alias("form_type"))


@query("""SELECT o_orderkey, 'CUSTOMER ' || o_custkey AS made, o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS reused FROM orders""")
def reuse_results(spark, d):
    """What a first run made of the texts of open orders is read by a second one over all orders; other parameters share nothing with it."""
    folder = f"{shared_folder(spark)}/packetlane-reuse-{uuid.uuid4().hex}"
    make = lambda new: new.select(reuse.KEY, F.upper("text").alias("made"))
    orders = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.concat(F.lit("customer "), "o_custkey").alias("text"))
    reuse.reused(orders.where("o_orderstatus = 'P'"), "text", {"mode": "upper", "block": 31}, make, folder)
    reuse.reused(orders, "text", {"mode": "lower", "block": 31}, make, folder)
    return reuse.reused(orders, "text", {"block": 31, "mode": "upper"}, make, folder).select("o_orderkey", "made", "reused")


@query("""WITH i AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS n, to_json({'name': 'f' || l_linenumber, 'text': CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END})::VARCHAR AS b FROM lineitem),
  p AS (SELECT k, n // 4 AS part, string_agg(b, ',' ORDER BY n) AS items FROM i GROUP BY 1, 2), c AS (SELECT k, count(*) AS n FROM i GROUP BY 1)
  SELECT o_orderkey AS run, coalesce(part, 0)::BIGINT AS part, CASE WHEN coalesce(part, 0) = 0 THEN '{"run":' || o_orderkey || ',"status":"' || o_orderstatus || '","item_count":' || coalesce(c.n, 0) ELSE '{"run":' || o_orderkey || ',"part":' || part END || ',"items":[' || coalesce(items, '') || ']' || CASE WHEN coalesce(part, 0) = 0 AND o_orderkey % 3 = 0 THEN ',"human_review":{"open":' || o_custkey || '}' ELSE '' END || '}' AS document
  FROM orders LEFT JOIN p ON p.k = o_orderkey LEFT JOIN c ON c.k = o_orderkey""")
def recognition_documents(spark, d):
    """Documents of orders in parts of four items, written as a set, replaced by it once more and read from the current one."""
    k, n = F.col("o_orderkey"), F.col("l_linenumber")
    runs = t(spark, d, "orders").select(k.alias("run"), F.col("o_orderstatus").alias("status"), F.when(k % 3 == 0, F.concat(F.lit('{"open":'), "o_custkey", F.lit("}"))).alias("human_review"))
    items = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.struct(n, "l_partkey", "l_suppkey").alias("place"), F.concat(F.lit("f"), n).alias("name"), F.when(n % 3 != 0, F.col("l_returnflag")).alias("text"), F.lit("x").alias("_pass"))
    documents = versions.recognition_documents(runs, items, "run", "place", ("human_review",), part_items=4)
    folder = f"{shared_folder(spark)}/packetlane-documents-{uuid.uuid4().hex}"
    versions.commit(documents.select("run", F.lit(0).cast("long").alias("part"), F.lit("").alias("document")), folder, "20260101", "parquet")
    versions.commit(documents, folder, "20260102", "parquet")
    return versions.read(spark, folder)


@query(f"""WITH {_PAGE}, v AS (SELECT c_custkey, y, x, {_PIXEL.format(key="c_custkey")} AS v FROM p, g WHERE NOT missing), b AS (SELECT c_custkey, quantile_cont(v::DOUBLE, 0.01) AS lo, quantile_cont(v::DOUBLE, 0.99) AS hi FROM v GROUP BY 1),
  s AS (SELECT c_custkey, y, x, floor(greatest(0, least(255, (v - lo) / (hi - lo) * 255)))::BIGINT AS v FROM v JOIN b USING (c_custkey))
  SELECT p.c_custkey, sum(v * (y * 16 + x + 1))::BIGINT AS weighed, min(v) AS darkest, max(v) AS lightest FROM p LEFT JOIN s ON s.c_custkey = p.c_custkey GROUP BY 1""")
def page_contrast(spark, d):
    """Pages with the levels between their outer percentiles stretched; missing pages stay missing."""
    got = marks.clean_pages(_pages(spark, d), clip=None, block=None)
    level = F.transform(F.sequence(F.lit(1), F.lit(256)), lambda k: F.conv(F.hex(F.substring("pixels", k, F.lit(1))), 16, 10).cast("long"))
    v = F.when(F.col("pixels").isNotNull(), level)
    weighed = F.aggregate(F.transform("v", lambda x, k: x * (k + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return got.withColumn("v", v).select("c_custkey", weighed.alias("weighed"), F.array_min("v").alias("darkest"), F.array_max("v").alias("lightest"))
