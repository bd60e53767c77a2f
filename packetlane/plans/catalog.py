"""Queries for the driver's tables and the SQL that gives the same rows.

Each query applies an operator of this library to a whole table; `@query(sql)` registers both under the function's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetlane.functions import jsonfix
from packetlane.functions import header as H
from packetlane.functions import text as X
from packetlane.operators import compare, lineage, mapping, normalize, pages, readings, regions, review
from packetlane.streaming import packets

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _customers(spark, d):
    n = t(spark, d, "nation").join(F.broadcast(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows by definition of the tables
    return t(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))


@query("""SELECT c_custkey, '2026' AS a, upper(n_name) AS b, lower(r_name) AS c,
  CASE lower(c_mktsegment) WHEN 'building' THEN 'B' WHEN 'machinery' THEN 'M' ELSE 'other' END AS d, CAST(c_nationkey AS VARCHAR) AS e,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'Yes' ELSE 'No' END AS f, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Yes' ELSE 'No' END AS g
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def sheet_rows(spark, d):
    entries = [
        {"type": "static", "column": "a", "value": 2026},
        {"type": "direct", "column": "b", "source": "nation", "transform": "upper"},
        {"type": "direct", "column": "c", "source": "region", "transform": "lower"},
        {"type": "lookup", "column": "d", "source": "segment", "map": {"building": "B", "machinery": "M"}, "default": "other"},
        {"type": "direct", "column": "e", "source": "nation_key", "transform": "number"},
        {"type": "multi_column", "source": "segment", "choices": {"building": "f", "machinery": "g"}, "mark": "Yes", "blank": "No"},
    ]
    source = {"nation": F.col("n_name"), "region": F.col("r_name"), "segment": F.col("c_mktsegment"), "nation_key": F.col("c_nationkey").cast("string")}
    return mapping.fill_rows(_customers(spark, d), ["c_custkey"], entries, source)


@query("SELECT c_custkey, " + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 'Yes' ELSE '' END AS {s.lower()}" for s in SEGMENTS) + " FROM customer")
def multi_column_mark(spark, d):
    e = [{"type": "multi_column", "source": "segment", "choices": {s: s.lower() for s in SEGMENTS}, "mark": "Yes", "blank": ""}]
    return mapping.fill_rows(t(spark, d, "customer"), ["c_custkey"], e, {"segment": F.col("c_mktsegment")})


@query("""SELECT o_orderkey, CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 'now' WHEN '2-high' THEN 'soon' WHEN '5-low' THEN 'later' ELSE 'unset' END AS value FROM orders""")
def lookup_default(spark, d):
    table = F.create_map(*[F.lit(x) for kv in {"1-urgent": "now", "2-high": "soon", "3-medium": "", "5-LOW": "never", "5-low": "later"}.items() for x in kv])
    return t(spark, d, "orders").select("o_orderkey", mapping.lookup(F.col("o_orderpriority"), table, F.lit("unset")).alias("value"))


@query("""WITH e AS (SELECT c_custkey, 'q1' AS name, c_mktsegment AS text, 0 AS pos FROM customer UNION ALL SELECT c_custkey, 'q2', c_name, 0 FROM customer UNION ALL SELECT c_custkey, 'q1', 'late', 1 FROM customer)
  SELECT c_custkey, 'B' AS col, lower(text) AS value FROM e WHERE name = 'q1' AND pos = 0 UNION ALL SELECT c_custkey, 'C', upper(text) FROM e WHERE name = 'q2'""")
def fill_cells(spark, d):
    c = t(spark, d, "customer")
    row = lambda name, text, pos: F.struct(F.lit(name).alias("name"), text.alias("text"), F.lit(pos).alias("pos"))
    answers = c.select("c_custkey", F.lit("6pre").alias("form_type"), F.inline(F.array(row("q1", F.col("c_mktsegment"), 0), row(" q2", F.col("c_name"), 0), row("q1", F.lit("late"), 1))))
    entries = spark.createDataFrame([("6pre", "q1", "B", "upper", 0), ("6pre", "q1", "B", "lower", 1), ("6pre", "q2", "C", "upper", 2), ("7pre", "q1", "D", "upper", 0)], "form_type string, name string, column string, transform string, entry_pos int")
    return mapping.fill_cells(answers, entries, ["c_custkey"]).select("c_custkey", F.col("column").alias("col"), "value")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER w AS filled,
  last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS filled_from FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def asof_fill(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    signal = F.when(F.col("event_type") == "signup", F.col("value"))
    return pages.forward_fill(e, ["user_id"], ["ts", "event_id"], signal, F.col("event_id")).select("event_id", "user_id", "filled", "filled_from")


@query("""WITH f AS (SELECT user_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events)
  SELECT user_id, sum(CASE WHEN event_type <> 'signup' AND filled IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS inferred, sum(CASE WHEN filled IS NULL THEN 1 ELSE 0 END)::BIGINT AS unresolved FROM f GROUP BY user_id""")
def fill_counts(spark, d):
    signal = F.when(F.col("event_type") == "signup", F.col("value"))
    e = pages.forward_fill(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], signal, F.col("event_id"))
    return pages.fill_counts(e, ["user_id"], signal)


@query("""SELECT conv_id, turn // 2 AS pair, max(CASE WHEN turn % 2 = 0 THEN length(text) END) AS odd_n, max(CASE WHEN turn % 2 = 1 THEN length(text) END) AS even_n,
  max(CASE WHEN turn % 2 = 0 THEN role END) AS odd_role, max(CASE WHEN turn % 2 = 1 THEN role END) AS even_role FROM conversations GROUP BY ALL""")
def pair_items(spark, d):
    return pages.pair_pages(t(spark, d, "conversations"), ["conv_id"], "turn", {"n": F.length("text").cast("long"), "role": F.col("role")})


@query("SELECT conv_id, count(*) AS pages, count(*) % 2 AS remainder FROM conversations GROUP BY conv_id HAVING count(*) % 2 <> 0")
def page_gate(spark, d):
    return pages.page_gate(t(spark, d, "conversations"), ["conv_id"])


_RANGES = """r AS (SELECT o_custkey, o_orderkey, day(o_orderdate) AS pages, sum(day(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS page_end FROM orders)"""


def _ranges(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.day("o_orderdate").cast("long").alias("pages"))
    return pages.page_ranges(o, ["o_custkey"], "o_orderkey", "pages")


@query(f"WITH {_RANGES} SELECT *, page_end - pages + 1 AS page_start FROM r")
def manifest_ranges(spark, d):
    return _ranges(spark, d)


@query(f"WITH {_RANGES} SELECT o_custkey, o_orderkey, m AS merged_page, m - (page_end - pages) AS source_page FROM (SELECT *, unnest(generate_series(page_end - pages + 1, page_end)) AS m FROM r)")
def manifest_pages(spark, d):
    return pages.manifest_pages(_ranges(spark, d)).select("o_custkey", "o_orderkey", "merged_page", "source_page")


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_size % 5 ORDER BY TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_size::VARCHAR END AS BIGINT) NULLS LAST, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_size::VARCHAR END, p_partkey) AS rank_last,
  row_number() OVER (PARTITION BY p_size % 5 ORDER BY TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_size::VARCHAR END AS BIGINT) NULLS FIRST, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_size::VARCHAR END, p_partkey) AS rank_first FROM part""")
def numeric_sort_rank(spark, d):
    p = t(spark, d, "part").withColumn("name", F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.col("p_size").cast("string")))
    w = lambda first: F.row_number().over(Window.partitionBy(F.col("p_size") % 5).orderBy(*pages.numeric_name_order("name", first), "p_partkey")).cast("long")
    return p.select("p_partkey", w(True).alias("rank_last"), w(False).alias("rank_first"))


@query("SELECT p_type, trim(p_name) AS value, count(*) AS n FROM part GROUP BY ALL")
def value_counts(spark, d):
    return normalize.value_counts(t(spark, d, "part"), ["p_type"], F.col("p_name"))


_BRANDS = "c AS (SELECT p_type, p_brand AS value, count(*) AS n FROM part GROUP BY ALL)"


@query(f"WITH {_BRANDS} SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, value) AS rank FROM c WHERE n >= 2 AND NOT regexp_full_match(value, '[0-9]+([/-][0-9]+)*[A-Za-z]?|[A-Za-z]?[0-9]+[A-Za-z]?')")
def repeated_canonicals(spark, d):
    c = normalize.value_counts(t(spark, d, "part"), ["p_type"], F.col("p_brand"))
    return normalize.repeated_canonicals(c, ["p_type"]).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY ALL), b AS (SELECT c_nationkey, sum(n)::BIGINT AS total, max(n) AS n FROM c GROUP BY 1)
  SELECT b.c_nationkey, min(value) AS value, b.n, total, greatest(2, least(3, ceil(total * 0.12)))::BIGINT AS min_count, CASE WHEN b.n < greatest(2, least(3, ceil(total * 0.12))) THEN 'too_few' ELSE 'dominant' END AS reason
  FROM b JOIN c ON b.c_nationkey = c.c_nationkey AND b.n = c.n GROUP BY ALL""")
def dominant_value(spark, d):
    return normalize.dominant(normalize.value_counts(t(spark, d, "customer"), ["c_nationkey"], F.col("c_mktsegment")), ["c_nationkey"])


def _names(spark, d):
    """Names of parts by size group and type, with a few letters misread, and all that repeat as canonicals."""
    p = t(spark, d, "part")
    misread = F.when(F.col("p_partkey") % 9 == 0, F.replace("p_name", F.lit("e"), F.lit("c"))).when(F.col("p_partkey") % 25 == 0, F.lit("unknown")).otherwise(F.col("p_name"))
    counts = normalize.value_counts(p.select((F.col("p_size") % 10).alias("g"), "p_type", misread.alias("v")), ["g", "p_type"], F.col("v"))
    return counts, normalize.repeated_canonicals(counts, ["g", "p_type"])


@query("""WITH c AS (SELECT p_size % 10 AS g, p_type, CASE WHEN p_partkey % 9 = 0 THEN replace(p_name, 'e', 'c') WHEN p_partkey % 25 = 0 THEN 'unknown' ELSE p_name END AS value, count(*) AS n FROM part GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY g, p_type ORDER BY n DESC, value) AS rank FROM c WHERE n >= 2 AND lower(value) NOT IN ('unknown', 'null', 'none', 'na')),
  s AS (SELECT c.g, c.p_type, c.value, k.value AS canonical, k.rank, lower(regexp_replace(c.value, '[^A-Za-z]', '', 'g')) AS a, lower(regexp_replace(k.value, '[^A-Za-z]', '', 'g')) AS b FROM c JOIN k USING (g, p_type)),
  x AS (SELECT *, 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b), 1) AS score FROM s),
  y AS (SELECT *, row_number() OVER (PARTITION BY g, p_type, value ORDER BY score DESC, rank) AS r FROM x)
  SELECT g, p_type, value, canonical, round(score, 6) AS score FROM y WHERE r = 1 AND (score >= 0.72 OR (length(a) >= 3 AND (contains(a, b) OR contains(b, a))))""")
def cluster_assign_lev(spark, d):
    counts, known = _names(spark, d)
    return normalize.assign_clusters(counts, known, ["g", "p_type"], "levenshtein").withColumn("score", F.round("score", 6))


@query()
def cluster_assign_ratio(spark, d):
    """Ratcliff-Obershelp has no SQL form; tests hold it against difflib."""
    counts, known = _names(spark, d)
    return normalize.assign_clusters(counts, known, ["g", "p_type"], "ratio").withColumn("score", F.round("score", 6))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_brand = 'Brand#1' THEN 'Brand#11' WHEN p_size % 2 = 0 AND p_brand = 'Brand#2' THEN 'Brand#22' ELSE p_brand END AS normalized,
  CASE WHEN p_size % 2 <> 0 THEN 'not_enabled' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'applied' ELSE 'unchanged' END AS reason FROM part""")
def apply_normalized(spark, d):
    p = t(spark, d, "part").withColumn("f", F.col("p_size") % 2)
    m = spark.createDataFrame([(0, "Brand#1", "Brand#11"), (0, "Brand#2", "Brand#22"), (1, "Brand#1", "never")], "f int, value string, canonical string")
    return normalize.apply_map(p, m, ["f"], "p_brand", spark.createDataFrame([(0,)], "f int")).select("p_partkey", "normalized", "reason")


@query("SELECT p_partkey, p_type FROM part p WHERE EXISTS (SELECT 1 FROM part e WHERE e.p_size = 7 AND e.p_type = p.p_type AND e.p_brand = p.p_brand)")
def enabled_semi(spark, d):
    p = t(spark, d, "part")
    return p.join(p.where("p_size = 7").select("p_type", "p_brand").distinct(), ["p_type", "p_brand"], "left_semi").select("p_partkey", "p_type")


_QUEUE = """q AS (SELECT d.doc_id, 'unlabelled' AS kind FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL
  UNION ALL SELECT doc_id, 'low_quality' FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)"""


def _queue(spark, d, separator="\0"):
    docs, labels = t(spark, d, "documents").select("doc_id"), t(spark, d, "labels")
    branch = lambda df, kind: df.select("doc_id", F.lit(kind).alias("kind"))
    return review.queue(branch(docs.join(labels, "doc_id", "left_anti"), "unlabelled"), branch(labels.where("quality = 0"), "low_quality"), branch(labels.where("toxic = 1"), "toxic"), key=["doc_id"], separator=separator)


@query(f"WITH {_QUEUE} SELECT doc_id, kind, kind || '|' || doc_id AS review_ref FROM q")
def review_queue(spark, d):
    return _queue(spark, d).select("doc_id", "kind", "review_ref")


@query(f"WITH {_QUEUE} SELECT doc_id, substr(sha256(kind || '/' || doc_id), 1, 24) AS entry_id FROM q")
def review_refs(spark, d):
    return _queue(spark, d, "/").select("doc_id", "entry_id")


@query("SELECT l_orderkey, min_by(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS l_partkey FROM lineitem GROUP BY l_orderkey")
def review_dedupe(spark, d):
    return review.keep_first(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 3 <> 0 THEN 'fixed-' || (o_orderkey % 5) ELSE o_orderstatus END AS o_orderstatus, (o_orderkey % 7 = 0 AND o_orderkey % 3 <> 0) AS corrected FROM orders""")
def corrections(spark, d):
    o = t(spark, d, "orders")
    own = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("seq"))
    text = F.when(F.col("seq") == 0, "first").when(F.col("seq") == 1, F.concat(F.lit("\tfixed-"), F.col("o_orderkey") % 5)).otherwise("\u00a0 ")
    fixes = own.select("o_orderkey", "seq", text.alias("corrected"), F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, "cancelled").otherwise("Skipped")).otherwise("done").alias("status"))
    return review.apply_corrections(o.select("o_orderkey", "o_orderstatus"), fixes, ["o_orderkey"], "o_orderstatus", "seq").select("o_orderkey", "o_orderstatus", "corrected")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN true WHEN event_type = 'signup' THEN false ELSE value < 0.85 END AS pending FROM events""")
def low_confidence(spark, d):
    flag = F.when(F.col("event_type") == "error", True).when(F.col("event_type") == "signup", False)
    return t(spark, d, "events").select("event_id", review.needs_review(flag, F.col("value")).alias("pending"))


_CELLS = r"""a AS (SELECT o_orderkey AS k, unnest(['status', 'priority', 'cust', 'price', 'day']) AS col, unnest([o_orderstatus, trim(o_orderpriority), o_custkey::VARCHAR, printf('%.2f', o_totalprice), strftime(o_orderdate, '%Y-%m-%d')]) AS truth FROM orders),
  b AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN -o_orderkey ELSE o_orderkey END AS k, unnest(['status', 'priority', 'cust', 'price', 'day']) AS col,
    unnest([CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE trim(o_orderpriority) END, o_custkey::VARCHAR, printf('%.2f', o_totalprice), CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END]) AS test FROM orders),
  p AS (SELECT coalesce(a.col, b.col) AS col, coalesce(CASE WHEN coalesce(a.col, b.col) = 'price' THEN regexp_replace(truth, '\.?0+$', '') ELSE truth END, '') AS truth, coalesce(CASE WHEN coalesce(a.col, b.col) = 'price' THEN regexp_replace(test, '\.?0+$', '') ELSE test END, '') AS test FROM a FULL JOIN b ON a.k = b.k AND a.col = b.col),
  m AS (SELECT col, count(*) AS compared, count(*) FILTER (truth = test) AS exact, count(*) FILTER (truth <> '' AND test = '') AS miss, count(*) FILTER (truth = '' AND test <> '') AS overfill, count(*) FILTER (truth <> '') AS nonempty FROM p GROUP BY col)"""


def _sides(spark, d):
    """Truth and test with the types of their cells: the test has other keys for some rows, so both sides have rows of their own."""
    k = F.col("o_orderkey")
    base = t(spark, d, "orders").select(k.alias("k"), F.col("o_orderstatus").alias("status"), F.concat(F.lit(" "), "o_orderpriority").alias("priority"), F.col("o_custkey").cast("double").alias("cust"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderdate").alias("day"))
    k = F.col("k")
    test = base.withColumns({"status": F.when(k % 5 == 0, "F").otherwise(F.col("status")), "priority": F.when(k % 4 == 0, " ").otherwise(F.col("priority")), "day": F.when(k % 7 != 0, F.col("day").cast("timestamp"))})
    return base, test.withColumn("k", F.when(k % 13 == 0, -k).otherwise(k))


def _cells(spark, d):
    cols = ["status", "priority", "cust", "price", "day"]
    return compare.cell_pairs(*[compare.melt(x, ["k"], cols) for x in _sides(spark, d)], ["k"])


@query(f"WITH {_CELLS} SELECT *, round(exact / compared, 6) AS accuracy FROM m")
def compare_cells(spark, d):
    return compare.cell_metrics(_cells(spark, d), ["column"]).withColumnRenamed("column", "col").withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {_CELLS} SELECT round(avg(exact / compared), 6) AS macro_accuracy, sum(exact)::BIGINT AS exact FROM m")
def compare_macro(spark, d):
    return compare.cell_metrics(_cells(spark, d), ["column"]).agg(F.round(F.avg("accuracy"), 6).alias("macro_accuracy"), F.sum("exact").alias("exact"))


@query(f"WITH {_CELLS} SELECT truth, test, count(*) AS n FROM p WHERE truth <> test AND col = 'status' GROUP BY ALL ORDER BY n DESC, truth, test LIMIT 10")
def confusion_topk(spark, d):
    return compare.confusion(_cells(spark, d).where(F.col("column") == "status"))


@query("""WITH a AS (SELECT c_custkey AS id, count(*) AS a FROM customer GROUP BY 1), b AS (SELECT o_custkey AS id, count(*) AS b FROM orders GROUP BY 1), m AS (SELECT coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (id)),
  s AS (SELECT count(*) FILTER (a > 0 AND b > 0) AS both_ids, count(*) FILTER (a > 0) AS truth_ids, count(*) FILTER (b > 0) AS test_ids, sum(CASE WHEN a > 0 THEN b ELSE 0 END)::BIGINT AS hit_rows, sum(b)::BIGINT AS test_rows, sum(greatest(0, b - 1))::BIGINT AS duplicates FROM m)
  SELECT both_ids AS "both", truth_ids, test_ids, hit_rows, test_rows, duplicates, round(both_ids / test_ids, 6) AS precision_set, round(hit_rows / test_rows, 6) AS precision_bag, round(both_ids / truth_ids, 6) AS recall,
  round(2 * (both_ids / test_ids) * (both_ids / truth_ids) / (both_ids / test_ids + both_ids / truth_ids), 6) AS f1 FROM s""")
def id_prf(spark, d):
    m = compare.id_metrics(t(spark, d, "customer").withColumnRenamed("c_custkey", "id"), t(spark, d, "orders").withColumnRenamed("o_custkey", "id"), "id")
    return m.withColumns({c: F.round(c, 6) for c in ("precision_set", "precision_bag", "recall", "f1")})


@query("""SELECT p_size % 10 AS g, round(avg(1 - levenshtein(lower(p_name), lower(p_type))::DOUBLE / greatest(length(p_name), length(p_type), 1)), 6) AS similarity, count(*) AS n FROM part GROUP BY 1""")
def text_similarity(spark, d):
    return t(spark, d, "part").groupBy((F.col("p_size") % 10).alias("g")).agg(F.round(F.avg(X.levenshtein_similarity(F.lower("p_name"), F.lower("p_type"))), 6).alias("similarity"), F.count(F.lit(1)).alias("n"))


_ANSWERS = ("b", "I", "true", "Yes", "strongly agree", "Neither agree nor disagree", "neutral", "9th Grade", "7th", "Other grade", "Non-Binary", "male", "unknown/not reported", "12", " ", "Maury")


@query(f"""WITH v AS (SELECT unnest([l_returnflag, l_linestatus, {list(_ANSWERS)!r}[l_partkey % 16 + 1]]) AS v FROM lineitem), n AS (SELECT v, count(*) AS n, lower(trim(v)) AS low FROM v GROUP BY v),
  k AS (SELECT v, n, CASE WHEN length(low) = 1 AND low BETWEEN 'a' AND 'h' THEN 'letter' WHEN low IN ('true', 'false') THEN 'boolean' WHEN low IN ('strongly disagree', 'disagree', 'neither agree nor disagree', 'agree', 'strongly agree') THEN 'likert'
    WHEN low IN ('6th grade', '7th grade', '8th grade', '9th grade', 'other grade') THEN 'grade' WHEN low IN ('girl', 'boy', 'non-binary', 'unknown/not reported') THEN 'gender' END AS kind FROM n)
  SELECT v AS value, kind, kind IS NULL AND regexp_matches(v, '[A-Za-z]') AS text_like, n FROM k""")
def categorical_types(spark, d):
    v = F.explode(F.array("l_returnflag", "l_linestatus", F.array(*map(F.lit, _ANSWERS))[(F.col("l_partkey") % 16).cast("int")]))
    counted = t(spark, d, "lineitem").select(v.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("value", X.categorical_type(F.col("value")).alias("kind"), X.is_text_like(F.col("value")).alias("text_like"), "n")


@query("""WITH f AS (SELECT l_orderkey, min((l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS m, count(*) AS hits FROM lineitem GROUP BY 1)
  SELECT o_orderkey, m[2] AS l_partkey, m[4] AS l_extendedprice, coalesce(hits, 0) AS hits FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""")
def first_hit_join(spark, d):
    lines = t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return compare.first_hit(t(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["l_partkey", "l_extendedprice"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def unmatched_anti(spark, d):
    return mapping.missing(t(spark, d, "customer").select("c_custkey", "c_name"), t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("""WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal < 0), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
  SELECT k, 'both' AS side FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT k, 'customer' FROM (SELECT k FROM c EXCEPT SELECT k FROM s) UNION ALL SELECT k, 'supplier' FROM (SELECT k FROM s EXCEPT SELECT k FROM c)""")
def coverage_sets(spark, d):
    c = t(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k"))
    s = t(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    side = lambda df, name: df.withColumn("side", F.lit(name))
    return side(c.intersect(s), "both").unionByName(side(c.subtract(s), "customer")).unionByName(side(s.subtract(c), "supplier"))


_EDGES = """e AS (SELECT DISTINCT r_name AS source, n_name AS target FROM region JOIN nation ON r_regionkey = n_regionkey UNION SELECT DISTINCT n_name, s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey)"""


def _edges(spark, d):
    r, n, s = t(spark, d, "region"), t(spark, d, "nation"), t(spark, d, "supplier")
    a = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("source"), F.col("n_name").alias("target"))  # 5 rows by definition
    b = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("source"), F.col("s_name").alias("target"))  # 25 rows by definition
    return lineage.edges(a, b)


@query(f"WITH {_EDGES} SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT source AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) GROUP BY node")
def lineage_degrees(spark, d):
    return lineage.degrees(_edges(spark, d))


@query(f"WITH {_EDGES} SELECT source, target FROM e")
def lineage_edges(spark, d):
    return _edges(spark, d)


@query("""SELECT 'error' AS severity, 'no_customer' AS code, o_orderkey::VARCHAR AS subject, 'order names no customer' AS message FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
  UNION ALL SELECT 'warning', 'no_lines', o_orderkey::VARCHAR, 'order has no lines' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT 'warning', 'reused', o_custkey::VARCHAR, 'customer has many orders' FROM orders GROUP BY o_custkey HAVING count(*) > 15""")
def mapping_issues(spark, d):
    o, c, li = t(spark, d, "orders"), t(spark, d, "customer"), t(spark, d, "lineitem")
    a = mapping.missing(o.select("o_orderkey", "o_custkey"), c.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select(F.col("o_orderkey").alias("subject"))
    b = mapping.missing(o.select("o_orderkey"), li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select(F.col("o_orderkey").alias("subject"))
    e = o.groupBy(F.col("o_custkey").alias("subject")).count().where("count > 15")
    return mapping.issues((a, "no_customer", "error", "order names no customer"), (b, "no_lines", "warning", "order has no lines"), (e, "reused", "warning", "customer has many orders"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 7 THEN 'a' WHEN p_size BETWEEN 20 AND 33 THEN 'b' ELSE 'c' END AS label FROM part WHERE p_size BETWEEN 1 AND 7 OR p_size BETWEEN 20 AND 33 OR p_size BETWEEN 45 AND 45")
def hidden_range_join(spark, d):
    r = spark.createDataFrame([(1, 7, "a"), (20, 33, "b"), (45, 45, "c")], "low int, high int, label string")
    return mapping.in_ranges(t(spark, d, "part").select("p_partkey", "p_size"), r, "p_size", "low", "high").select("p_partkey", "label")


@query("""WITH s AS (SELECT user_id, event_type, round(sum(value), 6) AS v FROM events GROUP BY ALL), b AS (SELECT user_id, max(v) AS score FROM s GROUP BY 1)
  SELECT b.user_id, CASE WHEN score > 0.5 THEN min(event_type) ELSE '' END AS answer, score FROM b JOIN s ON s.user_id = b.user_id AND s.v = b.score GROUP BY b.user_id, score""")
def argmax_choice(spark, d):
    s = t(spark, d, "events").groupBy("user_id", F.col("event_type").alias("choice")).agg(F.round(F.sum("value"), 6).alias("score"))
    return regions.argmax_choice(s, ["user_id"], threshold=0.5)


@query("SELECT vec_id, round(list_min(embedding)::DOUBLE, 6) AS least, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding), 6) AS mean, list_position(embedding, list_max(embedding))::BIGINT AS best FROM embeddings")
def score_stats(spark, d):
    e = F.col("embedding")
    mean = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(e)
    return t(spark, d, "embeddings").select("vec_id", F.round(F.array_min(e).cast("double"), 6).alias("least"), F.round(mean, 6).alias("mean"), F.array_position(e, F.array_max(e)).alias("best"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_pop(value), 6) AS stdev, round(count(*) FILTER (value > 50) / count(*), 6) AS rate FROM events GROUP BY 1")
def bench_stats(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.stddev_pop("value"), 6).alias("stdev"), F.round(F.count_if(F.col("value") > 50) / F.count(F.lit(1)), 6).alias("rate"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def json_scalar(spark, d):
    return t(spark, d, "events").select("event_id", jsonfix.scalar_text(F.col("props")).alias("value"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN substr(s_name, 10) WHEN s_suppkey % 4 = 1 THEN substr(s_name, 10) ELSE substr(s_name, 10) END AS value, 'Record: ' || substr(s_name, 10) AS raw FROM supplier")
def json_repair(spark, d):
    v = F.substring("s_name", 10, 100)
    k = F.col("s_suppkey") % 4
    broken = F.when(k == 0, F.concat(F.lit('{"Record ID: "'), v, F.lit('"}'))).when(k == 1, F.concat(F.lit("{'Record ID': '"), v, F.lit("'}"))).when(k == 2, F.concat(F.lit('```json\n{"Record ID" "'), v, F.lit('"}\n```'))).otherwise(F.concat(F.lit('text {"id": "'), v, F.lit('"} more')))
    return t(spark, d, "supplier").select("s_suppkey", jsonfix.scalar_text(broken).alias("value"), F.concat(F.lit("Record: "), v).alias("raw"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN regexp_replace(s_name, '[^0-9]', '', 'g') ELSE '' END AS value FROM supplier")
def regex_gate(spark, d):
    n = F.col("s_name")
    attempts = F.array(n, F.upper(n), F.when(F.col("s_suppkey") % 2 == 0, readings.run_passes(n, ["trim", "digits"])).otherwise(F.lower(n)))
    return t(spark, d, "supplier").select("s_suppkey", readings.regex_gate(attempts, "[0-9]+").alias("value"))


_GRADES = " ".join(rf"WHEN regexp_matches(n, '\b{g}\s*T\s*H\b|\b{g}\s+T\s+G\s*R\s*A\s*D\s*E\b|\b{g}\s*TH\s*GRADE\b') OR (strpos(q, '{g}TH') > 0 AND strpos(q, 'GRADE') > 0 AND abs(strpos(q, '{g}TH') - strpos(q, 'GRADE')) < 18) THEN '{g}'" for g in "876")


@query(rf"""WITH h AS (SELECT page_id, CASE page_id % 11 WHEN 0 THEN '8th Grade: Post-Assessment' WHEN 1 THEN '7 T H  GRADE pre assess' WHEN 2 THEN 'HIGH fever, post' WHEN 3 THEN 'school (High) PRE-ASSESSMENT, then POST-ASSESSMENT' WHEN 4 THEN '6THgrade post' WHEN 5 THEN url WHEN 6 THEN 'PREFERRED 8TH' WHEN 7 THEN url || ' 7 T GRADE pre-' WHEN 9 THEN 'PRE then POST' WHEN 10 THEN 'PREFER POST' END AS x FROM pages),
  m AS (SELECT *, trim(regexp_replace(regexp_replace(upper(x), '[^A-Z0-9\s\-]', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM h), k AS (SELECT *, replace(n, ' ', '') AS q, left(n, 350) AS head, regexp_extract(n, 'PRE[\s\-_]*ASSESS') AS a, regexp_extract(n, 'POST[\s\-_]*ASSESS') AS b FROM m)
  SELECT page_id, n AS norm, CASE WHEN contains(n, 'HIGH') AND contains(n, 'SCHOOL') THEN 'h' {_GRADES} END AS grade,
  CASE WHEN a <> '' AND (b = '' OR strpos(n, a) < strpos(n, b)) THEN 'pre' WHEN b <> '' THEN 'post' WHEN contains(head, 'POST') THEN CASE WHEN regexp_matches(head, '\bPRE\b') AND strpos(head, 'PRE') < strpos(head, 'POST') THEN 'pre' ELSE 'post' END WHEN regexp_matches(head, '\bPRE\b') OR contains(head, 'PRE-') THEN 'pre' END AS phase FROM k""")
def header_classify(spark, d):
    k, u = F.col("page_id") % 11, F.col("url")
    texts = ["8th Grade: Post-Assessment", "7 T H  GRADE pre assess", "HIGH fever, post", "school (High) PRE-ASSESSMENT, then POST-ASSESSMENT", "6THgrade post", u, "PREFERRED 8TH", F.concat(u, F.lit(" 7 T GRADE pre-")), None, "PRE then POST", "PREFER POST"]
    x = F.coalesce(*[F.when(k == i, v) for i, v in enumerate(texts) if v is not None])
    n = F.col("norm")
    return t(spark, d, "pages").select("page_id", H.normalize_header(x).alias("norm")).select("page_id", "norm", H.detect_grade(n).alias("grade"), H.detect_phase(n).alias("phase"))


@query("SELECT page_id, regexp_extract_all(url, '([0-9]+)', 1) AS digits, len(list_distinct(list_transform(regexp_extract_all(url, '([A-Za-z]{2,})', 1), lambda w: lower(w))))::INTEGER AS words FROM pages")
def url_tokens(spark, d):
    return t(spark, d, "pages").select("page_id", X.digit_groups(F.col("url")).alias("digits"), F.size(X.word_signatures(F.col("url"))).alias("words"))


@query("SELECT page_id, length(html) AS raw, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS clean FROM pages")
def html_cleanup(spark, d):
    clean = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\n\r\f\x0B]+", " "))
    return t(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("raw"), F.length(clean).cast("long").alias("clean"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderdate AS DATE) END AS day, month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) AS signature FROM orders")
def label_dates(spark, d):
    o, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.coalesce(*[F.when(k == i, F.concat(F.lit(" "), F.date_format(o, f))) for i, f in enumerate(("M/d/yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "MM-dd-yyyy"))], F.lit("13/45/2020"))
    return t(spark, d, "orders").select("o_orderkey", X.parse_date(text).alias("day"), F.array_join(X.date_signatures(F.concat(F.lit("Date: "), F.date_format(o, "M/d/yyyy"), F.lit(" or "), F.date_format(o, "MM-dd-yyyy"), F.lit(", not 13/1/2020"))), ";").alias("signature"))


@query("SELECT o_orderkey, 'Raw: ' || o_orderstatus || ', pages: ' || o_orderkey || '-' || (o_orderkey + 1) || ', high (0.988)' AS note FROM orders")
def comment_render(spark, d):
    m = F.create_map(F.lit("{raw}"), F.col("o_orderstatus"), F.lit("{pages}"), X.pages_string(F.col("o_orderkey"), F.col("o_orderkey") + 1), F.lit("{confidence}"), X.format_confidence(F.lit("high"), F.lit(0.98765)))
    return t(spark, d, "orders").select("o_orderkey", X.render(F.lit("Raw: {raw}, pages: {pages}, {confidence}"), m).alias("note"))


@query("SELECT l_orderkey, l_discount, 'FF' || printf('%02X', round_even(255 - 11 * (1 - l_discount * 10), 0)::INTEGER) || printf('%02X', round_even(255 - 73 * (1 - l_discount * 10), 0)::INTEGER) || printf('%02X', round_even(255 - 73 * (1 - l_discount * 10), 0)::INTEGER) AS argb, count(*) AS n FROM lineitem GROUP BY ALL")
def heatmap_hex(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey", "l_discount").agg(F.count(F.lit(1)).alias("n")).withColumn("argb", X.heat_color(F.col("l_discount") * 10))


@query("SELECT p_partkey, CASE WHEN p_partkey < 1 THEN NULL WHEN p_partkey <= 26 THEN chr((64 + p_partkey)::INTEGER) WHEN p_partkey <= 702 THEN chr((64 + (p_partkey - 1) // 26)::INTEGER) || chr((65 + (p_partkey - 1) % 26)::INTEGER) WHEN p_partkey <= 18278 THEN chr((65 + (p_partkey - 703) // 676)::INTEGER) || chr((65 + (p_partkey - 703) // 26 % 26)::INTEGER) || chr((65 + (p_partkey - 703) % 26)::INTEGER) ELSE chr((65 + (p_partkey - 18279) // 17576)::INTEGER) || chr((65 + (p_partkey - 18279) // 676 % 26)::INTEGER) || chr((65 + (p_partkey - 18279) // 26 % 26)::INTEGER) || chr((65 + (p_partkey - 18279) % 26)::INTEGER) END AS letters, CASE WHEN p_partkey > 0 THEN p_partkey END AS number FROM part")
def column_letters(spark, d):
    p = t(spark, d, "part").select("p_partkey", X.column_letters(F.col("p_partkey")).alias("letters"))
    return p.withColumn("number", X.column_number(F.col("letters")))


@query("SELECT min(doc_id) AS first_id, count(*) AS copies FROM (SELECT doc_id, lower(regexp_replace(text, '[^0-9A-Za-z]+', '', 'g')) AS k FROM documents) GROUP BY k")
def near_dup_docs(spark, d):
    k = t(spark, d, "documents").select("doc_id", F.sha2(X.compact_alnum(F.col("text")), 256).alias("k"))
    return k.groupBy("k").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).drop("k")


@query("""SELECT p_partkey, p_name AS text, CASE WHEN p_partkey % 3 = 0 THEN 'single_source' WHEN length(regexp_replace(p_name, '[^0-9A-Za-z]', '', 'g')) >= 5 THEN 'near_duplicate' ELSE 'union' END AS reason FROM part""")
def fuse_agreeing(spark, d):
    """Two readings that differ in case only, or of which one says nothing: what fusion gives, as it is."""
    p = t(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "null").otherwise(F.concat(F.lit(" "), F.col("p_name"))).alias("a_text"), F.lit(0.5).alias("a_score"), F.col("p_name").alias("b_text"), F.lit(None).cast("double").alias("b_score"))
    return readings.choose_reading(p, "fusion").select("p_partkey", "text", F.col("text_source").alias("reason"))


@query()
def fuse_readings(spark, d):
    """Two noisy readings of a name; the ladder of rules has no SQL form, tests hold it against vectors."""
    n = F.col("p_name")
    p = t(spark, d, "part").select("p_partkey", F.translate(n, "eo", "ec").alias("a_text"), F.lit(0.7).alias("a_score"), F.regexp_replace(n, r"^(\w+) (\w+)", "$1 $2s").alias("b_text"), F.lit(None).cast("double").alias("b_score"))
    return readings.choose_reading(p, "fusion").select("p_partkey", "text", "text_source", "label")


@query("""SELECT event_id, CASE WHEN value > 90 THEN 'a' ELSE 'b' END AS text, CASE WHEN value > 90 THEN 'first' ELSE 'second' END AS source FROM events""")
def reading_fallback(spark, d):
    p = t(spark, d, "events").select("event_id", F.lit("a").alias("a_text"), (F.col("value") / 100).alias("a_score"), F.lit("b").alias("b_text"), F.lit(None).cast("double").alias("b_score"))
    return readings.choose_reading(p, "fallback").select("event_id", "text", F.col("text_source").alias("source"))


@query("""SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def contamination(spark, d):
    """Documents that hold a benchmark text of any length whole."""
    return compare.containing(t(spark, d, "documents"), t(spark, d, "benchmark"))


@query("SELECT name, kind, count(*) AS n FROM (SELECT p_partkey, unnest([(p_size % 9)::VARCHAR, (p_size % 9) || 'a', CASE WHEN p_size % 2 = 0 THEN (p_size % 7) || 'B' ELSE 'id' END]) AS name, unnest([CASE WHEN true THEN 'mcq' END, 'mcq_choice', CASE WHEN p_size % 2 = 0 THEN 'mcq_choice' ELSE 'text' END]) AS kind FROM part) GROUP BY ALL")
def region_kinds(spark, d):
    p, s = t(spark, d, "part"), F.col("p_size")
    names = F.array((s % 9).cast("string"), F.concat(s % 9, F.lit("a")), F.when(s % 2 == 0, F.concat(s % 7, F.lit("B"))).otherwise("id"))
    r = regions.region_kinds(p.select("p_partkey", F.explode(names).alias("name")), ["p_partkey"])
    return r.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, min(l_quantity) AS x, min(l_tax) AS y, round(max(l_quantity + l_discount) - min(l_quantity), 6) AS w, round(max(l_tax + l_linenumber) - min(l_tax), 6) AS h FROM lineitem GROUP BY 1")
def union_boxes(spark, d):
    b = t(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"), F.col("l_discount").alias("w"), F.col("l_linenumber").alias("h"))
    return regions.union_boxes(b, ["l_orderkey"]).withColumns({"w": F.round("w", 6), "h": F.round("h", 6)})


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '[0-9]{2}') THEN 1 ELSE 0 END AS two, lower(regexp_replace(p_brand, '[^0-9A-Za-z]+', '', 'g')) AS compact, regexp_replace(lower(p_type), '[^a-z]', '', 'g') AS letters, length(regexp_replace(p_brand, '[^0-9]', '', 'g')) AS digits FROM part")
def text_scalars(spark, d):
    b = F.col("p_brand")
    return t(spark, d, "part").select("p_partkey", b.rlike("[0-9]{2}").cast("int").alias("two"), X.compact_alnum(b).alias("compact"), X.alpha_signature(F.col("p_type")).alias("letters"), F.length(F.regexp_replace(b, "[^0-9]", "")).cast("long").alias("digits"))


@query("SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    return packets.windowed(t(spark, d, "events"), "ts", ["event_type"], "1 day", n=F.count(F.lit(1)), total=F.round(F.sum("value"), 4))


@query("WITH e AS (SELECT event_type, value, date_trunc('day', ts) - INTERVAL 1 DAY * k AS w FROM events, (SELECT unnest([0, 1]) AS k)) SELECT w AS window_start, w + INTERVAL 2 DAY AS window_end, event_type, count(*) AS n FROM e GROUP BY ALL")
def sliding_windows(spark, d):
    return packets.windowed(t(spark, d, "events"), "ts", ["event_type"], "2 days", "1 day", n=F.count(F.lit(1)))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM g GROUP BY user_id, s""")
def session_windows(spark, d):
    return packets.sessions(t(spark, d, "events"), "ts", ["user_id"], "6 hours")


@query("SELECT p_type, list(p_partkey ORDER BY p_retailprice DESC, p_partkey)[1:3] AS examples FROM part GROUP BY p_type")
def topk_examples(spark, d):
    """The first three of each group. Rows are cut to three a task and group first, so no group is gathered whole."""
    p = t(spark, d, "part").select("p_type", F.struct((-F.col("p_retailprice")).alias("o"), F.col("p_partkey").alias("k")).alias("e"))
    w = Window.partitionBy("p_type").orderBy("e")
    top = p.withColumn("r", F.row_number().over(w)).where("r <= 3")
    return top.groupBy("p_type").agg(F.array_sort(F.collect_list("e")).alias("l")).select("p_type", F.transform("l", lambda e: e["k"]).alias("examples"))


@query("SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)")
def coverage_rollup(spark, d):
    return _customers(spark, d).rollup("n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0, round_even(l_quantity * 1.5, 0) - 2) AS x, least(60, round_even((l_quantity + l_linenumber) * 1.5, 0) + 2) - greatest(0, round_even(l_quantity * 1.5, 0) - 2) AS w
  FROM lineitem WHERE least(60, round_even((l_quantity + l_linenumber) * 1.5, 0) + 2) > greatest(0, round_even(l_quantity * 1.5, 0) - 2)""")
def box_scale_clip(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    box = regions.scale_and_clip(q, F.lit(0.0), n, F.lit(5.0), F.lit(1.5), F.lit(1.0), F.lit(60.0), F.lit(90.0), 2)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", box.alias("b")).where("b is not null").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "b.x", "b.w")


@query("SELECT l_orderkey, count(*) AS line_count, min(l_discount) AS min_score, round(avg(l_discount), 6) AS mean_score FROM lineitem GROUP BY 1")
def line_stats(spark, d):
    return regions.line_stats(t(spark, d, "lineitem"), ["l_orderkey"], "l_discount").withColumn("mean_score", F.round("mean_score", 6))


@query("SELECT user_id, event_type, count(*) AS calls, min(event_id) AS first_seen FROM events GROUP BY ALL")
def call_batches(spark, d):
    e = t(spark, d, "events").withColumn("model", F.struct("user_id", "event_type"))
    return readings.call_batches(e, "model", "event_id").select("model.user_id", "model.event_type", "calls", "first_seen")


@query("SELECT conv_id, turn, role FROM conversations WHERE turn IN (4, 5)")
def slice_item(spark, d):
    return pages.slice_item(t(spark, d, "conversations").withColumn("page_index", F.col("turn")), 2).select("conv_id", "turn", "role")


_FORM_NAMES = ("7pre", " HPOST ", "8post", "6th", "a[b]:c*d?e/f\\\\g", "", "a name of more than twenty letters", "6prepost")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice / 400000 >= 0.85 THEN 'high' WHEN o_totalprice / 400000 >= 0.5 THEN 'medium' ELSE 'low' END AS label,
  ['7th Pre Data (Original)', 'HS Post Data (Original)', '8th Post Data (Original)', '6th (Original)', 'a b c d e f g (Original)', 'Data (Original)', 'a name of more than (Original)', '6prepost (Original)'][o_orderkey % 8 + 1] AS sheet FROM orders""")
def score_labels(spark, d):
    form = F.array(*map(F.lit, _FORM_NAMES))[(F.col("o_orderkey") % 8).cast("int")]
    return t(spark, d, "orders").select("o_orderkey", X.score_label(F.col("o_totalprice") / 400000).alias("label"), X.original_sheet_name(form).alias("sheet"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN CASE WHEN o_totalprice = floor(o_totalprice) THEN printf('%.1f', o_totalprice) ELSE rtrim(printf('%.2f', o_totalprice), '0') END WHEN 2 THEN o_orderkey || '000000000.5' WHEN 3 THEN o_orderkey || '12345678901234567890' WHEN 4 THEN o_orderpriority ELSE '0.5' END AS number,
  CASE o_orderkey % 6 WHEN 0 THEN o_custkey || '' WHEN 1 THEN '5.0' WHEN 2 THEN 'true' ELSE 'a b' END AS text, (o_orderkey % 2 = 0)::VARCHAR.upper() AS truth,
  CASE o_orderkey % 3 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN o_custkey || '.123456'[:greatest(1, 13 - length(o_custkey::VARCHAR))] ELSE '1e-05' END AS float,
  CASE WHEN o_orderkey % 4 < 3 THEN lpad(o_custkey::VARCHAR, 7, '0') || 'A' END AS id FROM orders""")
def typed_cells(spark, d):
    """Numbers as texts, cells by their type, ids where a text has them."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    price = F.regexp_replace(F.format_string("%.2f", F.col("o_totalprice").cast("double")), r"\A0+|0+\z", "")
    number = F.coalesce(*[F.when(k % 6 == i, v) for i, v in enumerate([F.concat(F.lit("+00"), c), F.concat(price, F.lit("0")), F.concat(k, F.lit("0_0000_0000.50")), F.concat(F.lit(" "), k, F.lit("12345678901234567890 ")), F.col("o_orderpriority")])], F.lit("5.0e-1"))
    text = F.coalesce(*[F.when(k % 6 == i, v) for i, v in enumerate([c, F.lit(" 5.0"), F.lit("true")])], F.lit("a \t b "))
    float_ = F.when(k % 3 == 0, F.col("o_custkey").cast("double")).when(k % 3 == 1, F.col("o_custkey") + F.lit(0.123456)).otherwise(F.lit(0.00001))
    seven = F.concat(F.lpad(c, 7, "0"), F.lit("A"))
    id_ = F.coalesce(*[F.when(k % 4 == i, v) for i, v in enumerate([seven, F.concat(F.lit("Record: 12 "), seven), F.concat(F.lit("7654321B: x"), seven, F.lit("x 1234567B"))])], F.concat(seven, F.lit(":")))
    return t(spark, d, "orders").select("o_orderkey", X.parse_number(number).alias("number"), X.normalize_cell(text).alias("text"), X.normalize_cell(k % 2 == 0, "boolean").alias("truth"), X.normalize_cell(float_, "double").alias("float"), X.id_strict(id_).alias("id"))


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN o_orderstatus WHEN 2 THEN 'p' WHEN 3 THEN o_orderpriority WHEN 4 THEN 'true' ELSE '' END AS value FROM orders""")
def answer_scalars(spark, d):
    """The first scalar of answers with several members: order, blanks, nested values, keys that are no text."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    answer = F.coalesce(*[F.when(k % 7 == i, v) for i, v in enumerate([
        F.concat(F.lit('{"zeta": "'), c, F.lit('", "alpha": "2"}')),
        F.concat(F.lit('{"detected_text": " ", "text": null, "a": {"b": 1}, "c": [2], "b": "'), "o_orderstatus", F.lit('"}')),
        F.lit('{"confidence": 0.9, "previewed": "p", "needs_human_review": true}'),
        F.concat(F.lit('```json\n{"b": "{no object}", "text": "'), "o_orderpriority", F.lit('"}\n```')),
        F.lit('text before {"a": true, "b": 3} and after'),
        F.lit('{"text": "Unreadable"}'),
    ])], F.lit('{"confidence_label": "high"}'))
    return t(spark, d, "orders").select("o_orderkey", jsonfix.scalar_text(answer).alias("value"))
