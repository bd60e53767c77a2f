"""Lineage graphs: nodes, edges, degrees and what is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlane.operators.mapping import ITEM_SOURCES
from packetlane.operators.validation import TYPES, destinations
from packetlane.store import dropped, written


def nodes(**tables: DataFrame) -> DataFrame:
    """(kind, name) of each table's column `name`, under the keyword's name as kind."""
    return reduce(DataFrame.unionByName, [t.select(F.lit(k).alias("kind"), F.col("name").cast("string").alias("name")) for k, t in tables.items()])


def edges(*tables: DataFrame) -> DataFrame:
    """(source, target) rows of all tables, repeats kept once."""
    return reduce(DataFrame.unionByName, [t.select("source", "target") for t in tables]).distinct()


def degrees(edge: DataFrame) -> DataFrame:
    """In and out degree of each node, from one pass and one pre-aggregated grouping."""
    ends = edge.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def dangling(edge: DataFrame, node: DataFrame) -> DataFrame:
    """Edges whose source is no node."""
    return edge.join(node.select(F.col("name").alias("source")).distinct(), "source", "left_anti")


def contracted(edge: DataFrame, middle: Column) -> DataFrame:
    """(source, target) of nodes that aren't middle ones and that a path leads through, from one to the other, over middle nodes only.

    middle: a condition on `node`. Only middle nodes that middle nodes lead to and from take part in rounds, and what is kept there are the ends
    that they reach and the pairs of a power of two of steps, not all pairs between: a chain of n middle nodes takes log2(n) rounds of at
    most n pairs; circles end when a round finds nothing new. All other edges are joined once.
    """
    is_middle = F.coalesce(middle, F.lit(False))
    first = edge.where("source is not null and target is not null").select("source", "target", F.col("source").alias("node")).select("source", "target", is_middle.alias("from_middle"), F.col("target").alias("node"))
    marked = written(first.select("source", "target", "from_middle", is_middle.alias("to_middle")))
    pairs = lambda condition: marked.where(condition).select("source", "target")
    direct, entering = pairs("not from_middle and not to_middle"), pairs("not from_middle and to_middle")
    inner, leaving = pairs("from_middle and to_middle"), pairs("from_middle and not to_middle")

    passed = inner.select(F.inline(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("way")), F.struct(F.col("target").alias("node"), F.lit(2).alias("way")))))
    passed = written(passed.groupBy("node").agg(F.bit_or("way").alias("way")).where("way = 3").select("node"))
    steps = written(inner.join(passed.select(F.col("node").alias("source")), "source", "left_semi").distinct())
    ends = steps.select(F.explode(F.array("source", "target")).alias("source")).distinct()
    reached = written(leaving.join(ends, "source", "left_semi").distinct())
    dropped(passed)
    n = reached.count()
    while True:
        more = written(reached.unionByName(_joined(steps, reached)).distinct())
        dropped(reached)
        reached, before = more, n
        n = reached.count()
        if n == before:
            break
        longer = written(_joined(steps, steps).distinct())
        dropped(steps)
        steps = longer
    dropped(steps)

    over_inner = written(_joined(inner, leaving.unionByName(reached)).distinct())
    dropped(reached)
    out = written(direct.unionByName(_joined(entering, leaving.unionByName(over_inner))).distinct())
    dropped(marked, over_inner)
    return out


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """(source, target) of a pair on the left and one on the right that goes on where it ends."""
    return left.select("source", F.col("target").alias("via")).join(right.select(F.col("source").alias("via"), "target"), "via").select("source", "target")


def mapping_graph(rows: DataFrame, keys: list[str], sources: DataFrame) -> DataFrame:
    """keys, source, target, kind, row, choice: edges from regions, item fields and static values to mapping rows, and from these to columns.

    rows: keys, row, type, source, column, choices, no_answer, as in `validation`. sources: keys, source, id of the regions; a source may have several.
    """
    kind, name = F.lower(F.trim(F.coalesce("type", F.lit("")))), F.trim(F.coalesce("source", F.lit("")))
    node = F.concat(F.lit("map:"), F.col("row").cast("string"))
    given = rows.select(*keys, "row", kind.alias("__type"), name.alias("__source"), node.alias("target"))
    own = F.when(F.col("__type") == "static", F.concat(F.lit("static:"), F.col("row").cast("string"))).when(F.col("__source").isin(*ITEM_SOURCES), F.concat(F.lit("virtual:"), "__source"))
    none = F.lit(None).cast("string").alias("choice")
    fixed = given.withColumn("source", own).where("source is not null").select(*keys, "source", "target", F.when(F.col("__type") == "static", "static_to_mapping").otherwise("source_to_mapping").alias("kind"), "row", none)
    found = given.where(own.isNull()).join(sources.select(*keys, F.col("source").alias("__source"), "id"), [*keys, "__source"])
    found = found.select(*keys, F.col("id").alias("source"), "target", F.lit("source_to_mapping").alias("kind"), "row", none)
    to = destinations(rows, keys).select(*keys, node.alias("source"), F.concat(F.lit("col:"), "column").alias("target"), F.lit("mapping_to_column").alias("kind"), "row", F.coalesce("choice", F.lit("")).alias("choice"))
    return reduce(DataFrame.unionByName, [fixed, found, to])


def direct_edges(graph: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, column, row, choice: what a region, field or value fills, without the mapping row between."""
    a = graph.where("kind <> 'mapping_to_column'").select(*keys, "row", "source")
    b = graph.where("kind = 'mapping_to_column'").select(*keys, "row", F.substring("target", 5, 10).alias("column"), "choice")
    return a.join(b, [*keys, "row"]).select(*keys, "source", "column", "row", "choice")


def graph_nodes(rows: DataFrame, keys: list[str], sources: DataFrame, columns: DataFrame, graph: DataFrame) -> DataFrame:
    """keys, id, kind, mapped of all nodes: regions, item fields, static values, mapping rows, and columns of the sheet or that a row writes to."""
    forms = rows.select(*keys).distinct()
    of = lambda df, id_, kind: df.select(*keys, id_.alias("id"), F.lit(kind).alias("kind"))
    row = F.col("row").cast("string")
    written_to = graph.where("kind = 'mapping_to_column'").select(*keys, F.col("target").alias("id")).unionByName(columns.select(*keys, F.concat(F.lit("col:"), F.upper(F.trim("column"))).alias("id"))).distinct()
    every = [
        of(sources, F.col("id"), "region"),
        of(forms.select(*keys, F.explode(F.array(*map(F.lit, ITEM_SOURCES))).alias("f")), F.concat(F.lit("virtual:"), "f"), "item_field"),
        of(rows.where(F.lower(F.trim("type")) == "static"), F.concat(F.lit("static:"), row), "static"),
        of(rows, F.concat(F.lit("map:"), row), "mapping"),
        of(written_to, F.col("id"), "column"),
    ]
    ends = graph.select(*keys, F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("__in", F.lit(True))
    return reduce(DataFrame.unionByName, every).join(ends, [*keys, "id"], "left").select(*keys, "id", "kind", (F.coalesce("__in", F.lit(False)) | F.col("kind").isin("static", "mapping")).alias("mapped"))


def graph_issues(rows: DataFrame, keys: list[str], sources: DataFrame, columns: DataFrame) -> DataFrame:
    """keys, severity, code, row, message of mapping rows that lead from or to nothing. Forms without known columns are not checked for columns."""
    kind, name = F.lower(F.trim(F.coalesce("type", F.lit("")))), F.trim(F.coalesce("source", F.lit("")))
    text = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    row = F.col("row").cast("string")
    issue = lambda df, severity, code, message: df.select(*keys, F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col("row").cast("long").alias("row"), message.alias("message"))
    named = rows.withColumns({"__type": kind, "__source": name})
    to = destinations(rows, keys)
    known = sources.select(*keys, F.trim("source").alias("__source")).distinct()
    lost = named.where((F.col("__type") != "static") & (F.col("__source") != "") & ~F.col("__source").isin(*ITEM_SOURCES)).join(known, [*keys, "__source"], "left_anti")
    sheet = columns.select(*keys, F.upper(F.trim("column")).alias("column")).distinct()
    return reduce(DataFrame.unionByName, [
        issue(named.where(~F.col("__type").isin(*TYPES)), "error", "unknown_mapping_type", text("type ", F.col("__type"), " of row ", row, " is unknown")),
        issue(lost, "error", "missing_source", text("row ", row, " names a source that no region has: ", F.col("__source"))),
        issue(named.where((F.col("__type") != "static") & (F.col("__source") == "")), "error", "missing_source_field", text("row ", row, " names no source")),
        issue(named.where("__type <> 'static'").join(to.select(*keys, "row").distinct(), [*keys, "row"], "left_anti"), "warning", "missing_destination", text("row ", row, " names no column")),
        issue(to.join(sheet.select(*keys).distinct(), keys, "left_semi").join(sheet, [*keys, "column"], "left_anti"), "error", "missing_column", text("row ", row, " writes to a column that the sheet lacks: ", F.col("column"))),
    ])
