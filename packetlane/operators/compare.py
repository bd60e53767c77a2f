"""Truth against test: cell metrics, identifier metrics, confusion, similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlane.functions.text import categorical_type, is_text_like, levenshtein_similarity, normalize_cell, valid_id


def melt(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, value) with values as they are compared, each by its column's type, in one pass over the rows."""
    kinds = dict(df.dtypes)
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), normalize_cell(F.col(c), kinds[c]).alias("value")) for c in columns])).alias("m")).select(*keys, "m.column", "m.value")


def cell_pairs(truth: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Melted cells side by side, from a full outer join; cells of one side only are empty on the other."""
    a, b = truth.withColumnRenamed("value", "truth"), test.withColumnRenamed("value", "test")
    return a.join(b, [*keys, "column"], "full_outer").na.fill("", ["truth", "test"])


def cell_metrics(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """compared, exact, miss (truth only), overfill (test only), nonempty and accuracy."""
    t, s = F.col("truth"), F.col("test")
    out = pairs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(t == s).alias("exact"),
        F.count_if((t != "") & (s == "")).alias("miss"),
        F.count_if((t == "") & (s != "")).alias("overfill"),
        F.count_if(t != "").alias("nonempty"),
    )
    return out.withColumn("accuracy", F.try_divide("exact", "compared"))


def confusion(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent differing (truth, test) pairs."""
    c = pairs.where("truth <> test").groupBy("truth", "test").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), "truth", "test").limit(k)


def f1(p: Column, r: Column) -> Column:
    return F.when(p.isNull() | r.isNull(), None).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def id_metrics(truth: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """One row: set and bag precision, recall, F1, and surplus copies; from counts by id."""
    a = truth.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("a"))
    b = test.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("b"))
    m = a.join(b, "id", "full_outer").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    hit = (F.col("a") > 0) & (F.col("b") > 0)
    s = m.agg(F.count_if(hit).alias("both"), F.count_if(F.col("a") > 0).alias("truth_ids"), F.count_if(F.col("b") > 0).alias("test_ids"), F.sum(F.when(hit, F.col("b"))).alias("hit_rows"), F.sum("b").alias("test_rows"), F.sum(F.greatest(F.lit(0), F.col("b") - 1)).alias("duplicates"))
    s = s.withColumns({"precision_set": F.try_divide("both", "test_ids"), "precision_bag": F.try_divide("hit_rows", "test_rows"), "recall": F.try_divide("both", "truth_ids")})
    return s.withColumn("f1", f1(F.col("precision_set"), F.col("recall")))


def mean_similarity(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg(levenshtein_similarity(F.lower("truth"), F.lower("test"))).alias("similarity"), F.count(F.lit(1)).alias("n"))


def first_hit(left: DataFrame, right: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Left join to the first row of each key on the right, and how many rows there are; pre-aggregated, no window."""
    h = right.groupBy(key).agg(F.min(F.struct(*order, *[F.col(c).alias(f"v_{c}") for c in columns])).alias("f"), F.count(F.lit(1)).alias("hits"))
    return left.join(h.select(key, *[F.col(f"f.v_{c}").alias(c) for c in columns], "hits"), key, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def sheet_rows(sheets: DataFrame, columns: list[str], id_column: str, place: list[str]) -> DataFrame:
    """place (of a row: its sheet's position, its row), id (upper case, empty if none) and cells, normalised by the types of their columns."""
    kinds = dict(sheets.dtypes)
    cell = lambda c: normalize_cell(F.col(c), kinds[c])
    return sheets.select(F.struct(*place).alias("place"), F.upper(cell(id_column)).alias("id"), F.array(*[cell(c) for c in columns]).alias("cells"))


def matched_rows(truth: DataFrame, test: DataFrame) -> DataFrame:
    """Rows of the test that have an id, each with the first row of that id on any sheet of the truth and the number of such rows (null and 0: none).

    Both are rows of `sheet_rows`. The truth is one row for each id before it meets the test, so a frequent id is one row of each task.
    """
    first = truth.where("id <> ''").groupBy("id").agg(F.min_by("cells", "place").alias("truth"), F.count(F.lit(1)).alias("hits"))
    return test.where("id <> ''").join(first, "id", "left").select("id", F.col("id").alias("truth_id"), "place", "truth", F.col("cells").alias("test"), F.coalesce("hits", F.lit(0)).alias("hits"))


def aligned_rows(truth: DataFrame, test: DataFrame) -> DataFrame:
    """The same for rows at the same place: every row of the test that has an id, whatever the truth's id is there."""
    other = truth.select("place", F.col("id").alias("truth_id"), F.col("cells").alias("truth"))
    return test.where("id <> ''").join(other, "place", "left").select("id", F.coalesce("truth_id", F.lit("")).alias("truth_id"), "place", F.coalesce("truth", F.transform("cells", lambda _: F.lit(""))).alias("truth"), F.col("cells").alias("test"), F.lit(1).alias("hits"))


def compared_cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """place, column, truth, test, kind of all cells of compared rows with a value on either side."""
    cells = F.explode(F.arrays_zip(F.array(*map(F.lit, columns)).alias("column"), F.col("truth").alias("truth"), F.col("test").alias("test")))
    flat = rows.where("hits > 0").select("place", cells.alias("c")).select("place", "c.*").where("truth <> '' or test <> ''")
    return flat.withColumn("kind", F.coalesce(categorical_type(F.col("truth")), categorical_type(F.col("test"))))


def cell_report(cells: DataFrame) -> DataFrame:
    """scope (all, column, type), name and counts: one pass over the cells, by grouping sets."""
    t, s = F.col("truth"), F.col("test")
    same, like = F.lower(t) == F.lower(s), is_text_like(t) | is_text_like(s)
    flags = cells.select("column", "kind", (t == s).alias("exact"), (s == "").alias("miss"), (t == "").alias("overfill"), same.alias("same"), like.alias("like"), F.when(like, levenshtein_similarity(F.lower(t), F.lower(s))).alias("similarity"))
    known = F.col("kind").isNotNull()
    out = flags.groupingSets([["column"], ["kind"], []], "column", "kind").agg(
        F.grouping_id().alias("g"),
        F.count(F.lit(1)).alias("compared"),
        F.count_if("exact").alias("exact"),
        F.count_if("miss").alias("miss"),
        F.count_if("overfill").alias("overfill"),
        F.count_if(known).alias("categorical"),
        F.count_if(known & F.col("same")).alias("categorical_exact"),
        F.count_if("like").alias("text_like"),
        F.count_if(F.col("like") & F.col("same")).alias("text_exact"),
        F.sum("similarity").alias("similarity"),
    )
    scope = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "column").otherwise("type")
    out = out.withColumns({"scope": scope, "name": F.coalesce(F.when(F.col("g") == 1, F.col("column")).when(F.col("g") == 2, F.col("kind")), F.lit("")), "accuracy": F.try_divide("exact", "compared"), "similarity": F.try_divide("similarity", "text_like")})
    return out.where("g <> 2 or kind is not null").drop("column", "kind", "g")


def mismatch_examples(cells: DataFrame, k: int = 3) -> DataFrame:
    """column, rank, place, truth, test of the first k cells of each column that differ. Each task keeps its own first ones only."""
    order = Window.partitionBy("column").orderBy("place")
    return cells.where("truth <> test").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("column", "rank", "place", "truth", "test")


def letter_confusions(cells: DataFrame, k: int = 10) -> DataFrame:
    """truth, test and n of the k most frequent differing answers by letter; ties in the order of the texts."""
    low = cells.where("kind = 'letter' and truth <> '' and test <> '' and lower(truth) <> lower(test)").select(F.lower("truth").alias("truth"), F.lower("test").alias("test"))
    return low.groupBy("truth", "test").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "truth", "test").limit(k)


def id_report(truth: DataFrame, test: DataFrame) -> DataFrame:
    """One row on ids of all sheets of the truth and of the test, from counts by id: found, precision by rows, recall by ids, repeats, formats."""
    a, b = (x.where("id <> ''").groupBy("id").agg(F.count(F.lit(1)).alias(n)) for x, n in ((truth, "a"), (test, "b")))
    m = a.join(b, "id", "full_outer").select("id", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"), valid_id(F.col("id")).cast("int").alias("valid"))
    a, b, more = F.col("a"), F.col("b"), lambda c: F.greatest(F.lit(0), c - 1)
    hit = (a > 0) & (b > 0)
    of = lambda when, x: F.coalesce(F.sum(F.when(when, x)), F.lit(0))
    one = m.agg(
        of(a > 0, a).alias("truth_rows"), of(b > 0, b).alias("test_rows"), of(hit, b).alias("found"), F.count_if(hit).alias("unique_found"), F.count_if(a > 0).alias("truth_ids"), F.count_if(b > 0).alias("test_ids"),
        F.count_if(a > 1).alias("truth_ids_repeated"), of(a > 0, more(a)).alias("truth_duplicates"), of(hit, more(b)).alias("test_duplicates"), of(a > 0, a * F.col("valid")).alias("truth_valid"), of(hit, b * F.col("valid")).alias("test_valid"),
    )
    one = one.withColumns({"not_found": F.col("test_rows") - F.col("found"), "precision": F.try_divide("found", "test_rows"), "recall": F.try_divide("unique_found", "truth_ids"), "truth_valid_rate": F.try_divide("truth_valid", "truth_rows"), "test_valid_rate": F.try_divide("test_valid", "found")})
    return one.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def report(truth: DataFrame, test: DataFrame, columns: list[str], *, by_id: bool = True) -> DataFrame:
    """All metrics of a comparison as one long table: scope, name, metric, value. truth, test: rows of `sheet_rows`; by_id: found on any sheet of the truth, else aligned by place."""
    cells = compared_cells(matched_rows(truth, test) if by_id else aligned_rows(truth, test), columns)
    counted = cell_report(cells)

    def long(df: DataFrame, scope: Column, name: Column) -> DataFrame:
        names = [c for c in df.columns if c not in ("scope", "name")]
        rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]))
        return df.select(scope.alias("scope"), name.alias("name"), rows.alias("m")).select("scope", "name", "m.*")

    macro = counted.where("scope = 'column'").agg(F.avg("accuracy").alias("macro_accuracy"))
    parts = [long(counted, F.col("scope"), F.col("name")), long(macro, F.lit("all"), F.lit("")), long(id_report(truth, test), F.lit("ids"), F.lit(""))]
    return reduce(DataFrame.unionByName, parts).where("value is not null")


_SPACE, _OTHER = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
HEAD = 60


def _cutter(size: int):
    return lambda k: F.substring(F.col("text"), k, F.lit(size))


def _tagger(by_word: bool):
    return lambda head: F.struct(F.lit(by_word).alias("by_word"), head.alias("head"))


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, item_id: documents (doc_id, text) that hold a passage (item_id, text) of any length, wherever it begins.

    Candidates come from an equi-join on heads of at most HEAD characters. A passage with white space inside has its head
    at its second word, as there any document that holds it has a word start too; the head of any other passage is
    its beginning, looked for at every character. Then the exact test decides.
    """
    inner = F.regexp_extract("text", rf"(?s){_SPACE}({_OTHER}.{{0,{HEAD - 1}}})", 1)
    heads = passages.where("text is not null").select("item_id", F.col("text").alias("passage"), (inner != "").alias("by_word"), F.when(inner != "", inner).otherwise(F.substring("text", 1, HEAD)).alias("head"))
    heads = heads.withColumn("size", F.length("head"))
    docs = docs.select("doc_id", "text")
    found = [F.array().cast("array<struct<by_word:boolean,head:string>>")]
    for by_word, size in sorted(tuple(r) for r in heads.select("by_word", "size").distinct().collect()):
        if by_word:
            at = F.regexp_extract_all("text", F.lit(rf"(?s)(?<={_SPACE})(?=({_OTHER}.{{{size - 1}}}))"), 1)
        else:
            at = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - (size - 1))), _cutter(size))
        found.append(F.transform(F.array_distinct(at), _tagger(by_word)))
    starts = docs.select("doc_id", F.explode(F.concat(*found)).alias("s")).select("doc_id", "s.*")
    starts = starts.join(heads.select("by_word", "head").distinct(), ["by_word", "head"], "left_semi")
    pairs = starts.join(heads, ["by_word", "head"]).select("doc_id", "item_id", "passage")
    return pairs.join(docs, "doc_id").where(F.contains("text", F.col("passage"))).select("doc_id", "item_id").distinct()
