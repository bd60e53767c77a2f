"""Pages, packets and records: forward fill of form types, pairing, provenance, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_fill(df: DataFrame, partition: list[str], order: list[str], value: Column, source: Column, out: str = "filled", out_source: str = "filled_from") -> DataFrame:
    """The last non-null value at or before each row, and which row had it; leading nulls stay null."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({out: F.last(value, ignorenulls=True).over(w), out_source: F.last(F.when(value.isNotNull(), source), ignorenulls=True).over(w)})


def fill_counts(df: DataFrame, partition: list[str], value: Column, filled: str = "filled") -> DataFrame:
    """How many rows were inferred, and how many stayed unresolved."""
    return df.groupBy(*partition).agg(F.count_if(value.isNull() & F.col(filled).isNotNull()).alias("inferred"), F.count_if(F.col(filled).isNull()).alias("unresolved"))


def page_side(n: Column) -> Column:
    return F.when(n % 2 == 0, "b").otherwise("a")


def pair_index(position: Column) -> Column:
    """Zero-based positions to pairs."""
    return F.floor(position / 2)


def pair_pages(pages: DataFrame, keys: list[str], position: str, columns: dict[str, Column]) -> DataFrame:
    """One row for each pair of pages; the first page's columns get the prefix odd_, the second's even_ (null if there is none)."""
    p = pages.withColumn("pair", pair_index(F.col(position)))
    even = F.col(position) % 2 == 1
    aggs = [F.max(F.when(~even, c)).alias(f"odd_{n}") for n, c in columns.items()] + [F.max(F.when(even, c)).alias(f"even_{n}") for n, c in columns.items()]
    return p.groupBy(*keys, "pair").agg(*aggs)


def page_gate(pages: DataFrame, keys: list[str], multiple: int = 2) -> DataFrame:
    """Packets whose number of pages is no multiple of what a record needs."""
    n = pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"))
    return n.where(F.col("pages") % multiple != 0).withColumn("remainder", F.col("pages") % multiple)


def page_ranges(sources: DataFrame, partition: list[str], order: str, count: str) -> DataFrame:
    """page_start and page_end of each source in the merged packet, by a running sum."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(count).over(w)
    return sources.withColumn("page_end", end).withColumn("page_start", F.col("page_end") - F.col(count) + 1)


def manifest_pages(ranges: DataFrame) -> DataFrame:
    """One row for each merged page, with its page in the source."""
    return ranges.where("page_end >= page_start").withColumn("merged_page", F.explode(F.sequence("page_start", "page_end"))).withColumn("source_page", F.col("merged_page") - F.col("page_start") + 1)


def clean_manifest(rows: DataFrame, order: str) -> DataFrame:
    """Positive integer merged pages, the last row of each; a missing source page is the merged page."""
    r = rows.withColumn("merged_page", F.col("merged_page").cast("string").try_cast("int")).where("merged_page > 0")
    w = Window.partitionBy("merged_page").orderBy(F.desc(order))
    return r.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn").withColumn("source_page", F.coalesce(F.col("source_page").cast("string").try_cast("int"), "merged_page"))


def with_provenance(pages: DataFrame, manifest: DataFrame, default_name: Column) -> DataFrame:
    """Left join of pages to a manifest, with the packet's own name and page as fallbacks."""
    m = manifest.select("merged_page", F.col("source_file_name").alias("__name"), F.col("source_page").alias("__page"))
    out = pages.join(m, pages["page_num"] == m["merged_page"], "left")
    return out.withColumns({"source_file_name": F.coalesce("__name", default_name), "source_page": F.coalesce("__page", "page_num")}).drop("merged_page", "__name", "__page")


def numeric_name_order(name: str, numeric_first: bool = True) -> list[Column]:
    """Sort key of field names: numbers by value, before or after all others."""
    n = F.when(F.col(name).rlike(r"\A\d+\z"), F.col(name).try_cast("bigint"))
    return [n.asc_nulls_last() if numeric_first else n.asc_nulls_first(), F.col(name).asc()]


def reading_order() -> list[Column]:
    """Lines of 8 pixels, then left to right."""
    return [F.bround(F.col("y") / 8).asc(), F.col("x").asc()]


def slice_item(trace: DataFrame, item: int) -> DataFrame:
    return trace.where(F.col("page_index").isin(2 * item, 2 * item + 1))


# Names of sources that are no regions.
RESERVED_SOURCES = ("id", "form_type", "page_odd", "page_even")


def merge_pages(odd: DataFrame, even: DataFrame) -> DataFrame:
    """Rows of both pages of a pair, with the side they come from."""
    return odd.withColumn("page_in_pair", F.lit("odd")).unionByName(even.withColumn("page_in_pair", F.lit("even")), allowMissingColumns=True)


def prefix_slice(trace: DataFrame, name: str, pages: list[int]) -> DataFrame:
    """Entries p<page>:... of a run's trace that belong to some pages."""
    return trace.where(F.regexp_extract(F.col(name), r"\Ap([0-9]+):", 1).isin(*[str(p) for p in pages]))


def range_slice(cells: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """Cells (row, column as numbers) inside a range, both ends included."""
    return cells.where(F.col("row").between(*rows) & F.col("column").between(*columns))


def source_order(name: str) -> list[Column]:
    """Reserved sources, then numbers, then numbers with letters, then other names."""
    c = F.col(name)
    number = F.regexp_extract(c, r"\A([0-9]+)[A-Za-z]*\z", 1).try_cast("bigint")
    kind = F.when(c.isin(*RESERVED_SOURCES), -1).when(c.rlike(r"\A[0-9]+\z"), 0).when(number.isNotNull(), 1).otherwise(2)
    return [kind, F.coalesce(F.when(kind >= 0, number), F.lit(0)), F.lower(c), c]


def source_catalog(regions: DataFrame, lenient: bool = False) -> DataFrame:
    """form_type and source: what mappings of a form may name. regions: form_type, side, name. Without both sides a form has none, unless lenient."""
    named = regions.select("form_type", "side", F.trim("name").alias("source"))
    if not lenient:
        whole = named.groupBy("form_type").agg(F.count_distinct("side").alias("sides")).where("sides >= 2")
        named = named.join(whole.select("form_type"), "form_type", "left_semi")
    reserved = named.select("form_type").distinct().select("form_type", F.explode(F.array(*map(F.lit, RESERVED_SOURCES))).alias("source"))
    return named.where("source <> ''").select("form_type", "source").unionByName(reserved).distinct()


def expected_forms(files: DataFrame, path: str = "path") -> DataFrame:
    """Names of forms from template images' names, without their side."""
    stem = F.regexp_replace(F.regexp_extract(F.col(path), r"([^/]*)\.png\z", 1), r"(?i)_[ab]\z", "")
    return files.select(stem.alias("form_type")).where(F.col("form_type").rlike(r"\A[A-Za-z0-9][A-Za-z0-9_\-]*\z")).distinct()


def form_types(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct form types of each run, and how many there are."""
    return pages.where(F.coalesce(F.trim("form_type"), F.lit("")) != "").groupBy(*keys).agg(F.array_sort(F.collect_set(F.trim("form_type"))).alias("form_types")).withColumn("n", F.size("form_types"))
