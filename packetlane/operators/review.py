"""Human review: the queue and the corrections that come back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlane.functions.text import entry_id, make_ref, valid_id

THRESHOLD = 0.85


def needs_review(flag: Column, score: Column, threshold: float = THRESHOLD) -> Column:
    """An explicit flag decides; else a score below the threshold."""
    return F.when(flag.isNotNull(), flag).otherwise(F.coalesce(score < threshold, F.lit(False)))


def queue(*branches: DataFrame, key: list[str], separator: str = "\0") -> DataFrame:
    """Branches of rows (kind, key columns, ...) in one queue, with review_ref and entry_id."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)
    cols = [F.col("kind"), *[F.col(k) for k in key]]
    return rows.withColumns({"review_ref": make_ref(*cols), "entry_id": entry_id(*cols, separator=separator)})


def keep_first(rows: DataFrame, key: list[str], order: list[str], only_kind: str | None = None) -> DataFrame:
    """The first row of each key; with only_kind, rows of other kinds all stay."""
    pick = rows if only_kind is None else rows.where(F.col("kind") == only_kind)
    rest = [c for c in rows.columns if c not in {*key, *order}]
    first = pick.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("__r"))
    out = first.select(*[c if c in key else F.col(f"__r.{c}").alias(c) for c in rows.columns])
    return out if only_kind is None else out.unionByName(rows.where(~F.equal_null("kind", F.lit(only_kind))))


UNCHANGED = ("skipped", "cancelled")  # fixed values: statuses of corrections that never change anything


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def apply_corrections(rows: DataFrame, corrections: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """Upsert by key: of several corrections the last counts; skipped, cancelled and blank ones never change anything."""
    new = stripped(F.col("corrected"))
    live = corrections.where(~stripped(F.lower(F.coalesce("status", F.lit("")))).isin(*UNCHANGED) & (new != "")).withColumn("__corrected", new)
    last = live.groupBy(*key).agg(F.max(F.struct(order, "__corrected")).alias("c")).select(*key, F.col("c.__corrected").alias("__new"))
    out = rows.join(last, key, "left")
    return out.withColumns({"corrected": F.col("__new").isNotNull(), value: F.coalesce("__new", F.col(value))}).drop("__new")


def pending(items: DataFrame, rows: DataFrame, source: str, *, threshold: float = THRESHOLD, use_flags: bool = True, all_ids: bool = False) -> DataFrame:
    """The review queue of a run, one row for each thing to look at.

    items: item_index, id, id_score, id_flag. rows: item_index, position, page_in_pair, name, kind, text, score, flag, ref (may be null).
    An id is looked at if it is no record id, flagged, or read with a score below the threshold; a text if it is flagged,
    or without a flag scored below the threshold; a choice if it is empty. Texts with one ref count once, the first.
    """
    flagged = F.coalesce("id_flag", F.lit(False)) if use_flags else F.lit(False)
    low = F.coalesce(F.col("id_score") < threshold, F.lit(False))
    record = stripped(F.coalesce("id", F.lit("")))
    ids = items.where(F.lit(all_ids) | ~valid_id(record) | flagged | low).select(
        "item_index", F.lit(0).cast("long").alias("position"), F.lit("_").alias("page_in_pair"), F.lit("__id__").alias("name"), F.lit("id").alias("kind"), record.alias("text_current"), F.round("id_score", 6).alias("score"), F.col("id_flag").alias("flag"), F.lit(None).cast("string").alias("ref")
    )
    kind = F.lower(F.coalesce("kind", F.lit("")))
    score = F.coalesce(F.col("score") < threshold, F.lit(False))
    look = F.coalesce(F.col("flag"), score) if use_flags else score
    page = F.coalesce(F.when(F.col("page_in_pair") != "", F.col("page_in_pair")), F.lit("unknown"))
    empty = stripped(F.coalesce("text", F.lit(""))) == ""
    fields = rows.where(((kind == "text") & look) | ((kind == "mcq") & empty)).select(
        "item_index", F.col("position").cast("long").alias("position"), page.alias("page_in_pair"), F.coalesce("name", F.lit("")).alias("name"), kind.alias("kind"), F.when(kind == "mcq", "").otherwise(F.coalesce("text", F.lit(""))).alias("text_current"), F.when(kind == "text", F.round("score", 6)).alias("score"), F.when(kind == "text", look).alias("flag"), F.when(F.col("ref") != "", F.col("ref")).alias("ref")
    )
    parts = [F.lit(source), F.col("item_index"), F.col("page_in_pair"), F.col("name"), F.col("kind")]
    out = ids.unionByName(fields).withColumns({"review_ref": F.coalesce("ref", make_ref(*parts)), "entry_id": entry_id(*parts), "status": F.lit("pending")}).drop("ref")
    texts = out.where("kind = 'text'")
    first = texts.groupBy("review_ref").agg(F.min(F.struct("item_index", "position", *[c for c in out.columns if c not in ("item_index", "position", "review_ref")])).alias("r"))
    return out.where("kind <> 'text'").unionByName(first.select("review_ref", "r.*"))


def pending_of_queue(queue: DataFrame, source: str) -> DataFrame:
    """Entries that readers queued themselves, in the form of `pending`, with what they leave out filled in."""
    page = F.coalesce(F.when(F.col("page_in_pair") != "", F.col("page_in_pair")), F.lit("unknown"))
    parts = [F.lit(source), F.col("item_index"), page, F.coalesce("name", F.lit("")), F.lit("text")]
    return queue.where(F.lower("kind") == "text").select("item_index", page.alias("page_in_pair"), F.coalesce("name", F.lit("")).alias("name"), F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text_current"), F.round("score", 6).alias("score"), "flag", F.coalesce(F.when(F.col("ref") != "", F.col("ref")), make_ref(*parts)).alias("review_ref"), entry_id(*parts).alias("entry_id"), F.lit("pending").alias("status"))


def correct_items(items: DataFrame, rows: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, rows) after a review. corrections: item_index, kind, review_ref, name, page_in_pair, corrected, status, position.

    Of an id the last correction counts, in upper case. A field is found by its ref within its item, else it is the first row with the name
    and kind, and the page if one is given; the last correction that finds a row counts. Rows need position and ref; both sides stay whole.
    """
    new = stripped(F.col("corrected"))
    live = corrections.where(~F.lower(F.coalesce("status", F.lit("pending"))).isin(*UNCHANGED) & (new != "")).select("item_index", F.lower("kind").alias("kind"), F.when(F.col("review_ref") != "", F.col("review_ref")).alias("ref"), F.coalesce("name", F.lit("")).alias("name"), F.when(F.col("page_in_pair") != "", F.col("page_in_pair")).alias("page"), new.alias("new"), F.col("position").alias("turn"))
    ids = live.where("kind = 'id'").groupBy("item_index").agg(F.upper(F.max_by("new", "turn")).alias("__id"))
    fixed = items.join(ids, "item_index", "left").withColumn("id", F.coalesce("__id", "id")).drop("__id")
    wanted = live.where(F.col("kind").isin("text", "mcq"))
    of = rows.select("item_index", "position", F.col("ref").alias("r_ref"), F.coalesce("name", F.lit("")).alias("name"), F.lower("kind").alias("kind"), F.coalesce("page_in_pair", F.lit("")).alias("r_page"))
    hits = ["item_index", "turn", "new"]
    by_ref = wanted.where("ref is not null").join(of.select("item_index", F.col("r_ref").alias("ref"), "position"), ["item_index", "ref"]).groupBy(*hits).agg(F.min("position").alias("position"))
    left = wanted.join(by_ref.select("item_index", "turn"), ["item_index", "turn"], "left_anti")
    by_name = left.join(of.drop("r_ref"), ["item_index", "name", "kind"]).where("page is null or page = r_page").groupBy(*hits).agg(F.min("position").alias("position"))
    last = by_ref.unionByName(by_name).groupBy("item_index", "position").agg(F.max_by("new", "turn").alias("__new"))
    return fixed, rows.join(last, ["item_index", "position"], "left").withColumn("text", F.coalesce("__new", "text")).drop("__new")
