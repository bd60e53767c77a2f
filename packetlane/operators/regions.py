"""Regions of interest: kinds from names, boxes, and choices from darkness scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlane.functions.text import norm_ws


def region_kinds(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Adds question, letter and kind: a number with lettered siblings is mcq, a letter one mcq_choice, all else text."""
    r = regions.withColumns({"question": F.regexp_extract("name", r"\A(\d+)[A-Za-z]?\z", 1), "letter": F.lower(F.regexp_extract("name", r"\A\d+([A-Za-z])\z", 1))})
    r = r.withColumn("question", F.when(F.col("question") != "", F.col("question")))
    choices = r.where("letter <> '' and question is not null").groupBy(*keys, "question").agg(F.array_sort(F.collect_set("letter")).alias("letters"))
    out = r.join(choices, [*keys, "question"], "left")
    kind = F.when((F.col("letter") != "") & F.col("question").isNotNull(), "mcq_choice").when(F.col("letters").isNotNull(), "mcq").otherwise("text")
    return out.withColumn("kind", kind)


def union_boxes(choices: DataFrame, keys: list[str]) -> DataFrame:
    """The box around all choices of a question."""
    b = choices.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b"))
    return b.select(*keys, "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h"))


def box_from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Null for an empty box; corners in any order."""
    box = F.struct(F.least(x1, x2).alias("x"), F.least(y1, y2).alias("y"), F.abs(x2 - x1).alias("w"), F.abs(y2 - y1).alias("h"))
    return F.when((x1 != x2) & (y1 != y2), box)


def box_from_points(points: Column) -> Column:
    """Bounding box of an array of [x, y]."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return box_from_corners(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def scale_and_clip(x: Column, y: Column, w: Column, h: Column, sx: Column, sy: Column, width: Column, height: Column, pad: int = 0) -> Column:
    """A schema's box on an image of another size, widened by pad and held inside; null if nothing is left."""
    left, top = F.greatest(F.lit(0), F.bround(x * sx) - pad), F.greatest(F.lit(0), F.bround(y * sy) - pad)
    right, bottom = F.least(width, F.bround((x + w) * sx) + pad), F.least(height, F.bround((y + h) * sy) + pad)
    return F.when((right > left) & (bottom > top), F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h")))


def usable_regions(regions: DataFrame, keys: list[str], min_size: int = 4) -> DataFrame:
    """Regions with a unique name, a size and a place inside the image."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "name"))
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("w") <= F.col("image_width")) & (F.col("y") + F.col("h") <= F.col("image_height"))
    return regions.withColumn("__n", n).where((F.col("__n") == 1) & (F.col("w") >= min_size) & (F.col("h") >= min_size) & inside).drop("__n")


def argmax_choice(scores: DataFrame, keys: list[str], choice: str = "choice", score: str = "score", threshold: float = 0.0) -> DataFrame:
    """The choice with the best score above the threshold, alphabetically first on a tie; else an empty answer."""
    best = scores.groupBy(*keys).agg(F.min(F.struct((-F.col(score)).alias("neg"), F.col(choice).alias("choice"))).alias("b"))
    return best.select(*keys, F.when(-F.col("b.neg") > threshold, F.col("b.choice")).otherwise("").alias("answer"), (-F.col("b.neg")).alias("score"))


def line_stats(lines: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("line_count"), F.coalesce(F.min(score), F.lit(0.0)).alias("min_score"), F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score"))


def corner_box(corners: Column) -> Column:
    """Corners (array of four numbers) as whole numbers x1, y1, x2, y2; null if there are not four or the box is empty."""
    v = F.transform(corners, lambda x: F.round(x.try_cast("double")).cast("int"))
    names = ("x1", "y1", "x2", "y2")
    ok = (F.size(v) == 4) & F.forall(v, lambda x: x.isNotNull()) & (F.get(v, 2) > F.get(v, 0)) & (F.get(v, 3) > F.get(v, 1))
    return F.when(ok, F.struct(*[F.get(v, k).alias(n) for k, n in enumerate(names)]))


def top_rows(height: Column, percent: Column) -> Column:
    """Rows of an image in its top part of this many percent, one at least."""
    p = F.greatest(F.lit(0.01), F.least(F.lit(100.0), percent))
    return F.when(height <= 0, 0).otherwise(F.greatest(F.lit(1), F.least(height, F.bround(height * p / 100).cast("int"))))


def named_regions(regions: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Regions with a name, trimmed, other than those dropped (whatever their case), with whole coordinates."""
    name = F.trim(F.coalesce("name", F.lit("")))
    kept = regions.withColumn("name", name).where((F.col("name") != "") & ~F.lower("name").isin(*[d.lower() for d in drop] or [""]))
    return kept.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).cast("int") for c in ("x", "y", "w", "h")})


def preview_regions(lines: DataFrame, least: int = 4, longest: int = 80) -> DataFrame:
    """Lines of text as regions to begin with: named by their text, of a least size."""
    text = norm_ws(F.coalesce("text", F.lit("")))
    size = lambda c: F.greatest(F.lit(least), F.coalesce(F.col(c).try_cast("double"), F.lit(float(least))).cast("int"))
    at = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).cast("int")
    return lines.where(text != "").withColumns({"name": F.substring(text, 1, longest), "x": at("x"), "y": at("y"), "w": size("w"), "h": size("h")})


def inside_root(path: Column, root: str) -> Column:
    """A path below a root, absolute; null if it leaves the root, names a parent, or is blank."""
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    base = root.rstrip("/") + "/"
    full = F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit(base), p))
    return F.when((p != "") & ~F.array_contains(F.split(p, "/"), "..") & F.startswith(full, F.lit(base)), full)
