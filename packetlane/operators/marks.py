"""Choices marked on scanned pages: pages meet the regions and the printed template of their form and are scored in Arrow batches.

A page stays one row until its scores are there, so its pixels are never copied by a region. Pages of several megabytes
want `spark.sql.execution.arrow.maxBytesPerBatch` at some tens of megabytes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlane.functions import imaging
from packetlane.functions import marks as M
from packetlane.store import written

FORM = ["form_type", "side"]
#: Templates and regions up to this many bytes are broadcast; beyond it each form's pages are dealt over SALTS parts.
BROADCAST_BYTES = 64 << 20
SALTS = 32
_BOX = ("x", "y", "w", "h")


def form_sheets(regions: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """One row for each form and side: its regions as an array in order of name, the size they were drawn for, its template."""
    more = [c for c in ("name", "question", "letter") if c in regions.columns]
    box = F.struct(*more, *[F.col(c).cast("double").alias(c) for c in _BOX])
    sheets = regions.groupBy(*FORM).agg(F.array_sort(F.collect_list(box)).alias("regions"), F.max("image_width").alias("image_width"), F.max("image_height").alias("image_height"))
    if templates is None:
        return sheets.withColumns({"t_pixels": F.lit(None).cast("binary"), "t_width": F.lit(None).cast("int"), "t_height": F.lit(None).cast("int")})
    # one template a form: the first by size and bytes, should there be several
    one = templates.groupBy(*FORM).agg(F.min(F.struct("width", "height", "pixels")).alias("t"))
    one = one.select(*FORM, F.col("t.pixels").alias("t_pixels"), F.col("t.width").alias("t_width"), F.col("t.height").alias("t_height"))
    return sheets.join(one, FORM, "left")


def join_forms(pages: DataFrame, sheets: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Each page with the sheet of its form and side; pages without one keep nulls. One form may hold most pages."""
    sheets = written(sheets)
    size = sheets.agg(F.coalesce(F.sum(F.coalesce(F.length("t_pixels"), F.lit(0)) + 256 * F.size("regions")), F.lit(0)).alias("n")).first()["n"]
    if size <= limit:
        return pages.join(F.broadcast(sheets), FORM, "left")
    salted = pages.withColumn("__salt", F.pmod(F.xxhash64("pixels"), F.lit(SALTS)))
    copies = sheets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("__salt", F.col("__salt").cast("long"))
    return salted.join(copies, [*FORM, "__salt"], "left").drop("__salt")


def _scaled(regions, ref_w, ref_h, width: int, height: int) -> list[tuple[float, ...]]:
    fits = pd.isna(ref_w) or pd.isna(ref_h) or ref_w <= 0 or ref_h <= 0
    sx, sy = (1.0, 1.0) if fits else (width / ref_w, height / ref_h)
    return [(r["x"] * sx, r["y"] * sy, r["w"] * sx, r["h"] * sy) for r in regions]


def mark_scores(pages: DataFrame, regions: DataFrame, templates: DataFrame, *, pad: int = 5, eps: float = 0.05, suppress: float = 5.0, power: float = 3.0, sigma: float = 5.0, limit: int = BROADCAST_BYTES) -> DataFrame:
    """pages (form_type, side, pixels, width, height, others) without pixels, with `choices`: array of (question, letter, score).

    regions: form_type, side, question, letter, x, y, w, h, image_width, image_height. Scores are null where the page is
    missing or broken, its form has no regions, or its template is missing.
    """

    @F.pandas_udf("array<double>")
    def score(pixels: pd.Series, width: pd.Series, height: pd.Series, t_pixels: pd.Series, t_width: pd.Series, t_height: pd.Series, boxes: pd.Series, ref_w: pd.Series, ref_h: pd.Series) -> pd.Series:
        out = []
        for p, w, h, tp, tw, th, b, rw, rh in zip(pixels, width, height, t_pixels, t_width, t_height, boxes, ref_w, ref_h, strict=True):
            if b is None or not M.whole(p, w, h) or not M.whole(tp, tw, th):
                out.append(None)
                continue
            w, h = int(w), int(h)
            corners = [(max(round(x) - pad, 0), max(round(y) - pad, 0), min(round(x + bw) + pad, w), min(round(y + bh) + pad, h)) for x, y, bw, bh in _scaled(b, rw, rh, w, h)]
            out.append(M.added_marks(M.image(p, w, h), (bytes(tp), int(tw), int(th)), corners, eps, suppress, power, sigma))
        return pd.Series(out, dtype=object)

    joined = join_forms(pages, form_sheets(regions, templates), limit)
    boxes = F.transform("regions", lambda r: F.struct(*[r[c].alias(c) for c in _BOX]))
    scored = joined.withColumn("__s", score("pixels", "width", "height", "t_pixels", "t_width", "t_height", boxes, F.col("image_width").cast("double"), F.col("image_height").cast("double")))
    choices = F.zip_with("regions", F.coalesce("__s", F.array()), lambda r, s: F.struct(r["question"].alias("question"), r["letter"].alias("letter"), s.alias("score")))
    return scored.withColumn("choices", choices).drop("__s", "pixels", "regions", "image_width", "image_height", "t_pixels", "t_width", "t_height")


def mark_answers(pages: DataFrame, regions: DataFrame, templates: DataFrame, accept: float = 0.0, **settings) -> DataFrame:
    """A row for each page and question of its form: the letter with most added darkness, if above `accept`, first by alphabet on a tie; else ''.

    All of it happens inside the page's own row. `scores` maps letters to scores; pages that can't be scored answer '' with null scores.
    Of regions with the same question and letter the last by place counts.
    """
    rows = mark_scores(pages, regions, templates, **settings)
    q = rows.withColumn("question", F.explode(F.array_sort(F.array_distinct(F.transform("choices", lambda c: c["question"])))))
    own = F.filter("choices", lambda c: c["question"].eqNullSafe(F.col("question")))
    letters = F.array_sort(F.array_distinct(F.transform(own, lambda c: c["letter"])))
    last = lambda a: F.element_at(F.filter(own, lambda c: c["letter"] == a), -1)["score"]
    pairs = F.transform(letters, lambda a: F.struct(a.alias("letter"), last(a).alias("score")))
    q = q.withColumn("__p", pairs)
    best = F.array_min(F.transform(F.filter("__p", lambda p: p["score"] > max(accept, 0.0)), lambda p: F.struct((-p["score"]).alias("n"), p["letter"].alias("letter"))))
    known = F.exists("__p", lambda p: p["score"].isNotNull())
    return q.withColumns({"answer": F.coalesce(best["letter"], F.lit("")), "scores": F.when(known, F.map_from_entries("__p"))}).drop("choices", "__p")


def filled_marks(pages: DataFrame, regions: DataFrame, asked: DataFrame, *, graduated: bool = False, thresholds: dict[str, float] | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A row for each page and name asked of its form: mean darkness, the mean weighed towards the edge, and whether the region is filled.

    asked: form_type, side, name. A page without pixels, or a name without a region, is not filled and has darkness 0.
    Of regions with the same name the first by place counts.
    """
    limits = thresholds or {}

    @F.pandas_udf("array<struct<flat:double,graduated:double>>")
    def score(pixels: pd.Series, width: pd.Series, height: pd.Series, boxes: pd.Series, ref_w: pd.Series, ref_h: pd.Series) -> pd.Series:
        out = []
        for p, w, h, b, rw, rh in zip(pixels, width, height, boxes, ref_w, ref_h, strict=True):
            if b is None or not M.whole(p, w, h):
                out.append(None)
                continue
            w, h = int(w), int(h)
            held = []
            for box in _scaled([{k: int(r[k]) for k in _BOX} for r in b], rw, rh, w, h):
                x, y, bw, bh = map(int, box)
                x, y = max(0, min(x, w - 1)), max(0, min(y, h - 1))
                held.append((x, y, max(1, min(bw, w - x)), max(1, min(bh, h - y))))
            out.append([{"flat": f, "graduated": g} for f, g in M.flat_and_graduated(M.image(p, w, h), held)])
        return pd.Series(out, dtype=object)

    names = asked.where(F.col("name").isNotNull()).groupBy(*FORM).agg(F.array_sort(F.collect_set("name")).alias("asked"))
    sheets = form_sheets(regions).join(names, FORM, "right").withColumn("regions", F.coalesce("regions", F.array()))
    joined = join_forms(pages, sheets, limit)
    boxes = F.transform("regions", lambda r: F.struct(*[r[c].alias(c) for c in _BOX]))
    scored = joined.withColumn("__s", score("pixels", "width", "height", boxes, F.col("image_width").cast("double"), F.col("image_height").cast("double")))
    seen = scored.withColumn("__s", F.zip_with("regions", F.coalesce("__s", F.array()), lambda r, s: F.struct(r["name"].alias("name"), s["flat"].alias("flat"), s["graduated"].alias("graduated"))))
    one = seen.withColumn("name", F.explode("asked")).withColumn("__s", F.try_element_at(F.filter("__s", lambda s: s["name"] == F.col("name")), F.lit(1)))
    label = F.lower(F.substring("name", -1, 1))
    least = F.coalesce(*[F.when(label == a, F.lit(v)) for a, v in limits.items()], F.lit(M.FILLED))
    value = F.col("__s")["graduated" if graduated else "flat"]
    out = one.withColumns({"filled": F.coalesce(value >= least, F.lit(False)), "flat": F.coalesce(F.col("__s.flat"), F.lit(0.0)), "graduated": F.coalesce(F.col("__s.graduated"), F.lit(0.0))})
    return out.drop("__s", "asked", "pixels", "regions", "image_width", "image_height", "t_pixels", "t_width", "t_height")


def clean_pages(pages: DataFrame, *, deskew: bool = False, least_skew: float = 0.3, clip: float | None = 2.0, tiles: int = 8, stretch: tuple[float, float, float] | None = (1.0, 99.0, 1.0), block: int | None = 31, offset: float = 10) -> DataFrame:
    """pages with their pixels cleaned and `skew`, the degrees that were taken out: turned upright, equalised by tiles, stretched, made black and white.

    A step whose setting is None (deskew: False) is left out. Missing or broken pages keep their pixels and have no skew.
    No shuffle: each page is cleaned where it is; `reuse.reused` keeps what was made of the same bytes before.
    """

    @F.pandas_udf("struct<pixels:binary,skew:double>")
    def clean(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        out, skews = [], []
        for p, w, h in zip(pixels, width, height, strict=True):
            if not M.whole(p, w, h):
                out.append(p)
                skews.append(None)
                continue
            page = M.image(p, int(w), int(h))
            turn = imaging.skew(page) if deskew else 0.0
            turn = turn if abs(turn) >= least_skew else 0.0
            page = imaging.turned(page, -turn) if turn else page
            page = imaging.equalized(page, clip, tiles) if clip is not None else page
            page = imaging.contrast(page, *stretch) if stretch is not None else page
            page = imaging.binarized(page, block, offset) if block is not None else page
            out.append(page.tobytes())
            skews.append(turn)
        return pd.DataFrame({"pixels": pd.Series(out, dtype=object), "skew": pd.Series(skews, dtype=float)})

    cleaned = pages.withColumn("__c", clean("pixels", "width", "height"))
    return cleaned.withColumns({"pixels": F.col("__c.pixels"), "skew": F.col("__c.skew")}).drop("__c")
