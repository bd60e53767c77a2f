"""Readers of the JSON documents that a capture run leaves: manifests, region schemas, mappings, items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetlane.operators.pages import reading_order

REGION = "struct<id:string,name:string,x:double,y:double,w:double,h:double,postprocess_passes:array<string>,vlm_query:string,output_regex:string,post_normalize:boolean,post_normalize_mode:string>"
SCHEMA = f"image_path string, image_name string, image_width int, image_height int, rois array<{REGION}>"
MANIFEST = "version int, merged_pdf_path string, sources array<struct<source_index:int,source_file_name:string,stored_pdf_path:string,page_count:int,merged_page_start:int,merged_page_end:int>>, pages array<struct<merged_page:string,source_index:int,source_file_name:string,source_pdf_path:string,source_page:string>>"
ENTRY = "struct<type:string,source:string,column:string,value:string,transform:string,map:map<string,string>,default:string,mark:string,blank:string,no_answer:string,choices:map<string,string>>"
MAPPING = f"form_type string, sheet string, start_row int, mappings array<{ENTRY}>"


def _json(spark: SparkSession, path, schema: str) -> DataFrame:
    """One document a file; a file that is no JSON object gives a row of nulls, which callers drop."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_name"))


def region_schemas(spark: SparkSession, path) -> DataFrame:
    """One row for each region; form_type and side come from names like 6pre_a.json, others are the default (null)."""
    d = _json(spark, path, SCHEMA).where("rois is not null")
    form, side = F.regexp_extract("file", r"\A(.+)_([ab])\.json\z", 1), F.regexp_extract("file", r"\A(?:.+_)?(?:side)?([ab])\.json\z", 1)
    d = d.withColumns({"form_type": F.when(~form.isin("", "schema"), form), "side": F.when(side != "", side)})
    r = d.select("form_type", "side", "image_width", "image_height", F.posexplode("rois").alias("pos", "r"))
    return r.select("form_type", "side", "image_width", "image_height", "pos", "r.*").where("trim(name) <> ''").fillna(0, ["x", "y", "w", "h"])


def manifest_pages(spark: SparkSession, path) -> DataFrame:
    """Pages of manifests with their position; bad files give nothing."""
    d = _json(spark, path, MANIFEST).where("pages is not null")
    return d.select("file", F.posexplode("pages").alias("pos", "p")).select("file", "pos", "p.*")


def manifest_sources(spark: SparkSession, path) -> DataFrame:
    return _json(spark, path, MANIFEST).where("sources is not null").select("file", F.explode("sources").alias("s")).select("file", "s.*")


def mapping_entries(spark: SparkSession, path, sheets: dict[str, str] | None = None) -> DataFrame:
    """One row for each entry with its position; `sheets` overrides the sheet of a form. A mapping without its keys is an error."""
    d = _json(spark, path, MAPPING)
    ok = F.col("form_type").isNotNull() & F.col("sheet").isNotNull() & F.col("start_row").isNotNull() & F.col("mappings").isNotNull()
    d = d.withColumn("mappings", F.when(ok, F.col("mappings")).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(" lacks a required key")))))
    if sheets:
        named = F.create_map(*[F.lit(x) for kv in sheets.items() for x in kv])
        d = d.withColumn("sheet", F.coalesce(F.try_element_at(named, "form_type"), "sheet"))
    return d.select("form_type", "sheet", "start_row", F.posexplode("mappings").alias("entry_pos", "e")).select("form_type", "sheet", "start_row", "entry_pos", "e.*")


def items(spark: SparkSession, path, limit: int | None = None) -> DataFrame:
    """Items of documents that are {"items": [...]}, an array, or one object; rows that are no objects are skipped. limit: the first ones by file and place."""
    text = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    whole = F.when(F.startswith(kind, F.lit("ARRAY")), F.col("v")).otherwise(F.coalesce(F.try_variant_get("v", "$.items", "variant"), F.try_parse_json(F.concat(F.lit("["), F.to_json("v"), F.lit("]")))))
    parts = spark.tvf.variant_explode(F.col("v").outer())
    rows = text.select("file", whole.alias("v")).lateralJoin(parts).select("file", F.col("pos").alias("item_index"), F.col("value").alias("item"))
    rows = rows.where(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")))
    return rows.orderBy("file", "item_index").limit(limit) if limit is not None else rows


def ocr_lines(readings: DataFrame) -> DataFrame:
    """readings: page, texts, scores, boxes (arrays of [x1, y1, x2, y2], or of points [[x, y], ...]); one row for each line with a box.

    `place` is the line's place in reading order of its page: by lines of 8 pixels from the top, then from the left. Lines of a page are few, so a window orders them.
    """
    z = readings.select("page", F.posexplode(F.arrays_zip("texts", "scores", "boxes")).alias("pos", "z"))
    points = "array<array" in dict(readings.dtypes)["boxes"].removeprefix("array<")
    side = lambda k: F.transform("z.boxes", lambda p: F.get(p, F.lit(k)))
    ends = [F.array_min(side(0)), F.array_min(side(1)), F.array_max(side(0)), F.array_max(side(1))] if points else [F.try_element_at("z.boxes", F.lit(k)) for k in (1, 2, 3, 4)]
    x1, y1, x2, y2 = ends
    out = z.select("page", "pos", F.col("z.texts").alias("text"), F.col("z.scores").alias("score"), F.least(x1, x2).alias("x"), F.least(y1, y2).alias("y"), F.abs(x2 - x1).alias("w"), F.abs(y2 - y1).alias("h"))
    return out.where("w > 0 and h > 0").withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(*reading_order(), "pos")))


def odd_images(spark: SparkSession, path) -> DataFrame:
    """Files named page_0001 and so on, odd pages only: path and page, no content is read."""
    f = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length", F.regexp_extract("path", r"page_(\d+)\.\w+\z", 1).try_cast("int").alias("page"))
    return f.where("page % 2 = 1")


def newest_first(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("modificationTime"), F.lower("path"))
