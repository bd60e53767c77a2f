"""Results kept by content: what was computed for the same bytes with the same parameters is read, not made again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlane.store import exists

KEY = "content_key"


def signature(params: dict) -> str:
    """A name for parameters: equal whatever the order of their keys."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:32]


def reused(rows: DataFrame, content: str, params: dict, compute: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """rows with the columns that `compute` makes of their content, and `reused`: whether they were there before.

    compute takes (content_key, content), one row for each content that is new under these parameters, and returns
    content_key with the columns it makes. They are appended to `folder`, one folder for each signature of parameters, on
    which all later runs rest; nothing there is changed. A run that is lost leaves whole rows of single contents, so it only
    leaves less to make, and if two runs made the same content at once the first by value counts. Only keys of the rows meet
    the kept keys; content moves only where it is new. Null content gives nulls and is not kept.
    """
    spark = rows.sparkSession
    place = f"{folder.rstrip('/')}/{signature(params)}"
    keyed = rows.withColumn(KEY, F.sha2(F.col(content).cast("binary"), 256))
    new = keyed.where(F.col(KEY).isNotNull()).select(KEY, content)
    before = spark.read.parquet(place) if exists(spark, place) else None
    if before is not None:
        new = new.join(before.select(KEY), KEY, "left_anti")
    run = spark.sql("SELECT uuid() AS u").first()["u"]
    made = compute(new.groupBy(KEY).agg(F.first(content).alias(content)))
    made.withColumn("__run", F.lit(run)).write.mode("append").parquet(place)
    values = [c for c in made.columns if c != KEY]
    kept = spark.read.schema(f"{_ddl(made)}, __run string").parquet(place)
    one = kept.groupBy(KEY).agg(F.min(F.struct(F.col("__run") == run, *values)).alias("v"))  # rows of earlier runs come first
    out = keyed.join(one, KEY, "left")
    return out.select(*rows.columns, *[F.col("v")[c].alias(c) for c in values], F.coalesce(~F.col("v.col1"), F.lit(False)).alias("reused"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
