"""Sinks that change as a whole: a new set of files becomes the current one by a single rename, earlier sets stay as backups.

Spark writes a set (any format, any partitioning) to a folder of its own below the sink. Then the pointer, a small file that
names it, is put in its place by one rename, on any file system Hadoop knows. Readers follow the pointer: they see the old set
or the new one, never both, whenever a task, an executor or the driver is lost. The last writer to commit is current.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from packetlane.store import exists, file_system

POINTER = "current.json"


def commit(df: DataFrame, path: str, stamp: str, fmt: str = "json", partition_by: tuple[str, ...] = (), **options) -> str:
    """Writes df as the sink's next set, `stamp` telling when; returns its name. The one before stays until `vacuum`."""
    spark, name = df.sparkSession, f"{stamp}-{uuid.uuid4().hex}"
    writer = df.write.format(fmt).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(f"{path}/{name}")
    point(spark, path, name, fmt, df.schema.json())
    return name


def point(spark: SparkSession, path: str, name: str, fmt: str, schema: str) -> None:
    body = json.dumps({"set": name, "format": fmt, "schema": schema})
    jvm = spark.sparkContext._jvm
    draft, fs = file_system(spark, f"{path}/{POINTER}.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(body.encode()))
    out.close()
    # a rename that replaces its target is one step
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), replace)


def current(spark: SparkSession, path: str) -> dict | None:
    """What the pointer says: set, format and schema; None before the first commit."""
    if not exists(spark, f"{path}/{POINTER}"):
        return None
    return json.loads(spark.read.text(f"{path}/{POINTER}", wholetext=True).first()["value"])


def read(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The current set, or the one of this name (of the current one's format and columns)."""
    at = current(spark, path)
    if at is None:
        raise FileNotFoundError(f"nothing was committed to {path!r}")
    return spark.read.format(at["format"]).schema(StructType.fromJson(json.loads(at["schema"]))).load(f"{path}/{name or at['set']}")


def sets(spark: SparkSession, path: str) -> list[str]:
    """Names of all sets that hold a finished write, oldest stamp first; sets of lost writers are not among them."""
    p, fs = file_system(spark, path)
    if not fs.exists(p):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Deletes all but the current set and the `keep` finished ones with the latest stamps before it; returns what went."""
    at = (current(spark, path) or {}).get("set")
    old = [s for s in sets(spark, path) if s != at]
    gone = old[: max(0, len(old) - keep)]
    for s in gone:
        p, fs = file_system(spark, f"{path}/{s}")
        fs.delete(p, True)
    return gone


def recognition_documents(runs: DataFrame, items: DataFrame, run: str, position: str, blocks: tuple[str, ...] = (), part_items: int = 10_000) -> DataFrame:
    """A JSON document for each run: its columns, `item_count`, its `items` in order, then those of its `blocks` (JSON text) that aren't null.

    Items keep nulls; columns that begin with an underscore are internal and stay out. A run of more than `part_items` items
    is continued in further parts, so none grows without bound; each part carries the run's name and all but the first only items.
    """
    shown = [c for c in items.columns if c not in (run, position) and not c.startswith("_")]
    body = F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})
    rank = F.row_number().over(Window.partitionBy(run).orderBy(position)) - 1
    numbered = items.select(run, rank.alias("__k"), body.alias("__b"))
    parts = numbered.groupBy(run, F.floor(F.col("__k") / part_items).alias("part")).agg(F.array_sort(F.collect_list(F.struct("__k", "__b"))).alias("__i"), F.count(F.lit(1)).alias("__n"))
    totals = parts.groupBy(run).agg(F.sum("__n").alias("item_count"))
    heads = runs.join(totals, run, "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))
    fields = [c for c in runs.columns if c not in blocks and not c.startswith("_")]
    start = F.regexp_replace(F.to_json(F.struct(*fields, "item_count")), r"\}\z", "")
    tail = F.concat(*[F.coalesce(F.concat(F.lit(f',"{b}":'), F.col(b)), F.lit("")) for b in blocks], F.lit("}"))
    joined = heads.select(run, start.alias("__start"), tail.alias("__tail")).join(parts, run, "left")
    listed = F.concat(F.lit(',"items":['), F.array_join(F.transform(F.coalesce("__i", F.array()), lambda i: i["__b"]), ","), F.lit("]"))
    first = F.coalesce(F.col("part"), F.lit(0)) == 0
    more = F.regexp_replace(F.to_json(F.struct(run, "part")), r"\}\z", "")
    return joined.select(run, F.coalesce("part", F.lit(0)).cast("long").alias("part"), F.concat(F.when(first, F.col("__start")).otherwise(more), listed, F.when(first, F.col("__tail")).otherwise("}")).alias("document"))
