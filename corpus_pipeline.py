"""The corpus pipeline: language ID, near-dedup, substring dedup, mixing, tokens.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all rows of its input. All but the last
return the columns of documents (extra columns of the input stay where the stage only filters). Null and
empty texts are rejected by the first stage; rows with a null doc_id are no copies of others and stay; an empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlane.llm import bpe, langid, minhash, mixing, substrings
from packetlane.llm.queries import tokenizer
from packetlane.llm.store import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of the tokens that the mixing stage keeps.
BUDGET = 0.8


def _bundled(docs: DataFrame) -> DataFrame:
    """Other columns than those of documents as one, so that no name of theirs meets a name that a stage adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in COLUMNS]
    return docs.select(*[c for c in COLUMNS if c in docs.columns], *([F.struct(*rest).alias("__rest")] if rest else []))


def _unbundled(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col(c) if c in COLUMNS else F.col(f"__rest.`{c}`").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not recognised with a calibrated score."""
    return _unbundled(langid.identify(_bundled(docs), langid.learn(docs)).where("not rejected"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies."""
    kept = minhash.near_duplicates(docs).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings that an earlier document has; documents with nothing left go."""
    cut = substrings.dedup(docs, keep_text=True, characters=True, carry=["lang", "source"])
    return cut.where(F.octet_length("kept") > 0).select("doc_id", F.col("kept").cast("string").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics come near their target shares; no weights are kept, so probabilities are bounded. Rows with a null doc_id are drawn by their text."""
    drawn = F.coalesce("sampled", mixing.uniform(F.col("text")) < F.col("probability"))
    return _unbundled(mixing.mix(_bundled(docs), budget=BUDGET, bounded=True).where(drawn), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), *tokenizer()).drop("text")


STAGES = [("language_id", language), ("minhash_near_dedup", near_duplicates), ("suffix_dedup", repeated_strings), ("mixing", mix), ("byte_bpe", tokens)]

#: SQL can't express the trained, hashed and tokenised stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
