"""Queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlane.llm import bpe, embeddings, html_text, langid, minhash, mixing, negatives, ngram, ogg, periods, substrings, tools, toxicity
from packetlane.llm.sampling import crc_mod


def tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.link_tool_calls(*tools.calls_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")), tools.SCHEMAS)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = crc_mod(F.col("doc_id"), 3) == 1
    model = toxicity.learn(docs, labels, languages=langid.learn(docs.where(~held), fit_rows=2000))  # its cuts by language see no held-out row either
    held = held.alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", "predicted")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode_decode(docs, *tokenizer()).drop("text")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir))


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_column(documents(spark, sf_dir))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), drop_text=True)
    return out.select("doc_id", "tokens", "topic", F.round("probability", 6).alias("probability"), F.round("weight", 6).alias("weight"), "sampled")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0, label=label)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(documents(spark, sf_dir), change=periods.rotated)


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score_all(documents(spark, sf_dir), crc_mod(F.col("doc_id"), 5) == 1)


QUERIES = {"op1_chat_tools": op1_chat_tools, "op2_minhash_dedup": op2_minhash_dedup, "op3_toxicity": op3_toxicity, "op4_byte_bpe": op4_byte_bpe, "op5_suffix_dedup": op5_suffix_dedup, "op6_ogg_media": op6_ogg_media, "op7_embedding_dedup": op7_embedding_dedup, "op8_language_id": op8_language_id, "op9_mixing": op9_mixing, "op10_html_text": op10_html_text, "op11_hard_negatives": op11_hard_negatives, "op12_periodic_runs": op12_periodic_runs, "op13_lm_score": op13_lm_score}
SQL: dict[str, str] = {"op1_chat_tools": tools.SQL, "op9_mixing": mixing.sql(), "op11_hard_negatives": negatives.SQL}
