"""The registered queries of this subpackage, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm import chat, digest, fertility, mixing, neardup, packing, perplexity, planes, secrets, substrings
from kinetrace.llm.tokens import public_path
from kinetrace.session import prepare, shared_folder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = shared_folder(spark, "bit-planes")
    planes.write_dataset(_read(spark, sf_dir, "documents"), to, public_path("byte_bpe_50k.json"))
    return planes.document_index(spark, to)


def op2_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(_read(spark, sf_dir, "documents"), report=32)


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perplexity.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "perplexity", "threshold", "trusted", "kept")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_turns(chat.table_turns(table.unionByName(extra))))


def op5_feature_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(_read(spark, sf_dir, "documents"))


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_rules(_read(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_read(spark, sf_dir, "documents"))


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = packing.prompted(_read(spark, sf_dir, "documents"))
    return packing.pack_documents(texts, public_path("word_bpe_49k.json"), segments="segments", **packing.INSTRUCTION).drop("ids", "loss_mask")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents")).drop("uid")


def op10_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    f.__name__: f
    for f in (
        op1_bit_planes,
        op2_paragraph_dedup,
        op3_kneser_ney,
        op4_chat_format,
        op5_feature_digest,
        op6_fertility,
        op7_secrets,
        op8_vector_packing,
        op9_jaccard_join,
        op10_systematic_mix,
    )
}

SQL = {"op4_chat_format": chat.chat_sql(), "op10_systematic_mix": mixing.mix_sql()}
