"""A corpus pipeline of five stages over the table documents, each calling one operator of kinetrace.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder and
read again as the next one's docs, and the folder before it goes. All but the last return the columns of documents.

Defined cases: documents whose text is null or without a word are rejected by the first stage; repeated rows become one
in the second, as exact copies do; null doc_ids, languages and sources pass through all stages; very long texts are cut
only by the packing; ties are broken as the operators say; further columns, whatever their names, stay up to the
packing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetrace.llm import mixing, neardup, packing, perplexity, secrets
from kinetrace.llm.tokens import public_path
from kinetrace.session import drop_folder, prepare, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose perplexity is above their language's threshold."""
    return perplexity.keep_good(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of exact and near copies."""
    return neardup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by a mark; no document goes."""
    return secrets.redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts, prompt and answer, into sequences of 4096 tokens; one row a piece, with its token ids and loss mask."""
    return packing.pack_documents(packing.prompted(docs), public_path("word_bpe_49k.json"), segments="segments", **packing.INSTRUCTION)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixture),
    ("packing", pack),
]

#: The classifier, the MinHash forest and the tokenizer have no SQL form; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, each stage written and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            to = shared_folder(spark, f"stage-{i}")
            docs.write.parquet(to)
            docs = spark.read.parquet(to)
            if last is not None:
                drop_folder(spark, last)
            last = to
    return docs
