"""Cleans a table of documents in stages; each works on all that the stage before it kept.

All stages but the last return the columns of documents, which is all that they read: further columns do not
matter, and an empty table gives an empty one. The result has, for each document that is kept, its
id, the number and digest of its token ids and the digest of the text that they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelplan.llm import decontaminate, language, minhash, sentencepiece_bpe, suffix_dedup
from pixelplan.llm.storage import folder, remove

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = ("lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, have no letter or are like no language that the labelled rows teach."""
    model = language.fit(docs.where(~language.held_out()))
    return language.predict(docs, model, carry=REST).where(~F.col("rejected")).select("doc_id", "text", "rest.*").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies, that with the smallest id; null texts stay."""
    return minhash.drop_copies(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; drops documents of which nothing but white space is left.

    Null and empty texts stay as they are; n_chars follows the text where something was taken out.
    """
    left = suffix_dedup.without_repeats(docs.select(*COLUMNS))
    left = left.where((F.col("n_removed") == 0) | (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more are words of benchmark windows; null texts stay."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, as counts and digests; a null text counts as empty. Ids may be null or repeat."""
    return sentencepiece_bpe.digest(sentencepiece_bpe.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("contamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: The stages have no SQL form (a fitted model, signatures, bytes); tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written to the shared folder, read by the next and then removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    place = folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{place}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
