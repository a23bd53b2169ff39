"""A corpus pipeline: each stage reads all that its predecessor kept, and all but the last return documents' columns.

1. language: rows whose text has no language (null, or without a letter) go; lang becomes the one predicted.
2. near_duplicates: of each group of links on five-word shingles of similarity 0.8 or more, the document of smallest id
   stays, null last; rows are told apart by id and text, and rows without words belong to no group and stay.
3. repeats: byte strings of 200 or more that repeat are cut out of the texts; rows stay, even if nothing remains.
4. benchmark: documents that overlap a benchmark item go.
5. tokens: SentencePiece ids with an end id, and the text they decode to, beside the predicted lang.

Null texts go in the first stage; rows without id stay, and repeated rows are one document of a group. Without labelled
rows to learn languages from, lang stays as it was. Empty tables give empty results; further columns pass the first four
stages as they are. Each stage's table is deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm import decontaminate, language_id, near_dup, piece_codec, suffix_dedup
from specloom.llm.common import drop, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(spark, docs, language_id.learn(docs.select("doc_id", "text", "lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_first(spark, docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark, docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = piece_codec.encode_documents(docs, keep=("lang",))
    return out.select("doc_id", "lang", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL cannot express the classifier, the library's tokenizer or components; tests hold each stage against its operator,
#: which has brute-force tests of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
        if last is not None:
            drop(spark, last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
