"""A training corpus from the table documents: good documents, one of each near-duplicate group, without benchmark
passages, mixed by source, as token ids. Each stage's result is written and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sightline.llm.common import table, written
from sightline.llm.decontam import decontaminated
from sightline.llm.mixing import mixed_documents
from sightline.llm.near_dup import one_of_each_group
from sightline.llm.quality import good_documents
from sightline.llm.token_output import read_token_pages, write_token_pages


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs, shingle_words=5, similarity=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pages = write_token_pages(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_pages(pages).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("benchmark decontamination", decontamination), ("source mixing", mixing), ("token ids", token_ids)]

#: No SQL has the tokenizer, the classifier or the draws; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
