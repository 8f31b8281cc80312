"""The training-data pipeline: five stages over ``documents``, each written and read again.

1. toxicity: documents that the classifier chain rejects go.
2. near_duplicates: one document of each SimHash group stays.
3. decontamination: documents that hold a benchmark item go.
4. secrets: spans are masked in place; every document stays.
5. tokens: the token ids of each document.

Stages 1 to 4 return all columns of ``documents``; their helper columns cannot clash with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, secrets, simhash, toxicity
from plumbline.llm.frames import read, shared_folder
from plumbline.llm.queries import TOKENIZER, toxicity_chain


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity_chain(docs, sf_dir)
    return docs.filter(toxicity.score(chain, F.col("text"))[len(chain.categories) - 1] < chain.thresholds[-1])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids``: ids as little-endian unsigned 32-bit integers."""
    tokens = bpe.encode(docs, TOKENIZER)
    return tokens.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("tokens", to_tokens),
]

#: SQL has no classifier, edit verification or tokenizer; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written to the shared folder and reread."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
