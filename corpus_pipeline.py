"""The corpus pipeline: raw documents to packed training sequences, in five stages.

Each stage works on all rows that the stage before it kept; its result is written as Parquet in
the shared folder and read again, so a lost executor costs tasks of one stage only.

1. quality classifier: documents that the co-trained classifier rejects go;
2. n-gram Jaccard join: one document of each component of near duplicates stays;
3. benchmark decontamination: documents that a benchmark item leaks into go;
4. secret scans: credentials in the texts are replaced by a mark;
5. packing: what is left is packed into sequences of 1024 tokens (doc_id, start, length, ...,
   sequence_id, offset, input_ids).

All stages but the last return the columns of documents.

Defined cases: rows with null or empty texts pass the first four stages (as the classifier scores them) and are packed
as their end; rows with null ids are never named, so they stay; rows that share an id are judged one by one in the
first two stages and in the fourth, and together in the third (a benchmark item in one of them removes the id); very
long texts are worked on whole; an empty table gives no rows; more columns, whatever their names, are kept up to
packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shotgrid.llm import cotrain, decontaminate, packing, secrets, simjoin
from shotgrid.llm.common import documents, give_back, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotrain.keep_good(docs, cotrain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simjoin.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.infer(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scan),
    ("packing", pack),
]

#: Classifier, automata and online packing can't be expressed in SQL; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
        give_back()                     # what the stage's fitting left on the driver
    return docs
