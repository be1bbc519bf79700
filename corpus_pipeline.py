"""A training corpus from raw documents: quality rules, quality classifier, near duplicates, benchmark passages, tokens.

Each stage takes what the one before kept and returns the columns of ``documents``; the last returns the token digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm import bpe, decontam, lines, quality, setjoin
from tidewire.llm.frames import small, written
from tidewire.llm.queries import vocabulary
from tidewire.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rules nor consist of lines shared across their source."""
    ship_package(spark)
    return lines.kept_rows(docs.select(*COLUMNS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labelled ones among them, takes for good."""
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component: the smallest ``doc_id``, of several texts under it that of the smallest hash.
    Documents without words are all kept; of rows that repeat id and text one stays, and so does every row without an id."""
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    found = setjoin.link_components(docs).where("doc_id is not null")
    place = F.struct("doc_id", "text_hash")
    first = found.where("n_shingles > 0").groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    first = small(written(first.select("component", "first"), "first-of-component"))
    gone = found.join(first, "component").where(place != F.col("first")).select("doc_id", "text_hash").distinct()
    keyed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(small(written(gone, "near-duplicates")), ["doc_id", "text_hash"], "left_anti")
    repeated = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "text_hash")
    repeated = small(written(repeated, "repeated-rows"))
    order = F.row_number().over(W.partitionBy("doc_id", "text_hash").orderBy(F.xxhash64(*COLUMNS)))
    one = kept.join(repeated, ["doc_id", "text_hash"], "left_semi").withColumn("place", order).where("place = 1").select(*COLUMNS)
    return kept.join(repeated, ["doc_id", "text_hash"], "left_anti").select(*COLUMNS).unionByName(one)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which less than a twentieth of the words stand in benchmark passages."""
    ship_package(spark)
    judged = decontam.judge(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.where("not contaminated").select(*COLUMNS)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document that is left."""
    ship_package(spark)
    return bpe.round_trip_digests(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_tokens),
]

#: Neither compressed sizes nor tokens can be had in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are a table in the shared folder that the next one reads."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
