"""A corpus pipeline of five stages over documents: filter, clean, deduplicate, mix and pack.

Each stage reads what the one before it kept. All but the last return the columns of
documents; the last returns the spans that make up each training sequence. The
operators say what nulls, empty and long texts, ties and repeated rows give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from hyplab.llm import line_templates, mixing, near_duplicates, packing, quality_classifier
from hyplab.llm.store import cut

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs.select(*DOCUMENT), model, DOCUMENT).where("predicted = 1").select(*DOCUMENT)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates, near duplicates counted once; n_chars follows the text."""
    classes = cut(near_duplicates.components(docs))
    left = line_templates.drop_recurring(docs.select(*DOCUMENT), line_templates.EVERY_LINE, classes)
    n_chars = F.when(F.col("n_lines_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*DOCUMENT)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id.

    Rows that repeat a doc_id with its text are one document. Rows without doc_id cannot
    be named by a verdict and stay, one for each text.
    """
    verdicts = near_duplicates.near_duplicates(docs).where("NOT kept AND doc_id IS NOT NULL")
    gone = verdicts.select("doc_id", F.col("hash").alias("_h")).distinct()
    named = docs.select(*DOCUMENT).withColumn("_h", F.xxhash64("text"))
    left = named.join(gone, ["doc_id", "_h"], "left_anti")
    once = F.row_number().over(W.partitionBy("doc_id", "_h").orderBy("source"))
    return left.withColumn("_n", once).where("_n = 1").select(*DOCUMENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    measured = mixing.measure(docs.select(*DOCUMENT))
    slim = cut(measured.select("doc_id", "source", "_size", "_place"))
    taken = mixing.take(measured, mixing.plan(slim, mixing.targets(slim))).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*DOCUMENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of documents by training sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-duplicate removal", distinct_documents),
    ("source mixing", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
