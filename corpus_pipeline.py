"""The training-data pipeline: documents through five stages, each written as Parquet and read again.

Stages take (spark, docs, sf_dir) and return the columns of documents, the last one the packed pieces. Each works
on all rows that the one before it kept. Rows with null or blank texts are rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.decontam import without_leaks
from strandloom.llm.neardup import near_duplicates
from strandloom.llm.packing import best_fit_pack
from strandloom.llm.quality import quality_scores
from strandloom.llm.queries import byte_bpe
from strandloom.llm.suffix import repeated_spans, without_spans
from strandloom.operators.shared import materialise

#: Not expressible in SQL: the stages are tested against plain versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality_scores(docs).filter("quality_kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id. Rows without an id stay."""
    copies = near_duplicates(docs, width=5, threshold=0.8).filter("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes or more that also start earlier; texts of which nothing is left go."""
    left = without_spans(repeated_spans(docs, length=100))
    return left.filter(F.trim("text") != "").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return best_fit_pack(docs, byte_bpe(), capacity=2048, end_id=0)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = materialise(docs, f"stage{k}")
    return docs
