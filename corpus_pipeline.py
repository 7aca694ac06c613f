"""The training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage but the last returns the columns of its input; documents it rejects
are gone and texts it cuts stay cut for those after it.  Columns besides doc_id,
text and source are carried along whatever their names.

No SQL is given: the classifier and its fit can't be expressed in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relplan.llm import minhash, mixing, pu_quality, substrings, winnow
from relplan.sources import shared

#: A document stays if its calibrated chance of being good is at least this.
GOOD = 0.7
#: A window or whole item of so many words tells a leak by itself; shorter whole items, which are common speech, need a second item.
TELLING_WORDS = 5
#: Near copies from this similarity on; 40 bands of 5 miss a pair at it with chance 1e-7.
SIMILAR = {"percent": 80, "coordinates": 200, "band": 5}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts; without trusted positives it can't tell, and all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = pu_quality.train(docs.select("doc_id", "text"), labels)
    if "w" not in model:
        return docs
    scored = pu_quality.score(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), model)
    return scored.where(F.col("score") >= GOOD).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; of rows with one id and text, one stays."""
    return minhash.first_of_each(docs, **SIMILAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside runs of 20 that also start earlier in the corpus are cut out; texts without such runs stay as they are."""
    found = substrings.remove_repeats(docs, substrings.WORDS, texts=True)
    return found.select(*[F.col("kept").cast("string").alias("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of eight words of any benchmark item, without a whole item of five to seven, and without two items of any length."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = winnow.contamination(docs, items, telling=TELLING_WORDS)
    return found.where("n_telling = 0 and not contaminated").select(*[F.col("rest")[c].alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix reads, in the order of their virtual finish times."""
    return mixing.schedule(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicate removal", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("source mixing", mixture),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    shared.ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared.keep(docs, f"stage{i}")
    return docs
