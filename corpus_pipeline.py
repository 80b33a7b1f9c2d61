"""A training-data pipeline over ``documents``: five stages of the ``llm``
operators, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelkeep.llm import op1_toxicity, op3_simhash, op4_pii, op5_decontaminate, op7_bpe
from modelkeep.llm.common import discard, fresh, settle, staged

# All stages keep the columns they are given, whatever they are called, and give
# no rows for an empty table.  Null texts count as empty; texts of any length are
# read whole; null and repeated ids are ids like others.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 1 predicts to be toxic go.  Its model is fitted
    to the labelled documents of this stage's input; without labels its own
    lexicon serves.  Null and empty texts stay; each repeated row is judged alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = op1_toxicity.fit(docs, labels, op1_toxicity.training_rows())
    score = op1_toxicity.score_column(spark, model)
    name = fresh(docs, "toxicity_score")
    return docs.withColumn(name, score(F.col("text").cast("string"))).where(F.col(name) < 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of operator 3 the document with the smallest id stays,
    once if its row repeats.  Null and empty texts are one class; rows of one id
    with different texts are judged each on its own; of a class without ids any
    one row stays."""
    return op3_simhash.one_of_each(docs, shingle=3, distance=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 5 finds contaminated go.  Null and empty texts
    have no words and stay; rows of one id with different texts are judged each
    on its own, repeated rows alike."""
    return op5_decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, share=20)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What operator 4 finds is replaced by its kind; n_chars follows (null text: 0).  Every row stays."""
    settle(spark)
    done = docs.withColumn("text", op4_pii.redacted(F.col("text").cast("string")))
    return done.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids, their number, and the digest of what they
    decode to, by operator 7 (null and empty texts: no ids).  Every row stays."""
    return op7_bpe.tokenized(docs, op7_bpe.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL can't express the stages (a fitted grammar, SimHash, tokenization); a test checks each by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  Each result but the last is staged in the
    shared folder, and goes from there as soon as the next one is complete."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
