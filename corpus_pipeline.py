"""From raw documents to packed training sequences: five stages, each stored before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from innsight.llm import jaccard, packing, risk_rules, spans, tokens, toxicity
from innsight.llm.work import stored
from innsight.sources.shared import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half.

    Where the labels teach nothing (none, or of one class only), all documents are kept.
    """
    model = toxicity.learnt(docs, _labels(spark, sf_dir))
    if model.empty:
        return docs.select(*COLUMNS)
    return toxicity.scored(docs, model, name="_score").where("_score < 0.5").select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep."""
    return risk_rules.judged(docs, _labels(spark, sf_dir)).where("kept").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every near-duplicate group: five words, similarity 0.8 or more.

    Rows with a null id are linked with nothing and stay. Of rows that repeat both id and text
    one stays. Different texts under one id are documents of their own; of those in one group
    the first by a hash stays.
    """
    known = docs.where("doc_id is not null").select(*COLUMNS)
    twice = stored(known.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("_twice")), "repeated-ids")
    numbered = known.join(twice, "doc_id", "left").withColumn(
        "_number", F.when(F.col("_twice"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    )
    renamed = stored(numbered.where("_twice").select(F.col("doc_id").alias("_id"), "_number").distinct(), "numbers")
    groups = jaccard.near_duplicate_groups(numbered, id_col="_number").select(F.col("doc_id").alias("_number"), "component_id")
    first = F.min(F.struct(F.coalesce("_id", "_number"), "_number"))
    stay = groups.join(renamed, "_number", "left").groupBy("component_id").agg(first.alias("first"))
    kept = numbered.join(stored(stay.select("first._number"), "stay"), "_number", "left_semi")
    same = Window.partitionBy("doc_id", "text").orderBy("lang", "source", "n_chars")
    single = kept.where("_twice").withColumn("_row", F.row_number().over(same)).where("_row = 1")
    return (
        kept.where("_twice is null").select(*COLUMNS)
        .unionByName(single.select(*COLUMNS))
        .unionByName(docs.where("doc_id is null").select(*COLUMNS))
    )


def without_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occurred before; texts left without words go."""
    cleaned = spans.remove_repeated_spans(docs.select(*COLUMNS)).where(F.trim("text") != "")
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokens.default_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_good),
    ("near_duplicates", one_of_each_group),
    ("substring_dedup", without_repeated_spans),
    ("packing", packed),
]

#: Training and tokenizing cannot be written in SQL; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
