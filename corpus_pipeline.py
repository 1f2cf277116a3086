"""From raw documents to packed training sequences, one operator a stage.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. ``run``
writes every stage's result as Parquet in the shared folder and reads it again as the next one's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertiplan.llm import decontaminate, minhash, packing, secrets, toxicity
from vertiplan.llm._store import drop, keep, scope

TOXIC = 0.3
NEAR_WORDS, NEAR_PERCENT = 5, 80
COVERAGE = 0.5
SEQUENCE = 4096

#: Learned models and token ids are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under TOXIC. The model learns from the labels of documents in ``docs``."""
    columns = docs.columns
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "toxicity_score"
    while name in {c.lower() for c in columns}:
        name += "_"
    return toxicity.score(docs, machine, name).where(F.col(name) < TOXIC).select(columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row with the least doc_id; rows with a null id and those without text stay.
    Rows that share a doc_id but not the text are judged each on its own; of equal rows in a group one stays."""
    columns = docs.columns
    judged = minhash.judged(docs, NEAR_WORDS, NEAR_PERCENT).where("component is not null").select("doc_id", "row_hash", "component", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    # one row per text; where several texts of a group have its least id, the one with the least hash stays
    texts = judged.groupBy("component", "doc_id", "row_hash", "kept").agg(F.count("*").alias("n"))
    texts = keep(texts.select("component", "doc_id", "row_hash", "kept", (F.col("kept") & (F.col("n") > 1)).alias("once")), "judged")
    ranked = texts.where("kept").groupBy("component").agg(F.min("row_hash").alias("stays"), F.count("*").alias("c")).where("c > 1")
    more = texts.where("kept").join(ranked, "component").where("row_hash <> stays").select("doc_id", "row_hash", F.lit(False).alias("once"))
    told = texts.where("not kept or once").select("doc_id", "row_hash", F.col("kept").alias("once")).union(more)
    told = told.groupBy("doc_id", "row_hash").agg(F.min("once").alias("once"))
    told = told.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), F.col("once").alias("_once"))
    key = (F.col("doc_id").cast("long") == F.col("_id")) & (minhash.row_hash("text") == F.col("_hash"))
    if texts.where("once").isEmpty():
        return docs.join(told, key, "left_anti").select(columns)
    told = keep(told, "told")
    single = docs.join(told, key, "left_anti").select(columns)
    order = Window.partitionBy("_id", "_hash").orderBy(*(F.col(f"`{c}`") for c in columns))
    repeated = docs.join(told.where("_once"), key).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select(columns)
    return single.union(repeated)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item of which at least COVERAGE is tiled."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), COVERAGE)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind in brackets and n_chars to match."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most SEQUENCE."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scope(spark) as inner:
            before, docs = docs, keep(stage(spark, docs, sf_dir), name)
            inner.remove(docs.kept_path)
        if hasattr(before, "kept_path"):
            drop(before)
    return docs
