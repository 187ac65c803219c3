"""A training corpus from raw documents, in five stages, each written and read again as Parquet.

All stages but the last keep the columns of the documents, whatever their names, and rows
in any order. A row with a null id has no language label, is no copy and cannot be found
by id, so it stays where its text alone decides; rows that repeat an id are judged each by
its own text in language identification and substring dedup, and go together where an id
is named (copies, benchmark items). Null and empty texts go with the language stage. Empty
tables go through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowframe.llm import langid, packing, queries, simhash, substring_dedup
from flowframe.llm.common import broadcast_if_small, checkpoint_dir, is_training, settle, table
from flowframe.llm.decontaminate import decontaminate

#: Documents whose language is less certain than this are rejected.
LEAST_CONFIDENCE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that can be told; all of them where no document has a language to learn from."""
    model = langid.train(docs.where(is_training()))
    if not model.languages:
        return docs
    told = "_" + max(docs.columns, key=len)  # longer than any other name
    rows = docs.withColumn(told, langid.prediction(spark, model, F.col("text")))
    return rows.where((F.col(f"{told}.lang_pred") != "und") & (F.col(f"{told}.score") >= LEAST_CONFIDENCE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group, linked at a Jaccard similarity of 0.8 of five-word shingles."""
    copies = settle(simhash.near_copies(docs).where("doc_id <> component_id").select("doc_id").distinct())  # never a null id
    return docs.join(broadcast_if_small(copies), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; documents that are nothing else go."""
    others = tuple(c for c in docs.columns if c != "doc_id")
    kept = substring_dedup.substring_dedup(docs, keep=others).where("n_removed < n_words or n_words = 0")
    changed = F.col("n_removed") > 0
    return kept.withColumns({
        "text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType),
    }).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [("language_id", language), ("simhash_near_dedup", near_dedup), ("substring_dedup", repeated_passages), ("decontamination", leaks), ("packing", packed)]

#: The first, second and last stage use a model, a hash and a tokenizer that SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
