"""Corpus pipeline: from raw documents to packed sequences, in five stages.

Each stage works on all that its predecessor kept. ``run`` writes each result as Parquet into
the shared folder of ``spark.checkpoint.dir`` and reads it again for the next stage; the
folder of a stage is removed once the next one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import langid, lines, minhash, packing, quality, queries, shared

#: Tokenisers, classifiers and near duplicates are beyond SQL: tests/llm/test_pipeline.py holds the stages
#: against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the fences of their language and source."""
    return quality.keep(docs)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str, str]:
    """Columns under names that clash with nothing, and those of id, text and language."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names["doc_id"], names["text"], names["lang"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those whose language stays ambiguous."""
    rows, id_col, text_col, lang_col = _numbered(docs)
    judged = langid.predict(rows, langid.fit(rows, id_col, text_col, lang_col), text_col)
    kept = judged.filter((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous"))
    return kept.select(*rows.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated line chunks from the texts; n_chars follows. A document of which no word is left goes: all of it stands elsewhere."""
    rows, id_col, text_col, _ = _numbered(docs)
    out = lines.dedup(rows, id_col, text_col).filter((F.col("n_removed") == 0) | F.col(text_col).rlike("[^ \\t-\\r]"))
    out = out.select(*rows.columns).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest id; of rows that share id and text one."""
    return minhash.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the whole ``documents`` table."""
    docs = shared.read_table(spark, sf_dir, "documents")
    base = f"{shared.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            shared.remove_folder(spark, f"{base}/{k - 1}")
    return docs
