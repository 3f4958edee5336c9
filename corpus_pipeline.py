"""From raw documents to packed training sequences: each stage's result is the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.llm.packing import pack, pieces
from lyrebird.llm.pii import redact
from lyrebird.llm.quality import THRESHOLD, scorer, train
from lyrebird.llm.simhash import first_of_each
from lyrebird.runtime import stage_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier, fitted on the labels, doesn't reject.

    A null, empty or very long text is scored whole like any other; without usable labels all score 0.5 and stay; repeated rows
    score alike; an empty table stays empty; other columns pass unchanged.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(scorer(docs, model) >= THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id.

    Null, empty and blank texts are one group, texts of any length are compared whole; a null id comes after all others; of rows that agree in id and
    text one stays; an empty table stays empty; other columns pass unchanged.
    """
    return first_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data, plain or disguised, replaced by its kind; n_chars follows the text.

    A null text stays null, with a null n_chars; a text of any length is searched whole; repeated rows stay; an empty table stays empty.
    """
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences: one row for each piece of a document.

    A null or empty text is the end id alone, a very long one as many pieces as it needs; null and repeated ids are packed like any others; an empty table
    gives no rows. The columns are those of the pieces.
    """
    return pack(pieces(docs, remembered=REMEMBERED))


#: Chunks that a worker remembers while it encodes; fewer than op8 has alone, as its memory outlives the stage.
REMEMBERED = 150_000

STAGES = [("quality_classifier", quality), ("simhash_near_dedup", near_dedup), ("pii", private), ("best_fit_packing", packing)]

#: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage_table(docs, name)
    return docs
