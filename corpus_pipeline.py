"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet in
the shared folder and read again as the next stage's documents. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.llm import near_text, packing, personal, quality, toxicity
from riskframe.llm.common import Workspace, read
from riskframe.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic. Each row is scored where it stands; a null id stays.

    Null and empty texts are scored as texts without words. Every stage makes no rows of none.
    """
    model = toxicity.ToxicityModel(docs, read(spark, sf_dir, "labels"))
    return model.filter(docs)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no base rule and whose posterior quality is at least one half.

    Null and empty texts fail; repeated rows are judged alike; a null id stays as it is.
    """
    return quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with Jaccard >= 0.8.

    Unlike texts under one id are no copies of each other and all stay.
    """
    return near_text.keep_texts(docs, size=5, percent=80)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; n_chars is the new length.

    Every row stays, null ids and repeats too; a null text stays null and keeps its n_chars.
    """
    redact = personal.redactor(personal.fit_span_classifier(docs))
    out = docs.withColumn("text", redact("text"))
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their places in sequences of 2048 tokens.

    Null and empty texts are one piece of the end id; repeated rows are packed each.
    """
    return packing.pack_documents(docs, tokenizer_path(), capacity=2048, end=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("near_duplicates", drop_copies),
    ("personal_data", hide_personal),
    ("packing", pack),
]

#: No stage can be said in SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    space = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = space.settle(docs, name)
            space.release(name)
    return docs
