"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

A stage takes (spark, docs, folder) and works on all rows that the one before it kept; all but the
last return the columns of ``documents``.  A stage may be called by itself: it sends the package to
the workers first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripquarry.llm import byte_bpe, decontaminate, near_dedup, quality_knn, quality_rules
from tripquarry.llm.frames import shared_folder
from tripquarry.llm.queries import table, tokenizer
from tripquarry.session import shipped


@shipped
def apply_quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 8: documents that fail the base rules or the label model go."""
    return quality_rules.filter_quality(docs)


@shipped
def apply_quality_classifier(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 2: documents that the classifier doesn't predict as good go.

    It is fitted on the labelled rows of the whole ``documents`` table, since the rules have
    already taken most bad examples out of ``docs``.
    """
    model = quality_knn.fit_quality(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    scored = quality_knn.score_quality(docs, model)
    return scored.where(F.col("predicted") == 1).select(*scored.columns[: len(docs.columns)]).toDF(*docs.columns)


@shipped
def apply_near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 6: one document of each class stays."""
    return near_dedup.drop_near_copies(docs)


@shipped
def apply_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 1: documents with an occurring benchmark window go."""
    return decontaminate.decontaminate(docs, table(spark, folder, "benchmark"), remove="documents")


@shipped
def apply_encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 5: token ids of every document, and the digest of what they decode to; all columns
    but the text stay."""
    return byte_bpe.encode(docs, tokenizer(), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep=[c for c in docs.columns if c != "text"])


STAGES = [
    ("quality rules", apply_quality_rules),
    ("quality classifier", apply_quality_classifier),
    ("near-duplicates", apply_near_dedup),
    ("decontamination", apply_decontamination),
    ("encoding", apply_encoding),
]

#: The label model, the classifier and BPE aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; between stages, Parquet in the shared checkpoint folder.

    What a stage has written goes when the stage after it is written; what the last one reads
    stays, since its rows are computed when the caller asks for them.
    """
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, folder, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{place}/{k}")
            docs = spark.read.parquet(f"{place}/{k}")
            if k:
                old = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/{k - 1}")
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
