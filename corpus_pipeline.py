"""The corpus pipeline: five stages, each over all that the one before has kept, each stage's result written and read again by the next.

toxicity         rows that the toxicity model rejects go; it learns from the labelled rows of its own input
near_duplicates  of each group of near duplicates the document with the least doc_id stays
passages         words in passages of 13 words or more that an earlier document has go; the rest of such a text is joined by single spaces
secrets          secrets are replaced by a mask
packing          the texts' tokens, packed into sequences: the last stage's columns are those of the packing operator

Texts that change get a new n_chars (code points); a null text stays null. An empty table gives an empty result in every stage; extra columns go along
to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.llm import lsh_forest, packing, secrets, substring, toxicity
from larderflow.llm.common import materialised, opened, sealed


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that the model calls toxic. Null and empty texts have the score of the bias; repeated rows share their fate."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(sealed(docs), model).filter("predicted = 0").select(*opened(docs.columns))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each class of near duplicates, that with the least doc_id; rows without words or with a null doc_id stay."""
    return lsh_forest.one_of_each(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose texts have lost the passages of earlier rows; no row goes. Null, empty and short texts and rows with a null doc_id stay as they are."""
    return _counted(substring.deduplicated(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets masked; no row goes. Null and empty texts stay as they are."""
    forest = secrets.train_forest(secrets.labelled_findings(spark))
    return _counted(secrets.redacted(docs, forest))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places, as packing.packed_documents gives them."""
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("passages", without_passages),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Models, hashing and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialised(docs, name)
    return docs
