"""The corpus pipeline: from documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet in the shared folder and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.llm.common import fold, table, with_new
from linkwright.llm.mixing import mix_sources
from linkwright.llm.packing import pack_documents
from linkwright.llm.pii import pseudonymise_documents
from linkwright.llm.simhash import drop_near_duplicates
from linkwright.llm.toxicity import fit_toxicity, score_toxicity
from linkwright.plans.runtime import stash


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored 0.7 or more go; the examples are labelled rows outside the held-out fold.

    A null or empty text has no neighbours and stays; rows that repeat are judged each; without labels nothing goes.
    """
    labelled = table(spark, sf_dir, "labels").where(~fold(3, 1)).select("doc_id", F.col("toxic").alias("label"))
    model = fit_toxicity(docs, labelled)
    return docs.where(score_toxicity(docs, model)["score"] < 0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of SimHash near-duplicates stays: the least id's, then the least text hash's.

    Rows without words are one group; a row with a null id stays only where its whole group has none.
    """
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, its personal data replaced, ``n_chars`` counted anew; a null text stays null."""
    out = pseudonymise_documents(docs.select(F.struct("*").alias("row"), "text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return with_new(out, docs.columns, new)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, none at all for those it does not; rows without words stay once.

    A null source is one source; ties of finish times go by source, then by a hash of the id.
    """
    mixed = mix_sources(docs, carry=tuple(docs.columns)).where("repeats > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row goes; a row without words has one piece and no bin."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: Nearest neighbours, SimHash and the Feistel rounds have no SQL. Every operator is tested against a brute-force
#: version of itself; the pipeline's own test holds near-dedup against one and checks what the other stages decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs
