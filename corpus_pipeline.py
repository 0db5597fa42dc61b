"""The training-data pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns the next table, which is
written as Parquet in the shared folder and read again. All but the last return
the columns of ``documents``.

Null and empty texts are documents without words: the classifier judges them
like others, they are near-duplicates of nothing, leak nothing, hold no secret
and are packed as their end alone. Rows without an id pass all stages; repeated
rows of an id become one in the second stage (of those of one id the largest
text, then the least hash of all columns). Very long texts are read whole and
cut by the last stage only. An empty table, or empty labels or benchmark, gives
an empty result or rejects nothing. Other columns, whatever their names, pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrel.llm import latent_decontamination, linear_packing, minhash_dups, ordinal_quality, secrets
from kestrel.llm.common import cut_lineage, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the rated ones, keeps."""
    model = ordinal_quality.fit(ordinal_quality.ratings(docs, read(spark, sf_dir, "labels")), 3)
    return ordinal_quality.select(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    return minhash_dups.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return latent_decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, each with its sequence and place."""
    return linear_packing.pack(linear_packing.pieces(docs))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", hide_secrets),
    ("best-fit packing", packing),
]

#: Fitted weights, latent vectors and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
