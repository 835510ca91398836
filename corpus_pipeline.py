"""Training-corpus pipeline: quality, toxicity, near duplicates, personal data, packing.

STAGES are run in order; each is written as Parquet and read again as the next one's docs. All but the last return
the columns of docs. A stage's defined cases are those of the operator it calls; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import packing, pii, quality, shingle_join, toxicity
from tracewright.llm.common import cut, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the pairwise ranking, learned from labels, doesn't reject."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose expected severity stays below the limit. The model is learned from labels of docs."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles and a similarity of 0.8. Documents without words stay."""
    return shingle_join.one_of_each(docs, 5, 80, 100)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_duplicates", one_of_each), ("personal_data", no_personal_data), ("packing", packed)]
#: Models, components and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
