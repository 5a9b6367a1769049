"""From raw documents to packed training sequences, one stage after the other.

Each stage takes (spark, docs, folder), works on all that the one before kept, and returns documents with
the columns they came with; the last returns the pieces of the sequences. ``run`` writes what a stage
returns to the shared folder and reads it again for the next.

* toxicity: documents that the classifier rejects go.
* near duplicates: of each group of documents linked by word shingles, the one with the least id stays.
* personal data: every span found is replaced by its kind.
* mixing: documents are taken as often as the target weights ask for, each at least once.
* packing: all tokens are cut into pieces and the pieces put into windows.

Nulls, empty texts, repeated rows, empty tables and further columns have the results that the operators'
modules define. No stage can be said in SQL: the first and fourth learn, the second follows links to
their end, the third checks digits, the last encodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recon.llm import jaccard_join, mixing, packing, pii, toxicity
from recon.llm.common import table, written
from recon.llm.queries import WORD_MODEL, vocabulary

#: Words of a shingle, and the likeness in percent from which two documents are near duplicates.
SHINGLE_WORDS = 5
NEAR_PERCENT = 80
#: The mixed corpus has this many times the tokens; every document stays at least once.
GROWTH = 1.25
#: Weights of clean, poor and toxic tokens in it: what looks toxic after the first stage is not repeated.
WEIGHTS = (*mixing.TARGET[:2], 0.0)


def toxicity_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, folder, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return jaccard_join.keep_first(docs, SHINGLE_WORDS, NEAR_PERCENT)


def personal_data_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return mixing.resample(docs, table(spark, folder, "labels"), WEIGHTS, growth=GROWTH, least=1.0)


def packing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return packing.pack(docs, vocabulary(WORD_MODEL))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("personal data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
