"""The corpus pipeline: language ID, near-dedup, personal data, mixing and BPE, one after another.

Each stage gets what the one before it kept, as a table that was written and read again, and works on all
of it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ranklane.llm import bpe, langid, mixing, pii, simhash
from ranklane.llm.catalogue import VOCABULARY
from ranklane.llm.common import Scratch, table

#: Rows of the batches in which texts go to Python: executors and their workers hold whole ones, and a text may be long.
BATCH = 1_000
#: Model training, EM and sampling draw on hashes and numpy, which SQL cannot express.
ORACLE_SQL = None


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones and those without a letter go."""
    _small_batches(spark)
    return langid.identify(docs).where("NOT rejected").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word Jaccard similarities of 0.8 or more connect."""
    _small_batches(spark)
    return simhash.keep_similar(docs, Scratch(spark))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked in their texts."""
    return pii.mask(docs, Scratch(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixing.mix(docs, Scratch(spark))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, checked by decoding."""
    _small_batches(spark)
    return bpe.encode(docs, VOCABULARY, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixture),
    ("BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder as Parquet and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    before = None
    for _, stage in STAGES:
        docs, path = scratch.write(stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = path
    return docs
