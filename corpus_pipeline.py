"""A training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; :func:`run` writes and rereads each result in the shared folder. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontamination, minhash, mixing, token_store, toxicity
from brindle.llm.common import read, scratch_folder
from brindle.llm.queries import END_ID, tokenizer_path

#: Words of a shingle and the similarity in percent of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the calibrated toxicity threshold of their language.

    The model learns from the labelled rows of ``docs``. Every row is judged by
    its own text, so repeated rows go or stay together. Null and empty texts hold
    nothing toxic and stay; without labels every row does.
    """
    return toxicity.reject_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of least doc_id.

    Documents without words or without an id are in no group and stay; rows
    of one id are one document.
    """
    return minhash.drop_near_duplicates(docs, size=SHINGLE, percent=PERCENT)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``.

    Rows of one id go or stay together; a row without an id is known by its text.
    Null, empty and short texts hold no passage and stay.
    """
    return decontamination.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (none, once or twice), in the
    order of the schedule's slots.

    A null source is a source of its own; null and empty texts have no words and
    come where their place in the stream does. Equal ids and texts share their
    number of copies. Ties in the shuffle's hash are equal rows.
    """
    return mixing.mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the token files.

    One row per row: null ids first, then by id, rows of one id by text. A null or
    empty text has the end id alone; no rows make a store without blocks.
    """
    folder = scratch_folder(spark, "pipeline-tokens")
    token_store.write_tokens(docs, folder, tokenizer_path(), end_id=END_ID)
    return token_store.read_tokens(spark, folder)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("source_mix", mix_sources),
    ("token_ids", write_token_ids),
]

#: A trained classifier and tokenizer are no SQL; tests compare each stage with
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``, each written and reread."""
    folder = scratch_folder(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
