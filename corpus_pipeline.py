"""The corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's documents.

A stage takes any table with doc_id, text and (for the mix) source; other columns, whatever their names, pass through all stages but the last. Rows count one by
one: rows without an id, repeated ids and rows repeated whole are rows like others. A null text counts as an empty one. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import exact_dedup, mixing, ngram_join, quality, sentencepieces
from kinfold.llm.common import Scratch, table, written
from kinfold.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose score reaches 0.3, judged by their whole texts. Learns from the labels of `docs` (those that aren't held out); labels without a row,
    repeated, null or other than 0 and 1 do no harm; without four labels of each kind all rows get one score. Equal texts share their fate."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for the case of A-Z: of those with its largest doc_id (rows without an id only where no other has the text),
    and of rows repeated with that id and text any one. Null and empty texts are one group."""
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts whose sets of 5-word shingles link: the one with the smallest doc_id (rows without an id last; of repeated rows any one).
    Texts without words link with nothing and all stay; shorter ones count as one shingle."""
    return ngram_join.representatives(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: up to three times, or not at all where its source is over its target. Null is a source of its own. The order of choice is a
    seeded hash of the id (of the text where there is none), ties by a hash of the text. Texts without words are taken as often as their source is taken whole."""
    return mixing.mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each row doc_id, n_tokens, ids_crc32, parity, round_trip, the ids of its whole text and the text decoded from them; empty texts have no ids."""
    return sentencepieces.encoded(docs, vocabulary("piece_bpe_32k.model"), with_ids=True)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage), ("mixing to weights", mix_stage), ("sentencepiece", encode_stage)]

#: Compression and tokenizing can't be said in SQL; tests hold each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir. The tables between stages are removed when the last one is written."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return written(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
