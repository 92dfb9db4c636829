"""A corpus pipeline in five stages: each takes the documents its predecessor kept, all but the last return documents.

Edge cases follow the operators' docstrings. Besides: documents without a recognised language go (null and letterless texts, and scores
under ``LEAST_SCORE``); ``lang`` becomes the predicted language; ``n_chars`` follows the text; a document that loses all its visible lines goes; of
near duplicates (SimHash of four-word shingles, four or fewer differing bits) the smallest doc_id stays, of its repeated rows one. Empty tables give empty tables; other columns are carried along.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexframe.llm import decontam, langid, linededup, packing, simhash  # noqa: E402
from lexframe.llm.common import read, ship  # noqa: E402
from lexframe.sources.workdir import written  # noqa: E402

LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    named = langid.annotate(docs, langid.fit(docs.select("doc_id", "text", "lang")), "_stage_lang", "_stage_score")
    kept = named.filter((F.col("_stage_lang") != langid.UNKNOWN) & (F.col("_stage_score") >= LEAST_SCORE))
    return kept.select(*[F.col("_stage_lang").alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rest = linededup.dedup_lines(docs).filter((F.col("n_lines_removed") == 0) | F.col("text").rlike(r"\S"))
    return rest.select(*[F.length("text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return packing.pack(docs, path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Learned models and similarity components have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
