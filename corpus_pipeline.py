"""A pipeline over the documents: language, near duplicates, benchmark leaks, secrets, mixing."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import decontaminate, langid, mixing, secret_scan, simhash
from tidegauge.llm.common import fresh
from tidegauge.session import shared_dir

#: Least score of the predicted language; below it, and without letters, a document goes.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is clearly in one of the learned languages."""
    out = fresh(docs, "language")
    named = langid.identify(docs, langid.train(docs), out=out)
    return named.where((F.col(f"{out}.lang") != "und") & (F.col(f"{out}.score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.representatives(docs, words=5, similarity=0.8)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret_scan.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document; documents it leaves out have no row."""
    return mixing.mix(docs).where(F.col("taken") > 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("leaks", leaks), ("secrets", secrets), ("mixture", mixture)]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read by the next."""
    path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"

    def apply(docs: DataFrame, stage: tuple) -> DataFrame:
        stage[1](spark, docs, sf_dir).write.parquet(f"{path}/{stage[0]}")
        return spark.read.parquet(f"{path}/{stage[0]}")

    return functools.reduce(apply, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"))
