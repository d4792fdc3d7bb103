"""op6: unigram and log-bilinear scores of every whole text of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, lm


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(common.table(spark, sf_dir, "documents"))[0]


QUERIES = {"op6_lm_scores": op6_lm_scores}
SQL: dict[str, str] = {}
