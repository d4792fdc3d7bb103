"""op3: rules' measures and the label model's verdict over every whole text of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, quality


def verdicts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Measures by document, base_failed and kept; texts are read once, the measures are written in between."""
    measures = common.written(quality.measured(docs, keep=keep), "quality")
    judged = quality.judged(measures, quality.fitted(measures))
    return judged.withColumn("base_failed", quality.base_failed()).withColumn("kept", ~F.col("base_failed") & F.col("quality_kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return verdicts(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


QUERIES = {"op3_quality_rules": op3_quality_rules}
SQL: dict[str, str] = {}
