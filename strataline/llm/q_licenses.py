"""op9: licences in every whole text of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, licenses


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(common.table(spark, sf_dir, "documents")).drop("found")


QUERIES = {"op9_license_scan": op9_license_scan}
SQL: dict[str, str] = {}
