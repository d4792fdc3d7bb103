"""op1: secrets in every whole text of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, secrets


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = common.written(secrets.findings(docs, ["doc_id"]), "findings")
    net = secrets.fitted(found)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secrets.with_model(found, net).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


QUERIES = {"op1_secret_scan": op1_secret_scan}
SQL: dict[str, str] = {}
