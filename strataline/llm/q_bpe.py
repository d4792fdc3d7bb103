"""op7: byte-level BPE over every whole text of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

RANK_FILE = "byte_bpe_50k.tiktoken"


def rank_bytes(name: str = RANK_FILE) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = rank_bytes()
    coded = bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, out="decoded")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), bpe.id_digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
SQL: dict[str, str] = {}
