"""The corpus pipeline: quality, near duplicates, secrets, mixing, tokens.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and its decisions take effect.
All but the last return the columns of documents; the last returns tokens. Stages are written as Parquet and read
again, so each is recovered from files. Each begins with a collection on every executor, so that heap which the one before filled is
free for its Python workers.

Cases, for every stage: docs has doc_id, text and source at least; any other column, whatever its name, passes as it is (n_chars
follows a changed text). A null text is an empty one, and stays null where the row stays. Texts are read whole at any length. An
empty table gives an empty table of the same columns. Null doc_id and repeated rows: see each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import bpe, common, jaccard, mixing, q_bpe, q_mixing, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model and the base rules keep; a row stays or goes by its own text, so repeated rows stay or go
    together; null and empty texts have no words and go.

    Measures are taken twice, once to fit the model and once beside the text, which is cheaper than a copy of all texts.
    """
    common.rested(spark)
    fit = quality.fitted(common.written(quality.measured(docs, keep=[]), "quality"))
    return quality.row_verdicts(docs, fit).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that with the smallest doc_id; of rows that repeat a doc_id, one. Rows without
    doc_id can't be named by a link and stay."""
    common.rested(spark)
    member = jaccard.membership(docs.select("doc_id", "text"))
    gone = member.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = common.written(kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.limit(1).count() == 0:
        return kept.select(*docs.columns)
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", *[c for c in docs.columns if c != "text"])).alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret, of the patterns or the network, replaced by a mark; n_chars follows the text. Rows stay, each by itself."""
    common.rested(spark)
    found = common.written(secrets.findings(docs, ["doc_id"]), "findings")
    clean = secrets.redacted(docs, secrets.fitted(found))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row a copy that the mix takes, in shards, shuffled within each. A null source is a source; repeated rows
    are taken together; a row without words takes part in full passes."""
    common.rested(spark)
    return mixing.mixed_rows(docs, q_mixing.MIX).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, decoded again for the digest: doc_id, source, n_tokens, ids_sha256, decoded_sha256, ids. A row without
    text has no token; repeated rows have a row each."""
    common.rested(spark)
    ranks = q_bpe.rank_bytes()
    coded = bpe.encode_documents(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN, out="decoded")
    return coded.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), bpe.id_digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("token_ids").alias("ids"))


STAGES = [("quality rules", quality_rules), ("n-gram jaccard join", near_duplicates), ("secret scans", secret_scan), ("source mixing", mix), ("byte-level bpe", tokens)]

#: The label model, the network and the permuted blocks have no SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
