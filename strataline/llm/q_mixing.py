"""op8: all documents mixed to weights 1, 2, 3 over their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, mixing

MIX = mixing.Mix()


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix took, counted over the rows that were dealt to shards; a document in no shard took nothing."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = common.written(mixing.sized(docs, MIX, keep=["doc_id"]), "sizes")
    plan = mixing.plan(rows.drop("row"), MIX)
    dealt = common.written(mixing.dealt(rows, plan, MIX).drop("row"), "mix")
    # rows that repeat doc_id and text are drawn together: their copies are told apart by nothing, each has a copy a turn
    took = dealt.groupBy("name", "key", "size").agg(F.sort_array(F.collect_set(F.struct("copy", "shard"))).alias("took"))
    known = mixing.with_block(rows, plan.sources).join(took, ["name", "key", "size"], "left")
    copies = F.when(F.col("took").isNull(), 0).otherwise(F.size("took"))
    return known.select("row.doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), F.coalesce(F.transform("took", lambda d: d["shard"]), F.array().cast("array<bigint>")).alias("shards"))


QUERIES = {"op8_source_mixing": op8_source_mixing}
SQL: dict[str, str] = {}
