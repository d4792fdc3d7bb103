"""op5: every whole text of documents stored as an image, read back, hashed and shown as an NPY tile, which is stored too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, media


#: Rows and columns of a tile.
SIDE = 16


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = common.written(media.text_images(docs), "images")
    tiles = common.written(media.image_features(stored, side=SIDE), "tiles")
    return tiles.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(":", "difference_hash", F.substring(F.sha2("tile", 256), 1, 16)).alias("feature"),
    )


QUERIES = {"op5_media_columns": op5_media_columns}
SQL: dict[str, str] = {}
