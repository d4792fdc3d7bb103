"""A session for local use; on a cluster give the session that spark-submit made."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ready(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers: they get it by Spark's own file server unless they see it anyway."""
    context = spark.sparkContext
    seen = str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.master.startswith("local") and Path.cwd() == ROOT
    if not seen and not getattr(context, "_strataline_shipped", False):
        folder = tempfile.mkdtemp()  # the driver serves the file from here until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = os.path.join(folder, "strataline.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted((ROOT / "strataline").rglob("*.py")):
                out.write(path, path.relative_to(ROOT))
        context.addPyFile(archive)
        context._strataline_shipped = True
    return spark


def session(cores: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("strataline").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.driver.memory", "8g")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    out = builder.getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    return out
