"""The pipeline as a query; its stages are in corpus_pipeline.py at the repository's top."""

from __future__ import annotations

import corpus_pipeline

QUERIES = {"pipeline": lambda spark, sf_dir: corpus_pipeline.run(spark, sf_dir)}
SQL: dict[str, str] = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
