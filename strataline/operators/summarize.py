"""Files to stats, stats to summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, builtin
from ..functions.text import file_name, is_text, latin1, prefix, unknown_format
from .classify import dimension, language
from .lines import counted, let

MEASURES = ["files", "lines", "blanks", "comments", "code"]
UNKNOWN = "Unknown"


def per_file(files: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """path, language (null if unknown), unknown_format and the five measures of every text file.

    files: (path, content BINARY) or (path, text STRING). Files that aren't text leave no row. The language dimension has
    the catalog's size and is broadcast; all else is one narrow pass.
    """
    catalog = catalog or builtin()
    rows = files.select("path", F.coalesce(F.col("content") if "content" in files.columns else F.col("text").cast("binary"), F.lit(b"")).alias("content"))

    def kept(first: Column) -> Column:
        found = let(file_name(F.col("path")), lambda name: let(latin1(first), lambda text: F.struct(name.alias("name"), language(name, text, catalog).alias("language"))))
        return F.when(is_text(first), F.array(found)).otherwise(F.array().cast("array<struct<name:string,language:string>>"))

    # a generator, not a filter: a filter would be moved below and repeat what it asks for
    rows = rows.select("path", "content", F.inline(let(prefix(F.col("content")), kept)))
    joined = rows.join(F.broadcast(dimension(files.sparkSession, catalog).drop("id")), "language", "left")
    none = F.array().cast("array<string>")
    pairs = F.coalesce("pairs", F.array().cast("array<struct<open:string,close:string>>"))
    stats = counted(latin1(F.col("content")), F.coalesce("markers", none), pairs, F.coalesce("closed_run", F.lit("^(?!)")))
    return joined.select("path", "language", F.when(F.col("language").isNull(), unknown_format(F.col("name"))).alias("unknown_format"), stats.alias("stats")).select("path", "language", "unknown_format", "stats.*")


def by_language(stats: DataFrame) -> DataFrame:
    """Measures by language, files without one under Unknown."""
    return stats.groupBy(F.coalesce("language", F.lit(UNKNOWN)).alias("language")).agg(*(F.sum(m).alias(m) for m in MEASURES))


def with_total(stats: DataFrame, key: str = "language") -> DataFrame:
    """by_language with a grand total row (is_total), in one aggregation."""
    named = stats.withColumn(key, F.coalesce(F.col(key), F.lit(UNKNOWN)))
    rolled = named.rollup(key).agg(*(F.sum(m).alias(m) for m in MEASURES), F.grouping(key).cast("int").alias("is_total"))
    return rolled.withColumn(key, F.when(F.col("is_total") == 1, "Total").otherwise(F.col(key)))


def ordered(summary: DataFrame) -> DataFrame:
    """Most code first, then by name; the total last."""
    return summary.orderBy(*(["is_total"] if "is_total" in summary.columns else []), F.desc("code"), "language")


def unknown_formats(stats: DataFrame) -> DataFrame:
    """Files by unknown format, most first."""
    return stats.where("unknown_format is not null").groupBy(F.col("unknown_format").alias("format")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "format")


@dataclass
class Summary:
    """Results of a scan: rows in order, the total, and unknown formats in order."""

    languages: list[tuple]
    total: tuple
    formats: list[tuple[str, int]]


def summarize(files: DataFrame, catalog: Catalog | None = None, verbose: bool = False) -> Summary:
    """Collected summary; at most one row a language of the catalog comes back, formats only if verbose."""
    stats = per_file(files, catalog)
    if verbose:
        stats = stats.persist()
    rows = [tuple(r) for r in ordered(by_language(stats)).select("language", *MEASURES).collect()]
    formats = [tuple(r) for r in unknown_formats(stats).collect()] if verbose else []
    if verbose:
        stats.unpersist()
    total = tuple(sum(r[k] for r in rows) for k in range(1, 6)) if rows else (0,) * 5
    return Summary(rows, total, formats)
