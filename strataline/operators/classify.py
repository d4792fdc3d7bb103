"""A file's language: whole name, prefix, suffix, first line, then extension with content rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..catalog_data import LEAST_LEAD, LEAST_SCORE, SHEBANGS
from ..functions.text import ascii_lower, extension


def by_name(name: Column, catalog: Catalog) -> Column:
    """Language of a whole file name, else of the first prefix, else of the first suffix that fits."""
    out = F.lit(None).cast("string")
    for pattern, language in reversed(catalog.suffixes):
        out = F.when(F.endswith(name, F.lit(pattern)), language).otherwise(out)
    for pattern, language in reversed(catalog.prefixes):
        out = F.when(F.startswith(name, F.lit(pattern)), language).otherwise(out)
    return F.coalesce(_lookup(dict(catalog.exact), name), out)


def _lookup(table: dict[str, str], key: Column) -> Column:
    if not table:
        return F.lit(None).cast("string")
    quoted = ("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for pair in table.items() for x in pair)
    return F.expr(f"map({', '.join(quoted)})")[key]  # one expression to parse, folded into a literal


def by_shebang(first: Column) -> Column:
    """Language of an interpreter line, by substrings of it in order."""
    line = F.substring_index(first, "\n", 1)
    out = F.lit(None).cast("string")
    for language, parts in reversed(SHEBANGS):
        found = F.lit(False)
        for part in parts:
            found = found | F.contains(line, F.lit(part))
        out = F.when(found, language).otherwise(out)
    return F.when(F.startswith(first, F.lit("#!")), out)


def score(first: Column, rules: tuple[tuple[str, int], ...]) -> Column:
    """Sum of the scores of rules that match; `^` stands at line starts, line feeds alone end lines, classes are ASCII."""
    out = F.lit(0)
    for regex, points in rules:
        out = out + F.when(first.rlike(f"(?md){regex.removeprefix('(?-u:').removesuffix(')') if regex.startswith('(?-u:') else regex}"), points).otherwise(0)
    return out


def by_content(first: Column, candidates: list[int], catalog: Catalog) -> Column:
    """The best candidate by content rules if it scores and leads enough, else the first."""
    scored = F.array(*(F.struct(score(first, catalog.languages[k].rules).alias("points"), F.lit(-at).alias("order"), F.lit(catalog.languages[k].name).alias("name")) for at, k in enumerate(candidates)))
    ranked = F.sort_array(scored, asc=False)
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    clear = (best["points"] >= LEAST_SCORE) & (best["points"] >= second["points"] + LEAST_LEAD)
    return F.when(clear, best["name"]).otherwise(catalog.languages[candidates[0]].name)


def by_extension(name: Column, first: Column, catalog: Catalog) -> Column:
    """Language of an extension, in any ASCII case; content rules only where several languages share it."""
    key = ascii_lower(extension(name))
    sole = {x: catalog.languages[ids[0]].name for x, ids in catalog.by_extension.items() if len(ids) == 1 or not any(catalog.languages[k].rules for k in ids)}
    out = _lookup(sole, key)
    for x, ids in catalog.by_extension.items():
        if x not in sole:
            out = F.when(key == x, by_content(first, ids, catalog)).otherwise(out)
    return out


def language(name: Column, first: Column, catalog: Catalog) -> Column:
    """Language name of a file, null if unknown. first: its first bytes, a character each."""
    return F.coalesce(by_name(name, catalog), by_shebang(first), by_extension(name, first, catalog))


def dimension(spark, catalog: Catalog) -> DataFrame:
    """One row a language: id, language, markers, pairs and the expression of closed comments."""
    from ..catalog import closed_run

    rows = [(k, x.name, list(x.line_comments), [(a, b) for a, b in x.block_comments], closed_run(x.block_comments)) for k, x in enumerate(catalog.languages)]
    return spark.createDataFrame(rows, "id int, language string, markers array<string>, pairs array<struct<open:string,close:string>>, closed_run string")
