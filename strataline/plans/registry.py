"""Registered queries of the line-counting engine and their DuckDB equivalents.

The tables hold no source files, so the queries make some: document d's line i gets marks by (d + i) % 13, and the
document a file name by d; both engines do so alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..functions import text as T
from ..operators import classify, lines, summarize
from ..session import ready
from ..sources import ignore
from . import render

#: File names of documents, by doc_id modulo their number.
NAMES = ("src/a.rs", "B.RS", "Makefile", "x/style.css", "z.unknown", "README", "deep/dir/Dockerfile.dev", "app.mjs", ".hidden", "notes.TXT", "conf.yaml.in")
#: First lines of documents, by doc_id modulo their number.
FIRST = ("#!/usr/bin/env python3", "#!/home/ubuntu/bin/sh", "#!/bin/bash -e", "#!/usr/bin/ruby", "# python", "#!/usr/bin/env node")
#: First lines of contents for the extensions m and v; a document's text follows.
M_TEXTS = ("%{\n  area of a circle\n%}\nfunction a = area(r)\n", "#import <Cocoa/Cocoa.h>\n@implementation Counter\n", "", "classdef Shape\n@protocol Drawn\n")
V_TEXTS = ("import math\npub struct Point {\n", "module adder(a, b);\nassign c = a;\nendmodule\n", "", "fn area(r f64) {\n")
#: Folders and names of paths, by doc_id, and the ignore files of their tree.
FOLDERS = ("src", "build", ".cache", "docs/api", "target/debug")
FILES = ("a.rs", "b.log", "keep.log", ".hidden.py", "c.tmp", "README.md")
IGNORES = {"": "*.log\n!keep.log\nbuild/\n/target\n", "docs": "*.tmp\n"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], key: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(key, F.lit(len(values))).cast("int"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, path, text): documents with comment marks and file names."""
    docs = _table(spark, sf_dir, "documents")

    def marked(line: Column, i: Column) -> Column:
        k = F.pmod(F.col("doc_id") + i, F.lit(13))
        return (
            F.when(k == 0, "").when(k == 1, F.concat(F.lit("  // "), line)).when(k == 2, F.concat(F.lit("/* "), line)).when(k == 3, F.concat(line, F.lit(" */")))
            .when(k == 4, F.concat(F.lit("*/ /* "), line)).when(k == 5, F.concat(F.lit("/* a */ "), line)).otherwise(line)
        )

    text = F.array_join(F.transform(F.split("text", "\n", -1), marked), "\n")
    return docs.select("doc_id", "source", _pick(NAMES, F.col("doc_id")).alias("path"), text.alias("text"))


def _counted(text: str, language: tuple[tuple, tuple] = ((), ())) -> Column:
    marks, pairs = language
    markers = F.array(*map(F.lit, marks)).cast("array<string>")
    blocks = F.array(*(F.struct(F.lit(a).alias("open"), F.lit(b).alias("close")) for a, b in pairs)).cast("array<struct<open:string,close:string>>")
    return lines.counted(F.col(text), markers, blocks, F.lit(catalog.closed_run(tuple(pairs))))


def _sums(df: DataFrame, key: str, stats: Column) -> DataFrame:
    return df.select(key, stats.alias("s")).groupBy(key).agg(*(F.sum(f"s.{m}").alias(m) for m in summarize.MEASURES))


def lines_by_source(spark, sf_dir):
    return _sums(_table(spark, sf_dir, "documents"), "source", _counted("text")).orderBy(F.desc("code"), "source")


def conversation_lines(spark, sf_dir):
    return _sums(_table(spark, sf_dir, "conversations"), "role", _counted("text"))


def blank_lines(spark, sf_dir):
    rows = corpus(spark, sf_dir).withColumn("lines", T.lines(F.col("text")))
    return rows.groupBy("source").agg(F.sum(F.size(F.filter("lines", lambda x: T.trim_start(x) == "")).cast("long")).alias("blanks"))


def line_comments(spark, sf_dir):
    rows = corpus(spark, sf_dir).withColumn("lines", T.lines(F.col("text")))
    return rows.groupBy("source").agg(F.sum(F.size(F.filter("lines", lambda x: F.startswith(T.trim_start(x), F.lit("//")))).cast("long")).alias("comments"))


def block_fold(spark, sf_dir):
    return _sums(corpus(spark, sf_dir), "source", _counted("text", (("//",), (("/*", "*/"),))))


def html_comments(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.split(F.replace("html", F.lit("><"), F.lit(">\n<")), "\n", -1).alias("lines"))
    return pages.agg(F.sum(F.size("lines").cast("long")).alias("lines"), F.sum(F.size(F.filter("lines", lambda x: F.startswith(T.trim_start(x), F.lit("<!--")))).cast("long")).alias("comments"))


def page_extension(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    return pages.groupBy(F.coalesce(T.ascii_lower(T.extension(T.file_name(F.col("path")))), F.lit("-")).alias("ext")).agg(F.count("*").alias("pages"))


def filename_rules(spark, sf_dir):
    named = corpus(spark, sf_dir).select(classify.by_name(T.file_name(F.col("path")), catalog.builtin()).alias("language"))
    return named.groupBy(F.coalesce("language", F.lit("-")).alias("language")).agg(F.count("*").alias("files"))


def shebang(spark, sf_dir):
    firsts = _table(spark, sf_dir, "documents").select(F.concat(_pick(FIRST, F.col("doc_id")), F.lit("\n"), F.col("text")).alias("first"))
    return firsts.groupBy(F.coalesce(classify.by_shebang(F.col("first")), F.lit("-")).alias("language")).agg(F.count("*").alias("files"))


def _disambiguated(spark, sf_dir, ext: str, texts: tuple[str, ...]) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.concat(_pick(texts, F.col("doc_id")), F.col("text")).alias("first"))
    found = classify.by_content(F.col("first"), catalog.builtin().by_extension[ext], catalog.builtin())
    return rows.groupBy(found.alias("language")).agg(F.count("*").alias("files"))


def disambiguate_m(spark, sf_dir):
    return _disambiguated(spark, sf_dir, "m", M_TEXTS)


def disambiguate_v(spark, sf_dir):
    return _disambiguated(spark, sf_dir, "v", V_TEXTS)


def summary_rollup(spark, sf_dir):
    stats = summarize.per_file(corpus(spark, sf_dir).select("path", "text"))
    return summarize.ordered(summarize.with_total(stats))


def unknown_formats(spark, sf_dir):
    return summarize.unknown_formats(summarize.per_file(corpus(spark, sf_dir).select("path", "text")))


def summary_json(spark, sf_dir):
    rows = summarize.by_language(summarize.per_file(corpus(spark, sf_dir).select("path", "text")))
    item = F.struct("language", "files", "lines", "comments", "blanks", "code")
    return rows.select(F.to_json(item).alias("json"))


def format_numbers(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.grouped(F.col("n_chars") * 997).alias("formatted"))


def text_filter(spark, sf_dir):
    """Files with a NUL in or after the detection prefix, with ill-formed bytes, or cut characters at its end."""
    k = F.pmod(F.col("doc_id"), F.lit(6))
    filler = F.repeat(F.lit("x"), T.PREFIX_BYTES - 1).cast("binary")
    raw = F.col("text").cast("binary")
    content = (
        F.when(k == 0, F.concat(raw, F.lit(b"\x00"))).when(k == 1, F.concat(filler, F.lit("é\n").cast("binary"))).when(k == 2, F.concat(filler, F.lit(b"x\x00")))
        .when(k == 3, F.concat(F.lit(b"\xff"), raw)).when(k == 4, F.lit(b"")).otherwise(raw)
    )
    rows = _table(spark, sf_dir, "documents").select(k.cast("int").alias("kind"), T.is_text(T.prefix(content)).alias("is_text"))
    return rows.groupBy("kind").agg(F.count_if("is_text").alias("kept"), F.count("*").alias("files"))


def catalog_integrity(spark, sf_dir):
    """Rules whose language the catalog lacks: none."""
    own = catalog.builtin()
    rules = spark.createDataFrame([(kind, p, name) for kind, table in (("exact", own.exact), ("prefix", own.prefixes), ("suffix", own.suffixes)) for p, name in table], "kind string, pattern string, language string")
    return rules.join(F.broadcast(classify.dimension(spark, own)), "language", "left").groupBy("kind").agg(F.count("*").alias("rules"), F.count_if(F.col("id").isNull()).alias("dangling"))


def _summary(spark, sf_dir) -> summarize.Summary:
    return summarize.summarize(corpus(spark, sf_dir).select("path", "text"), verbose=True)


def rendered_table(spark, sf_dir):
    """The table as printed, line by line."""
    return spark.createDataFrame(list(enumerate(render.table(_summary(spark, sf_dir)).split("\n"))), "n long, line string")


def rendered_json(spark, sf_dir):
    return spark.createDataFrame([(render.as_json(_summary(spark, sf_dir)),)], "document string")


def rendered_formats(spark, sf_dir):
    return spark.createDataFrame([(render.formats(_summary(spark, sf_dir)),)], "report string")


def ignore_rules(spark, sf_dir):
    """Paths of a tree with ignore files at its root and below: which are left out."""
    docs = _table(ready(spark), sf_dir, "documents")
    paths = docs.select(F.concat(_pick(FOLDERS, F.col("doc_id")), F.lit("/"), _pick(FILES, F.floor(F.col("doc_id") / len(FOLDERS)))).alias("path"))
    return ignore.marked(paths, IGNORES).groupBy("path", "ignored").agg(F.count("*").alias("files"))


def queries() -> dict:
    return {f.__name__: f for f in (rendered_table, rendered_json, rendered_formats, ignore_rules, lines_by_source, conversation_lines, blank_lines, line_comments, block_fold, html_comments, page_extension, filename_rules, shebang, disambiguate_m, disambiguate_v, summary_rollup, unknown_formats, summary_json, format_numbers, text_filter, catalog_integrity)}


# DuckDB.

_WHITE = "' ' || chr(9) || chr(10) || chr(12) || chr(13)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(" || chr(10) || ".join(_quoted(p) for p in v.split("\n")) for v in values) + "]"


def _sql_pick(values: tuple[str, ...]) -> str:
    return f"({_list(values)})[(doc_id % {len(values)}) + 1]"


def _sql_lines(text: str) -> str:
    return f"CASE WHEN string_split({text}, chr(10))[-1] = '' THEN string_split({text}, chr(10))[:-2] ELSE string_split({text}, chr(10)) END"


def _corpus_sql() -> str:
    """CTE marked: a row a line; corpus: doc_id, source, path, lines (the last empty one dropped)."""
    return f"""split AS (SELECT doc_id, source, {_sql_pick(NAMES)} AS path, string_split(text, chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, source, path, unnest(parts) AS s, generate_subscripts(parts, 1) - 1 AS i, len(parts) AS n FROM split),
marked AS (SELECT doc_id, source, path, i, n, CASE (doc_id + i) % 13 WHEN 0 THEN '' WHEN 1 THEN '  // ' || s WHEN 2 THEN '/* ' || s WHEN 3 THEN s || ' */'
  WHEN 4 THEN '*/ /* ' || s WHEN 5 THEN '/* a */ ' || s ELSE s END AS line FROM numbered),
kept AS (SELECT * FROM marked WHERE NOT (i = n - 1 AND line = ''))"""


def _fold_sql(line_marks: str, has_block: str) -> str:
    """CTE folded: per document the counts, by a recursive walk over its lines; the two arguments are SQL conditions on path."""
    after = r"regexp_replace(ltrim({x}, " + _WHITE + r"), '^(?:/\*[\s\S]*?\*/[ \t\n\f\r]*)*', '')"
    rest = after.format(x="substr(t, instr(t, '*/') + 2)")
    opened = after.format(x="substr(substr(t, 3), instr(substr(t, 3), '*/') + 2)")
    return f"""trimmed AS (SELECT doc_id, source, path, i, ltrim(line, {_WHITE}) AS t, {line_marks} AS lm, {has_block} AS bc FROM kept),
moves AS (SELECT *, CASE WHEN t = '' THEN 'keep' WHEN instr(t, '*/') = 0 THEN 'in' WHEN starts_with({rest}, '/*') THEN 'in' ELSE 'out' END AS if_in,
  CASE WHEN t = '' THEN 'keep' WHEN lm AND starts_with(t, '//') THEN 'out' WHEN bc AND starts_with(t, '/*') THEN
    CASE WHEN instr(substr(t, 3), '*/') = 0 THEN 'in' WHEN starts_with({opened}, '/*') THEN 'in' ELSE 'out' END ELSE 'out' END AS if_out FROM trimmed),
listed AS (SELECT doc_id, any_value(source) AS source, any_value(path) AS path, list(t ORDER BY i) AS ts, list(if_in ORDER BY i) AS ins, list(if_out ORDER BY i) AS outs, bool_or(lm) AS lm, bool_or(bc) AS bc FROM moves GROUP BY doc_id),
walked AS (
  WITH RECURSIVE walk AS (
    SELECT doc_id, 0 AS k, 'out' AS st, 0 AS blanks, 0 AS comments, 0 AS code FROM listed
    UNION ALL
    SELECT w.doc_id, w.k + 1, CASE WHEN (CASE w.st WHEN 'in' THEN ins ELSE outs END)[w.k + 1] = 'keep' THEN w.st ELSE (CASE w.st WHEN 'in' THEN ins ELSE outs END)[w.k + 1] END,
      w.blanks + (ts[w.k + 1] = '')::INT,
      w.comments + (ts[w.k + 1] <> '' AND (w.st = 'in' OR (lm AND starts_with(ts[w.k + 1], '//')) OR (bc AND starts_with(ts[w.k + 1], '/*'))))::INT,
      w.code + (ts[w.k + 1] <> '' AND w.st = 'out' AND NOT (lm AND starts_with(ts[w.k + 1], '//')) AND NOT (bc AND starts_with(ts[w.k + 1], '/*')))::INT
    FROM walk w JOIN listed USING (doc_id) WHERE w.k < len(ts))
  SELECT doc_id, arg_max(blanks, k) AS blanks, arg_max(comments, k) AS comments, arg_max(code, k) AS code, max(k) AS lines FROM walk GROUP BY doc_id),
folded AS (SELECT d.doc_id, d.source, {_sql_pick(NAMES).replace('doc_id', 'd.doc_id')} AS path, coalesce(lines, 0) AS lines, coalesce(blanks, 0) AS blanks, coalesce(comments, 0) AS comments, coalesce(code, 0) AS code FROM documents d LEFT JOIN walked USING (doc_id))"""


_SUMS = "count(*)::BIGINT AS files, sum(lines)::BIGINT AS lines, sum(blanks)::BIGINT AS blanks, sum(comments)::BIGINT AS comments, sum(code)::BIGINT AS code"


def _plain_sql(table: str, key: str) -> str:
    return f"""WITH l AS (SELECT {key}, {_sql_lines('text')} AS ls FROM {table})
SELECT {key}, count(*)::BIGINT AS files, sum(len(ls))::BIGINT AS lines, sum(len(list_filter(ls, lambda x: ltrim(x, {_WHITE}) = '')))::BIGINT AS blanks, 0::BIGINT AS comments,
  sum(len(list_filter(ls, lambda x: ltrim(x, {_WHITE}) <> '')))::BIGINT AS code FROM l GROUP BY {key}"""


def _languages_sql() -> str:
    """The language of each of NAMES, as a CASE on path."""
    known = {"src/a.rs": "Rust", "B.RS": "Rust", "Makefile": "Makefile", "x/style.css": "CSS", "deep/dir/Dockerfile.dev": "Dockerfile", "app.mjs": "JavaScript", "notes.TXT": "Text", "conf.yaml.in": "YAML"}
    return "CASE path " + " ".join(f"WHEN {_quoted(p)} THEN {_quoted(x)}" for p, x in known.items()) + " ELSE 'Unknown' END"


def _scored_sql(texts: tuple[str, ...], first: str, second: str) -> str:
    from ..catalog_data import CONTENT_RULES

    def points(language: str) -> str:
        return " + ".join(f"CASE WHEN regexp_matches(t, {_quoted('(?m)' + regex)}) THEN {n} ELSE 0 END" for x, n, regex in CONTENT_RULES if x == language)

    return f"""WITH t AS (SELECT {_sql_pick(texts)} || text AS t FROM documents), s AS (SELECT {points(first)} AS a, {points(second)} AS b FROM t)
SELECT CASE WHEN b >= 4 AND b >= a + 2 THEN {_quoted(second)} ELSE {_quoted(first)} END AS language, count(*)::BIGINT AS files FROM s GROUP BY 1"""


def _rendered_sql(by_path: str, language: str) -> str:
    """CTE s: the summary by language; cells: strings of all rows of the table; w: widths of its columns."""
    columns = ("files", "lines", "blanks", "comments", "code")
    texts = ", ".join(f"format('{{:,}}', {c}) AS {c}" for c in columns)
    return f"""{by_path}, s AS (SELECT {language} AS language, {_SUMS} FROM folded GROUP BY 1),
total AS (SELECT {", ".join(f"sum({c})::BIGINT AS {c}" for c in columns)} FROM s),
cells AS (SELECT 0 AS k, 'Language' AS language, 'Files' AS files, 'Lines' AS lines, 'Blank' AS blanks, 'Comment' AS comments, 'Code' AS code
  UNION ALL SELECT 1 + row_number() OVER (ORDER BY s.code DESC, language), language, {texts} FROM s
  UNION ALL SELECT (SELECT count(*) FROM s) + 3, 'Total', {texts} FROM total),
w AS (SELECT max(length(language)) AS language, {", ".join(f"max(length({c})) AS {c}" for c in columns)} FROM cells)"""


def oracle_sql() -> dict[str, str]:
    columns = ("files", "lines", "blanks", "comments", "code")
    rust = "path IN ('src/a.rs', 'B.RS', 'app.mjs')"
    block = "path IN ('src/a.rs', 'B.RS', 'app.mjs', 'x/style.css')"
    by_path = f"WITH {_corpus_sql()}, {_fold_sql(rust, block)}"
    language = _languages_sql()
    line = f"string_split({_sql_pick(FIRST)}, chr(10))[1]"
    rendered = _rendered_sql(by_path, language)
    line_end = "chr(10)"
    numbers = lambda row, indent: f" || ',' || {line_end} || ".join(f"'{indent}\"{c}\": ' || {row}.{c}" for c in ("files", "lines", "comments", "blanks", "code"))
    return {
        "rendered_table": f"""{rendered} SELECT k AS n, rpad(c.language, w.language::INT, ' ') || {" || ".join(f"' ' || lpad(c.{x}, w.{x}::INT, ' ')" for x in columns)} AS line FROM cells c, w
UNION ALL SELECT k, repeat('-', w.language) || {" || ".join(f"' ' || repeat('-', w.{x})" for x in columns)} FROM w, (SELECT 1 AS k UNION ALL SELECT count(*) + 2 FROM s)
UNION ALL SELECT count(*) + 4, '' FROM s""",
        "rendered_json": f"""{rendered}, items AS (SELECT string_agg('    {{' || {line_end} || '      "language": "' || language || '",' || {line_end} || {numbers('s', '      ')} || {line_end} || '    }}', ',' || {line_end} ORDER BY s.code DESC, language) AS x FROM s)
SELECT '{{' || {line_end} || '  "languages": [' || {line_end} || x || {line_end} || '  ],' || {line_end} || '  "total": {{' || {line_end} || {numbers('total', '    ')} || {line_end} || '  }}' || {line_end} || '}}' || {line_end} AS document FROM items, total""",
        "rendered_formats": f"""WITH p AS (SELECT {_sql_pick(NAMES)} AS path FROM documents), f AS (SELECT CASE path WHEN 'z.unknown' THEN '.unknown' ELSE path END AS format, count(*)::BIGINT AS files FROM p WHERE path IN ('z.unknown', 'README', '.hidden') GROUP BY 1)
SELECT {line_end} || 'Unknown file formats:' || {line_end} || string_agg('  ' || rpad(format, 24, ' ') || ' ' || lpad(format('{{:,}}', files), 8, ' ') || {line_end}, '' ORDER BY files DESC, format) AS report FROM f""",
        "ignore_rules": f"""WITH p AS (SELECT ({_list(FOLDERS)})[doc_id % 5 + 1] AS folder, ({_list(FILES)})[(doc_id // 5) % 6 + 1] AS file FROM documents)
SELECT folder || '/' || file AS path, NOT (folder IN ('src', 'docs/api') AND (file IN ('a.rs', 'keep.log', 'README.md') OR (file = 'c.tmp' AND folder = 'src'))) AS ignored, count(*)::BIGINT AS files FROM p GROUP BY 1, 2""",
        "lines_by_source": _plain_sql("documents", "source"),
        "conversation_lines": _plain_sql("conversations", "role"),
        "blank_lines": f"WITH {_corpus_sql()} SELECT source, count(*) FILTER (ltrim(line, {_WHITE}) = '')::BIGINT AS blanks FROM kept GROUP BY source",
        "line_comments": f"WITH {_corpus_sql()} SELECT source, count(*) FILTER (starts_with(ltrim(line, {_WHITE}), '//'))::BIGINT AS comments FROM kept GROUP BY source",
        "block_fold": f"WITH {_corpus_sql()}, {_fold_sql('true', 'true')} SELECT source, {_SUMS} FROM folded GROUP BY source",
        "html_comments": f"WITH l AS (SELECT unnest(string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10))) AS x FROM pages) SELECT count(*)::BIGINT AS lines, count(*) FILTER (starts_with(ltrim(x, {_WHITE}), '<!--'))::BIGINT AS comments FROM l",
        "page_extension": r"WITH n AS (SELECT string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] AS x FROM pages) SELECT CASE WHEN regexp_matches(x, '^[\s\S]+\.[^.]*$') THEN translate(string_split(x, '.')[-1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '-' END AS ext, count(*)::BIGINT AS pages FROM n GROUP BY 1",
        "filename_rules": f"WITH p AS (SELECT {_sql_pick(NAMES)} AS path FROM documents) SELECT CASE WHEN path = 'Makefile' THEN 'Makefile' WHEN starts_with(string_split(path, '/')[-1], 'Dockerfile') THEN 'Dockerfile' WHEN ends_with(path, '.yaml.in') THEN 'YAML' ELSE '-' END AS language, count(*)::BIGINT AS files FROM p GROUP BY 1",
        "shebang": f"WITH l AS (SELECT {line} AS x FROM documents) SELECT CASE WHEN NOT starts_with(x, '#!') THEN '-' WHEN contains(x, 'python') THEN 'Python' WHEN contains(x, 'node') OR contains(x, 'deno') OR contains(x, 'bun') THEN 'JavaScript' WHEN contains(x, 'sh') THEN 'Shell' ELSE '-' END AS language, count(*)::BIGINT AS files FROM l GROUP BY 1",
        "disambiguate_m": _scored_sql(M_TEXTS, "MATLAB", "Objective-C"),
        "disambiguate_v": _scored_sql(V_TEXTS, "V", "Verilog"),
        "summary_rollup": f"{by_path} SELECT CASE WHEN grouping(l) = 1 THEN 'Total' ELSE l END AS language, {_SUMS}, grouping(l)::INT AS is_total FROM (SELECT {language} AS l, * FROM folded) GROUP BY ROLLUP (l)",
        "unknown_formats": f"WITH p AS (SELECT {_sql_pick(NAMES)} AS path FROM documents) SELECT CASE path WHEN 'z.unknown' THEN '.unknown' ELSE path END AS format, count(*)::BIGINT AS files FROM p WHERE path IN ('z.unknown', 'README', '.hidden') GROUP BY 1",
        "summary_json": f"""{by_path}, s AS (SELECT {language} AS language, {_SUMS} FROM folded GROUP BY 1) SELECT '{{"language":"' || language || '","files":' || files || ',"lines":' || lines || ',"comments":' || comments || ',"blanks":' || blanks || ',"code":' || code || '}}' AS json FROM s""",
        "format_numbers": "SELECT doc_id, format('{:,}', n_chars * 997) AS formatted FROM documents",
        "text_filter": "SELECT (doc_id % 6)::INT AS kind, count(*) FILTER (doc_id % 6 IN (1, 2, 4, 5) OR (doc_id % 6 = 0 AND strlen(text) >= 16384))::BIGINT AS kept, count(*)::BIGINT AS files FROM documents GROUP BY 1",
        "catalog_integrity": "SELECT * FROM (VALUES ('exact', 22::BIGINT, 0::BIGINT), ('prefix', 4::BIGINT, 0::BIGINT), ('suffix', 4::BIGINT, 0::BIGINT)) AS v(kind, rules, dangling)",
    }
