"""op2: all conversations, and one of control strings, formatted and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common

#: Texts of conversation -1.
ODD = "</s>[INST] ok [/INST]"
BUDGET = chat.Budget()


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.unionByName(spark.sql(f"select -1L as conv_id, t as turn, r as role, '{ODD}' as text from values (0L, 'user'), (1L, 'assistant') as v(t, r)"))


def read_back(windows: DataFrame) -> DataFrame:
    """One row a conversation, from the formatted windows alone: turns are those after the repeated ones."""
    parsed = chat.parsed(windows)
    own = F.slice("turns", F.col("n_repeated") + 1, F.size("turns"))
    line = F.concat_ws("", F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    by_window = parsed.select("conv_id", "window", F.size(own).alias("n"), line.alias("line"), F.concat_ws("", "targets").alias("loss_text"), F.length("formatted").alias("chars"))
    joined = lambda c: F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("window", c))), lambda x: x[c]))
    text = joined("loss_text")
    return by_window.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sha2(joined("line"), 256).alias("turns_sha256"), F.length(text).cast("long").alias("loss_chars"),
        F.sha2(text, 256).alias("loss_sha256"), F.sum("chars").cast("long").alias("formatted_chars"), F.count("*").alias("n_windows"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows are stored, and all that is returned is read from them."""
    return read_back(common.written(chat.windows(turns(spark, sf_dir), BUDGET), "windows"))


QUERIES = {"op2_chat_format": op2_chat_format}
_ESCAPED = r"regexp_replace({x}, '([<\[])(\\*)(" + chat.CONTROL + r")', '\1\\\2\3', 'g')"
SQL = {
    "op2_chat_format": rf"""
WITH RECURSIVE src AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{ODD}' UNION ALL SELECT -1, 1, 'assistant', '{ODD}'),
t AS (SELECT *, len(regexp_extract_all(text, '{chat.TOKEN}')) + 4 AS tokens, row_number() OVER o AS place, floor(coalesce(turn, 4611686018427387903) / {BUDGET.block}) AS block FROM src WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
p AS (SELECT *, place = 1 AND role = 'system' AND tokens <= {BUDGET.system} AS is_system, sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) - tokens AS before, row_number() OVER (PARTITION BY conv_id, block ORDER BY place) AS k,
  dense_rank() OVER (PARTITION BY conv_id ORDER BY block) AS part, 13 + length(replace(replace(role, '\', '\\'), chr(10), '\n')) + 1 + length({_ESCAPED.format(x="text")}) AS chars FROM t),
walk AS (SELECT conv_id, part, k, tokens AS held, true AS begins FROM p WHERE k = 1
  UNION ALL SELECT p.conv_id, p.part, p.k, CASE WHEN held + p.tokens > {BUDGET.room} THEN p.tokens ELSE held + p.tokens END, held + p.tokens > {BUDGET.room} FROM walk JOIN p ON p.conv_id = walk.conv_id AND p.part = walk.part AND p.k = walk.k + 1),
w AS (SELECT p.conv_id, p.part, p.place, p.before FROM p JOIN walk USING (conv_id, part, k) WHERE begins),
retained AS (SELECT w.conv_id, sum(p.chars) AS c FROM w JOIN p ON w.conv_id = p.conv_id AND p.is_system WHERE w.place > 1 GROUP BY 1),
repeated AS (SELECT w.conv_id, sum(p.chars) AS c FROM w JOIN p ON w.conv_id = p.conv_id AND p.part >= w.part - 1 AND p.place BETWEEN w.place - {BUDGET.history_turns} AND w.place - 1 AND NOT p.is_system AND w.before - p.before <= {BUDGET.history} GROUP BY 1),
n AS (SELECT conv_id, count(*) AS n FROM w GROUP BY 1),
c AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars FROM p GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (chars + coalesce(retained.c, 0) + coalesce(repeated.c, 0))::BIGINT AS formatted_chars, n.n::BIGINT AS n_windows
FROM c JOIN n USING (conv_id) LEFT JOIN retained USING (conv_id) LEFT JOIN repeated USING (conv_id)
""",
}
