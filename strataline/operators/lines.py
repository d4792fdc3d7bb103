"""The stateful fold over a file's lines: blank, comment or code, with the pending block-comment close as state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import lines, trim_start


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def after(text: Column, token: Column) -> Column:
    """What follows the first token in text, null where there is none."""
    at = F.position(token, text)
    return F.when(at > 0, F.substring(text, at + F.length(token), F.length(text)))


def first_open(text: Column, pairs: Column) -> Column:
    """The first pair in order whose opening begins text."""
    return F.get(F.filter(pairs, lambda p: F.startswith(text, p["open"])), F.lit(0))


def state_after(rest: Column, pairs: Column, closed_run: Column) -> Column:
    """The pending close once a comment has closed before rest: closed comments go at once, then another may open."""
    return first_open(F.regexp_replace(trim_start(rest), closed_run, F.lit("")), pairs)["close"]


def counted(text: Column, markers: Column, pairs: Column, closed_run: Column) -> Column:
    """struct(files, lines, blanks, comments, code) of a text.

    markers: array of line-comment marks; pairs: array of struct(open, close); closed_run: catalog.closed_run of them.
    """
    zero = F.struct(F.lit(None).cast("string").alias("pending"), *(F.lit(0).cast("long").alias(k) for k in ("blanks", "comments", "code")))

    def add(acc: Column, pending: Column, kind: str) -> Column:
        return F.struct(pending.alias("pending"), *((acc[k] + (1 if k == kind else 0)).alias(k) for k in ("blanks", "comments", "code")))

    def closing(body: Column, close: Column) -> Column:
        """The pending close after body, in which close is looked for."""
        return let(after(body, close), lambda rest: F.when(rest.isNull(), close).otherwise(state_after(rest, pairs, closed_run)))

    def step(acc: Column, line: Column) -> Column:
        def classify(t: Column) -> Column:
            none = F.lit(None).cast("string")
            opened = let(first_open(t, pairs), lambda p: F.when(p.isNull(), add(acc, none, "code")).otherwise(add(acc, closing(F.substring(t, F.length(p["open"]) + 1, F.length(t)), p["close"]), "comments")))
            return (
                F.when(t == "", add(acc, acc["pending"], "blanks"))
                .when(acc["pending"].isNotNull(), add(acc, closing(t, acc["pending"]), "comments"))
                .when(F.exists(markers, lambda m: F.startswith(t, m)), add(acc, none, "comments"))
                .otherwise(opened)
            )

        return let(trim_start(line), classify)

    def done(rows: Column) -> Column:
        return F.aggregate(rows, zero, step, lambda acc: F.struct(F.lit(1).cast("long").alias("files"), F.size(rows).cast("long").alias("lines"), acc["blanks"].alias("blanks"), acc["comments"].alias("comments"), acc["code"].alias("code")))

    return let(lines(text), done)
