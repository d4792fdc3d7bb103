"""Chat formatting in budgeted windows, by DataFrame functions alone.

A turn is written `<|turn|>role\\ntext</s>\\n`. Control strings inside a role or text get a backslash after their first
character (and one more for each that stands there already), so they can't be mistaken for the template's and come
back exactly when one is taken off.

A conversation is cut at turns into windows. Its turns are gathered by blocks of turn numbers, so a conversation that holds a
large share of all rows is spread over many tasks; a block is one row. There, prefix sums of the turns' tokens place each turn:
a window takes turns as long as they fit the room that is left beside the system turn and the history; a turn longer than
the room has a window of its own, and a block begins one. A window begins with the system turn and repeats up to `history_turns`
turns before it, of its own block or the one before, as far as `history` tokens allow. The loss mask covers assistant
texts where they are new; repeated ones are masked out. Texts are shuffled once, to their blocks; what passes between
blocks is their counts (a row a block), the last turns of the block before, and the system turn.

Tokens are estimated by pieces of words, numbers and signs of the lengths that byte-level vocabularies have, unless the caller
gives a column of exact counts.

Cases: null text or role is empty; turns are ordered by turn (null last), then role, then text, and repeated rows are
turns of their own; a null conv_id is a conversation; texts and roles of any length and characters come back as they were;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import salted_lookup

#: Control strings of common chat templates and of this one, without their first character. Fixed values.
CONTROL = r"/?INST\]|/?s>|/?<SYS>>|\|turn\|>|\|im_(?:start|end)\|>|\|endoftext\|>"
_PLAIN = rf"([<\[])(\\*)({CONTROL})"
_ESCAPED = rf"([<\[])\\(\\*)({CONTROL})"
OPEN, CLOSE = "<|turn|>", "</s>"


#: Pieces that count as a token each.
TOKEN = r"\x20?\p{L}{1,7}|\x20?\p{N}{1,3}|\x20?[^\x09-\x0D\x20\p{L}\p{N}]{1,3}|[\x09-\x0D\x20]"


@dataclass(frozen=True)
class Budget:
    """tokens: of a window; history: of repeated turns; block: turn numbers gathered in one row."""

    tokens: int = 1024
    history: int = 128
    history_turns: int = 2
    system: int = 256
    block: int = 256

    @property
    def room(self) -> int:
        return self.tokens - self.system - self.history


def escape(col: Column) -> Column:
    return F.regexp_replace(col, _PLAIN, r"$1\\$2$3")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, _ESCAPED, "$1$2$3")


def _role(col: Column) -> Column:
    """A role on one line: backslashes and line ends are written \\\\ and \\n."""
    return F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unrole(col: Column) -> Column:
    """The inverse, pair by pair: between doubled backslashes, what is left of them begins a line end."""
    return F.array_join(F.transform(F.split(col, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(turns: DataFrame, budget: Budget, tokens: str | None = None) -> DataFrame:
    """(conv, conv_id, block, n, raw): the turns of a block, n of them, in order."""
    c = F.col
    count = c(tokens).cast("long") if tokens else F.regexp_count("text", F.lit(TOKEN)).cast("long") + 4
    rows = turns.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    item = F.struct(c("turn").isNull().alias("last"), "turn", "role", "text", count.alias("tokens"))
    rows = rows.select(F.coalesce(F.concat(F.lit("="), c("conv_id").cast("string")), F.lit("-")).alias("conv"), "conv_id", F.floor(F.coalesce(c("turn"), F.lit((1 << 62) - 1)) / budget.block).alias("block"), item.alias("item"))
    gathered = rows.groupBy("conv", "block").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list("item")).alias("items"))
    return gathered.select("conv", "conv_id", "block", F.size("items").alias("n"), F.col("items").alias("raw"))


def _shown(raw: Column, budget: Budget) -> Column:
    """Turns as they are written, with tokens, and whether they are targets or may be the system turn."""
    return F.transform(raw, lambda x: F.struct(
        F.concat(F.lit(OPEN), escape(_role(x["role"])), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"), x["tokens"].alias("tokens"),
        (x["role"] == "assistant").alias("target"), ((x["role"] == "system") & (x["tokens"] <= budget.system)).alias("system"),
    ))


def _neighbours(rows: DataFrame, budget: Budget) -> DataFrame:
    """(conv, block, off: turns before it, tail: last turns of the block before, lead: the conversation's system turn) of all
    blocks but first ones."""
    c = F.col
    order = W.partitionBy("conv").orderBy("block")
    light = rows.select("conv", "block", "n").withColumns({"off": F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), "prior": F.lag("block").over(order)})
    later = light.where("prior is not null").select("conv", "block", "off", "prior")
    most = F.greatest(c("n") - budget.history_turns, F.lit(0)) + 1
    # the system turn stands first in the conversation's first block: the others ask for it there
    first = light.groupBy("conv").agg(F.min("block").alias("block"), F.count("*").alias("blocks")).where("blocks > 1").drop("blocks")
    lead = rows.join(first, ["conv", "block"]).select("conv", F.get(_shown(F.slice("raw", 1, 1), budget), F.lit(0)).alias("lead")).where("lead.system")
    tails = rows.select("conv", c("block").alias("prior"), _shown(F.slice("raw", most, budget.history_turns), budget).alias("tail"))
    # of a first block's turns, the system turn is never repeated as history
    met = later.join(tails, ["conv", "prior"]).join(first.select("conv", c("block").alias("begin")), "conv", "left")
    tail = F.when((c("prior") == c("begin")), F.filter("tail", lambda x, k: ~((k == 0) & x["system"] & (c("off") <= budget.history_turns)))).otherwise(c("tail"))
    return salted_lookup(met.withColumn("tail", tail).select("conv", "block", "off", "tail"), lead, "conv", 8, c("block"))


def _starts(items: Column, room: int) -> Column:
    """Where windows begin: a turn that no longer fits begins the next."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("k"))

    def step(acc: Column, x: Column) -> Column:
        begins = (acc["k"] == 0) | (acc["sum"] + x["tokens"] > room)
        return F.struct(F.when(begins, x["tokens"]).otherwise(acc["sum"] + x["tokens"]).alias("sum"), F.when(begins, F.concat(acc["starts"], F.array(acc["k"]))).otherwise(acc["starts"]).alias("starts"), (acc["k"] + 1).alias("k"))

    return F.aggregate(items, zero, step, lambda acc: acc["starts"])


def windows(turns: DataFrame, budget: Budget = Budget(), tokens: str | None = None) -> DataFrame:  # noqa: B008
    """One row a window: conv_id, window (its first new turn's place), formatted, loss (array of start, end in code
    points, end exclusive), n_repeated turns at its start, tokens, and over_budget for a single turn too long.

    tokens: a column of exact counts, template included, instead of the estimate.
    """
    c = F.col
    rows = blocks(turns, budget, tokens)
    met = rows.join(_neighbours(rows, budget), ["conv", "block"], "left").withColumn("items", _shown(c("raw"), budget))
    met = met.withColumns({"off": F.coalesce("off", F.lit(0)), "tail": F.coalesce("tail", F.slice("items", 1, 0))})
    own = F.get("items", F.lit(0))
    met = met.withColumn("lead", F.when(c("off") == 0, F.when(own["system"], own)).otherwise(c("lead")))
    met = met.withColumn("starts", _starts(c("items"), budget.room))
    cut = F.transform("starts", lambda s, k: F.struct(s.alias("start"), (F.coalesce(F.get("starts", k + 1), F.size("items")) - s).alias("n")))
    cut = met.select("conv_id", "off", "lead", "items", F.explode(cut).alias("cut"), "tail")
    # turns just before the window, the last first; each must fit with those after it
    before = F.concat("tail", F.slice("items", 1, c("cut.start")))
    before = let(before, lambda x: F.slice(x, F.greatest(F.size(x) - budget.history_turns, F.lit(0)) + 1, budget.history_turns))
    cut = cut.withColumn("near", before)
    isnt_lead = lambda k: ~((c("off") == 0) & (c("cut.start") - F.size("near") + k == 0) & F.get("near", k)["system"])
    fits = lambda k: F.aggregate(F.slice("near", k + 1, F.size("near")), F.lit(0).cast("long"), lambda acc, x: acc + x["tokens"]) <= budget.history
    repeated = F.filter("near", lambda x, k: isnt_lead(k) & fits(k))
    later = (c("off") + c("cut.start") > 0) & c("lead").isNotNull()
    kept = cut.select("conv_id", (c("off") + c("cut.start") + 1).cast("long").alias("window"), F.concat(F.when(later, F.array("lead")).otherwise(F.slice("items", 1, 0)), repeated).alias("old"), F.slice("items", c("cut.start") + 1, c("cut.n")).alias("new"))
    return _assembled(kept, budget)


def _assembled(kept: DataFrame, budget: Budget) -> DataFrame:
    c = F.col
    part = lambda x, target: F.struct(x["head"].alias("head"), x["body"].alias("body"), x["tokens"].alias("tokens"), target.alias("target"))
    packed = kept.select("conv_id", "window", F.size("old").alias("n_repeated"), F.concat(F.transform("old", lambda x: part(x, F.lit(False))), F.transform("new", lambda x: part(x, x["target"]))).alias("turns"))
    sizes = F.transform("turns", lambda t: F.length(t["head"]) + F.length(t["body"]) + len(CLOSE) + 1)
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE + "\n"))), "")
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    packed = packed.withColumns({"ends": ends, "formatted": formatted, "tokens": F.aggregate("turns", F.lit(0).cast("long"), lambda acc, x: acc + x["tokens"])})
    spans = F.zip_with("turns", F.slice("ends", 1, F.size("turns")), lambda t, at: F.struct((at + F.length(t["head"])).alias("start"), (at + F.length(t["head"]) + F.length(t["body"])).alias("end"), t["target"].alias("target")))
    loss = F.transform(F.filter(spans, lambda s: s["target"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return packed.select("conv_id", "window", "formatted", loss.alias("loss"), "n_repeated", "tokens", (c("tokens") > budget.tokens).alias("over_budget"))


def parsed(formatted: DataFrame) -> DataFrame:
    """Windows with turns (array of role, text), read from the formatted string, and targets (texts under the loss mask)."""
    cut = F.filter(F.split("formatted", r"<\|turn\|>", -1), lambda x: x != "")
    turn = F.transform(cut, lambda x: F.struct(_unrole(unescape(F.substring_index(x, "\n", 1))).alias("role"), unescape(_text(x)).alias("text")))
    under = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumns({"turns": turn, "targets": under})


def _text(x: Column) -> Column:
    """Between the first line end and the closing mark."""
    start = F.locate("\n", x)
    return F.substring(x, start + 1, F.length(x) - start - len(CLOSE) - 1)
