"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source fall into blocks by a hash: `Mix.blocks` of them, and more where a block would exceed
`block_words`. A source whose target is r times its size is drawn in floor(r) full passes over its blocks, each in its own
permuted order, and a last pass that takes blocks until the rest of the target is met. This gives each source an exact quota of
block draws. The quotas are split among output shards by a tree: at each node the draws of its left half are
multivariate-hypergeometric given the node's quotas, so the shards' shares are those of a shuffle of all draws. Nodes are
split in parallel, `fan` leaves by one task. A shard owns disjoint stretches of each source's permuted draws;
rows are dealt to shards and shuffled within each by a keyed hash. The number of shards follows the words of the mix.

Everything is a table: of one row a source, or a block, or a draw (a block is some million words). Nothing of them is
collected; they are broadcast where a count shows them small, else looked up by a shuffle in which no source stands in one task.
A source's own blocks meet in one task, 20 bytes for each. Draws are kept under 2 ** 29 by larger blocks, which is what
numpy draws exactly. Every random choice is keyed by `seed`, so reruns agree, however rows are partitioned.

Cases: null text has size 0; null is a source, sorted last; documents of size 0 are drawn in full passes like others and
take 0 words; texts of any length are counted whole and never cut; rows that repeat doc_id and text fall into the
same block and are drawn together; an empty table gives an empty table; columns of the input pass unchanged whatever their names
(`mixed` alone replaces columns named shard and copy).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, salted_lookup, written


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in sorted order; cap: most times that a source is taken; blocks: of a source, at least;
    block_words: of a block, beyond that; shard_words: of an output shard; fan: leaves that a task splits a node into."""

    weights: tuple[float, ...] = (1, 2, 3)
    cap: float = 3.0
    blocks: int = 1024
    block_words: int = 1_000_000
    shard_words: int = 2_000_000
    fan: int = 64
    seed: int = 17


@dataclass(frozen=True)
class Plan:
    """sources: (name, sid, source_size, target, blocks); draws: (sid, block, draws: array of turn, shard); shards: their number."""

    sources: DataFrame
    draws: DataFrame
    shards: int


#: Draws stay below this number, which numpy draws exactly from.
MOST_DRAWS = 1 << 29
#: Tables of so many rows at most (some 100 bytes each) are broadcast.
SMALL = 50_000


def _rng(seed: int, *what: object) -> np.random.Generator:
    digest = hashlib.sha256("\x1f".join(map(repr, what)).encode()).digest()
    return np.random.default_rng([seed, *np.frombuffer(digest, np.uint32).tolist()])


def split_quotas(quotas: np.ndarray, low: int, high: int, seed: int, fan: int = 1 << 30) -> list[tuple[int, int, np.ndarray]]:
    """A node (shards low to high, quotas by source) as up to `fan` nodes below it: (low, high, quotas).

    Halves have equal numbers of draws by their shards, rounded down at each node.
    """
    out, todo = [], [(low, high, quotas.astype(np.int64), fan)]
    while todo:
        a, b, left, most = todo.pop()
        if b - a == 1 or most < 2:
            out.append((a, b, left))
            continue
        middle = (a + b) // 2
        drawn = _rng(seed, "node", a, b).multivariate_hypergeometric(left, int(left.sum()) * (middle - a) // (b - a), method="marginals")
        todo += [(middle, b, left - drawn, most // 2), (a, middle, drawn, most // 2)]
    return out


def _name() -> Column:
    """A source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))


def sized(docs: DataFrame, mix: Mix, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row: struct of docs' columns or of those in keep; name of the source, key, size: words of the whole text)."""
    key = F.xxhash64(F.lit(mix.seed), *(F.col(c) for c in ("doc_id", text) if c in docs.columns))
    row = F.struct(*(F.col(f"`{c}`") for c in (keep if keep is not None else docs.columns)))
    return docs.select(row.alias("row"), _name().alias("name"), key.alias("key"), n_words(text).alias("size"))


def _looked_up(rows: DataFrame, facts: DataFrame, on: str, salt: Column) -> DataFrame:
    return rows.join(F.broadcast(facts), on, "left") if facts.count() <= SMALL else salted_lookup(rows, facts, on, 16, salt)


def targeted(rows: DataFrame, mix: Mix) -> DataFrame:
    """(name, sid, source_size, target, blocks, passes, rest): one row a source; sid is its place in the sorted order.

    Targets: shares of all words by weight; where one exceeds cap times its source's size it stops there, and the rest is shared
    again. As shares only grow, the sources above are those with less words for their weight than the current share asks for.
    """
    sums = rows.groupBy("name").agg(F.sum("size").alias("source_size"))
    ordered = sums.orderBy(F.col("name") == "-", "name").withColumn("id", F.monotonically_increasing_id())
    ordered = written(ordered, "sources")
    part = F.shiftright("id", 33)
    starts, at = {}, 0
    for r in sorted(ordered.groupBy(part.alias("part")).count().collect()):  # one row a partition
        starts[r.part], at = at, at + r["count"]
    offsets = rows.sparkSession.createDataFrame(sorted(starts.items()), "part long, start long")
    placed = ordered.withColumn("part", part).join(F.broadcast(offsets), "part").select("name", "source_size", (F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("sid"))
    weight = F.get(F.array(*(F.lit(float(w)) for w in mix.weights)), F.pmod("sid", F.lit(len(mix.weights))).cast("int"))
    placed = placed.withColumn("weight", weight)
    most = F.lit(float(mix.cap)) * F.col("source_size")
    total, share, above, before = 0, 0.0, F.lit(False), -1
    while True:
        got = placed.agg(F.sum("source_size").alias("total"), F.sum(F.when(above, F.col("source_size"))).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("free"), F.count_if(above).alias("n")).first()
        if not got.free or got.n == before:
            break
        total, before = got.total, got.n
        share = (total - mix.cap * (got.held or 0)) / got.free
        above = F.lit(share) * F.col("weight") > most
    least = max(1, min(mix.blocks, MOST_DRAWS // int(4 * mix.cap) // max(at, 1)))
    block = max(mix.block_words, int(4 * mix.cap * total) // MOST_DRAWS)
    target = F.when(above, most).otherwise(F.lit(share) * F.col("weight"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    facts = placed.withColumn("target", target).withColumn("passes", passes)
    grown = F.lit(2).cast("long") ** F.ceil(F.log2(F.greatest(F.col("source_size") / F.lit(block), F.lit(1.0))))
    return facts.select("name", "sid", "source_size", "target", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"), F.greatest(F.lit(least), grown.cast("long")).alias("blocks"))


def _last_pass(group: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Of one source's blocks with words, those that its last pass takes, in permuted order: each that still fits, and one more
    if that comes nearer to the target."""
    group = group.sort_values("block", ignore_index=True)
    sid, need = int(group["sid"].iloc[0]), float(group["rest"].iloc[0])
    words = group["words"].to_numpy()
    order = _rng(seed, "last", sid).permutation(len(words))
    fits = int(np.searchsorted(np.cumsum(words[order]), need, side="right"))
    taken = order[:fits].tolist()
    need -= float(words[order[:fits]].sum())
    for k in order[fits:].tolist():
        if words[k] <= need:
            taken.append(k)
            need -= words[k]
    left = np.setdiff1d(np.arange(len(words)), taken)
    if len(left):
        smallest = left[words[left].argmin()]
        if words[smallest] - need < need:
            taken.append(int(smallest))
    return pd.DataFrame({"sid": sid, "block": group["block"].to_numpy()[taken], "words": words[taken], "turn": int(group["passes"].iloc[0])})


def _split(group: pd.DataFrame, seed: int, fan: int) -> pd.DataFrame:
    group = group.sort_values("sid", ignore_index=True)
    low, high, sid = int(group["low"].iloc[0]), int(group["high"].iloc[0]), group["sid"].to_numpy()
    out = []
    for a, b, quotas in split_quotas(group["quota"].to_numpy(), low, high, seed, fan):
        some = np.flatnonzero(quotas)
        out.append(pd.DataFrame({"low": a, "high": b, "sid": sid[some], "quota": quotas[some]}))
    return pd.concat(out)


def shares(quotas: DataFrame, shards: int, mix: Mix) -> DataFrame:
    """(shard, sid, quota) of all shards from (sid, quota): the tree, `fan` leaves of a node at a time."""
    nodes, width = quotas.select(F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), "sid", "quota"), shards
    while width > 1:
        nodes = written(nodes.groupBy("low", "high").applyInPandas(partial(_split, seed=mix.seed, fan=mix.fan), "low long, high long, sid long, quota long"), "nodes")
        width = nodes.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 1
    return nodes.select(F.col("low").alias("shard"), "sid", "quota")


def with_block(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (of `sized`) with sid, source_size, target and block."""
    met = _looked_up(rows, sources.select("name", "sid", "source_size", "target", "blocks"), "name", F.col("key"))
    return met.withColumn("block", F.pmod("key", "blocks")).drop("blocks")


def plan(rows: DataFrame, mix: Mix) -> Plan:
    """What each shard draws. rows: (name, key, size) of all documents, a table that is read twice."""
    sources = written(targeted(rows, mix), "targets")
    by_block = written(with_block(rows, sources).groupBy("sid", "block").agg(F.sum("size").alias("words")), "by-block")
    met = _looked_up(by_block, sources.select("sid", "passes", "rest"), "sid", F.col("block"))
    full = met.where("passes > 0").select("sid", "block", "words", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).alias("turn"))
    last = met.where("rest > 0 and words > 0").groupBy("sid").applyInPandas(partial(_last_pass, seed=mix.seed), "sid long, block long, words long, turn long")
    draws = written(full.unionByName(last), "draws")
    # a source's draws in permuted order, and the shard whose stretch of them each falls into
    shards = max(1, -(-(draws.agg(F.sum("words")).first()[0] or 0) // mix.shard_words))
    leaves = shares(draws.groupBy("sid").agg(F.count("*").alias("quota")), shards, mix)
    start = F.sum("quota").over(Window.partitionBy("sid").orderBy("shard")) - F.col("quota")
    starts = leaves.select("sid", start.alias("at"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("turn"), "shard")
    at = F.row_number().over(Window.partitionBy("sid").orderBy("turn", F.xxhash64(F.lit(mix.seed), "sid", "turn", "block"), "block")).cast("long") - 1
    dealt = draws.select("sid", at.alias("at"), "block", "turn", F.lit(None).cast("long").alias("shard")).unionByName(starts)
    shard = F.last("shard", ignorenulls=True).over(Window.partitionBy("sid").orderBy("at", F.col("shard").isNull()))
    owned = dealt.select("sid", "block", "turn", shard.alias("shard")).where("block is not null")
    return Plan(sources, written(owned.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "shard"))).alias("draws")), "owned"), int(shards))


def drawn(rows: DataFrame, made: Plan) -> DataFrame:
    """rows (of `sized`) with source_size, target and draws: array of (turn, shard), one element a copy."""
    blocked = with_block(rows, made.sources)
    draws = F.broadcast(made.draws) if made.draws.count() <= SMALL else made.draws
    none = F.array().cast(made.draws.schema["draws"].dataType)
    return blocked.join(draws, ["sid", "block"], "left").withColumn("draws", F.coalesce("draws", none))


def dealt(rows: DataFrame, made: Plan, mix: Mix) -> DataFrame:
    """(row, name, key, size, shard, copy): a row a copy, dealt to its shard and shuffled within it."""
    copies = drawn(rows, made).select("row", "name", "key", "size", F.explode("draws").alias("draw"))
    out = copies.select("row", "name", "key", "size", F.col("draw.shard").alias("shard"), F.col("draw.turn").alias("copy"))
    parts = min(made.shards, 20_000)  # shards beyond that share a task, one after another
    return out.repartition(parts, "shard").sortWithinPartitions("shard", F.xxhash64(F.lit(mix.seed), "key", "copy", "shard"))


def mixed_rows(docs: DataFrame, mix: Mix = Mix(), text: str = "text") -> DataFrame:  # noqa: B008
    """The mixed corpus as (row: struct of docs' columns, shard, copy), laid out by shard and shuffled within it."""
    made = plan(written(sized(docs, mix, text, []).drop("row"), "sizes"), mix)
    return dealt(sized(docs, mix, text), made, mix).select("row", "shard", "copy")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """The mixed corpus: columns of docs plus shard and copy."""
    return mixed_rows(docs, mix).select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in ("shard", "copy")), "shard", "copy")
