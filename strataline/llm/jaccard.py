"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

Documents are sets of 64-bit hashes of their distinct word n-grams. One order holds for all n-grams: rare before
frequent, ties by hash; it is cut into fragments, and a set is cut with it.

1. Classes. Documents with equal sets are one class (a 128-bit digest); a class is handled once.
2. Candidates. In the order, the first n - ceil(t n) + 1 n-grams of a set (its head) meet those of every set that
   reaches similarity t. Heads are posted by n-gram. A posting has a centre, the member with the fewest rare
   n-grams; a member goes with the centre it meets most often and with that of fewest rare n-grams, so a group of copies
   gives stars, not all its pairs. Stars are chosen by an estimate; what they miss, step 4 finds.
3. Verification. For each candidate pair, every fragment counts its own part of the overlap; the
   parts are summed per pair and compared with t exactly.
4. Components of the links found. A posting whose members lie in several components gives its pairs across
   components, if their lengths can reach t; a pair must share many n-grams of its heads, so it is looked for in each
   set's shortest postings only. They are verified likewise. Pairs inside a
   component can't change the result, so no link between different components is lost, and no group is expanded into
   all pairs.

N-grams count as frequent by what tasks repeat locally; the order is exact for any such estimate, which only
decides how short postings are. Hashes of different n-grams of one pair collide with a probability below 1e-12. Classes are told apart
by 128 bits; between steps 64 of them name a class. Classes that share a name, some three pairs of 10^10, are found and named anew, so none
hides another.

Cases: null and empty texts have the empty set and link with nothing; a text with fewer words than n has its
whole sequence as one n-gram; a null doc_id takes part in no link and has no component; rows that repeat a
doc_id are one document, linked if any of its texts is; an empty table gives an empty table; columns of the
input other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, let_go, salted_lookup, settled, utf8, written

_U = np.uint64
_BASE, _UNBASE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@dataclass(frozen=True)
class Join:
    """n: words of an n-gram; percent: similarity asked for; fragments: parts of the order's rare end; frequent: most n-grams known as
    frequent; lane: logarithm of how many sets of a frequent n-gram are posted together; bits: of the digest that name a class."""

    n: int = 5
    percent: int = 80
    fragments: int = 4
    frequent: int = 500_000
    lane: int = 9
    bits: int = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, _U(base))
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingles(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text, all texts at once.

    A word's hash is a polynomial in its bytes, read off prefix sums over the joined bytes.
    """
    joined = b"\n".join(texts).lower() + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    space = blank[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])) != 0)
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * _powers(len(raw), _BASE), out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * _powers(len(raw), _UNBASE)[starts]) if len(starts) else np.zeros(0, np.uint64)
    del sums
    bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
    first = np.searchsorted(starts, bounds)
    factors = _powers(n + 1, 0xD1342543DE82EF95)[1:]
    grams = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        grams += words[k : k + len(grams)] * factors[k]
    grams = _mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            out.append(_mix((words[a:b] * factors[: b - a]).sum(keepdims=True) + _U(b - a)))
        else:
            out.append(grams[:0])
    return out


def digest(grams: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers; of the first, its name, only `bits`."""
    at = np.arange(1, len(grams) + 1, dtype=np.uint64)
    pair = [_mix((_mix(grams + _U(seed)) * (at * _U(2) + _U(1))).sum(keepdims=True) + _U(len(grams)))[0] for seed in (0x243F6A8885A308D3, 0x13198A2E03707344)]
    return int((pair[0] >> _U(64 - bits)).astype(np.int64)), int(pair[1].astype(np.int64))


class Order:
    """The global order: n-grams not known as frequent by hash, then frequent ones by the logarithm of their count.

    It also names sets: by the first part of their digest, or anew where `renamed` (digest to name) has them.
    """

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bits: int = 64, renamed: dict[tuple[int, int], int] | None = None):
        self.hashes, self.weights, self.bits, self.renamed = hashes, weights, bits, renamed or {}

    def name(self, grams: np.ndarray) -> int:
        both = digest(grams, self.bits)
        return self.renamed.get(both, both[0])

    def weight(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(grams), np.uint8)
        at = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
        return np.where(self.hashes[at] == grams, self.weights[at], 0).astype(np.uint8)


def head_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _parts(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some 1 MB of text, at least a row each."""
    let_go()
    sizes = np.array([len(x) for x in utf8(batch.column("text"))])
    group = np.cumsum(sizes) // most if len(sizes) else sizes
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(sizes) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def _sets(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, n, d1, d2 of every row."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                grams = shingles(utf8(part.column("text")), join.n)
                pairs = np.array([digest(g, join.bits) for g in grams], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(g) for g in grams], pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["doc_id", "n", "d1", "d2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long")


def _repeated_locally(docs: DataFrame, join: Join, most: int = 2_000_000) -> DataFrame:
    """(gram, count) for what a task sees in two different sets of its own; candidates for frequent n-grams."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                grams, counts = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                often = counts > 1
                yield pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["gram", "count"])

        for batch in batches:
            for part in _parts(batch):
                for g in shingles(utf8(part.column("text")), join.n):
                    own = digest(g)[0]
                    if own not in seen:
                        seen.add(own)
                        held.append(g)
                        size += len(g)
                if size > most:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("text").mapInArrow(run, "gram long, count long")


def _renamed(classes: DataFrame) -> dict[tuple[int, int], int]:
    """New names of the classes (d1, d2) whose d1 others have too: of N classes N ** 2 / 2 ** 64, which come to the driver."""
    shared = [r.d1 for r in classes.groupBy("d1").agg(F.min("d2").alias("low"), F.max("d2").alias("high")).where("low <> high").select("d1").collect()]
    met = classes.where(F.col("d1").isin(shared)).select("d1", "d2").collect() if shared else []
    return {(r.d1, r.d2): int(_mix(np.array([r.d1 ^ r.d2], np.int64).view(np.uint64)).view(np.int64)[0]) for r in met}


def _with_names(frame: DataFrame, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """frame (d1, d2, ...) with d1 as the name of its class."""
    if not renamed:
        return frame
    fresh = F.create_map(*(x for (a, b), name in renamed.items() for x in (F.struct(F.lit(a).cast("long").alias("d1"), F.lit(b).cast("long").alias("d2")), F.lit(name).cast("long"))))
    return frame.withColumn("d1", F.coalesce(fresh[F.struct("d1", "d2")], "d1"))


def _order(docs: DataFrame, join: Join, renamed: dict[tuple[int, int], int]) -> Order:
    """The order from the most frequent n-grams, join.frequent at most (9 bytes each; broadcast).

    They are those above a power of two of the count, chosen from the number of n-grams by power.
    """
    counted = written(_repeated_locally(docs, join).groupBy("gram").agg(F.floor(F.log2(F.sum("count"))).cast("int").alias("weight")).where("weight >= 2"), "frequent")
    sizes = {r.weight: r["count"] for r in counted.groupBy("weight").count().collect()}
    least, held = max(sizes, default=0) + 1, 0
    while least - 1 >= 2 and held + sizes.get(least - 1, 0) <= join.frequent:
        least -= 1
        held += sizes.get(least, 0)
    top = counted.where(F.col("weight") >= least).toPandas()
    hashes = top["gram"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(hashes)
    return Order(hashes[by], top["weight"].to_numpy(np.int64).astype(np.uint8)[by], join.bits, renamed)


def _heads(docs: DataFrame, join: Join, order: Order) -> DataFrame:
    """Postings (gram, lane, d1, n, rare) of the heads; a task posts a set once. Frequent n-grams are posted in lanes, more of them the
    more frequent they are."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in _parts(batch):
                grams, d1, n, rare, lane = [], [], [], [], []
                for g in shingles(utf8(part.column("text")), join.n):
                    own = shared.value.name(g)
                    if own in seen or not len(g):
                        continue
                    seen.add(own)
                    weight = shared.value.weight(g)
                    head = np.lexsort((g, weight))[: head_length(len(g), join.percent)]
                    grams.append(g[head])
                    spread = np.clip(weight[head].astype(np.int64) - join.lane, 0, 30)  # lanes follow the count, so none grows with it
                    lane.append(np.where(spread > 0, own & ((1 << spread) - 1), -1).astype(np.int32))
                    d1.append(np.full(len(head), own, np.int64))
                    n.append(np.full(len(head), len(g), np.int32))
                    rare.append(np.full(len(head), int((weight == 0).sum()), np.int32))
                if grams:
                    columns = [np.concatenate(x) for x in (grams, lane, d1, n, rare)]
                    columns[0] = columns[0].view(np.int64)
                    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["gram", "lane", "d1", "n", "rare"])
                    for at in range(0, whole.num_rows, 200_000):
                        yield whole.slice(at, 200_000)

    return docs.select("text").mapInArrow(run, "gram long, lane int, d1 long, n int, rare int")


#: Weights from which the frequent part of the order is cut.
BANDS = (1, 6, 10)


def _segments(docs: DataFrame, join: Join, order: Order) -> DataFrame:
    """(doc_id, d1, fragment, segment): each set cut along the order.

    The part that isn't frequent is cut into ranges of the hash, the frequent part into bands of frequency.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = _U(((1 << 64) - 1) // join.fragments)
        for batch in batches:
            for part in _parts(batch):
                ids, d1, fragment, segment = [], [], [], []
                for doc, g in zip(part.column("doc_id").to_pylist(), shingles(utf8(part.column("text")), join.n), strict=True):
                    own = shared.value.name(g)
                    weight = shared.value.weight(g)
                    band = np.searchsorted(BANDS, weight, side="right")
                    own_fragment = np.where(band == 0, np.minimum(g // wide, _U(join.fragments - 1)).astype(np.int64), join.fragments - 1 + band)
                    for k in np.unique(own_fragment).tolist():
                        ids.append(doc)
                        d1.append(own)
                        fragment.append(k)
                        segment.append(g[own_fragment == k].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(d1, pa.int64()), pa.array(fragment, pa.int32()), pa.array(segment, pa.binary())], names=["doc_id", "d1", "fragment", "segment"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, d1 long, fragment int, segment binary")


def _partial_overlaps(pairs: DataFrame) -> DataFrame:
    """Overlap of two segments by row."""
    kept = [f for f in pairs.schema.fields if f.name not in ("left", "right")]
    names = [f.name for f in kept]

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                out.append(int((y[at] == x).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.int64())], names=[*names, "part"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return pairs.mapInArrow(run, f"{ddl}, part long")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, join: Join, order: Order) -> DataFrame:
    """Links (x, y) among pairs (a, b) of d1: parts of the overlap by fragment, summed and compared."""
    named = written(_named(pairs, classes), "pairs")
    active = named.select("x").union(named.select("y")).distinct()
    segments = written(_segments(docs.join(active.withColumnRenamed("x", "doc_id"), "doc_id", "left_semi"), join, order), "segments")
    left = segments.select(F.col("doc_id").alias("x"), F.col("d1").alias("a"), "fragment", F.col("segment").alias("left"))
    right = segments.select(F.col("doc_id").alias("y"), F.col("d1").alias("b"), "fragment", F.col("segment").alias("right"))
    parts = _partial_overlaps(named.join(left, ["x", "a"]).join(right, ["y", "b", "fragment"]).select("x", "y", "a", "b", "nx", "ny", "fragment", "left", "right"))
    # a row that occurs twice gives the same part twice, which counts once
    once = F.collect_set(F.struct("fragment", "part"))
    summed = parts.groupBy("x", "a", "y", "b", "nx", "ny").agg(F.aggregate(once, F.lit(0).cast("long"), lambda acc, p: acc + p["part"]).alias("common"))
    links = written(summed.where(100 * F.col("common") >= join.percent * (F.col("nx") + F.col("ny") - F.col("common"))).select("x", "y").distinct(), "links")
    discard(named, segments)
    return links


def _named(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of d1 as pairs of class representatives with sizes; pairs whose sizes can't reach the similarity were left out before."""
    x = classes.select(F.col("d1").alias("a"), F.col("rep").alias("x"), F.col("n").alias("nx"))
    y = classes.select(F.col("d1").alias("b"), F.col("rep").alias("y"), F.col("n").alias("ny"))
    return pairs.join(x, "a").join(y, "b").where("x is not null and y is not null")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes with links; labels spread and jump until none changes."""
    both = links.union(links.select("y", "x")).where("x <> y").toDF("node", "other").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    held = labels
    while True:
        near = salted_lookup(both, labels.withColumnRenamed("node", "other"), "other", 4, F.col("node")).groupBy("node").agg(F.min("component").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("component", "near").alias("label"), "component")
        above = labels.select(F.col("node").alias("label"), F.col("component").alias("above"))
        then = written(salted_lookup(spread, above, "label", 4, F.col("node")).select("node", F.least("label", F.coalesce("above", "label")).alias("component"), F.col("component").alias("before")), "labels")
        done = then.where("component <> before").limit(1).count() == 0
        discard(held)
        labels, held = then.drop("before"), then
        if done:
            discard(both)
            return labels


def _reach(join: Join):
    """An estimate of the largest partner of a set of n n-grams, of which `seen` head n-grams stand in other heads.

    It is no bound: an n-gram that is in no other head may stand beyond a partner's head. It only chooses stars.
    """
    head = F.col("n") - F.ceil(join.percent * F.col("n") / 100 - 1e-9) + 1
    common = F.col("n") - (head - F.col("seen"))
    return F.floor((100 + join.percent) * common / join.percent - F.col("n") + 1e-9)


def _lengths_fit(join: Join):
    return 100 * F.least("n", "m") >= join.percent * F.greatest("n", "m")


def _needed(join: Join):
    """How many head n-grams a pair must share to reach the similarity.

    Up to the end of the head that ends first in the order, what is common stands in both heads; beyond it that set has
    no more than its size less its head.
    """
    least = F.ceil(join.percent * (F.col("n") + F.col("m")) / (100 + join.percent) - 1e-9)
    return F.greatest(least - (F.ceil(join.percent * F.greatest("n", "m") / 100 - 1e-9) - 1), F.lit(1))


def _postings(docs: DataFrame, join: Join, order: Order) -> DataFrame:
    """(gram, d1, n, rare): heads' n-grams that several sets' heads have."""
    same = "partition by gram, lane order by rare, d1 rows between unbounded preceding and unbounded following"
    first = [F.expr(f"first({c}) over ({same})").alias(f"first_{c}") for c in ("d1", "n", "rare")]
    met = _heads(docs, join, order).select("gram", "lane", "d1", "n", "rare", *first).where("d1 <> first_d1 or lane >= 0")
    met = written(met.select("gram", "d1", "n", "rare", "first_d1", "first_n", "first_rare").distinct(), "met")
    out = written(met.select("gram", "d1", "n", "rare").union(met.select("gram", "first_d1", "first_n", "first_rare")).distinct(), "postings")
    discard(met)
    return out


def joined(docs: DataFrame, join: Join = Join()) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B008
    """docs (doc_id, text) as: rows (doc_id, n_shingles, d1, d2) for every document; classes with their
    representative (smallest doc_id) and component; links between representatives that span all components."""
    rows = written(_sets(docs, join), "sets")
    classes = written(rows.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "classes")
    renamed = _renamed(classes)
    rows, classes = _with_names(rows, renamed), _with_names(classes, renamed)
    order = _order(docs, join, renamed)
    posted = _postings(docs, join, order)
    # a document goes with the centre that it meets most often, and with that of fewest rare n-grams, a group's origin
    sets = posted.groupBy("d1", "n").agg(F.count("*").alias("seen")).select("d1", _reach(join).alias("reach"), "n")
    likely = posted.join(sets.where(100 * F.col("reach") >= join.percent * F.col("n")).drop("n"), "d1")
    centre = F.min_by(F.struct(F.col("d1").alias("centre"), F.col("n").alias("m"), F.col("reach").alias("far_reach"), F.col("rare").alias("rarest")), F.struct("rare", "d1"))
    likely = written(likely, "likely")
    centres = likely.groupBy("gram").agg(F.count("*").alias("k"), centre.alias("c")).where("k > 1").select("gram", "c.*")
    star = salted_lookup(likely, centres, "gram", 4, F.col("d1")).where("d1 <> centre").where(_lengths_fit(join) & (F.col("m") <= F.col("reach")) & (F.col("n") <= F.col("far_reach")))
    met = star.groupBy("d1", "centre", "rarest").agg(F.count("*").alias("met"))
    nearest = met.groupBy("d1").agg(F.max_by("centre", F.struct("met", "centre")).alias("one"), F.min_by("centre", F.struct(F.col("rarest"), -F.col("met"), F.col("centre"))).alias("two"))
    pairs = nearest.select("d1", F.explode(F.array_distinct(F.array("one", "two"))).alias("centre"))
    ordered = written(pairs.select(F.least("d1", "centre").alias("a"), F.greatest("d1", "centre").alias("b")).distinct(), "stars")
    discard(likely)
    links = _verified(ordered, docs, classes, join, order)
    found = components(links)
    # postings across components, and their pairs
    nodes = classes.where("rep is not null").join(found, classes["rep"] == found["node"], "left").select("d1", F.coalesce("component", "rep").alias("component"))
    placed = written(posted.drop("rare").join(nodes, "d1"), "placed")
    discard(posted)
    shares = placed.groupBy("gram", "component").agg(F.count("*").alias("own"))
    mixed = shares.groupBy("gram").agg(F.count("*").alias("parts"), F.sum("own").alias("k"), F.max_by("component", F.struct("own", "component")).alias("main")).where("parts > 1").select("gram", "k", "main")
    # of a set's n-grams there, short postings first, all but the last `needed` - 1 find every partner that shares so many
    own = "partition by d1"
    ranked = written(placed.join(mixed, "gram").withColumns({"at": F.expr(f"row_number() over ({own} order by k, gram)"), "of": F.expr(f"count(*) over ({own})")}).drop("k"), "ranked")
    discard(placed)
    other = ranked.select("gram", F.col("d1").alias("e"), F.col("n").alias("m"), F.col("component").alias("far"), F.col("at").alias("far_at"), F.col("of").alias("far_of"))
    short = (F.col("at") <= F.col("of") - _needed(join) + 1) & (F.col("far_at") <= F.col("far_of") - _needed(join) + 1)
    # one side stands outside the component that has most of a posting: the pairs inside that one are never listed
    rest = ranked.where("component <> main").join(other, "gram").where((F.col("component") != F.col("far")) & ((F.col("far") == F.col("main")) | (F.col("d1") < F.col("e")))).where(_lengths_fit(join) & short)
    rest = rest.select(F.least("d1", "e").alias("a"), F.greatest("d1", "e").alias("b")).distinct()
    rest = written(rest.join(ordered, ["a", "b"], "left_anti"), "across")
    discard(ranked)
    if rest.limit(1).count():
        links = written(links.union(_verified(rest, docs, classes, join, order)).distinct(), "links")
        found = components(links)
    owned = classes.join(found, classes["rep"] == found["node"], "left").select("d1", "d2", "rep", "n", F.coalesce("component", "rep").alias("component_id"))
    return rows, owned, links


def membership(docs: DataFrame, join: Join = Join()) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    rows, owned, _ = joined(docs, join)
    facts = owned.select(F.struct("d1", "d2").alias("class"), "component_id").where("component_id is not null")
    classed = rows.withColumn("class", F.struct("d1", "d2"))
    out = salted_lookup(classed, facts, "class", 8, F.xxhash64("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
