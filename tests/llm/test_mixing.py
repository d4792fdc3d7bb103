import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from strataline.llm import mixing
from strataline.llm.q_mixing import MIX, op8_source_mixing


def plain_targets(sizes, weights, cap):
    total, out, free = sum(sizes), {}, set(range(len(sizes)))
    while free:
        left, w = total - sum(out.values()), sum(weights[k] for k in free)
        over = {k for k in free if left * weights[k] / w > cap * sizes[k] * (1 + 1e-12)}
        if not over:
            return [out.get(k, left * weights[k] / w) for k in range(len(sizes))]
        out |= {k: cap * sizes[k] for k in over}
        free -= over
    return [out[k] for k in range(len(sizes))]


def test_targets(spark):
    rng = np.random.default_rng(2)
    for trial in range(6):
        sizes = [int(x) for x in rng.integers(0, 10 ** (trial % 4 + 1), 9)]
        names = [f"s{k}" for k in range(8)] + [None]
        docs = spark.createDataFrame([(k, "w " * n, s) for k, (n, s) in enumerate(zip(sizes, names, strict=True))], "doc_id long, text string, source string")
        got = mixing.targeted(mixing.sized(docs, MIX), MIX).orderBy("sid").collect()
        want = plain_targets(sizes, [(1, 2, 3)[k % 3] for k in range(9)], 3.0)
        assert [r.name for r in got] == [*(f"=s{k}" for k in range(8)), "-"] and [r.source_size for r in got] == sizes
        assert np.allclose([r.target for r in got], want, rtol=1e-9, atol=1e-6)


def tree(quotas, shards, seed, fan=1 << 30):
    """shards x sources, splitting by `fan` leaves at a time."""
    todo, out = [(0, shards, quotas)], {}
    while todo:
        low, high, left = todo.pop()
        for a, b, q in mixing.split_quotas(left, low, high, seed, fan):
            if b - a == 1:
                out[a] = q
            else:
                todo.append((a, b, q))
    return np.array([out[k] for k in range(shards)])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=8), st.integers(1, 40))
def test_splitting_tree_is_exact(quotas, shards):
    parts = tree(np.array(quotas), shards, 3)
    assert (parts.sum(axis=0) == quotas).all() and (parts >= 0).all()
    sizes = parts.sum(axis=1)
    assert sizes.max() - sizes.min() <= np.ceil(np.log2(shards)) + 1
    assert (tree(np.array(quotas), shards, 3, 4) == parts).all()


def test_splitting_tree_has_the_moments_of_a_shuffle():
    quotas = np.array([30, 70, 100])
    drawn = np.array([tree(quotas, 4, seed)[1] for seed in range(800)])
    assert np.abs(drawn.mean(axis=0) - quotas / 4).max() < 0.5
    want = 50 * (quotas / 200) * (1 - quotas / 200) * 150 / 199
    assert np.abs(drawn.var(axis=0) / want - 1).max() < 0.25


def check(rows, docs):
    by = defaultdict(list)
    for r in rows:
        by[docs[r.doc_id][0]].append(r)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    want = plain_targets(sizes, [(1, 2, 3)[k % 3] for k in range(len(order))], 3.0)
    for s, size, target in zip(order, sizes, want, strict=True):
        taken = sum(r.taken for r in by[s])
        assert all(r.source_size == size and abs(r.target - target) < 1e-6 * max(1, target) for r in by[s])
        assert abs(taken - target) <= max(0.02 * target, min((r["size"] for r in by[s] if r["size"]), default=0)), (s, taken, target)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id][1] or ""))
        assert r.taken == r["size"] * len(r.shards) and len(r.shards) <= 3


def test_query_meets_targets_and_reruns_agree(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_source_mixing(spark, sf).collect()
    assert len(rows) == len(docs)
    check(rows, docs)
    again = op8_source_mixing(spark, sf).repartition(3).collect()
    assert sorted((r.doc_id, r.taken, tuple(r.shards)) for r in rows) == sorted((r.doc_id, r.taken, tuple(r.shards)) for r in again)


def corpus(spark, n=400):
    rows = [(k, None if k % 7 == 0 else "w " * (k % 40), None if k % 5 == 0 else f"s{k % 3}", k, k + 1, k + 2) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, size int, target int")


def test_shards_are_disjoint_stretches_and_columns_stay(spark):
    docs = corpus(spark)
    mix = mixing.Mix(blocks=64, shard_words=900, fan=4)
    rows = mixing.sized(docs, mix)
    made = mixing.plan(rows.drop("row"), mix)
    out = mixing.dealt(rows, made, mix)
    copies = out.collect()
    taken = sum(r["size"] for r in copies)
    assert made.shards == -(-taken // 900) and {r.shard for r in copies} <= set(range(made.shards))
    assert sorted((r.row.doc_id, r["copy"], r.shard) for r in copies) == sorted((r.row.doc_id, d.turn, d.shard) for r in mixing.drawn(rows, made).collect() for d in r.draws)
    # the draws of a shard are what the tree says, source by source
    owned = made.draws.selectExpr("sid", "explode(draws) as d").collect()
    by = defaultdict(int)
    for r in owned:
        by[r.d.shard, r.sid] += 1
    quotas = [sum(n for (_, s), n in by.items() if s == k) for k in range(max(s for _, s in by) + 1)]
    want = tree(np.array(quotas), made.shards, mix.seed)
    assert all(by[k, s] == want[k, s] for k in range(made.shards) for s in range(len(quotas)))
    # rows stand shuffled within their shard, and as the same set again from other partitions
    kept = mixing.mixed_rows(docs.repartition(5), mix).select("row.*", F.col("shard").alias("to")).collect()
    assert sorted((r.doc_id, r.shard, r["size"], r.target, r.to) for r in kept) == sorted((r.row.doc_id, r.row.shard, r.row["size"], r.row.target, r.shard) for r in copies)
    assert mixing.mixed(docs, mix).columns == ["doc_id", "text", "source", "size", "target", "shard", "copy"]
    ids = [r.doc_id for r in kept if r.to == 0]
    assert ids != sorted(ids)


def test_lookups_beyond_a_broadcast_give_the_same(spark, monkeypatch):
    docs, mix = corpus(spark), mixing.Mix(blocks=64, shard_words=900)
    rows = lambda: sorted((r.row.doc_id, r["copy"], r.shard) for r in mixing.mixed_rows(docs, mix).collect())
    small = rows()
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert rows() == small


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None, None), (None, None, None), (1, "", "a"), (2, "x y z", "a"), (2, "x y z", "a"), (3, "w " * 30_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed(docs).collect()
    assert all((r.doc_id, r.text, r.source) in rows for r in out)
    assert sum(r.doc_id == 2 for r in out) % 2 == 0
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert MIX.cap == 3.0
