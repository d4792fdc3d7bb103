import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from strataline.llm import lm
from strataline.llm.q_lm import op6_lm_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    tokens = [(d, [*WORD.findall((t or "").translate(LOWER)), None]) for d, t in docs]
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    count = Counter(w for d, ws in tokens if not held[d] for w in ws)
    n, v = sum(count.values()), len(count)
    return sorted(((d, held[d], len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 5)) for d, ws in tokens), key=str)


def rows(frame):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in frame.collect()), key=str)


def test_query_and_held_out_gain(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    result = op6_lm_scores(spark, sf).cache()
    assert rows(result) == plain(docs)
    held = [r for r in result.collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    result.unpersist()


def test_model_learns_order_that_unigrams_cannot(spark):
    rng = random.Random(8)
    follows = {w: rng.sample("abcdefghijkl", 2) for w in "abcdefghijkl"}

    def text():
        out = [rng.choice("abcdefghijkl")]
        for _ in range(200):
            out.append(rng.choice(follows[out[-1]]))
        return " ".join(out)

    docs = spark.createDataFrame([(k, text()) for k in range(400)], "doc_id long, text string").repartition(2)
    held = [r for r in lm.scored(docs)[0].collect() if r.held_out]
    per = lambda k: sum(r[k] for r in held) / sum(r.n_tokens for r in held)
    assert per("score") > per("base_score") + 0.3


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    model = lm.Model(np.sort(rng.integers(5, 500, 23))[::-1].astype(float), 300, lm.Settings(width=4))
    for name in model.NAMES:
        setattr(model, name, (getattr(model, name) + rng.normal(0, 0.5, getattr(model, name).shape)).astype(np.float32))
    for one, two in [(0, 3), (24, 24), (23, 21)]:
        p = np.exp(model.log_probability(np.full(24, one), np.full(24, two), np.arange(24)))
        assert abs(p.sum() - 1) < 1e-5
    # one by one, by the definition
    q = model.context[2] * model.weights[0] + model.context[24] * model.weights[1]
    logits = model.classes[:, :4] @ q + model.classes[:, 4]
    inner = model.words[5:10, :4] @ q + model.words[5:10, 4]
    want = logits[2] - np.log(np.exp(logits).sum()) + inner[3] - np.log(np.exp(inner).sum())
    assert model.span == 5 and abs(model.log_probability(np.array([2]), np.array([24]), np.array([8]))[0] - want) < 1e-5


def test_partitions_and_groups_do_not_matter(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(300)], k=rng.randint(0, 80)))) for k in range(300)], "doc_id long, text string")
    small = lm.Settings(block=2000, lane=40, bucket=200)
    got = [sorted((r.doc_id, r.n_known, r.base_score, round(r.score, 6)) for r in lm.scored(docs.repartition(n), s)[0].collect()) for n, s in [(1, small), (8, small), (3, lm.Settings(block=2000, lane=40, bucket=200, group=4, train=2000))]]
    assert got[0] == got[1]
    assert [x[:3] for x in got[0]] == [x[:3] for x in got[2]] and max(abs(a[3] - b[3]) for a, b in zip(got[0], got[2], strict=True)) < 1e-3


def test_contexts_stop_at_texts():
    one, two = lm._positions(np.array([5, 6, 7, 8, 9]), np.array([1, 3, 1]), 99)
    assert one.tolist() == [99, 99, 6, 7, 99] and two.tolist() == [99, 99, 99, 6, 99]


def test_nulls_repeats_and_empty(spark):
    rows_ = [(1, None), (2, ""), (3, "A a b"), (3, "A a b"), (None, "c " * 40_000), (9, "é É  x")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    assert rows(lm.scored(docs)[0]) == plain(rows_)
    assert lm.scored(docs.limit(0))[0].count() == 0
    only_held = next(k for k in range(100) if lm.is_held_out(k, lm.Settings()))
    assert lm.scored(spark.createDataFrame([(only_held, "x y")], "doc_id long, text string"))[0].first().n_known == 0
