import hashlib
from collections import Counter

import pytest
import tiktoken

import corpus_pipeline
from strataline.llm import bpe, q_bpe, q_mixing
from tests.llm import test_jaccard, test_mixing, test_quality, test_secrets

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The result of every stage, documents first."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.common.written(stage(spark, out[-1], SF), "test-stage"))
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}


def test_columns(stages):
    for frame in stages[1:-1]:
        assert frame.columns == stages[0].columns and frame.schema == stages[0].schema


def test_quality_drops_what_fails_and_keeps_clean(spark, stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert all(after[d] == before[d] for d in after)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for d, t in after.items():
        assert test_quality.plain(t)[0] >= 50
    clean = [d for d, q in labels.items() if q == 1 and test_quality.plain(before[d])[0] >= 50 and test_quality.quality.measure(before[d].encode())[4] * 2 <= test_quality.plain(before[d])[0]]
    assert sum(d in after for d in clean) >= 0.99 * len(clean)
    junk = [d for d, q in labels.items() if q == 0]
    assert sum(d in after for d in junk) <= 0.25 * len(junk)


def test_one_document_of_each_component(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert set(after) == {component for _, component in test_jaccard.brute(before).values()}
    assert stages[2].count() == len(after)


def test_no_secret_is_left_and_clean_texts_stay(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert set(before) == set(after)
    for d, t in after.items():
        assert test_secrets.plain(t) == []
        assert test_secrets.plain(before[d]) or t == before[d] or "[secret]" in t
    assert sum(before[d] != after[d] and not test_secrets.plain(before[d]) for d in after) <= 0.01 * len(after)
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_mix_meets_targets(stages):
    rows = stages[3].collect()
    n = Counter(r.doc_id for r in stages[4].select("doc_id").collect())
    size = {r.doc_id: test_quality.plain(r.text)[0] for r in rows}
    assert max(n.values()) <= 3
    order = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size[r.doc_id] for r in rows if r.source == s) for s in order]
    want = test_mixing.plain_targets(sizes, [q_mixing.MIX.weights[k % 3] for k in range(len(order))], 3.0)
    for s, target in zip(order, want, strict=True):
        own = [r.doc_id for r in rows if r.source == s]
        assert abs(sum(size[d] * n[d] for d in own) - target) <= max(0.02 * target, min(size[d] for d in own))


def test_tokens_are_those_of_the_library(stages):
    theirs = tiktoken.Encoding("own", pat_str=q_bpe.public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(q_bpe.rank_bytes()), special_tokens={})
    before = texts(stages[4])
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows:
        ids = theirs.encode_ordinary(before[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()


NAMES = ["doc_id", "text", "lang", "source", "n_chars", "quality", "length", "_votes", "n_words", "size", "target", "key", "row", "name", "shard", "copy", "draws", "base", "open", "spans", "n", "d1", "component_id", "token_ids", "decoded"]
def good(name):
    return " ".join(f"{name}{k} {'the of and in'.split()[k % 4]}" for k in range(90)) + "."


LONG = " ".join(f"{'the of and in'.split()[k % 4]} x{k * 7919 % 30011}" for k in range(60_000)) + "."
SECRET = good("bird") + " token = abcdef123456 and so on."


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeats, an empty and a very long text, and columns with names of ours."""
    rows = [(None, None, None, None), (None, "a b", "en", "s"), (1, SECRET, "en", None), (2, good("dog"), "en", "s"), (2, good("dog"), "en", "s"), (3, "", None, "s"), (4, LONG, "en", "t"), (None, good("cow"), None, None)]
    types = ", ".join(f"{n} {'string' if n in ('text', 'lang', 'source') else 'long'}" for n in NAMES)
    return spark.createDataFrame([(*r, *(100 + k for k in range(len(NAMES) - 4))) for r in rows], types)


def values(frame):
    return sorted(((r.doc_id or 0, r.text or "") for r in frame.collect()), key=str)


def unchanged(frame):
    assert frame.columns == NAMES
    for r in frame.collect():
        assert list(r)[5:] == [100 + k for k in range(1, len(NAMES) - 4)]


def test_stages_take_odd_rows(spark, odd):
    kept = corpus_pipeline.common.written(corpus_pipeline.quality_rules(spark, odd, SF), "test")
    unchanged(kept)
    assert values(kept) == sorted([(0, good("cow")), (1, SECRET), *[(2, good("dog"))] * 2, (4, LONG)], key=str)
    once = corpus_pipeline.common.written(corpus_pipeline.near_duplicates(spark, odd, SF), "test")
    unchanged(once)
    assert values(once) == sorted([(0, ""), (0, "a b"), (0, good("cow")), (1, SECRET), (2, good("dog")), (3, ""), (4, LONG)], key=str)
    clean = corpus_pipeline.common.written(corpus_pipeline.secret_scan(spark, odd, SF), "test")
    unchanged(clean)
    assert values(clean) == sorted([(r[0], r[1].replace("token = abcdef123456", "[secret]")) for r in values(odd)], key=str)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in clean.collect())
    mixed = corpus_pipeline.common.written(corpus_pipeline.mix(spark, odd, SF), "test")
    unchanged(mixed)
    assert set(values(mixed)) <= set(values(odd)) and sum(r.doc_id == 2 for r in mixed.collect()) % 2 == 0
    theirs = tiktoken.Encoding("own", pat_str=q_bpe.public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(q_bpe.rank_bytes()), special_tokens={})
    got = corpus_pipeline.tokens(spark, odd, SF).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted((d, theirs.encode_ordinary(t)) for d, t in values(odd))


def test_stages_take_nothing(spark, odd):
    docs = odd.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.collect() == [] and (k == 4 or out.columns == NAMES)


def test_secrets_are_learnt_from_every_finding(spark, monkeypatch):
    def none(*_):
        raise AssertionError("a sample")

    monkeypatch.setattr(corpus_pipeline.secrets, "sample", none)
    docs = spark.createDataFrame([(1, "token = abcdef1 and on", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.secret_scan(spark, docs, SF).collect()) == [(1, "[secret] and on"), (2, None)]


def full_collections(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_stages_begin_with_a_collection(spark):
    """The heap that a stage has filled is given back before the next one's Python workers need the memory."""
    docs = spark.createDataFrame([(1, "a few words", "a")], "doc_id long, text string, source string")
    for _, stage in corpus_pipeline.STAGES:
        before = full_collections(spark)
        stage(spark, docs, SF)
        assert full_collections(spark) > before
