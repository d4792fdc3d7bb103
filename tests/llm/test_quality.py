import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataline.llm import quality
from strataline.llm.q_quality import op3_quality_rules, verdicts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in (i, i + 1, i + 2)} if len(windows) < 3000 else None
    lines, seen, duplicates = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, None if covered is None else len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "the", " ", "\n", "\t", "|", "#", " ", "日"]), max_size=60).map("".join))
def test_measures(text):
    assert quality.measure(text.encode())[:5] == plain(text)


def test_em_recovers_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.85
    wrong_good, caught = [0.01, 0.02, 0.01, 0.03, 0.01], [0.6, 0.5, 0.7, 0.6, 0.8]
    votes = np.stack([np.where(rng.random(truth.size) < 0.1, 0, np.where(rng.random(truth.size) < np.where(truth, g, b), -1, 1)) for g, b in zip(wrong_good, caught, strict=True)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit(patterns, counts.astype(float), tuple("abcde"))
    assert np.abs(model.bad[:, 0] - caught).max() < 0.08 and np.abs(model.good[:, 0] - wrong_good).max() < 0.02
    assert ((model.posterior(votes) >= 0.5) == truth).mean() > 0.95


def test_query_against_plain_measures_and_labels(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op3_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    clean = dropped = junk = caught = 0
    for r in rows:
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == want[:4]
        if want[4] is not None:
            assert r.n_repeat_words == want[4]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
        if not r.base_failed and r.doc_id in labels:
            clean += labels[r.doc_id] == 1
            dropped += labels[r.doc_id] == 1 and not r.kept
            junk += labels[r.doc_id] == 0
            caught += labels[r.doc_id] == 0 and not r.kept
    assert dropped <= 0.01 * clean and caught >= 0.8 * junk


def test_nulls_repeats_and_empty(spark):
    good = "the cat is on the mat and it was here. " * 2 + " ".join(f"word{i} of" for i in range(60)) + "."
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, good, 5), (3, good, 5), (None, "x " * 90_000, 5)], "doc_id long, text string, n_words long")
    got = verdicts(docs.drop("n_words"), ["doc_id"]).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 2
    assert quality.measured(docs, keep=["doc_id", "n_words"]).count() == 5
    assert verdicts(docs.limit(0).select("doc_id", "text"), ["doc_id"]).count() == 0


def test_columns_named_like_rules_and_results_stay(spark):
    good = "the cat is on the mat and it was here. " * 2 + " ".join(f"word{i} of" for i in range(60)) + "."
    names = ["doc_id", "text", "quality", "length", "_votes", "n_words", "row", "votes", "kept"]
    docs = spark.createDataFrame([(k, good if k else "x", *range(10, 17)) for k in range(4)], ", ".join(f"{n} {'string' if n == 'text' else 'long'}" for n in names))
    measures = quality.measured(docs, keep=names)
    fit = quality.fitted(measures)
    got = quality.row_verdicts(docs, fit).where("kept").select("row.*")
    assert got.columns == names and sorted(map(tuple, got.collect())) == [(k, good, *range(10, 17)) for k in (1, 2, 3)]
    judged = quality.judged(measures, fit).collect()
    assert len(judged) == 4 and all((r.length, r._votes, r.row, r.votes) == (11, 12, 14, 15) for r in judged)
