import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataline.llm import jaccard
from strataline.llm.q_jaccard import op10_ngram_jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, n=5):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(docs, percent=80):
    """doc_id -> (set size, component) by comparing every pair that shares anything."""
    sets = {d: plain_set(t) for d, t in docs.items()}
    posted = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            posted[g].append(d)
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        common = Counter(e for g in s for e in posted[g] if e > d)
        for e, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[e]) - c):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in docs}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "é", "ab", " ", "\n", "\t", "\x0b", " "]), max_size=40).map("".join), min_size=1, max_size=4))
def test_shingles_are_the_distinct_ngrams(texts):
    got = jaccard.shingles([t.encode() for t in texts], 5)
    want = [plain_set(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])
            assert (jaccard.digest(got[i]) == jaccard.digest(got[j])) == (want[i] == want[j])


def test_head_length_meets():
    for n in range(1, 400):
        for percent in (50, 80, 95):
            least = -(-percent * n // 100)
            assert jaccard.head_length(n, percent) == n - least + 1


def check(spark, docs, **kind):
    frame = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")
    rows = jaccard.membership(frame, jaccard.Join(**kind)).collect()
    assert len(rows) == len(docs)
    want = brute(docs)
    wrong = [(r.doc_id, r.n_shingles, r.component_id, want[r.doc_id]) for r in rows if (r.n_shingles, r.component_id) != want[r.doc_id]]
    assert not wrong, wrong[:5]


def test_groups_of_copies_chains_and_shared_passages(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    docs, base = {}, [word() for _ in range(150)]
    for k in range(60):  # near copies that differ from each other more than from the original
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = word()
        docs[k] = " ".join(copy)
    for k in range(60, 90):  # exact copies in other case and spacing
        docs[k] = "\n ".join(base).upper()
    for k in range(90, 130):  # one passage, else unlike; some short
        docs[k] = " ".join([word() for _ in range(rng.choice([2, 8, 15, 200]))] + passage)
    chain = [word() for _ in range(100)]
    for k in range(130, 150):  # a chain of small steps
        chain = chain[2:] + [word(), word()]
        docs[k] = " ".join(chain)
    docs |= {150: None, 151: "", 152: " \n\t ", 153: "one two", 154: "One  TWO", 155: "one two three four five", 156: "x " * 500, 157: "x " * 6}
    check(spark, docs)
    check(spark, docs, frequent=0)
    check(spark, docs, lane=1, fragments=1)
    check(spark, docs, bits=3)  # names that many classes share


def test_pairs_of_unequal_size_near_the_threshold(spark):
    """y is x with words put in or appended, so head n-grams of x may stand beyond the head of y."""
    rng, docs = random.Random(29), {}
    for k in range(250):
        x = [f"p{k}w{i}" for i in range(rng.randint(30, 160))]
        y, n = list(x), len(x) - 4
        m = round(n / rng.uniform(0.80, 0.87))
        if k % 2:
            y += [f"p{k}x{i}" for i in range(m - n)]
        else:
            at = rng.randrange(1, len(x))
            y[at:at] = [f"p{k}x{i}" for i in range(max(m - n - 4, 1))]
        docs |= {2 * k: " ".join(x), 2 * k + 1: " ".join(y)}
    want = brute(docs)
    assert sum(c != d for d, (_, c) in want.items()) > 150
    check(spark, docs)


def test_null_ids_repeated_rows_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text, 1), (5, text, 2), (5, text, 2), (3, text + " tail", 3), (7, "other", 4), (None, None, 5)], "doc_id long, text string, n long")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard.membership(docs).collect())
    assert got == [(-1, 0, None), (-1, 36, None), (3, 37, 3), (5, 36, 3), (5, 36, 3), (7, 1, 7)]
    assert jaccard.membership(docs.limit(0)).count() == 0


def test_repeated_rows_count_once(spark):
    """Pairs of similarity 0.4 to 0.78, each row several times: none links."""
    rng, rows = random.Random(3), []
    for k in range(60):
        x = [f"p{k}w{i}" for i in range(200)]
        keep = rng.randint(120, 170)
        rows += [(2 * k, " ".join(x))] * 3 + [(2 * k + 1, " ".join(x[:keep] + [f"p{k}y{i}" for i in range(200 - keep)]))] * 2
    want = brute(dict(rows))
    assert all(c == d for d, (_, c) in want.items())
    got = jaccard.membership(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.component_id == r.doc_id for r in got)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute(docs)
    rows = op10_ngram_jaccard(spark, sf).collect()
    assert len(rows) == len(docs) and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in rows)
    assert len({c for _, c in want.values()}) < len(docs)
