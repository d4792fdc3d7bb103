import random
import re

from strataline.llm import licenses
from strataline.llm.q_licenses import op9_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, scan=licenses.Scan()):
    """Every column by loops over words: each template tried at every place, without an index."""
    words = {d: WORD.findall((t or "").translate(LOWER)) for d, t in docs.items()}
    out = {}
    for d, ws in words.items():
        base = [(k, label) for p, label in licenses.PHRASES for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        found = []
        for t in scan.templates:
            template = t.text.split()
            parts = [(licenses._at(t.text, key), key.split()) for key in t.keys]
            for at in range(-parts[0][0], len(ws)):
                if all(at + p >= 0 and ws[at + p : at + p + len(key)] == key for p, key in parts):
                    same = sum(0 <= at + k < len(ws) and ws[at + k] == w for k, w in enumerate(template))
                    if same / len(template) >= scan.least:
                        found.append((t.label, at, same / len(template)))
        starts = [k for k, _ in base]
        labels = sorted({label for _, label in base} | {f[0] for f in found})
        score = max([0.5 * bool(base), *(f[2] for f in found)])
        out[d] = (len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in base})), ",".join(labels), round(score, 9))
    return out


def rows(frame):
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in frame.collect()}


def test_against_loops(spark):
    rng = random.Random(4)
    texts = [" ".join(t.text.split()).title() for t in licenses.TEMPLATES] + ["Licensed under CC BY-NC 4.0.", "MIT License mit license MIT\nLicense!", "cc, BY", "ccby cc bye", "GNU General Public License", "the mit license of the apache license", "übergnu general public license"]
    docs = {}
    for k in range(150):
        filler = " ".join(rng.choice(["the", "of", "word", "é", "license", "under", "a", "is", "free", "permission"]) for _ in range(rng.randint(0, 60)))
        cut = " ".join(rng.choice(texts).split()[: rng.randint(1, 30)]) if rng.random() < 0.5 else rng.choice(texts)
        docs[k] = filler + ". " + (cut if rng.random() < 0.8 else "") + rng.choice(["", " ", ". end", " " + rng.choice(texts)])
    docs |= {150: None, 151: "", 152: "the mit license " * 5000, 153: "version 2 0 " * 4000, 154: "submit licenses", 155: "xmit licenses soon", 156: "mit licenses", 157: ". ".join(texts[:-7]), 158: "permit licensed under cc bye"}
    frame = spark.createDataFrame([(k, v, "x") for k, v in docs.items()], "doc_id long, text string, labels string")
    assert rows(licenses.scanned(frame)) == plain(docs)


def test_notices_beside_words_of_other_templates(spark):
    """Every whole notice is found, whatever words of other templates stand in the text."""
    every = [t.text for t in licenses.TEMPLATES]
    words = " ".join(sorted({w for t in every for w in t.split()}))
    docs = {0: ". ".join(every), **{k + 1: f"{words}. {t}. {words}" for k, t in enumerate(every)}}
    frame = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scanned(frame).collect()}
    assert {f["label"] for f in got[0].found if f["coverage"] == 1} == {t.label for t in licenses.TEMPLATES}
    for k, t in enumerate(licenses.TEMPLATES):
        assert (t.label, 1.0) in {(f["label"], f["coverage"]) for f in got[k + 1].found}


def test_repeats_null_ids_and_empty(spark):
    frame = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "cc by")], "doc_id long, text string")
    got = [tuple(r) for r in licenses.scanned(frame).drop("found").collect()]
    assert got.count((1, 5, 1, 3, 3, "mit", "mit", 1.0)) == 2 and [r for r in got if r[0] is None] == [(None, 2, 1, 0, 0, "cc-by", "cc-by", 0.5)]
    assert licenses.scanned(frame.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    result = op9_license_scan(spark, sf)
    assert rows(result) == plain(docs)
    assert any("gpl-3.0" in r.labels for r in result.collect())
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
