"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Votes are counted by pattern over all
documents (at most 3 ** rules patterns, whatever the corpus), expectation-maximisation over these counts
estimates how often each rule is right about good and about bad documents, and the posterior
probability of quality under these estimates decides; no rule alone does.

Cases: null or empty text has no words and counts 0 everywhere; texts of any length are read whole; repeated
rows count as often as they occur; an empty table gives an empty table; a column of the input that is
named like a result (MEASURES, quality, quality_kept) is replaced by it, any other name is free, rules' names too. `row_verdicts`
leaves every column of the input as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, settled, slices, utf8

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_closed_lines", "n_upper", "n_letters", "n_digits", "n_stop"]

# Frequent function words of English, German, French and Spanish.
STOP = frozenset(
    b"a an and are as at be by for from he in is it of on or that the they this to was were which with you "
    b"au aux ce de des du elle en et il la le les mais ne on ou par pas pour que qui sa se sur un une "
    b"als am auf aus bei das dem den der des die ein eine er es ich im in ist mit nicht sich sie und von zu "
    b"al como con de del el en es la las lo los no para por que se su un una y".split()
)
_SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_CLOSERS = (b".", b"!", b"?", b'"', b":", b";", b"\xbb", b"\xe2\x80\xa6", b"\xe2\x80\x9d")


def measure(raw: bytes) -> tuple[int, ...]:
    """MEASURES of one text."""
    words = raw.split()
    n = len(words)
    continuation = 0 if raw.isascii() else len(raw) - len(raw.decode("utf-8", "replace"))
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            first: dict = {}
            covered = np.zeros(n, bool)
            for i, window in enumerate(windows):
                j = first.setdefault(window, i)
                if j != i:
                    covered[i : i + 3] = covered[j : j + 3] = True
            repeat = int(covered.sum())
    seen: set[bytes] = set()
    lines = duplicates = closed = 0
    for line in raw.split(b"\n"):
        bare = line.rstrip()
        if bare and bare.lstrip():
            lines += 1
            duplicates += line in seen
            seen.add(line)
            closed += bare.endswith(_CLOSERS)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (
        n, sum(map(len, words)) - continuation, len(raw) - len(raw.translate(None, _SYMBOLS)), duplicates, repeat, lines, closed,
        upper, upper + len(raw) - len(raw.translate(None, _LOWER)), len(raw) - len(raw.translate(None, _DIGITS)), sum(map(STOP.__contains__, raw.lower().split())),
    )


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns `keep`) with MEASURES of the whole text."""
    kept = [f for f in docs.schema.fields if (f.name in keep if keep is not None else True) and f.name not in MEASURES]
    schema = T.StructType([*kept, *(T.StructField(m, T.LongType(), False) for m in MEASURES)])

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            table = np.array([measure(x) for x in utf8(batch.column(text))], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(table[:, k].copy()) for k in range(len(MEASURES)))], names=[f.name for f in schema.fields])

    return docs.select(*dict.fromkeys([*(f.name for f in kept), text])).mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """Votes good at or inside `good`, bad beyond `bad`, and abstains between; lower: small values are bad."""

    name: str
    value: Column
    good: float
    bad: float
    lower: bool = False
    needs: Column | None = None

    def vote(self) -> Column:
        v = self.value
        good, bad = (v >= self.good, v < self.bad) if self.lower else (v <= self.good, v > self.bad)
        vote = F.when(good, 1).when(bad, -1).otherwise(0)
        return (vote if self.needs is None else F.when(self.needs, vote).otherwise(0)).cast("int")


def default_rules() -> list[Rule]:
    """Nine rules, with a wide band between good and bad in which they abstain."""
    c = F.col
    share = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    return [
        Rule("length", c("n_words").cast("double"), 80, 50, lower=True),
        Rule("symbols", share("n_symbols", "n_words"), 0.1, 0.4),
        Rule("shouting", share("n_upper", "n_letters"), 0.2, 0.4, needs=c("n_letters") > 20),
        Rule("function_words", share("n_stop", "n_words"), 0.1, 0.02, lower=True, needs=c("n_words") > 20),
        Rule("repeated_lines", share("n_dup_lines", "n_lines"), 0.1, 0.4, needs=c("n_lines") > 1),
        Rule("repeated_words", share("n_repeat_words", "n_words"), 0.15, 0.4),
        Rule("word_length", share("word_chars", "n_words"), 9, 14, needs=c("n_words") > 0),
        Rule("digits", share("n_digits", "word_chars"), 0.1, 0.35),
        Rule("closed_lines", share("n_closed_lines", "n_lines"), 0.5, 0.1, lower=True, needs=c("n_lines") > 3),
    ]


@dataclass(frozen=True)
class LabelModel:
    """Estimated accuracies: P(vote | good) and P(vote | bad) by rule for votes -1, 0, 1; and P(good)."""

    rules: tuple[str, ...]
    good: np.ndarray
    bad: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good | votes); votes: a row per document, a column per rule. Abstentions carry no evidence."""
        at = votes.astype(int) + 1
        evidence = np.log(self.good) - np.log(self.bad)
        evidence[:, 1] = 0
        odds = np.log(self.prior) - np.log1p(-self.prior) + evidence[np.arange(len(self.rules)), at].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(votes: np.ndarray, counts: np.ndarray, rules: tuple[str, ...], iterations: int = 100, strength: float = 0.005) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts.

    Among votes cast, a rule says bad of a share e of the good documents and of a share d of the bad ones.
    Pseudo-counts in proportion to the corpus (`strength` of it) hold d and e near a rule that is right more often than not, so
    that the two classes keep their meaning at every size.
    """
    at, total = votes.astype(int) + 1, max(counts.sum(), 1)
    low, high = at == 0, at == 2
    p = np.array([0.98, 0.3, 0.05])[np.minimum(low.sum(axis=1), 2)]  # the start: by the number of bad votes
    weight = strength * total
    good = bad = None
    prior = 0.8
    for _ in range(iterations):
        good, bad = np.full((len(rules), 3), 1.0), np.full((len(rules), 3), 1.0)
        for y, table, start in ((p, good, 0.02), (1 - p, bad, 0.3)):
            w = (counts * y)[:, None]
            no, yes = (w * low).sum(axis=0), (w * high).sum(axis=0)
            share = (no + weight * start + 1e-9) / (no + yes + weight + 2e-9)
            table[:, 0], table[:, 2] = share, 1 - share
        # a bad vote never speaks for quality, nor a good one against it
        bad[:, 0] = np.maximum(bad[:, 0], good[:, 0])
        bad[:, 2] = 1 - bad[:, 0]
        prior = float(np.clip(((counts * p).sum() + 0.8 * weight) / (total + weight), 0.05, 0.995))
        model = LabelModel(rules, good, bad, prior)
        then = model.posterior(votes)
        if np.abs(then - p).max(initial=0) < 1e-6:
            break
        p = then
    return LabelModel(rules, good, bad, prior)


def code_of(rules: list[Rule]) -> Column:
    """A document's votes as one number in base 3."""
    return reduce(lambda acc, r: acc * 3 + r.vote() + 1, rules, F.lit(0)).cast("int")


def decode(codes: np.ndarray, n: int) -> np.ndarray:
    return np.stack([codes // 3 ** (n - 1 - k) % 3 - 1 for k in range(n)], axis=1).reshape(-1, n)


@dataclass(frozen=True)
class Fitted:
    """A label model with the rules it was fitted for and the quality of every vote pattern seen."""

    rules: list[Rule]
    model: LabelModel
    codes: np.ndarray
    posterior: np.ndarray


def fitted(measures: DataFrame, rules: list[Rule] | None = None) -> Fitted:
    """The label model of all documents; patterns go to the driver, 3 ** rules rows at most."""
    rules = rules or default_rules()
    seen = measures.select(code_of(rules).alias("votes")).groupBy("votes").count().collect()
    codes = np.array([r[0] for r in seen], np.int64)
    votes = decode(codes, len(rules))
    model = fit(votes, np.array([r[1] for r in seen], float), tuple(r.name for r in rules))
    return Fitted(rules, model, codes, model.posterior(votes))


def judged(measures: DataFrame, fit_: Fitted, threshold: float = 0.5) -> DataFrame:
    """measures with quality (posterior probability) and quality_kept."""
    kept = [c for c in measures.columns if c not in ("quality", "quality_kept")]
    voted = measures.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), code_of(fit_.rules).alias("votes"))
    facts = measures.sparkSession.createDataFrame([(int(c), float(x)) for c, x in zip(fit_.codes, fit_.posterior, strict=True)], "votes int, quality double")
    return voted.join(F.broadcast(facts), "votes", "left").select("row.*", "quality", (F.col("quality") >= threshold).alias("quality_kept"))


def row_verdicts(docs: DataFrame, fit_: Fitted, text: str = "text") -> DataFrame:
    """Each row of docs as a struct `row`, untouched, with base_failed and kept."""
    judged_ = judged(measured(packed(docs, text), text, ["row"]), fit_)
    return judged_.select("row", base_failed().alias("base_failed"), (~base_failed() & F.col("quality_kept")).alias("kept"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
