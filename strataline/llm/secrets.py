"""Secret scans: fixed patterns, and a character convolutional network over every candidate in its context.

A candidate is a run of 16 or more characters of an encoded value with a digit in it. The network sees its
characters with the text to its left and right, and is trained on labelled findings: every different candidate in the
corpus, labelled by whether a pattern found it, the same values in contexts of others so that values count without a
keyword, and drawn values and counterexamples. Findings are dealt to blocks by a hash, however rows are dealt to tasks; in each
epoch every block takes its steps from the same network, and the blocks' networks are averaged. Held-out findings (all of a
value's, or none) calibrate its scores (a logistic fit); by kind of value its threshold is the highest that keeps the recall asked
for among all of them, and kinds with few share one. Its spans are added where no pattern has one.

Cases: null text is empty text; texts and values of any length are scanned whole (the network reads a
long value in overlapping windows and by its parts, and the highest score counts); overlapping findings of several kinds all stay; repeated rows give equal results;
without labelled findings the network learns from drawn ones; an empty table gives an empty table; columns named like a
result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, settled, slices, strings, written

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # shorter runs fail, and no part of one can pass
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_PART = re.compile(r"[A-Za-z0-9+]{16,}")
_DIGIT = re.compile(r"[0-9]")
_AZ = {upper: upper + 32 for upper in range(65, 91)}

LEFT, VALUE, RIGHT = 24, 40, 12
WIDTH = LEFT + VALUE + RIGHT


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' findings: leftmost, not overlapping within a kind."""
    found = []
    lower = text.lower() if text.isascii() else text.translate(_AZ)
    if any(k in lower for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text) if _DIGIT.search(m[0])]


def view(text: str, start: int, end: int) -> str:
    """What the network sees of a candidate: left context, value (its middle left out if long), right context; padded with NUL."""
    value = text[start:end]
    if len(value) > VALUE:
        value = value[: VALUE // 2] + value[len(value) - VALUE // 2 :]
    return text[max(0, start - LEFT) : start].rjust(LEFT, "\0") + value.ljust(VALUE, "\0") + text[end : end + RIGHT].ljust(RIGHT, "\0")


def views(text: str, start: int, end: int) -> list[str]:
    """All that the network sees of a candidate: its view and, if it is long, overlapping windows and its parts between
    / = _ -, those with a digit, as for candidates."""
    if end - start <= VALUE:
        return [view(text, start, end)]
    steps = [(a, a + VALUE) for a in (*range(start, end - VALUE, VALUE // 2), end - VALUE)]
    parts = [(start + m.start(), start + m.end()) for m in _PART.finditer(text[start:end])]
    spans = [(a, b) for a, b in dict.fromkeys([*steps, *(p for p in parts if p[1] - p[0] <= VALUE)]) if _DIGIT.search(text, a, b)]
    return [view(text, start, end), *(view(text, a, b) for a, b in spans)]


def shape(value: str) -> int:
    """Kind of value, for thresholds: 0 digits, 1 hexadecimal, 2 letters and digits, 3 with other characters."""
    return 0 if value.isdigit() else 1 if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) else 2 if value.isalnum() else 3


def value_of(window: str) -> str:
    return window[LEFT : LEFT + VALUE].rstrip("\0")


# Character classes that the network is given.
_CLASSES = {**{chr(c): 1 for c in range(97, 103)}, **{chr(c): 2 for c in range(103, 123)}, **{chr(c): 3 for c in range(65, 71)}, **{chr(c): 4 for c in range(71, 91)}, **{chr(c): 5 for c in range(48, 58)}, " ": 6, "\n": 6, "\t": 6, "=": 7, ":": 7, '"': 8, "'": 8, "`": 8, "-": 9, "_": 9, "/": 10, "+": 10, ".": 11, ",": 11, "@": 12, "\0": 0}
_TABLE = np.array([_CLASSES.get(chr(c), 13) for c in range(128)], np.int64)
N_CLASSES, N_LETTERS = 14, 27


def encode(windows: list[str]) -> np.ndarray:
    """Windows as (n, WIDTH, 2) of class and letter (case apart), both by code point; others are class 13."""
    codes = np.array([[min(ord(c), 127) for c in w] for w in windows], np.int64).reshape(-1, WIDTH)
    lower = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    letters = np.where((lower >= 97) & (lower <= 122), lower - 96, 0)
    return np.stack([_TABLE[codes], letters], axis=2)


@dataclass(frozen=True)
class Training:
    """Settings of the fit. A block has about `findings` labelled findings, or more where there would be over `blocks` of them, and
    at least `drawn` drawn ones; `fitted` takes every finding of the corpus, `sample` as many as a block has."""

    findings: int = 4000
    blocks: int = 256
    drawn: int = 4000
    filters: int = 24
    span: int = 5
    epochs: int = 12
    batch: int = 128
    rate: float = 0.004
    recall: float = 0.98
    least: int = 20
    seed: int = 5


class CharNet:
    """Embedding, one convolution over positions, maximum and mean by region, logistic output; trained by Adam."""

    def __init__(self, settings: Training):
        rng, self.settings = np.random.default_rng(settings.seed), settings
        d, k, f = 8, settings.span, settings.filters
        self.p = {
            "classes": rng.normal(0, 0.5, (N_CLASSES, d)), "letters": rng.normal(0, 0.3, (N_LETTERS, d)),
            "kernel": rng.normal(0, (2 / (k * (d + 1))) ** 0.5, (k * (d + 1), f)), "bias": np.zeros(f),
            "out": rng.normal(0, 0.1, 4 * f), "shift": np.zeros(1),
        }
        self.scale, self.offset = 1.0, 0.0
        self.thresholds = np.full(4, 0.5)
        self.kept = np.full(4, np.nan)  # recall on held-out findings, by kind

    def _forward(self, x: np.ndarray) -> tuple:
        p, k = self.p, self.settings.span
        region = np.zeros((len(x), WIDTH, 1))
        region[:, LEFT : LEFT + VALUE] = 1
        e = np.concatenate([p["classes"][x[:, :, 0]] + p["letters"][x[:, :, 1]], region], axis=2)
        columns = np.lib.stride_tricks.sliding_window_view(e, k, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - k + 1, -1)
        h = np.maximum(columns @ p["kernel"] + p["bias"], 0)
        inside = slice(LEFT - k // 2, LEFT + VALUE - k // 2)
        context = np.concatenate([h[:, : LEFT - k // 2], h[:, LEFT + VALUE - k // 2 :]], axis=1)
        present = (x[:, LEFT : LEFT + VALUE, 0] > 0)[:, : h[:, inside].shape[1], None]
        weight = present / np.maximum(present.sum(axis=1, keepdims=True), 1)
        value = h[:, inside] * present
        features = np.concatenate([value.max(axis=1), (h[:, inside] * weight).sum(axis=1), context.max(axis=1), context.mean(axis=1)], axis=1)
        return e, columns, h, inside, present, weight, value, context, features, features @ p["out"] + p["shift"][0]

    def logits(self, windows: list[str]) -> np.ndarray:
        return np.concatenate([self._forward(encode(windows[k : k + 512]))[-1] for k in range(0, len(windows), 512)]) if windows else np.zeros(0)

    def logits_of(self, x: np.ndarray) -> np.ndarray:
        """The same of encoded windows."""
        return np.concatenate([self._forward(x[k : k + 512])[-1] for k in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def _gradients(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict:
        p, k, f = self.p, self.settings.span, self.settings.filters
        e, columns, h, inside, present, weight, value, context, features, z = self._forward(x)
        dz = (1 / (1 + np.exp(-z)) - y) * w / len(x)
        g = {"out": features.T @ dz, "shift": np.array([dz.sum()])}
        df = dz[:, None] * p["out"]
        dh = np.zeros_like(h)
        rows, fs = np.arange(len(x))[:, None], np.arange(f)[None]
        dvalue = np.zeros_like(value)
        dvalue[rows, value.argmax(axis=1), fs] = df[:, :f]
        dh[:, inside] += dvalue * present + df[:, None, f : 2 * f] * weight
        dcontext = np.repeat(df[:, None, 3 * f :] / context.shape[1], context.shape[1], axis=1)
        dcontext[rows, context.argmax(axis=1), fs] += df[:, 2 * f : 3 * f]
        left = LEFT - k // 2
        dh[:, :left] += dcontext[:, :left]
        dh[:, LEFT + VALUE - k // 2 :] += dcontext[:, left:]
        dh *= h > 0
        g["kernel"] = columns.reshape(-1, columns.shape[2]).T @ dh.reshape(-1, f)
        g["bias"] = dh.sum(axis=(0, 1))
        dcolumns = (dh @ p["kernel"].T).reshape(len(x), h.shape[1], k, -1)
        de = np.zeros_like(e)
        for j in range(k):
            de[:, j : j + h.shape[1]] += dcolumns[:, :, j]
        d = p["classes"].shape[1]
        flat = de[:, :, :d].reshape(-1, d)
        for name, at, n in (("classes", x[:, :, 0], N_CLASSES), ("letters", x[:, :, 1], N_LETTERS)):
            g[name] = np.zeros((n, d))
            np.add.at(g[name], at.reshape(-1), flat)
        return g

    def unmoved(self) -> tuple[dict, dict, float]:
        """Adam's moments and number of steps before the first one."""
        return {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0.0

    def epoch(self, x: np.ndarray, y: np.ndarray, train: np.ndarray, rng: np.random.Generator, moved: tuple[dict, dict, float]) -> tuple[dict, dict, float]:
        """One pass over the rows `train`, both labels of equal weight; the moments after it."""
        s, (first, second, step) = self.settings, moved
        first, second = dict(first), dict(second)
        share = y[train].mean()
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // s.batch)):
            step += 1
            balance = np.where(y[rows] == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
            for k, g in self._gradients(x[rows], y[rows], balance).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.p[k] = self.p[k] - s.rate * (first[k] / (1 - 0.9**step)) / ((second[k] / (1 - 0.999**step)) ** 0.5 + 1e-8)
        return first, second, step

    def fit(self, windows: list[str], labels: np.ndarray) -> CharNet:
        """Train on the findings of four values in five; calibrate and choose thresholds on the rest."""
        s, rng = self.settings, np.random.default_rng(self.settings.seed + 1)
        aside = held_out(windows, s)
        held, train = np.flatnonzero(aside), np.flatnonzero(~aside)
        x, y = encode(windows), labels.astype(float)
        moved = self.unmoved()
        for _ in range(s.epochs):
            moved = self.epoch(x, y, train, rng, moved)
        z = self.logits([windows[k] for k in held])
        self.scale, self.offset = _logistic(z, y[held])
        p = self.probability(z)
        kinds = np.array([shape(value_of(windows[k])) for k in held])
        every = np.sort(p[y[held] == 1])
        for kind in range(4):
            own = np.sort(p[(kinds == kind) & (y[held] == 1)])
            scale = own if len(own) >= s.least else every
            self.thresholds[kind] = scale[int((1 - s.recall) * len(scale))] if len(scale) else 0.5
            self.kept[kind] = (own >= self.thresholds[kind]).mean() if len(own) else np.nan
        return self

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.offset, -60, 60)))

    def accepts(self, windows: list[str]) -> np.ndarray:
        kinds = np.array([shape(value_of(w)) for w in windows], int)
        return self.probability(self.logits(windows)) >= self.thresholds[kinds] if windows else np.zeros(0, bool)


def held_out(windows: list[str], settings: Training) -> np.ndarray:
    """Whether a finding is held out: all of a value's are, or none."""
    return np.array([xxhash.xxh64_intdigest(value_of(w).encode("utf-8", "surrogatepass"), settings.seed) % 5 == 0 for w in windows], bool)


def _logistic(z: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Platt's fit of scale and offset, by Newton's method with a small penalty; n: how often each occurs."""
    a, b = 1.0, 0.0
    n1, n0 = (n * y).sum(), (n * (1 - y)).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        g = np.array([(n * (p - t) * z).sum() + 1e-3 * (a - 1), (n * (p - t)).sum() + 1e-3 * b])
        v = n * p * (1 - p)
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -5, 5))
    return max(a, 1e-3), b


_WORDS = "section chapter version release module figure table page part item order invoice build test file image north south report draft final update server".split()


def drawn(n: int, rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Values and contexts drawn without a corpus: random keys of several alphabets, and strings that only look alike."""
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    pick = lambda items: items[int(rng.integers(len(items)))]
    word = lambda: pick(_WORDS)
    windows, labels = [], []
    while len(windows) < n:
        secret = bool(rng.random() < 0.5)
        if secret:
            value = "".join(pick(pick_from) for pick_from in [pick(alphabets)] for _ in range(int(rng.integers(20, 65))))
            lead = pick(["key = ", "credential: ", "auth=", "Bearer ", "export KEY=", "use ", '"', "the ", f"{word()} {word()} "]) + pick(["", '"', "'"])
        else:
            kind = int(rng.integers(6))
            number = lambda k: "".join(str(rng.integers(10)) for _ in range(k))
            value = [number(int(rng.integers(16, 24))), "-".join([number(4), number(2), number(2), number(4), number(2), number(2)]), "/".join(word() for _ in range(4)) + number(2), word() + word() + word() + number(3), "_".join([word(), word(), word(), number(4)]), "=" * int(rng.integers(16, 40)) + number(1)][kind]
            lead = f"{word()} {word()} " + pick(["", "(", '"', "no. ", "see ", "http://www.example.org/"])
        if len(value) < 16 or not _DIGIT.search(value):
            continue
        text = f"{word()} {word()} {lead}"
        windows.append(view(text + value + pick([" ", '"', ".", ", ", "\n"]) + word() + " " + word(), len(text), len(text) + len(value)))
        labels.append(secret)
    return windows, np.array(labels, float)


def examples(findings: list[tuple[str, bool]], n_drawn: int, rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Windows and labels to learn from: drawn ones, the findings, and the values of positive ones in others' contexts."""
    windows, labels = drawn(n_drawn, rng)
    more: list[float] = []
    contexts = [w for w, positive in findings if not positive] or list(windows)
    for window, positive in findings:
        windows.append(window)
        more.append(float(positive))
        if positive:  # the value alone, in the context of a counterexample
            other = contexts[int(rng.integers(len(contexts)))]
            windows.append(other[:LEFT] + window[LEFT : LEFT + VALUE] + other[LEFT + VALUE :])
            more.append(1.0)
    return windows, np.concatenate([labels, more])


def trained(findings: list[tuple[str, bool]], settings: Training = Training()) -> CharNet:  # noqa: B008
    """A network from a list of labelled findings (window, found by a pattern), here and now."""
    return CharNet(settings).fit(*examples(findings, settings.drawn, np.random.default_rng(settings.seed + 2)))


def overlaps(start: int, end: int, spans: list[tuple[int, int, str]]) -> bool:
    return any(a < end and start < b for a, b, _ in spans)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False), T.StructField("kind", T.StringType(), False)]), False)
_SPAN = pa.list_(pa.struct([pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False), pa.field("kind", pa.string(), False)]))
_OPEN = pa.list_(pa.struct([pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False), pa.field("window", pa.string(), False)]))
OPEN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False), T.StructField("window", T.StringType(), False)]), False)


def _dicts(rows: list[list[tuple]], names: tuple[str, str, str]) -> list[list[dict]]:
    return [[dict(zip(names, x, strict=True)) for x in row] for row in rows]


def findings(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` with base (the patterns' spans), open (candidates outside them, as the network sees them) and
    seen (labelled findings of this document)."""
    kept = [f for f in docs.schema.fields if f.name in keep]
    seen = T.ArrayType(T.StructType([T.StructField("window", T.StringType(), False), T.StructField("positive", T.BooleanType(), False)]), False)
    schema = T.StructType([*kept, T.StructField("base", SPAN, False), T.StructField("open", OPEN, False), T.StructField("seen", seen, False)])
    arrow_seen = pa.list_(pa.struct([pa.field("window", pa.string(), False), pa.field("positive", pa.bool_(), False)]))

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            base, loose, seen = [], [], []
            for x in strings(batch.column(text)):
                spans = base_spans(x)
                found = candidates(x)
                base.append(spans)
                loose.append([(a, b, w) for a, b in found if not overlaps(a, b, spans) for w in views(x, a, b)])
                seen.append([{"window": view(x, a, b), "positive": overlaps(a, b, spans)} for a, b in found])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(_dicts(base, ("start", "end", "kind")), _SPAN), pa.array(_dicts(loose, ("start", "end", "window")), _OPEN), pa.array(seen, arrow_seen)], names=[f.name for f in schema.fields])

    return docs.select(*dict.fromkeys([*(f.name for f in kept), text])).mapInArrow(run, schema)


def sample(found: DataFrame, settings: Training = Training()) -> list[tuple[str, bool]]:  # noqa: B008
    """The labelled findings with the smallest hashes over all documents, half of them of each label at most: a list for trying
    settings out with `trained`. No query learns from it; they use `fitted`.

    Each task offers its own smallest ones, as many as could be taken, each once: what is taken doesn't depend on how rows are dealt.
    """
    most = settings.findings // 2

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, dict[str, int]] = {True: {}, False: {}}

        def smallest(own: dict[str, int]) -> dict[str, int]:
            return dict(sorted(own.items(), key=lambda x: (x[1], x[0]))[:most])

        for batch in batches:
            for row in batch.column("seen").to_pylist():
                for x in row:
                    own = held[x["positive"]]
                    if x["window"] not in own:
                        own[x["window"]] = xxhash.xxh64_intdigest(x["window"].encode("utf-8", "surrogatepass"), 7) >> 1
                        if len(own) >= 2 * most + 1000:
                            held[x["positive"]] = smallest(own)
        rows = [(h, w, positive) for positive, own in held.items() for w, h in smallest(own).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_())], names=["hash", "window", "positive"])

    offered = found.select("seen").mapInArrow(run, "hash long, window string, positive boolean").distinct()
    out: list[tuple[str, bool]] = []
    for positive in (True, False):
        rows = offered.where(F.col("positive") == positive).orderBy("hash", "window").limit(most).collect()  # most rows at most
        out += [(r.window, positive) for r in rows]
    return out


def labelled(found: DataFrame) -> DataFrame:
    """Every different labelled finding of all documents: window, positive."""
    return found.select(F.explode("seen").alias("x")).select("x.window", "x.positive").distinct()


def blocks(seen: DataFrame, n_blocks: int, settings: Training) -> DataFrame:
    """Labelled findings dealt to blocks by a hash, a row a block, encoded with what they are learnt beside: windows (x), labels (y),
    whether they are held out, and kinds of their values, as bytes. What is in a block doesn't depend on how rows are dealt."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        own = sorted(zip(table.column("window").to_pylist(), table.column("positive").to_pylist(), strict=True))
        windows, labels = examples(own, max(settings.drawn, len(own)), np.random.default_rng([settings.seed + 2, block]))
        x = b"".join(encode(windows[k : k + 512]).astype(np.uint8).tobytes() for k in range(0, len(windows), 512))
        kinds = np.array([shape(value_of(w)) for w in windows], np.uint8)
        parts = {"x": x, "y": labels.astype(np.uint8).tobytes(), "held": held_out(windows, settings).astype(np.uint8).tobytes(), "kind": kinds.tobytes()}
        return pa.table({"block": pa.array([block], pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in parts.items()}})

    dealt = seen.withColumn("block", F.pmod(F.xxhash64("window", "positive"), F.lit(n_blocks)))
    return dealt.repartition(n_blocks, "block").groupBy("block").applyInArrow(run, "block long, x binary, y binary, held binary, kind binary")


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x, y, held, kind = (np.frombuffer(row[k], np.uint8) for k in ("x", "y", "held", "kind"))
    return x.reshape(-1, WIDTH, 2), y.astype(float), held.astype(bool), kind


def _averaged_epoch(dealt: DataFrame, net: CharNet, moved: tuple[dict, dict, float], number: int) -> tuple[dict, dict, float]:
    """One epoch of every block from the same network, which becomes the blocks' average by their training rows; the moments too.

    The driver gets a row a block: settings.blocks rows of some 40 KB at most, and adds them up in the blocks' order.
    """

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                x, y, held, _ = _unpacked(row)
                own, train = CharNet(net.settings), np.flatnonzero(~held)
                own.p = dict(net.p)
                first, second, step = own.epoch(x, y, train, np.random.default_rng([net.settings.seed + 1, number, row["block"]]), moved)
                state = np.concatenate([*(part[name].ravel() for part in (own.p, first, second) for name in net.p), [step]])
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([len(train)], pa.int64()), pa.array([state.tobytes()], pa.binary())], names=["block", "n", "state"])

    rows = sorted(dealt.mapInArrow(run, "block long, n long, state binary").collect(), key=lambda r: r.block)
    total = sum(r.n for r in rows)
    state = sum(np.frombuffer(r.state) * (r.n / total) for r in rows)
    parts, at = [], 0
    for _ in range(3):
        part = {}
        for name, own in net.p.items():
            part[name] = state[at : at + own.size].reshape(own.shape)
            at += own.size
        parts.append(part)
    net.p = parts[0]
    return parts[1], parts[2], float(state[at])


def _held_scores(dealt: DataFrame, net: CharNet) -> DataFrame:
    """The network's logit (z) of every held-out finding, its kind and label."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y, held, kind = _unpacked(batch.slice(k, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(kind[held].astype(np.int32)), pa.array(y[held] == 1), pa.array(net.logits_of(x[held]))], names=["kind", "positive", "z"])

    return dealt.mapInArrow(run, "kind int, positive boolean, z double")


def _calibrated(scores: DataFrame, net: CharNet) -> CharNet:
    """Scale and offset from how many held-out findings of each label are in each 64th of a logit, which is all that the driver
    sees; thresholds are exact order statistics of all."""
    s = net.settings
    at = F.floor(F.greatest(F.lit(-64.0), F.least(F.lit(63.99), "z")) * 64).alias("at")
    bins = sorted(scores.groupBy(at, "positive").count().collect())
    z, y, n = (np.array([r[k] for r in bins], float) for k in range(3))
    net.scale, net.offset = _logistic((z + 0.5) / 64, y, n)
    positive = scores.where("positive")
    counts = {r.kind: r["count"] for r in positive.groupBy("kind").count().collect()}

    def least_kept(rows: DataFrame, n: int) -> float:
        return rows.orderBy("z").offset(int((1 - s.recall) * n)).limit(1).first()["z"]

    total = sum(counts.values())
    shared = least_kept(positive, total) if total else -net.offset / net.scale  # a probability of one half
    lows = [least_kept(positive.where(F.col("kind") == kind), counts[kind]) if counts.get(kind, 0) >= s.least else shared for kind in range(4)]
    net.thresholds = net.probability(np.array(lows))
    above = {r.kind: r["count"] for r in positive.where(F.col("z") >= F.element_at(F.array(*map(F.lit, lows)), F.col("kind") + 1)).groupBy("kind").count().collect()}
    net.kept = np.array([above.get(kind, 0) / counts[kind] if kind in counts else np.nan for kind in range(4)])
    return net


def fitted(found: DataFrame, settings: Training = Training()) -> CharNet:  # noqa: B008
    """A network trained and calibrated on every different labelled finding of `findings`; with none, on drawn ones."""
    seen = written(labelled(found), "labelled")
    n = seen.count()
    if not n:
        discard(seen)
        return trained([], settings)
    dealt = written(blocks(seen, min(settings.blocks, -(-n // settings.findings)), settings), "blocks")
    net = CharNet(settings)
    moved = net.unmoved()
    for number in range(settings.epochs):
        moved = _averaged_epoch(dealt, net, moved, number)
    scores = written(_held_scores(dealt, net), "scores")
    net = _calibrated(scores, net)
    discard(seen, dealt, scores)
    return net


def with_model(found: DataFrame, net: CharNet) -> DataFrame:
    """findings with all spans: the base ones and the network's."""
    shared = found.sparkSession.sparkContext.broadcast(net)
    kept = [f for f in found.schema.fields if f.name not in ("open", "seen", "spans")]
    schema = T.StructType([*kept, T.StructField("spans", SPAN, False)])

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, loose = batch.column("base").to_pylist(), batch.column("open").to_pylist()
            windows = [x["window"] for row in loose for x in row]
            accepted = iter(shared.value.accepts(windows).tolist())
            spans = []
            for own, row in zip(base, loose, strict=True):
                more = [{"start": a, "end": b, "kind": "model"} for a, b in dict.fromkeys([(x["start"], x["end"]) for x in row if next(accepted)])]
                spans.append(sorted(own + more, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(spans, _SPAN)], names=[f.name for f in schema.fields])

    return found.select(*(f.name for f in found.schema.fields if f.name != "seen")).mapInArrow(run, schema)


def _marked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def redacted(docs: DataFrame, net: CharNet, mark: str = "[secret]", text: str = "text") -> DataFrame:
    """docs with every span, patterns' and network's, replaced by a mark; overlapping spans give one."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = docs.schema

    def cleaned(texts: list[str]) -> list[str]:
        patterns = [base_spans(x) for x in texts]
        found = [(k, a, b) for k, x in enumerate(texts) for a, b in candidates(x) if not overlaps(a, b, patterns[k])]
        seen = [(span, w) for span in found for w in views(texts[span[0]], *span[1:])]
        more: list[set] = [set() for _ in texts]
        for ((k, a, b), _), yes in zip(seen, shared.value.accepts([w for _, w in seen]).tolist(), strict=True):
            if yes:
                more[k].add((a, b))
        return [_marked(x, sorted({(a, b) for a, b, _ in own} | extra), mark) for x, own, extra in zip(texts, patterns, more, strict=True)]

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            column = batch.column(text)
            texts = [x if own is not None else None for x, own in zip(cleaned(strings(column)), column.to_pylist(), strict=True)]
            columns = [pa.array(texts, batch.schema.field(f.name).type) if f.name == text else batch.column(f.name) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def listed(spans: str):
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
