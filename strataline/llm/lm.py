"""LM scoring: exact unigram counts, and a log-bilinear model trained with noise-contrastive estimation.

1. Coding. Documents are dealt to lanes by a hash of what they hold and sorted there, so what follows doesn't depend on how rows
   were partitioned. Each task turns its lane into blocks: a block has its own vocabulary and its tokens as numbers in it.
2. Counts. A block's vocabulary goes to buckets of words, a packed row a block and bucket; a bucket's task adds up its words and
   sends every block the totals of its own. Where there are many blocks they are added up in groups first, so that a word which
   stands in every block never has more than `group` places in one task.
3. Training. The words of count `least` and more, the `vocabulary` most frequent ones at most, have a vector as context and one
   as target; they are cut into classes by frequency, and all other words share a class. P(word | context) is
   P(class | context) P(word | class, context), both log-bilinear in the two words before, each with its bias. Each block runs one pass
   of noise-contrastive estimation over all its training tokens from the same start (noise classes for the first factor, noise
   words of the same class for the second), and the blocks' parameters are averaged, each word's by how often it stands there.
4. Scoring. Batched matrix products give the normaliser of the classes for each pair of contexts met in a block, and that of the
   words of a class for each token; probabilities sum to one over known words and one for all unknown. A word without a vector
   has its class's probability times its share of the class by count.

What is broadcast and what each task sends to be averaged has the size of the vocabulary with vectors, 36 numbers a word.

Cases: null and empty texts are one end token; texts of any length are whole; a null doc_id trains and is scored (it is
not held out); repeated rows count each time; with no training token every word is unknown; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, slices, utf8, written

#: The token that ends a text; no word holds a blank.
END = b" "


@dataclass(frozen=True)
class Settings:
    """vocabulary: words with vectors, at most, of count `least` or more; width of vectors; noise: noise classes of a batch;
    block: bytes of text of a block, at most, or one document; lane: documents of a lane; bucket: places of words in a bucket;
    group: blocks that are added up together; train: tokens of a training task."""

    vocabulary: int = 8192
    least: int = 5
    width: int = 16
    noise: int = 48
    own_noise: int = 2
    batch: int = 8192
    rate: float = 0.15
    block: int = 6 << 20
    lane: int = 8192
    bucket: int = 500_000
    group: int = 4096
    train: int = 8_000_000
    modulus: int = 7
    held_out: int = 2
    seed: int = 29


def is_held_out(doc_id: int | None, settings: Settings) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % settings.modulus == settings.held_out


def _block(ids: list, texts: list[bytes], settings: Settings) -> tuple:
    """Documents as (ids, held out, lengths, codes, words by code, counts in training texts)."""
    tokens: list[bytes] = []
    lengths = []
    for text in texts:
        words = text.lower().split()
        words.append(END)
        lengths.append(len(words))
        tokens += words
    place: dict[bytes, int] = {}
    codes = np.fromiter((place.setdefault(w, len(place)) for w in tokens), np.int32, len(tokens))
    held = np.array([is_held_out(i, settings) for i in ids], bool)
    training = np.repeat(~held, lengths)
    return ids, held, np.array(lengths, np.int64), codes, list(place), np.bincount(codes[training], minlength=len(place))


def laned(docs: DataFrame, settings: Settings, text: str = "text") -> DataFrame:
    """(doc_id, text) in lanes by a hash of both, sorted by it: the same rows in the same order for any partitioning."""
    lanes = min(max(1, -(-docs.count() // settings.lane)), 100_000)
    keyed = docs.select("doc_id", F.col(text).alias("text"), F.xxhash64("doc_id", text).alias("key"))
    return keyed.repartition(lanes, "key").sortWithinPartitions("key", "doc_id").select("doc_id", "text")


def blocks(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Coded blocks of documents (doc_id, text), each task's in the order of its rows."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        size, made = 0, TaskContext.get().partitionId() << 24

        def flush() -> pa.RecordBatch:
            i, held, lengths, codes, words, counts = _block(ids, texts, settings)
            columns = [pa.array([made], pa.int64()), pa.array([i], pa.list_(pa.int64())), pa.array([held.tolist()], pa.list_(pa.bool_())), pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([codes.tobytes()], pa.binary()), pa.array([b"\n".join(words)], pa.binary()), pa.array([counts.astype(np.int64).tobytes()], pa.binary()), pa.array([len(words)], pa.int64()), pa.array([int(counts.sum())], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "held", "lengths", "codes", "words", "counts", "n_words", "training"])

        for batch in (part for whole in batches for part in slices(whole)):
            for doc, raw in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                if ids and size + len(raw) > settings.block:
                    yield flush()
                    ids, texts, size, made = [], [], 0, made + 1
                ids.append(doc)
                texts.append(raw)
                size += len(raw) + 1
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "block long, ids array<long>, held array<boolean>, lengths array<long>, codes binary, words binary, counts binary, n_words long, training long")


def _bucket_order(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a vocabulary by bucket, and where buckets 0, 1, ... begin in it."""
    bucket = np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words)).astype(np.int64) * buckets >> 32
    return np.argsort(bucket, kind="stable"), np.searchsorted(np.sort(bucket), np.arange(buckets + 1))


_PACKED = "bucket long, member long, words binary, counts binary"


def packed(coded: DataFrame, buckets: int) -> DataFrame:
    """(bucket, member: the block, words joined by line ends, counts) of all blocks."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = row["words"].split(b"\n"), np.frombuffer(row["counts"], np.int64)
                order, edges = _bucket_order(words, buckets)
                some = np.flatnonzero(np.diff(edges)).tolist()
                parts = [order[edges[b] : edges[b + 1]] for b in some]
                columns = [pa.array(some, pa.int64()), pa.array([row["block"]] * len(some), pa.int64()), pa.array([b"\n".join([words[k] for k in p.tolist()]) for p in parts], pa.binary()), pa.array([counts[p].tobytes() for p in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "member", "words", "counts"])

    return coded.select("block", "words", "counts").mapInArrow(run, _PACKED)


def _added(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of packed rows: distinct words, their sums, each place's number among them, and where rows end."""
    lists = [w.split(b"\n") for w in table.column("words").to_pylist()]
    coded = pa.array(itertools.chain.from_iterable(lists), pa.binary()).dictionary_encode()
    at = coded.indices.to_numpy()
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
    sums = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(sums, at, counts)
    return coded.dictionary, sums, at, np.cumsum([len(x) for x in lists])


_TOTALS = "bucket long, member long, totals binary, words binary, v long, n long"


def totals(rows: DataFrame, settings: Settings, n_members: int) -> DataFrame:
    """The global count of every place of packed rows: (bucket, member, totals); and for each bucket a row without member: its
    distinct training words (v), their tokens (n), and words of count `least` and more with their totals."""

    def final(table: pa.Table) -> pa.Table:
        words, sums, at, ends = _added(table)
        often = np.flatnonzero(sums >= settings.least)
        often = often[np.argsort(-sums[often], kind="stable")]
        parts = np.split(sums[at], ends[:-1])
        bucket = table.column("bucket")[0].as_py()
        n = len(parts)
        return pa.table({
            "bucket": pa.array([bucket] * (n + 1), pa.int64()), "member": pa.concat_arrays([*table.column("member").chunks, pa.array([None], pa.int64())]),
            "totals": pa.array([*(p.tobytes() for p in parts), sums[often].tobytes()], pa.binary()), "words": pa.array([None] * n + [b"\n".join(words.take(pa.array(often)).to_pylist())], pa.binary()),
            "v": pa.array([None] * n + [int((sums > 0).sum())], pa.int64()), "n": pa.array([None] * n + [int(sums.sum())], pa.int64()),
        })

    def together(table: pa.Table) -> pa.Table:
        words, sums, _, _ = _added(table)
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "member": table.column("over").slice(0, 1), "words": pa.array([b"\n".join(words.to_pylist())], pa.binary()), "counts": pa.array([sums.tobytes()], pa.binary())})

    def shared(own: pa.Table, above: pa.Table) -> pa.Table:
        known = dict(zip(above.column("words")[0].as_py().split(b"\n"), np.frombuffer(above.column("totals")[0].as_py(), np.int64).tolist(), strict=True))
        parts = [np.array([known[w] for w in x.split(b"\n")], np.int64).tobytes() for x in own.column("words").to_pylist()]
        none = pa.nulls(len(parts), pa.int64())
        return pa.table({"bucket": own.column("bucket"), "member": own.column("member"), "totals": pa.array(parts, pa.binary()), "words": pa.nulls(len(parts), pa.binary()), "v": none, "n": none})

    if n_members <= settings.group:
        return rows.groupBy("bucket").applyInArrow(final, _TOTALS)
    over = F.pmod(F.xxhash64("member"), F.lit(-(-n_members // settings.group)))
    rows = written(rows.withColumn("over", over), "packed")
    grouped = written(rows.groupBy("bucket", "over").applyInArrow(together, _PACKED), "grouped")
    found = written(totals(grouped, settings, -(-n_members // settings.group)), "totals")
    above = grouped.join(found.where("member is not null").select("bucket", "member", "totals"), ["bucket", "member"]).select("bucket", F.col("member").alias("over"), "words", "totals")
    own = rows.groupBy("bucket", "over").cogroup(above.groupBy("bucket", "over")).applyInArrow(shared, _TOTALS)
    return own.unionByName(found.where("member is null"))


def frequent(found: DataFrame, settings: Settings) -> tuple[list[tuple[bytes, int]], int, int]:
    """The words with vectors and their counts (settings.vocabulary rows at most), distinct training words, and training tokens."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["totals"], np.int64)[: settings.vocabulary]
                words = row["words"].split(b"\n")[: len(counts)]
                yield pa.RecordBatch.from_arrays([pa.array(words if len(counts) else [], pa.binary()), pa.array(counts)], names=["word", "count"])

    stats = found.where("member is null")
    sums = stats.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    top = stats.select("words", "totals").mapInArrow(run, "word binary, count long").orderBy(F.desc("count"), "word").limit(settings.vocabulary).collect()
    return [(bytes(r.word), r["count"]) for r in top], sums.v or 0, sums.n or 0


def _added_rows(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that occur, and the sums of their rows. Places are below 2 ** 16 (sorted by digits) or sorted as they are."""
    small = at.astype(np.uint16) if len(at) and at.max() < 1 << 16 else at
    order = np.argsort(small, kind="stable")
    ordered = at[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.add.reduceat(rows[order], first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -30, 30)))


class Model:
    """Parameters. Words with vectors have places 0 to n - 1 by frequency; n stands for any other word, n + 1 for a text's start.
    Class 0 holds the other words, class 1 + place // span the rest."""

    def __init__(self, counts: np.ndarray, others: int, settings: Settings):
        """counts: of the words with vectors, most frequent first; others: training tokens without one."""
        rng, n, d = np.random.default_rng(settings.seed), len(counts), settings.width
        self.settings, self.n, self.span = settings, n, max(1, int(np.ceil(n**0.5)))
        classes = np.arange(n) // self.span + 1
        mass = np.bincount(classes, counts, minlength=1).astype(float)
        mass[0] = others
        self.class_logs = np.log((mass + 1) / (mass + 1).sum()).astype(np.float32)
        self.word_logs = (np.log(counts) - np.log(mass[classes])).astype(np.float32) if n else np.zeros(0, np.float32)
        self.edges = np.concatenate([[0.0], np.cumsum(counts)])  # where words stand on the line of all their tokens
        self.context = rng.normal(0, 0.1, (n + 2, d)).astype(np.float32)
        self.weights = np.ones((2, d), np.float32)
        self.classes = np.concatenate([rng.normal(0, 0.1, (len(mass), d)), self.class_logs[:, None]], axis=1).astype(np.float32)
        self.words = np.concatenate([rng.normal(0, 0.1, (n, d)), self.word_logs[:, None]], axis=1).astype(np.float32)

    #: Vectors by word or class (the last column of classes and words is the bias), and what all share.
    NAMES = ("context", "classes", "words", "weights")

    def class_of(self, place: np.ndarray) -> np.ndarray:
        return np.where(place < self.n, place // self.span + 1, 0)

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """What the contexts predict, with a one for the bias."""
        out = np.ones((len(one), self.settings.width + 1), np.float32)
        np.multiply(self.context[one], self.weights[0], out=out[:, :-1])
        out[:, :-1] += self.context[two] * self.weights[1]
        return out

    def trained(self, one: np.ndarray, two: np.ndarray, place: np.ndarray, rng: np.random.Generator) -> Model:
        """A copy after one pass of noise-contrastive estimation, steps scaled as Adagrad does."""
        own = Model.__new__(Model)
        own.__dict__.update(self.__dict__)
        for k in self.NAMES:
            setattr(own, k, getattr(self, k).copy())
        sums = {k: np.ones_like(getattr(own, k)) for k in self.NAMES}
        step = own.settings.batch
        for at in rng.permutation(np.arange(0, len(place), step)).tolist():
            own._step(one[at : at + step], two[at : at + step], place[at : at + step], rng, sums)
        return own

    def _step(self, one: np.ndarray, two: np.ndarray, place: np.ndarray, rng: np.random.Generator, sums: dict) -> None:
        s, d = self.settings, self.settings.width
        q = self.predicted(one, two)
        # classes against noise classes, shared by the batch
        cls = self.class_of(place)
        p = np.exp(self.class_logs.astype(float))
        noise = rng.choice(len(p), s.noise, p=p / p.sum())
        level = np.float32(np.log(s.noise))
        up = _sigmoid(self.class_logs[cls] + level - np.einsum("ij,ij->i", q, self.classes[cls]))
        down = -_sigmoid(q @ self.classes[noise].T - (self.class_logs[noise] + level))
        gq = up[:, None] * self.classes[cls, :d] + down @ self.classes[noise, :d]
        self._move("classes", sums, np.concatenate([cls, noise]), np.concatenate([up[:, None] * q, down.T @ q]))
        # words against noise words of their class
        some = np.flatnonzero(cls)
        if len(some):
            word, k, own = place[some], s.own_noise, q[some]
            low, high = self.edges[(cls[some] - 1) * self.span], self.edges[np.minimum(cls[some] * self.span, self.n)]
            others = np.searchsorted(self.edges, low + rng.random((k, len(some))) * (high - low), side="right") - 1
            others = np.clip(others, (cls[some] - 1) * self.span, np.minimum(cls[some] * self.span, self.n) - 1)
            level = np.float32(np.log(k))
            up = _sigmoid(self.word_logs[word] + level - np.einsum("ij,ij->i", own, self.words[word]))
            vectors = self.words[others]
            down = -_sigmoid(np.einsum("ij,kij->ki", own, vectors) - (self.word_logs[others] + level))
            gq[some] += up[:, None] * self.words[word, :d] + np.einsum("ki,kij->ij", down, vectors[:, :, :d])
            self._move("words", sums, np.concatenate([word, others.reshape(-1)]), np.concatenate([up[:, None] * own, (down[:, :, None] * own).reshape(-1, d + 1)]))
        ca, cb = self.context[one], self.context[two]
        shared = np.stack([(gq * ca).sum(axis=0), (gq * cb).sum(axis=0)])
        self._move("context", sums, np.concatenate([one, two]), np.concatenate([gq * self.weights[0], gq * self.weights[1]]))
        sums["weights"] += shared * shared
        self.weights = self.weights + np.float32(s.rate) * shared / np.sqrt(sums["weights"])

    def _move(self, name: str, sums: dict, at: np.ndarray, rows: np.ndarray) -> None:
        places, g = _added_rows(at, rows)
        own, square = getattr(self, name), sums[name]
        square[places] += g * g
        own[places] += np.float32(self.settings.rate) * g / np.sqrt(square[places])

    def class_normalisers(self, one: np.ndarray, two: np.ndarray, most: int = 1 << 15) -> np.ndarray:
        """log of the classes' sum for each token; each pair of contexts is worked out once."""
        pairs, back = np.unique(one.astype(np.int64) * (self.n + 2) + two, return_inverse=True)
        out = np.empty(len(pairs), np.float32)
        for at in range(0, len(pairs), most):
            own = pairs[at : at + most]
            out[at : at + most] = _log_sums(self.predicted(own // (self.n + 2), own % (self.n + 2)) @ self.classes.T)
        return out[back]

    def log_probability(self, one: np.ndarray, two: np.ndarray, place: np.ndarray, most: int = 1 << 16) -> np.ndarray:
        """Natural log-probabilities of places (n: of all other words together); contexts: the word before, and the one before that."""
        out = -self.class_normalisers(one, two).astype(np.float64)
        cls = self.class_of(place)
        for at in range(0, len(place), most):
            cut = slice(at, at + most)
            q, own = self.predicted(one[cut], two[cut]), cls[cut]
            out[cut] += np.einsum("ij,ij->i", q, self.classes[own])
            order = np.argsort(own.astype(np.uint16) if len(self.classes) < 1 << 16 else own, kind="stable")
            edges = np.searchsorted(own[order], np.arange(1, len(self.classes) + 1))
            for c, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True), 1):
                if b > a:
                    rows = order[a:b]
                    scores = q[rows] @ self.words[(c - 1) * self.span : c * self.span].T
                    inner = scores[np.arange(b - a), place[cut][rows] - (c - 1) * self.span]
                    out[at + rows] += inner - _log_sums(scores)
        return out


def _log_sums(scores: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials by row; scores are overwritten."""
    top = scores.max(axis=1)
    scores -= top[:, None]
    np.exp(scores, out=scores)
    return np.log(scores.sum(axis=1)) + top


def _positions(classes: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the one before that; `start` at a text's start."""
    one, two = np.concatenate([[start], classes[:-1]]), np.concatenate([[start, start], classes[:-2]])[: len(classes)]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    one[first] = start
    two[first] = start
    later = first + 1
    two[later[lengths > 1]] = start
    return one, two


def _places(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((known.get(w, len(known)) for w in words), np.int64, len(words))


_SUMS = "part long, context binary, classes binary, words binary, weights binary, by_word binary, by_class binary"


def trained(coded: DataFrame, model: Model, top: list[tuple[bytes, int]], training: int) -> Model:
    """One pass over all training tokens, each block by itself, and the average: of a word's vectors by its tokens, of a class's by
    those of the class. Sums meet 32 at a time."""
    shared, settings = coded.sparkSession.sparkContext.broadcast((model, {w: k for k, (w, _) in enumerate(top)})), model.settings
    names = [x.split()[0] for x in _SUMS.split(", ")]

    def row(part: int, held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in held)], names=names)

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, known = shared.value
        held: list[np.ndarray] | None = None
        for batch in batches:
            for block in range(batch.num_rows):
                get = lambda name: batch.column(name)[block].as_py()  # noqa: B023, E731
                place = _places(get("words").split(b"\n"), known)[np.frombuffer(get("codes"), np.int32)]
                lengths = np.array(get("lengths"), np.int64)
                keep = np.repeat(~np.array(get("held"), bool), lengths)
                if not keep.any():
                    continue
                one, two = (x[keep] for x in _positions(place, lengths, start.n + 1))
                own = start.trained(one, two, place[keep], np.random.default_rng([settings.seed, get("block")]))
                by_word = np.bincount(np.concatenate([place[keep], one[one > start.n]]), minlength=start.n + 2).astype(float)
                by_class = np.bincount(start.class_of(place[keep]), minlength=len(start.classes)).astype(float)
                each = (by_word[:, None], by_class[:, None], by_word[: start.n, None], by_class.sum())
                more = [*((getattr(own, k) - getattr(start, k)).astype(np.float64) * w for k, w in zip(Model.NAMES, each, strict=True)), by_word, by_class]
                held = more if held is None else [a + b for a, b in zip(held, more, strict=True)]
        if held is not None:
            yield row(TaskContext.get().partitionId(), held)

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        held = [np.sum([np.frombuffer(x, np.float64) for x in table.column(k).to_pylist()], axis=0) for k in names[1:]]
        return pa.Table.from_batches([row(table.column("part")[0].as_py() // 32, held)])

    tasks = max(1, -(-training // settings.train))
    parts, n = coded.select("block", "lengths", "held", "codes", "words").coalesce(tasks).mapInArrow(run, _SUMS), tasks
    while n > 1:
        parts, n = parts.groupBy(F.floor(F.col("part") / 32).alias("over")).applyInArrow(add, _SUMS), -(-n // 32)
    got = parts.collect()  # one row
    if got:
        each = [np.frombuffer(got[0][k], np.float64) for k in names[1:]]
        weight = (each[4][:, None], each[5][:, None], each[4][: model.n, None], each[5].sum())
        for k, total, w in zip(Model.NAMES, each, weight, strict=False):
            start = getattr(model, k)
            setattr(model, k, (start + total.reshape(start.shape) / np.maximum(w, 1)).astype(np.float32))
    return model


def scores(known: DataFrame, model: Model, top: list[tuple[bytes, int]], buckets: int, tokens: int, words: int) -> DataFrame:
    """One row a document: held_out, n_tokens, n_known, train_tokens, base_score and score.

    known: blocks with totals by bucket; tokens, words: training tokens and distinct ones.
    """
    shared = known.sparkSession.sparkContext.broadcast((model, {w: k for k, (w, _) in enumerate(top)}))
    rest = tokens - sum(c for _, c in top) + words - len(top) + 1  # add-one within the class of words without a vector
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, places = shared.value
        for batch in batches:
            for block in range(batch.num_rows):
                get = lambda name: batch.column(name)[block].as_py()  # noqa: B023, E731
                local, code, lengths = get("words").split(b"\n"), np.frombuffer(get("codes"), np.int32), np.array(get("lengths"), np.int64)
                order, _ = _bucket_order(local, buckets)
                count = np.empty(len(local), np.int64)
                count[order] = np.concatenate([np.frombuffer(x["totals"], np.int64) for x in sorted(get("found"), key=lambda x: x["bucket"])])
                place = _places(local, places)
                base = np.log10((count + 1) / (tokens + words + 1))
                share = np.where(place == own.n, np.log10((count + 1) / rest), 0)
                one, two = _positions(place[code], lengths, own.n + 1)
                value = own.log_probability(one, two, place[code]) / np.log(10) + share[code]
                first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                sums = lambda x: np.add.reduceat(x, first)  # noqa: B023, E731
                columns = [pa.array(get("ids"), pa.int64()), pa.array(get("held"), pa.bool_()), pa.array(lengths), pa.array(sums((count > 0)[code].astype(np.int64))), pa.array(np.full(len(lengths), tokens)), pa.array(sums(base[code])), pa.array(sums(value))]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return known.mapInArrow(run, schema)


def scored(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, Model]:  # noqa: B008
    """Scores of every document, and the model; documents whose crc32 falls in the held-out class don't train it."""
    coded = written(blocks(laned(docs, settings), settings), "blocks")
    size = coded.agg(F.count("*").alias("blocks"), F.sum("n_words").alias("words"), F.sum("training").alias("training")).first()
    buckets = max(1, min(8192, -(-(size.words or 0) // settings.bucket)))
    found = written(totals(packed(coded, buckets), settings, size.blocks), "totals")
    top, words, tokens = frequent(found, settings)
    held = np.array([c for _, c in top], float)
    model = trained(coded, Model(held, int(tokens - held.sum()), settings), top, size.training or 0)
    own = found.where("member is not null").groupBy(F.col("member").alias("block")).agg(F.collect_list(F.struct("bucket", "totals")).alias("found"))
    known = coded.select("block", "ids", "held", "lengths", "codes", "words").join(own, "block")
    return scores(known, model, top, buckets, tokens, words), model
