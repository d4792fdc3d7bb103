"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming inverse.

The merges are compiled to a nondeterministic transducer. It reads bytes; a state is the last token
emitted and the bytes of the token being read. It may emit a token v after u only where the merges,
applied to the bytes of u and v together, give u and v again. A sequence in which all neighbours agree
so is the sequence that the merges give for the whole, so one run at most survives each prefix, and
its runs are told apart after no more bytes than the longest token has.

`Transducer` determinises it while it reads: a deterministic state holds the runs still possible,
without the tokens that all of them begin with; these have been emitted. A step is built when it is
met for the second time. States and steps are kept in a table of bounded size; when it is full, what is off it is followed run by
run, and after many such pieces it starts anew, so it keeps to what is frequent now.

Cases: null text is empty text and gives no token; texts and words of any length take time in
proportion; repeated rows and clashing column names are left as they are (columns are added or
replaced by name); an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEPT, settled, slices, strings


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a .tiktoken file: base64 and rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def _trie(ranks: dict[bytes, int]) -> dict[int, tuple[int, int, bool]]:
    """All tokens by byte: node | byte -> (node, token that ends there or -1, whether tokens go on). Nodes are multiples of 256, the
    root is 0."""
    numbers: dict[int, int] = {}
    ends: dict[int, int] = {}
    inner = set()
    for token, rank in ranks.items():
        node = 0
        for byte in token:
            inner.add(node)
            node = numbers.setdefault(node | byte, (len(numbers) + 1) << 8)
        ends[node] = rank
    return {step: (node, ends.get(node, -1), node in inner) for step, node in numbers.items()}


class _State:
    """The runs still possible, the longest-read first: (tokens not yet emitted, trie node of the next token so far)."""

    __slots__ = ("last", "runs", "steps")

    def __init__(self, last: int, runs: tuple[tuple[tuple[int, ...], int], ...]):
        self.last, self.runs, self.steps = last, runs, {}


#: Stands for a step met once and not yet built.
_MET = ((), ())


class Transducer:
    """Encodes one piece of text (a match of the split pattern) at a time."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 120_000, max_pairs: int = 400_000, renew: int = 4_000_000, short: int = 48):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.trie = _trie(ranks)
        self.max_states, self.max_pairs, self.renew, self.short = max_states, max_pairs, renew, short
        self._pairs: dict[int, bool] = {}
        self._split: dict = {}
        self._reset()

    def _reset(self) -> None:
        self._states: dict = {}
        self.full, self._missed = False, 0
        if not gc.isenabled():
            gc.collect()  # states may point at each other
        self._start = self._states[-1, (((), 0),)] = _State(-1, (((), 0),))

    def _merged(self, piece: bytes, below: int = 1 << 60) -> list[bytes]:
        """The merges of rank under `below` applied to a short piece in the order of their ranks."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes a token, None for a single byte; False if merges don't make it, or not from lower ranks."""
        found = self._split.get(token, 0)
        if found == 0:
            raw = self.bytes_of[token]
            parts = self._merged(raw, token)
            found = None if len(raw) == 1 else (parts[0], parts[1]) if len(parts) == 2 and max(self._rank(x) for x in parts) < token else False
            self._split[token] = found
        return found

    def _rank(self, part: bytes) -> int:
        """When a part is made: its rank, single bytes before all merges."""
        return -1 if len(part) == 1 else self.ranks.get(part, 1 << 60)

    def _may_follow(self, u: int, v: int) -> bool:
        """Whether v may be emitted after u (-1: first).

        Going back through the merges that made u and v, the last part of u and the first of v stand side by side from when
        both are made until one is merged on. A merge of the two with a rank before that would join u and v.
        """
        if len(self._pairs) >= self.max_pairs:
            self._pairs.clear()
        alone = self._halves(v) is not False or self._merged(self.bytes_of[v]) == [self.bytes_of[v]]
        found = self._pairs[u << 32 | v] = alone and (u < 0 or self._apart(u, v))
        return found

    def _apart(self, u: int, v: int) -> bool:
        left, right, left_ends, right_ends = self.bytes_of[u], self.bytes_of[v], 1 << 60, 1 << 60
        ranks = self.ranks
        while True:
            joined = ranks.get(left + right)
            if joined is not None and joined < left_ends and joined <= right_ends:
                return False
            made, other = self._rank(left), self._rank(right)
            if made < 0 and other < 0:
                return True
            halves = self._halves(made if made > other else other)
            if halves is False:  # merges out of order: apply them
                both = self.bytes_of[u] + self.bytes_of[v]
                return self._merged(both) == [self.bytes_of[u], self.bytes_of[v]]
            if made > other:
                left, left_ends = halves[1], made
            else:
                right, right_ends = halves[0], other

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        """Build the step from a state for one byte."""
        trie, pairs = self.trie, self._pairs
        runs, ended, last = [], None, state.last
        for pending, node in state.runs:
            hit = trie.get(node | byte)
            if hit is None:
                continue
            node, token, open_ = hit
            if token >= 0 and ended is None:
                u = pending[-1] if pending else last
                fits = pairs.get(u << 32 | token)
                if self._may_follow(u, token) if fits is None else fits:
                    ended = (*pending, token)
            if open_:
                runs.append((pending, node))
        if ended is not None:
            runs.append((ended, 0))
        elif not runs:
            raise ValueError(f"byte {byte} is in no token")
        emitted = runs[0][0]
        if emitted:
            n = len(emitted)
            for pending, _ in runs:
                while pending[:n] != emitted[:n]:
                    n -= 1
            emitted = emitted[:n]
            if n:
                last, runs = emitted[-1], [(pending[n:], node) for pending, node in runs]
        key = (last if any(not pending for pending, _ in runs) else -1, tuple(runs))
        found = self._states.get(key)
        if found is None:
            found = _State(*key)
            if self.full:  # used once, not kept
                return found, emitted
            self._states[key] = found
            self.full = len(self._states) >= self.max_states
        then = state.steps[byte] = (found, emitted)
        return then

    def _run_on(self, state: _State, rest: bytes) -> tuple[int, ...]:
        """The tokens from a state to the end of a short rest, without building states."""
        step, fitting = self.trie.get, self._pairs.get
        runs = [(pending, (pending[-1] if pending else state.last) << 32, node) for pending, node in state.runs]
        for byte in rest:
            then, ended = [], None
            for pending, u, node in runs:
                hit = step(node | byte)
                if hit is not None:
                    node, token, open_ = hit
                    if token >= 0 and ended is None:
                        fits = fitting(u | token)
                        if self._may_follow(u >> 32, token) if fits is None else fits:
                            ended = ((*pending, token), token << 32, 0)
                    if open_:
                        then.append((pending, u, node))
            if ended is not None:
                then.append(ended)
            runs = then
        if not runs or runs[-1][2]:
            raise ValueError("a byte of the text is in no token")
        return runs[-1][0]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        state, out, short, k = self._start, [], len(piece) <= self.short, 0
        for byte in piece:
            step = state.steps.get(byte)
            if step is None or step is _MET:
                if short and (step is None or self.full):  # a step is built when it is met again: most are not
                    if not self.full:
                        state.steps[byte] = _MET
                    else:
                        self._missed += 1
                        if self._missed >= self.renew:
                            self._reset()
                    return (*out, *self._run_on(state, piece[k:]))
                step = self._step(state, byte)
            state, emitted = step
            if emitted:
                out += emitted
            k += 1
        tail, node = state.runs[-1]
        if node and piece:
            raise ValueError("a byte of the text is in no token")
        return (*out, *tail)


class Encoder:
    """Splits text by the pattern and encodes every piece; keeps tables of pieces met before, of bounded size.

    When the newer table is full it becomes the older one; what is met there again moves up.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = 200_000):
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.max_pieces = max_pieces
        self._new: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}

    def _met(self, piece: str) -> tuple[int, ...]:
        ids = self._old.get(piece)
        if ids is None:
            ids = self.transducer.encode_piece(piece.encode())
        if len(piece) <= 64:
            if len(self._new) >= self.max_pieces:
                self._old, self._new = self._new, {}
            self._new[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        new, out = self._new, []
        for piece in self.split(text):
            ids = new.get(piece)
            if ids is None:
                ids = self._met(piece)
                new = self._new
            out += ids
        return out


# The state machine of UTF-8. A state says what may come next: 0 a character's start; 1, 2, 3 so many
# continuation bytes; 4 and 5 two, of which the first is narrowed (after E0, ED); 6 and 7 three, of which
# the first is narrowed (after F0, F4); 8 ill-formed.
BAD = 8
_NARROW = {4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}


def utf8_step(state: int, byte: int) -> int:
    if state == 0:
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return 1
        if 0xE0 <= byte <= 0xEF:
            return {0xE0: 4, 0xED: 5}.get(byte, 2)
        if 0xF0 <= byte <= 0xF4:
            return {0xF0: 6, 0xF4: 7}.get(byte, 3)
        return BAD
    if state in _NARROW:
        low, high, then = _NARROW[state]
        return then if low <= byte <= high else BAD
    return state - 1 if state != BAD and 0x80 <= byte <= 0xBF else BAD


class Decoder:
    """The machine lifted from bytes to tokens: steps[s][t] is the state after token t from state s, so tokens that begin
    and end between characters are passed over in one go."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.steps = np.full((BAD + 1, len(self.tokens)), BAD, np.uint8)
        table = [[utf8_step(s, b) for b in range(256)] for s in range(BAD + 1)]
        for rank, token in enumerate(self.tokens):
            for state in range(BAD):
                now = state
                for byte in token:
                    now = table[now][byte]
                self.steps[state, rank] = now

    def state_after(self, ids: np.ndarray, state: int = 0) -> int:
        """The machine's state after the tokens; BAD stays."""
        at = 0
        for k in np.flatnonzero(self.steps[0][ids]).tolist():
            if state and k > at:  # a token of whole characters inside a character
                return BAD
            state, at = int(self.steps[state, ids[k]]), k + 1
            if state == BAD:
                return BAD
        return BAD if state and at < len(ids) else state


class Stream:
    """Decodes one stream of token ids, a chunk at a time: complete characters are given out, a cut one waits for its rest.

    Ill-formed bytes become U+FFFD, and so does a cut end; `well_formed` says whether any did.
    """

    def __init__(self, decoder: Decoder):
        self.decoder, self.state, self.held, self.well_formed = decoder, 0, b"", True

    def feed(self, ids: np.ndarray) -> bytes:
        """The bytes of the characters that are complete with these ids."""
        raw = b"".join(map(self.decoder.tokens.__getitem__, ids.tolist()))
        then = self.decoder.state_after(ids, self.state)
        if then == BAD:
            return self._mended(raw)
        whole = self.held + raw
        self.state = then
        cut = 0 if then == 0 else next(k for k in range(1, 4) if whole[-k] >= 0xC0)  # back to where the open character starts
        self.held = whole[len(whole) - cut :]
        return whole[: len(whole) - cut]

    def _mended(self, raw: bytes) -> bytes:
        """The same by single steps, for a chunk with ill-formed bytes."""
        out, held, state, self.well_formed = bytearray(), bytearray(self.held), self.state, False
        for byte in raw:
            now = utf8_step(state, byte)
            if now == BAD:
                if held:
                    out += _MARK
                    held.clear()
                now = utf8_step(0, byte)
                if now == BAD:
                    out += _MARK
                    state = 0
                    continue
            held.append(byte)
            state = now
            if state == 0:
                out += held
                held.clear()
        self.state, self.held = state, bytes(held)
        return bytes(out)

    def end(self) -> bytes:
        left, self.held, self.state = self.held, b"", 0
        self.well_formed &= not left
        return _MARK if left else b""


_MARK = "\N{REPLACEMENT CHARACTER}".encode()


def decoded(decoder: Decoder, ids: np.ndarray, chunk: int = 1 << 16) -> tuple[bytes, bool]:
    """A whole stream through the machine, in chunks: its bytes, and whether they were well-formed."""
    stream = Stream(decoder)
    out = [stream.feed(ids[at : at + chunk]) for at in range(0, len(ids), chunk)]
    out.append(stream.end())
    return b"".join(out), stream.well_formed


class Codec:
    """An encoder and a decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoder, self.decoder = Encoder(ranks, pattern), Decoder(ranks)


def _kept(kind: type, ranks: bytes, *more: str):
    """A worker's encoder or decoder, kept for its next task with what its tables have learnt.

    One at a time is kept, until the worker turns to another operator; its tables have fixed bounds (some 200 MB in all, most of it
    states, neighbours and pieces).
    """
    key = (kind, hash(ranks), len(ranks), *more)
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = kind(parse_ranks(ranks), *more)
    return KEPT[key]


def _lists(rows: list[list[int]]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.asarray(x, np.int32) for x in rows]) if rows else np.zeros(0, np.int32)))


def _streams(lists: pa.ListArray) -> list[np.ndarray]:
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _decoded_columns(decoder: Decoder, streams: list[np.ndarray]) -> list[pa.Array]:
    rows = [decoded(decoder, x) for x in streams]
    return [pa.array([x for x, _ in rows], pa.binary()), pa.array([fine for _, fine in rows], pa.bool_())]


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "token_ids", keep_text: bool = False, out: str | None = None) -> DataFrame:
    """docs with the token ids (array<int>) of the whole text instead of the text; the other columns stay.

    out: a column for the bytes that the ids decode to (and `well_formed` beside it), decoded in the same worker from the ids alone.
    ranks: contents of a .tiktoken file, broadcast (it has the size of the vocabulary).
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    made = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(out, T.BinaryType(), False), T.StructField("well_formed", T.BooleanType(), False)] if out else [])]
    kept = [f for f in docs.schema.fields if f.name not in {f.name for f in made} and (keep_text or f.name != text)]
    schema = T.StructType([*kept, *made])

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _kept(Codec, shared.value, pattern)
        gc.disable()  # the tables are large and rarely hold cycles; a full table collects
        try:
            for batch in (part for whole in batches for part in slices(whole, 256, keep=True)):
                lists = _lists([codec.encoder.encode(x) for x in strings(batch.column(text))])
                more = _decoded_columns(codec.decoder, _streams(lists)) if out else []
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), lists, *more], names=[f.name for f in schema.fields])
        finally:
            gc.enable()

    read = dict.fromkeys([*(f.name for f in kept), text])
    return docs.select(*(f"`{c}`" for c in read)).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks: bytes, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """The bytes of the ids instead of the ids, and whether the state machine found them well-formed."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    kept = [f for f in encoded.schema.fields if f.name not in (ids, out, "well_formed")]
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType(), False), T.StructField("well_formed", T.BooleanType(), False)])

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _kept(Decoder, shared.value)
        for batch in (part for whole in batches for part in slices(whole, 256, keep=True)):
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *_decoded_columns(decoder, _streams(batch.column(ids)))], names=[f.name for f in schema.fields])

    return encoded.mapInArrow(run, schema)


def id_digest(ids: str = "token_ids"):
    """Hex digest of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)
