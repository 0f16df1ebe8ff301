"""A hashed maximum-entropy language model with class-factored softmax, and the unigram base.

P(token | history) = P(class | history) * P(subclass | class, history) * P(token | subclass). Each of
the most frequent tokens is a subclass of its own, all others are classed by a hash of their ending.
Both P(class | history) and P(subclass | class, history) are a softmax over hashed features, those
of the second taken together with the class: the last token, the last two, the token before the
last (a skip), and a constant. P(token | subclass) is the maximum-entropy solution for its only
feature, the token itself: smoothed relative frequency, with one place for tokens not seen.

Training takes all documents that aren't held out, PASSES times: in each round the tasks start from
the broadcast weights (a fixed size), walk their share of the documents in minibatches, and their
weights are summed per slice by a shuffle and averaged.

Token counts are a distributed table of all distinct tokens. The counts of the COMMON most frequent
ones are broadcast (a fixed size); each block of documents gets those of its other tokens by a join
on the token, so no machine holds the vocabulary and no frequent token is in the join.

Defined results: null and empty texts are an end token alone; a null doc_id is in training and
its crc32 is that of an empty string; repeated rows count and are scored each; very long texts are
scored in slices of tokens; ties of frequency go by the token's bytes; without training tokens N and
V are 0; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanframe.llm.common import block_count, materialize, slices, word_numbers

HELD_OUT = (7, 2)  # crc32 of the id as text, modulo, remainder
END = b"\n"  # no word has it
OUTER = WITHIN = 16  # classes, and subclasses of each
CLASSES = OUTER * WITHIN
HEAD = 8 * WITHIN  # tokens that are subclasses of their own
TAIL = (OUTER - 8) * WITHIN
SLOTS = 1 << 14  # hashed weights of each kind of feature, for classes and for subclasses
KINDS = 3
RATE, BATCH, ROUNDS = 0.5, 2048, 3
#: Times that each document is used: a second pass fits the training texts alone (held-out scores fall).
PASSES = 1
COMMON = 1 << 16  # tokens whose counts are broadcast: those of up to COMMON_BYTES
COMMON_BYTES = 64
BLOCK_BYTES = 1 << 22


def tokens(texts: pa.Array | pa.ChunkedArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens of some texts, all tokens in a row by their numbers among those, and each text's number of tokens."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    words, at, sizes = word_numbers(pc.ascii_lower(texts))
    return [w or END for w in words], at, sizes


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(HELD_OUT[0])) == HELD_OUT[1]


class Classes:
    """Subclass (its class times WITHIN, and its place there) and feature hash of distinct tokens."""

    def __init__(self, head: list[bytes]):
        self.head = {t: k for k, t in enumerate(head)}
        self.ends: dict[bytes, int] = {}  # subclasses of endings of two bytes at most

    def __call__(self, toks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ends = [t.rstrip(b".,;:!?")[-2:] for t in toks]
        for e in set(ends).difference(self.ends):
            self.ends[e] = HEAD + xxhash.xxh32_intdigest(e) % TAIL
        cells = map(self.head.get, toks, map(self.ends.__getitem__, ends))
        return np.fromiter(cells, np.int64, len(toks)), np.fromiter(map(xxhash.xxh32_intdigest, toks), np.int64, len(toks))


class Numbers:
    """Numbers for tokens, with each one's count, subclass and hash in arrays: one lookup a distinct token, up to a bound of tokens."""

    def __init__(self, classes: Classes, counts: dict[bytes, int] | None = None):
        self.classes, self.counts = classes, counts or {}
        self._clear()

    def _clear(self) -> None:
        self.of: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.table = np.zeros((3, 0), np.int64)

    def __call__(self, toks: list[bytes], which: np.ndarray) -> np.ndarray:
        """Rows of counts, subclasses and hashes of the tokens with these places in the list."""
        if len(self.of) > 500_000:
            self._clear()
        known = len(self.of)
        at = np.fromiter(map(self.of.__getitem__, toks), np.int64, len(toks))
        if new := list(itertools.islice(self.of, known, None)):  # in the order of their numbers
            c = np.fromiter(map(self.counts.get, new, itertools.repeat(0)), np.int64, len(new))
            if len(self.of) > self.table.shape[1]:  # room for as many again
                self.table = np.concatenate([self.table[:, :known], np.zeros((3, 2 * len(self.of) - known), np.int64)], 1)
            self.table[:, known : len(self.of)] = c, *self.classes(new)
        return self.table.take(at.take(which), 1)


GOLD, WHEEL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def feature_slots(hashes: np.ndarray, starts: np.ndarray, cells: np.ndarray | None = None) -> np.ndarray:
    """Slots of each token's features, a row for each kind, by the hashes of the tokens before it in its document.

    With the tokens' subclasses, slots for subclasses: features are taken together with the class.
    """
    h = hashes.astype(np.uint64)
    one = np.concatenate([[0], h[:-1]]).astype(np.uint64)
    two = np.concatenate([[0, 0], h[:-2]]).astype(np.uint64)[: len(h)]
    one[starts] = 1
    two[starts] = 2
    second = starts + 1
    two[second[second < len(h)]] = 1
    pair = (one * GOLD ^ two) * WHEEL
    kinds = [one, two + np.uint64(7), pair]
    if cells is not None:
        own = ((cells // WITHIN + 1).astype(np.uint64)) * WHEEL
        kinds = [x * WHEEL ^ own for x in kinds]
    return np.stack([(x * GOLD >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.uint16) for x in kinds])


def _put_rows(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """into[at] = rows, each row moved as one item."""
    item = np.dtype((np.void, into.itemsize * into.shape[1]))
    into.view(item)[at, 0] = rows.view(item)[:, 0]


class Weights:
    """The weights of one softmax: a row for each slot of each kind, then the constants."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def reach(self) -> float:
        """What no logit exceeds in size."""
        most = lambda x: max(float(x.max()), -float(x.min()))
        return sum(most(self.values[k * SLOTS : (k + 1) * SLOTS]) for k in range(KINDS)) + most(self.values[KINDS * SLOTS :])

    def _logits(self, slots: np.ndarray, own: np.ndarray | int, small: bool = False) -> np.ndarray:
        z = self.values.take(slots[0], 0)
        for k in range(1, KINDS):
            z += self.values.take(slots[k].astype(np.int64) + k * SLOTS, 0)
        z += self.values[KINDS * SLOTS + own]
        if small:  # their powers are sure to be in range
            return z
        top = z.max()
        z -= top if top - z.min() < 60 else z.max(1, keepdims=True)  # one shift for all rows where none vanishes
        return z

    def log10(self, slots: np.ndarray, own: np.ndarray | int, target: np.ndarray, small: bool) -> np.ndarray:
        """log10 of the probability of each token's target."""
        z = self._logits(slots, own, small)
        right = z[np.arange(len(z)), target].astype(np.float64)
        return (right - np.log(np.einsum("ij->i", np.exp(z, out=z)).astype(np.float64))) / math.log(10)

    def descend(self, slots: np.ndarray, own: np.ndarray | int, target: np.ndarray, squares: np.ndarray) -> None:
        """One minibatch of gradient steps with rates adapted by row."""
        g = self._logits(slots, own)
        np.exp(g, out=g)
        g /= np.einsum("ij->i", g)[:, None]
        g[np.arange(len(g)), target] -= 1
        for k in range(KINDS):
            self._step(g, slots[k], k * SLOTS, squares)
        if isinstance(own, int):
            self._change(g.sum(0)[None], np.array([KINDS * SLOTS + own]), squares)
        else:
            self._step(g, own.astype(np.uint16), KINDS * SLOTS, squares)

    def _step(self, g: np.ndarray, slots: np.ndarray, offset: int, squares: np.ndarray) -> None:
        order = np.argsort(slots, kind="stable")  # a radix sort
        at = slots.take(order)
        new = np.concatenate([[True], at[1:] != at[:-1]])
        first, rest = np.flatnonzero(new), np.flatnonzero(~new)
        total = g.take(order.take(first), 0)
        if len(rest):  # most slots have one token, and need no sum
            of = np.cumsum(new).take(rest) - 1
            start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            of = of.take(start)
            _put_rows(total, of, total.take(of, 0) + np.add.reduceat(g.take(order.take(rest), 0), start, 0))
        self._change(total, at.take(first).astype(np.int64) + offset, squares)

    def _change(self, total: np.ndarray, row: np.ndarray, squares: np.ndarray) -> None:
        square = squares.take(row) + np.einsum("ij,ij->i", total, total) / total.shape[1]
        squares[row] = square
        total *= (RATE / np.sqrt(square + 1))[:, None]
        _put_rows(self.values, row, self.values.take(row, 0) - total)


class Model:
    """Both softmaxes, their weights in one array."""

    ROWS = (KINDS * SLOTS + 1, KINDS * SLOTS + OUTER)

    def __init__(self, values: np.ndarray | None = None):
        self.values = np.zeros((sum(self.ROWS), OUTER), np.float32) if values is None else values
        self.outer, self.inner = Weights(self.values[: self.ROWS[0]]), Weights(self.values[self.ROWS[0] :])
        self.squares = np.zeros(len(self.values), np.float32)

    def learn(self, hashes: np.ndarray, starts: np.ndarray, cells: np.ndarray) -> None:
        outer, inner = feature_slots(hashes, starts), feature_slots(hashes, starts, cells)
        for k in range(0, len(cells), BATCH):
            own, sub = np.divmod(cells[k : k + BATCH], WITHIN)
            self.outer.descend(outer[:, k : k + BATCH], 0, own, self.squares[: self.ROWS[0]])
            self.inner.descend(inner[:, k : k + BATCH], own, sub, self.squares[self.ROWS[0] :])

    def log10(self, hashes: np.ndarray, starts: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token's subclass."""
        outer, inner, out = feature_slots(hashes, starts), feature_slots(hashes, starts, cells), []
        small_outer, small_inner = self.outer.reach() < 60, self.inner.reach() < 60
        for k in range(0, len(cells), BATCH):
            own, sub = np.divmod(cells[k : k + BATCH], WITHIN)
            out.append(self.outer.log10(outer[:, k : k + BATCH], 0, own, small_outer) + self.inner.log10(inner[:, k : k + BATCH], own, sub, small_inner))
        return np.concatenate(out)


def _batches_of_tokens(table, numbers: Numbers):
    """Hashes of the tokens of some documents at a time, where documents start, and subclasses."""
    for part in slices(table, "text", 64):
        toks, which, sizes = tokens(part.column("text"))
        _, cells, h = numbers(toks, which)
        ends = np.cumsum(sizes)
        for k in range(0, part.num_rows, 64):
            start = ends[k] - sizes[k]
            own = slice(start, ends[min(k + 64, part.num_rows) - 1])
            yield h[own], ends[k : k + 64] - sizes[k : k + 64] - start, cells[own]


def _train_round(docs: DataFrame, weights: np.ndarray, head: list[bytes]) -> np.ndarray:
    """The mean of the weights that the tasks end with, each weighted by its tokens."""
    session = docs.sparkSession
    start = session.sparkContext.broadcast(weights)
    slices = 32

    def run(batches):
        model, numbers, n = None, Numbers(Classes(head)), 0
        for b in batches:
            model = model or Model(start.value.copy())
            for h, starts, cells in _batches_of_tokens(b, numbers):
                model.learn(h, starts, cells)
                n += len(cells)
        if n:
            # One row a slice: the change of its weights, times the tokens it rests on.
            change = ((model.values - start.value) * np.float32(n)).reshape(-1)
            parts = np.array_split(change, slices)
            yield pa.RecordBatch.from_pydict({"slice": np.arange(slices, dtype=np.int32), "n": np.full(slices, n, np.int64), "change": [p.astype("<f4").tobytes() for p in parts]})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<f4").astype(np.float64) for x in table.column("change").to_pylist())
        return pa.table({"slice": table.column("slice")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "change": pa.array([total.astype("<f8").tobytes()], pa.binary())})

    sums = docs.mapInArrow(run, "slice int, n long, change binary").groupBy("slice").applyInArrow(add, "slice int, n long, change binary").collect()
    if not sums:
        return weights
    change = np.concatenate([np.frombuffer(r["change"], "<f8") / r["n"] for r in sorted(sums, key=lambda r: r["slice"])])
    return (weights + change.reshape(weights.shape)).astype(np.float32)


def train(docs: DataFrame, head: list[bytes]) -> np.ndarray:
    """Weights of all rows of `docs` (doc_id, text), each used PASSES times."""
    weights = Model().values
    for k in range(ROUNDS * PASSES):
        weights = _train_round(docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == k % ROUNDS).select("text"), weights, head)
    return weights


#: Bytes of text whose tokens a task counts before it hands them on.
COUNTED_BYTES = 1 << 24


def _count_tokens(batches):
    """Tokens of training documents with counts, summed over as many as a task can hold."""
    for b in batches:
        for part in slices(b, 0, 64, COUNTED_BYTES):
            toks, which, _ = tokens(part.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(toks, pa.binary()), pa.array(np.bincount(which, minlength=len(toks)), pa.int64())], ["token", "c"])


def _list_tokens(common):
    """Distinct tokens of a block that are none of the common ones."""

    def run(table: pa.Table) -> pa.Table:
        found = set()
        for part in slices(table, "text", 64):
            found.update(tokens(part.column("text"))[0])
        found.difference_update(common.value)
        return pa.table({"block": np.full(len(found), table.column("block")[0].as_py(), np.int32), "token": pa.array(list(found), pa.binary())})

    return run


def _score(weights, common, head: list[bytes], total: int, distinct: int, of_cell: np.ndarray, kinds_of_cell: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        known = dict(zip(counts.column("token").to_numpy().tolist(), counts.column("n").to_numpy().tolist(), strict=True))
        known.update(common.value)
        numbers, model, out = Numbers(Classes(head), known), Model(weights.value), []
        for part in slices(docs, "text", 512, 1 << 20):
            toks, which, sizes = tokens(part.column("text"))
            c, cells, h = numbers(toks, which)
            at = np.cumsum(sizes) - sizes
            log = np.log10(c + 1.0)
            base = log - math.log10(total + 1 * (distinct + 1))
            score = log - np.log10(of_cell + kinds_of_cell + 1.0)[cells] + model.log10(h, at, cells)
            out.append([part.column("doc_id").combine_chunks(), part.column("held_out").combine_chunks(), pa.array(sizes, pa.int64()), pa.array(np.add.reduceat((c > 0).astype(np.int64), at)), pa.array(np.full(part.num_rows, total)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(score, at))])
        if not out:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.chunked_array(list(x)) for x in zip(*out, strict=True)], schema=schema)

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    n = block_count(docs, BLOCK_BYTES)
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    grouped = rows.groupBy("block")
    learnt = docs.filter(~held_out()).select("text").mapInArrow(_count_tokens, "token binary, c long")
    counts = materialize(learnt.groupBy("token").agg(F.sum("c").alias("n")), "token counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    top = counts.filter((F.col("n") > 0) & (F.octet_length("token") <= COMMON_BYTES)).orderBy(F.desc("n"), "token").limit(COMMON).collect()
    common = spark.sparkContext.broadcast({bytes(r[0]): r[1] for r in top})
    head = [bytes(r[0]) for r in top[:HEAD]]

    def celled(batches):
        classes = Classes(head)
        for b in batches:
            cells, _ = classes([bytes(t) for t in b.column(0).to_pylist()]) if b.num_rows else (np.zeros(0, np.int64), None)
            n = np.array(b.column(1), np.int64)
            yield pa.RecordBatch.from_pydict({"k": np.arange(CLASSES, dtype=np.int32), "n": np.bincount(cells, n, CLASSES).astype(np.int64), "kinds": np.bincount(cells, minlength=CLASSES)})

    by_cell = counts.filter("n > 0").mapInArrow(celled, "k int, n long, kinds long").groupBy("k").agg(F.sum("n"), F.sum("kinds")).collect()
    of_cell, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for k, n_of, kinds_of in by_cell:
        of_cell[k], kinds[k] = n_of, kinds_of
    weights = spark.sparkContext.broadcast(train(docs.filter(~held_out()), head))
    known = grouped.applyInArrow(_list_tokens(common), "block int, token binary").join(counts.hint("shuffle_hash"), "token")  # a token has one count
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return grouped.cogroup(known.groupBy("block")).applyInArrow(_score(weights, common, head, total, distinct, of_cell, kinds), ddl)
