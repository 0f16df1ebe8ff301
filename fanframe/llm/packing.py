"""Packing token sequences into windows by non-negative least squares.

Every document gives ids and an end id. Full windows are cut off first; what remains is shorter
than a window. A packer sees a stream of documents in blocks of a few million tokens. Per block
it takes the histogram of remainders, enumerates all combinations of two or three lengths that
fill a window exactly, and solves "repeats of combinations = histogram" by non-negative least
squares (multiplicative updates on the sparse columns). There are far more combinations than
lengths, so most repeats are fractions: they are rounded in a row, each to the whole number that
the sum so far passes, which keeps the number of windows and what each length is asked for. The
documents that the rounded solution asks for are taken as far as they last, and the same is done
again with the histogram of the others, until a solution fills few more windows. Residual
documents are packed by best fit, longest first; then the least filled windows are taken apart
again and cut to fill the gaps of the others. The rest, less than a window a block, is cut into
sequences of powers of two, which need no padding.

Blocks are packed where their documents are read: a narrow map, with one scan and no shuffle,
and all memory bounded by the block. Sequence ids are the partition's number times 2^33 plus a
count, hence unique.

Defined results: null and empty texts give the end id alone; a null doc_id stays null; repeated
rows are packed each; equal lengths are taken in the order of the rows; an empty table gives no
rows; other columns are never read.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fanframe.llm.common import give_back, slices, word_numbers

WINDOW = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 22  # ids of the documents that are packed together
REMEMBERED = 500_000  # chunks of text whose ids a worker remembers, some 200 bytes each
SLICE_BYTES = 1 << 21  # of texts that are encoded together
UPDATES = 60  # of a solution; it ends sooner when the residual no longer falls by a hundredth
FEW = 0.01  # a solution that places a smaller share of the rest is the last


#: Trailing characters that are pre-tokens apart from a letter or digit before them; those of special tokens are not among them.
MARKS = b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"


def _ends_apart(core: bytes) -> bool:
    """Whether marks after these bytes start a pre-token: the last character is a Latin letter or digit in lower case, too."""
    last = core[-4:].decode("utf-8", "replace")[-1:]
    return last < "\u0250" and last.lower().isalnum()


class ChunkEncoder:
    """Ids of whole texts from ids of their chunks between white space.

    The vocabulary drops white space and neither its normalizer nor its pre-tokens reach across
    it, so a text's ids are its chunks' ids in a row. Chunks repeat, and each is encoded once; one
    with marks at its end is put together from the rest and the marks. All ids that are known lie
    in one array, from which those of texts are gathered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._add([b""], [np.array([END_ID])], [np.array([1])])  # the end of a text

    def _add(self, chunks: list[bytes], ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        """Remember chunks with their ids, which come in a row."""
        self.seen.update(zip(chunks, range(len(self.seen), len(self.seen) + len(chunks)), strict=True))
        self.ids = np.concatenate([self.ids, *ids], dtype="<u4", casting="unsafe")
        self.sizes = np.concatenate([self.sizes, *sizes], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks in a row, by the chunks' numbers, and how many each has."""
        n = self.sizes.take(at)
        shift = (self.starts.take(at) - np.cumsum(n) + n).astype(np.int32)  # ids of a slice and those known are far fewer than 2^31
        where = np.repeat(shift, n)
        where += np.arange(len(where), dtype=np.int32)
        return self.ids.take(where), n

    def _learn(self, chunks: list[bytes]) -> None:
        joined, plain = [], []
        for c in chunks:
            core = c.rstrip(MARKS)
            if len(core) < len(c) and core and _ends_apart(core):
                joined.append((c, core, c[len(core) :]))
            else:
                plain.append(c)
        parts = {x for _, *both in joined for x in both}.difference(self.seen)
        self._encode(list(parts.union(plain)))
        if joined:
            pairs = np.array([(self.seen[core], self.seen[marks]) for _, core, marks in joined])
            ids, n = self._gather(pairs.ravel())
            self._add([c for c, *_ in joined if c not in parts], [ids], [n.reshape(-1, 2).sum(1)])

    def _encode(self, chunks: list[bytes]) -> None:
        words, others = [], []
        for c in chunks:
            (words if c.decode("utf-8", "replace").isalpha() else others).append(c)
        known, ids, sizes = [], [], []
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            # Words of letters are encoded as one text: the last id of each has the word-end mark.
            got = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.ends[got]) + 1
            if len(ends) == len(part):
                known += part
                ids.append(got)
                sizes.append(np.diff(ends, prepend=0))
            else:
                others += part
        for k in range(0, len(others), 4096):  # what the tokenizer returns takes far more memory than the ids
            part = others[k : k + 4096]
            got = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in part], add_special_tokens=False)]
            known += part
            ids.append(np.fromiter(itertools.chain.from_iterable(got), np.int64))
            sizes.append(np.array([len(x) for x in got], np.int64))
        self._add(known, ids, sizes)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Little-endian 32-bit ids of all texts in a row, each text's with the end id behind them, and how many each has."""
        # Case is folded anyway, but not that of special tokens, which are recognised before.
        texts = texts.fill_null("")
        chunks, which, words = word_numbers(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        if len(self.seen) > REMEMBERED:
            self._clear()
        new = [c for c in chunks if c not in self.seen]
        if new:
            self._learn(new)
        numbers = np.fromiter(map(self.seen.__getitem__, chunks), np.int64, len(chunks))
        ids, n = self._gather(numbers.take(which))
        return ids, np.diff(np.cumsum(n)[np.cumsum(words) - 1], prepend=0)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ids, n = self.encode_texts(pa.array(texts, pa.binary()).view(pa.string()))
        ends = np.cumsum(n)
        return [ids[end - k : end - 1].tobytes() for end, k in zip(ends.tolist(), n.tolist(), strict=True)]


@functools.lru_cache(2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def combinations(have: np.ndarray, window: int) -> np.ndarray:
    """All columns of two and three lengths that fill the window, out of lengths with a count; padded with 0."""
    lengths = np.flatnonzero(have)
    lengths = lengths[lengths > 0]
    out = []
    for a in lengths[lengths <= window // 2].tolist():
        # a <= b <= c; of pairs b is 0.
        b = lengths[np.searchsorted(lengths, a) : np.searchsorted(lengths, (window - a) // 2, "right")]
        c = window - a - b
        b = b[have[c] > 0]
        pair = have[window - a] > 0
        column = np.empty((len(b) + pair, 3), np.int32)
        column[:, 0] = a
        column[: len(b), 1], column[: len(b), 2] = b, window - a - b
        if pair:
            column[-1, 1:] = 0, window - a
        out.append(column)
    return np.concatenate(out) if out else np.zeros((0, 3), np.int32)


def solve(columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-negative repeats x with columns @ x close to counts, by multiplicative updates."""
    size, k = len(counts), columns.shape[1]
    target = counts.astype(float)
    target[0] = 0
    flat = columns.T.ravel().astype(np.intp)  # else each use makes a copy

    def back(v: np.ndarray) -> np.ndarray:
        return v.take(flat).reshape(k, -1).sum(0)

    def made(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.tile(x, k), size)
        out[0] = 0
        return out

    goal = back(target)
    x = goal / np.maximum(back(made(np.ones(len(columns)))), 1e-12)
    before = np.inf
    for _ in range(UPDATES):
        now = made(x)
        off = float(((now - target) ** 2).sum())
        if off > 0.98 * before:  # squares: a hundredth of the residual
            break
        before = off
        x *= goal / np.maximum(back(now), 1e-12)
    return x


def rounded(x: np.ndarray) -> np.ndarray:
    """Whole numbers whose sums in a row are those of x, rounded."""
    sums = np.floor(np.cumsum(x) + 0.5)
    return np.diff(sums, prepend=0).astype(np.int64)


def plan(rest: np.ndarray, window: int) -> tuple[list[list[int]], np.ndarray]:
    """Groups of remainders that fill a window (indexes into `rest`), and the indexes left over, longest first."""
    counts = np.bincount(rest, minlength=window)
    order = np.argsort(rest, kind="stable")
    top = np.cumsum(counts)  # members of length n are order[top[n] - left[n] : top[n]]
    left = counts.copy()
    left[0] = 0
    groups: list[list[int]] = []
    placed = len(rest)
    while placed > FEW * left.sum():
        columns, placed = combinations(left, window), 0
        repeats = rounded(solve(columns, left)) if len(columns) else np.zeros(0, np.int64)
        asked = np.flatnonzero(repeats)
        asked = asked[np.argsort(-repeats[asked], kind="stable")]
        have, first = left.tolist(), (top - left).tolist()
        for column, repeat in zip(columns[asked].tolist(), repeats[asked].tolist(), strict=True):
            lengths = [n for n in column if n]
            while repeat and all(have[n] >= lengths.count(n) for n in lengths):
                members = []
                for n in lengths:
                    members.append(int(order[first[n]]))
                    first[n] += 1
                    have[n] -= 1
                groups.append(members)
                placed += len(members)
                repeat -= 1
        left = np.array(have)
    remain = [order[top[n] - left[n] : top[n]] for n in np.flatnonzero(left)[::-1]]
    return groups, np.concatenate(remain) if remain else np.zeros(0, np.int64)


def best_fit(loose: list[int], lengths: list[int], window: int) -> list[list[int]]:
    """The loose remainders in windows, each in the one with the least room that holds it; fullest windows first."""
    rooms: list[tuple[int, int]] = []  # (room, window), in order
    bins: list[list[int]] = []
    for m in loose:
        n = lengths[m]
        k = bisect.bisect_left(rooms, (n, -1))
        room, at = rooms.pop(k) if k < len(rooms) else (window, len(bins))
        if at == len(bins):
            bins.append([])
        bins[at].append(m)
        if room > n:
            bisect.insort(rooms, (room - n, at))
    return sorted(bins, key=lambda members: -sum(lengths[m] for m in members))


def pack(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) of a block, sequences from 0, none over the window.

    Each sequence but those of power-of-two size is full.
    """
    full, rest = np.divmod(lengths, window)
    doc = np.repeat(np.arange(len(lengths)), full)
    out = [np.stack([doc, (np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)) * window, np.full(len(doc), window), np.arange(len(doc)), np.zeros(len(doc), np.int64)], 1)]
    n = len(doc)
    groups, loose = plan(rest, window)
    begin, size = (full * window).tolist(), rest.tolist()
    rows: list[tuple[int, int, int, int, int]] = []

    def whole(members: list[int]) -> int:
        """Lays remainders into sequence n; the place behind them."""
        at = 0
        for m in members:
            rows.append((m, begin[m], size[m], n, at))
            at += size[m]
        return at

    for members in groups:
        whole(members)
        n += 1
    bins = best_fit(loose.tolist(), size, window)
    used = [sum(size[m] for m in members) for members in bins]
    # The fullest windows stay, as many as the others can fill up.
    stay, gaps, others = 0, 0, sum(used)
    while stay < len(bins) and gaps + window - used[stay] <= others - used[stay]:
        gaps += window - used[stay]
        others -= used[stay]
        stay += 1
    places = []  # (sequence, offset, room), in order
    for members in bins[:stay]:
        at = whole(members)
        if at < window:
            places.append((n, at, window - at))
        n += 1
    tail = others - gaps
    for room in [window] * (tail // window) + [1 << bit for bit in reversed(range(window.bit_length())) if tail % window >> bit & 1]:
        places.append((n, 0, room))
        n += 1
    k, done = 0, 0  # the place, and what is filled of it
    for m in [m for members in bins[stay:] for m in members]:
        start = 0
        while start < size[m]:
            seq, at, room = places[k]
            length = min(size[m] - start, room - done)
            rows.append((m, begin[m] + start, length, seq, at + done))
            start, done = start + length, done + length
            if done == room:
                k, done = k + 1, 0
    out.append(np.array(rows, np.int64).reshape(-1, 5))
    return np.concatenate(out)


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def emit(docs: list[pa.Array], packed: list[np.ndarray], sizes: list[np.ndarray], base: int):
        ids, lengths = np.concatenate(packed), np.concatenate(sizes)
        rows = pack(lengths, window)
        begin = (np.cumsum(lengths) - lengths).take(rows[:, 0]) + rows[:, 1]
        crc = [zlib.crc32(ids[b : b + n]) for b, n in zip(begin.tolist(), rows[:, 2].tolist(), strict=True)]
        doc = pa.concat_arrays(docs).cast(pa.int64()).take(pa.array(rows[:, 0]))
        yield pa.RecordBatch.from_arrays([doc, pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array(crc, pa.int64()), pa.array(lengths[rows[:, 0]]), pa.array(rows[:, 3] + base), pa.array(rows[:, 4])], names)

    def run(batches):
        enc, base = encoder(path), TaskContext.get().partitionId() << 33
        docs, packed, sizes, tokens = [], [], [], 0
        for b in batches:
            for part in slices(b, 1, 256, SLICE_BYTES):
                got, n = enc.encode_texts(part.column(1))
                give_back()
                ends = np.cumsum(n)
                for k in range(0, part.num_rows, 256):
                    docs.append(part.column(0).slice(k, 256))
                    sizes.append(n[k : k + 256])
                    packed.append(got[ends[k] - n[k] : ends[k + len(sizes[-1]) - 1]])
                    tokens += len(packed[-1])
                    if tokens >= BLOCK_TOKENS:
                        yield from emit(docs, packed, sizes, base)
                        base += tokens  # sequences are no more than ids
                        docs, packed, sizes, tokens = [], [], [], 0
                        give_back()
        if docs:
            yield from emit(docs, packed, sizes, base)
            docs, packed, sizes = [], [], []
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
