"""Removal of byte strings of 50 bytes and more that occur in an earlier document, by suffix arrays.

A string of 50 bytes has 27 grams of 24 bytes; the least of their hashes, its minimum, depends on
the string alone, so equal strings have equal minima, and neighbouring strings of a text mostly
share theirs. That makes the work local:

1. Each block of documents lists its texts' minima (one for about 14 bytes), once each. Lists
   are dealt by value, and each block learns which of its minima other documents have too.
2. For these alone the text pieces under one minimum (50 bytes and more) go to the minimum's
   shard, each distinct piece of a block once.
3. A shard whose pieces under a minimum differ builds its suffix array by induced sorting:
   suffixes are classified, the leftmost-smaller substrings are sorted and named, their order is
   found by doubling ranks of the reduced string, and all other suffixes are induced from it,
   bucket by bucket, in linear time. Common prefixes in permuted order then tell which 50-byte
   strings are equal, exactly, and the smallest doc_id of each is known.
4. Each block gets the answers for its pieces and marks the bytes.

The recursion on the reduced string is replaced by rank doubling over its names, since that is
array arithmetic; it ends when the order is settled for more than 50 bytes, all that is needed.

A hot passage costs a block one list entry and one piece, however often it occurs.

Defined results: null and empty texts lose nothing; a null doc_id counts as larger than all
others; repeated rows (same doc_id) don't count as earlier documents; texts under 50 bytes lose
nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import inspect

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanframe.llm.common import block_count, give_back, utf8_list

LENGTH = 50
GRAM = 24
WIDTH = LENGTH - GRAM + 1
BLOCK_BYTES = 1 << 22
JOINED_BYTES = 1 << 15  # of short texts whose minima are found together, in the processor's cache
LAST = np.iinfo(np.int64).max  # stands for a null doc_id

ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def minima(data: bytes) -> np.ndarray:
    """The minimum of each 50-byte string of the data, by its start."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.uint64)
    word = np.ndarray((n - 7,), "<u8", data, strides=(1,)).astype(np.uint64)
    h = word[:-16] * ODD[0]
    h ^= h >> np.uint64(29)
    h += word[8:-8]
    h *= ODD[1]
    h ^= h >> np.uint64(32)
    h += word[16:]
    h *= ODD[2]
    h ^= h >> np.uint64(29)
    size = 1
    while 2 * size <= WIDTH:
        h, size = np.minimum(h[:-size], h[size:]), 2 * size
    rest = WIDTH - size
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Value, text, first and last start of the runs of equal minima of all texts, in order.

    Short texts share calls. Values are mixed, since minima are small numbers and would crowd in a few buckets.
    """
    parts = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    sizes = np.array([len(t) for t in texts], np.int64)
    until = np.cumsum(sizes)
    k = 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(until, until[k] - sizes[k] + JOINED_BYTES, "right")))
        m = minima(b"".join(texts[k:stop]))
        ends = until[k:stop] - (until[k] - sizes[k])
        starts = ends - sizes[k:stop]
        long = np.flatnonzero(sizes[k:stop] >= LENGTH)
        if len(long):
            starts, ends = starts[long], ends[long]
            opens = np.ones(len(m), bool)
            np.not_equal(m[1:], m[:-1], out=opens[1:])
            opens[starts] = True
            first = np.flatnonzero(opens)
            text = np.searchsorted(starts, first, "right") - 1
            inner = (text >= 0) & (first <= ends[text] - LENGTH)  # strings within one text
            first, text = first[inner], text[inner]
            last = np.minimum(np.append(first[1:], len(m)) - 1, ends[text] - LENGTH)
            parts.append((m[first] * ODD[0], long[text] + k, first - starts[text], last - starts[text]))
        k = stop
    value, text, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    return value, text, first, last


def codes(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 31 further bits of minima. Within a bucket, whose number grows with the table, few
    different minima meet in one code, and those only cost work: pieces are compared by their bytes."""
    bucket = (values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return bucket << np.uint64(32) | values & np.uint64(0xFFFFFFFE)


def _has(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


# ---- suffix arrays ----


def _types(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last is the sentinel."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int32) - t[:-1])
    at = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = np.where(nxt < n, step[np.minimum(nxt, n - 2)] > 0, False)
    return out


def _deal(t: np.ndarray, p: np.ndarray, lists: list[list[np.ndarray]]) -> None:
    """Append positions to the lists of their symbols, keeping their order."""
    if not len(p):
        return
    sym = t[p]
    order = np.argsort(sym, kind="stable")
    p, sym = p[order], sym[order]
    cut = np.flatnonzero(sym[1:] != sym[:-1]) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(p)], strict=True):
        lists[sym[a]].append(p[a:b])


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """All suffixes from leftmost-smaller ones in their order: larger ones upwards, then smaller ones downwards."""
    starts: list[list[np.ndarray]] = [[] for _ in range(size)]
    _deal(t, seeds, starts)
    large: list[list[np.ndarray]] = [[] for _ in range(size)]
    none = np.zeros(0, np.int32)
    for c in range(size):
        k = 0
        while k < len(large[c]) or k == len(large[c]) and starts[c]:
            if k < len(large[c]):
                now = np.concatenate(large[c][k:])
                large[c][k:] = [now]
                k += 1
            else:
                now, starts[c] = np.concatenate(starts[c]), []
            before = now[now > 0] - 1
            _deal(t, before[~small[before]], large)
    done = [np.concatenate(x) if x else none for x in large]
    lower: list[list[np.ndarray]] = [[] for _ in range(size)]
    lower[0].append(np.array([len(t) - 1], np.int32))
    out: list[np.ndarray] = [none] * size
    for c in reversed(range(size)):
        k = 0
        while k < len(lower[c]):
            now = np.concatenate(lower[c][k:])
            lower[c][k:] = [now]
            k += 1
            before = now[now > 0] - 1
            _deal(t, before[small[before]], lower)
        back = done[c][::-1]
        before = back[back > 0] - 1
        _deal(t, before[small[before]], lower)
        out[c] = np.concatenate([done[c], np.concatenate(lower[c])[::-1] if lower[c] else none])
    return np.concatenate(out)


def suffix_array(t: np.ndarray, size: int, depth: int | None = None) -> np.ndarray:
    """Starts of all suffixes in order. t: symbols below size, ending with a 0 found nowhere else.

    depth: order by so many symbols at least is enough.
    """
    n = len(t)
    small = _types(t)
    first = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1  # leftmost-smaller suffixes
    if not len(first):
        first = np.array([n - 1], np.int32)
    order = _induce(t, small, first, size)
    is_first = np.zeros(n, bool)
    is_first[first] = True
    sorted_first = order[is_first[order]]
    # Names of the substrings between them: neighbours in order are compared symbol by symbol.
    index = np.zeros(n, np.int32)
    index[first] = np.arange(len(first))
    length = np.append(np.diff(first), 1)[index[sorted_first]]
    a, b = sorted_first[:-1].astype(np.int64), sorted_first[1:].astype(np.int64)
    same = length[:-1] == length[1:]
    open_, k = np.flatnonzero(same), 0
    while len(open_):
        equal = t[a[open_] + k] == t[b[open_] + k]
        same[open_[~equal]] = False
        k += 1
        # The first symbol after the substring belongs to it.
        open_ = open_[equal & (length[open_] + 1 > k) & (b[open_] + k < n) & (a[open_] + k < n)]
    name = np.zeros(len(first), np.int64)
    name[index[sorted_first]] = np.concatenate([[0], np.cumsum(~same)])
    # Ranks of the reduced string by doubling.
    reach = 1
    while name.max() + 1 < len(name) and (depth is None or reach < depth):
        nxt = np.append(name[reach:], np.zeros(min(reach, len(name)), np.int64) - 1)[: len(name)]
        key = name * (len(name) + 2) + nxt + 1
        by = np.argsort(key, kind="stable")
        new = np.zeros(len(name), np.int64)
        new[by] = np.concatenate([[0], np.cumsum(key[by][1:] != key[by][:-1])])
        name, reach = new, 2 * reach
    return _induce(t, small, first[np.argsort(name, kind="stable")], size)


def equal_strings(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Starts (in the joined pieces, one byte between) of all 50-byte strings within pieces, in suffix
    order, and whether each equals the one before."""
    joined = b"\0".join(pieces) + bytes(8)
    raw = np.frombuffer(joined, np.uint8)
    n = len(raw) - 8
    t = np.empty(n + 1, np.int16)
    t[:-1] = raw[:n].astype(np.int16) + 2
    t[-1] = 0
    lengths = np.array([len(p) for p in pieces])
    ends = np.cumsum(lengths + 1) - 1  # of pieces
    t[ends[:-1]] = 1
    left = np.repeat(ends, lengths + 1)[:n] - np.arange(n)
    inner = np.append(left >= LENGTH, False)
    order = suffix_array(t, 258, LENGTH + 1)
    order = order[inner[order]].astype(np.int64)
    # Common prefixes in text order: of each suffix and the one before it in the array.
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before >= 0)
    word = np.ndarray((len(raw) - 7,), "<u8", joined, strides=(1,)).astype(np.uint64)
    same, q = np.ones(len(at), bool), before[at]
    for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        same &= word[at + k] == word[q + k]
    flag = np.zeros(n + 1, bool)
    flag[at] = same
    return order, flag[order]


# ---- steps ----


def _rows(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """doc_id and text of each row."""
    docs = table.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy().astype(np.int64)
    return docs, [x for chunk in table.column("text").chunks for x in utf8_list(chunk)]


def _list_minima(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("found", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        docs, texts = _rows(table)
        v, text, *_ = runs(texts)
        v = codes(v, buckets)
        order = np.argsort(v, kind="stable")
        v, d = v[order], docs[text[order]]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
        if not len(first):
            return schema.empty_table()
        # The lowest bit: more than one document of this block has it.
        several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        v = v[first] | several.astype(np.uint64)
        bucket = (v >> np.uint64(32)).astype(np.int32)
        cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(v)]])
        block = table.column("block")[0].as_py()
        low = v.astype(np.uint32)
        parts = [low[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"bucket": bucket[cut[:-1]], "block": np.full(len(parts), block, np.int32), "found": parts}, schema)

    return run


def _find_shared(table: pa.Table) -> pa.Table:
    lists = [np.frombuffer(x, "<u4") for x in table.column("found").to_pylist()]
    one = np.uint32(1)
    every = np.sort(np.concatenate([x & ~one for x in lists]))
    twice = every[1:][every[1:] == every[:-1]]
    out = [(x & ~one)[(x & one).astype(bool) | _has(twice, x & ~one)] for x in lists]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "shared": pa.chunked_array([pa.array([x.astype("<u4").tobytes() for x in out], pa.binary())])})


def _pieces(texts: list[bytes], shared: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Of the runs whose minimum is shared: text, first and last start, number of the piece; of the
    distinct pieces in the order of their numbers: minimum and bytes (an Arrow array).

    The order is by minimum, then bytes, so it is the same whatever order the texts come in.
    """
    value, text, first, last = runs(texts)
    good = np.flatnonzero(_has(shared, codes(value, buckets)))
    value, text, first, last = value[good], text[good], first[good], last[good]
    cut = [texts[k][a:b] for k, a, b in zip(text.tolist(), first.tolist(), (last + LENGTH).tolist(), strict=True)]
    coded = pa.array(cut, pa.large_binary()).dictionary_encode()
    number, pieces = coded.indices.to_numpy(), coded.dictionary
    minimum = np.empty(len(pieces), np.uint64)
    minimum[number] = value  # a piece's bytes tell its minimum
    order = np.argsort(minimum, kind="stable")
    ordered = minimum[order]
    like = np.concatenate([[False], ordered[1:] == ordered[:-1], [False]])
    if len(tied := np.flatnonzero(like[1:] | like[:-1])):
        keys = list(zip(ordered[tied].tolist(), pieces.take(pa.array(order[tied])).to_pylist(), strict=True))
        order[tied] = order[tied][sorted(range(len(keys)), key=keys.__getitem__)]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return text, first, last, place[number], ordered, pieces.take(pa.array(order))


def _bytes(pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, memoryview]:
    """Where each piece begins, and the last ends, in their bytes."""
    ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
    return ends, memoryview(pieces.buffers()[2] or b"")


def _least(number: np.ndarray, docs: np.ndarray, size: int) -> np.ndarray:
    """The smallest doc_id of each number below size."""
    out = np.full(size, LAST)
    np.minimum.at(out, number, docs)
    return out


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ranges of n numbers from each first one, in a row."""
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def _send_pieces(shards: int, buckets: int):
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("minimum", pa.binary()), ("rest", pa.binary())])

    def run(table: pa.Table, lists: pa.Table) -> pa.Table:
        if not table.num_rows or not lists.num_rows:
            return schema.empty_table()
        shared = np.sort(np.concatenate([np.frombuffer(x, "<u4").astype(np.uint64) | np.uint64(b) << np.uint64(32) for b, x in zip(lists.column("bucket").to_pylist(), lists.column("shared").to_pylist(), strict=True)]))
        docs, texts = _rows(table)
        text, _, _, number, minimum, pieces = _pieces(texts, shared, buckets)
        if not len(pieces):
            return schema.empty_table()
        least = _least(number, docs[text], len(pieces))
        begin, data = _bytes(pieces)
        shard = (minimum >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)  # ascends
        cut = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]).tolist()
        block, pack = table.column("block")[0].as_py(), zstandard.ZstdCompressor(level=1).compress
        ids, sizes = least.astype("<i8"), np.diff(begin).astype("<i4")
        rest = [pack(b"".join([ids[a:b].tobytes(), sizes[a:b].tobytes(), data[begin[a] : begin[b]]])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        values = minimum.astype("<u8")
        return pa.table({"shard": shard[cut[:-1]].astype(np.int32), "block": np.full(len(rest), block, np.int32), "minimum": [values[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], "rest": rest}, schema)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each block's pieces, in the order sent, the smallest doc_id: one number if it holds for all strings of the piece, else one for each."""
    unpack = zstandard.ZstdDecompressor().decompress
    minimums = table.column("minimum").to_pylist()
    counts = np.array([len(x) // 8 for x in minimums])
    rest = [memoryview(unpack(x)) for x in table.column("rest").to_pylist()]
    minimum = np.frombuffer(b"".join(minimums), "<u8")
    docs, sizes = (np.frombuffer(b"".join([x[a * n : b * n] for x, n in zip(rest, counts.tolist(), strict=True)]), kind) for a, b, kind in ((0, 8, "<i8"), (8, 12, "<i4")))
    data = b"".join([x[12 * n :] for x, n in zip(rest, counts.tolist(), strict=True)])
    del rest
    begin = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(begin), pa.py_buffer(data)]).dictionary_encode()
    number, pieces = coded.indices.to_numpy(), coded.dictionary
    least = _least(number, docs, len(pieces))
    under = np.empty(len(pieces), np.uint64)
    under[number] = minimum
    _, group, alike = np.unique(under, return_inverse=True, return_counts=True)
    unlike = np.flatnonzero(alike[group] > 1)
    n = np.ones(len(pieces), np.int64)  # numbers in the answer
    if len(unlike):
        texts = pieces.take(pa.array(unlike)).to_pylist()
        order, same = equal_strings(texts)
        lengths = np.array([len(t) for t in texts])
        doc = np.repeat(least[unlike], lengths + 1)
        first = np.flatnonzero(~same)
        found = np.empty(len(doc), np.int64)
        found[order] = np.minimum.reduceat(doc[order], first)[np.cumsum(~same) - 1]
        strings = lengths - LENGTH + 1
        found = found[_spread(np.cumsum(lengths + 1) - lengths - 1, strings)]
        begin = np.cumsum(strings) - strings
        several = np.logical_or.reduceat(found != np.repeat(least[unlike], strings), begin)
        n[unlike[several]] = strings[several]
    start = np.cumsum(n) - n
    pool = np.empty(n.sum(), np.int64)
    pool[start] = least
    if len(unlike):
        pool[_spread(start[unlike[several]], strings[several])] = found[_spread(begin[several], strings[several])]
    sent = n[number]
    answers, at = pool[_spread(start[number], sent)].astype("<i8"), np.concatenate([[0], np.cumsum(sent)])
    to = np.cumsum(counts).tolist()
    cut = list(zip([0, *to], to, strict=False))
    sent = sent.astype("<i4")
    return pa.table(
        {"block": table.column("block"), "shard": table.column("shard"), "minimum": table.column("minimum"), "n": [sent[a:b].tobytes() for a, b in cut], "least": [answers[at[a] : at[b]].tobytes() for a, b in cut]},
        pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("minimum", pa.binary()), ("n", pa.binary()), ("least", pa.binary())]),
    )


def _covered(docs: np.ndarray, texts: list[bytes], lists: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of the maximal runs of bytes that strings found in earlier documents cover."""
    if not lists.num_rows:
        return (np.zeros(0, np.int64),) * 3
    lists = lists.sort_by("shard")
    minimum, n, least = (np.frombuffer(b"".join(lists.column(c).to_pylist()), kind) for c, kind in (("minimum", "<u8"), ("n", "<i4"), ("least", "<i8")))
    # The same pieces as were sent, in the same order, so that answers need no key.
    text, first, last, number, sent, _ = _pieces(texts, np.unique(codes(minimum, buckets)), buckets)
    if not np.array_equal(sent, minimum):
        raise ValueError("answers are not for the pieces of this block")
    n = n.astype(np.int64)
    of = n[number]
    earlier = least[_spread((np.cumsum(n) - n)[number], of)] < np.repeat(docs[text], of)
    # Answers for a whole piece cover it to its end, others a string.
    start = _spread(first, of)[earlier]
    end = np.repeat(np.where(of > 1, 0, last - first), of)[earlier] + start + LENGTH
    text = np.repeat(text, of)[earlier]
    opens = np.ones(len(start), bool)  # both ascend within a text
    opens[1:] = (start[1:] > end[:-1]) | (text[1:] != text[:-1])
    closes = np.ones(len(start), bool)
    closes[:-1] = opens[1:]
    return text[opens], start[opens], end[closes]


def _remove(columns: pa.Schema, make, buckets: int):
    """Cut each document of a block and give make(doc_id, text, kept parts, spans)."""

    def run(table: pa.Table, lists: pa.Table) -> pa.Table:
        docs, texts = _rows(table)
        text, start, end = _covered(docs, texts, lists, buckets)
        cut = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        start, end = start.tolist(), end.tolist()
        rows = []
        for doc, t, a, b in zip(docs.tolist(), texts, cut[:-1], cut[1:], strict=True):
            kept = b"".join([t[x:y] for x, y in zip([0, *end[a:b]], [*start[a:b], len(t)], strict=True)]) if a < b else t
            rows.append(make(None if doc == LAST else doc, t, kept, b - a))
        if not rows:
            return columns.empty_table()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), columns, strict=True)], schema=columns)

    return run


def _digests(doc, text: bytes, kept: bytes, spans: int) -> tuple:
    return doc, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()


def _replace(columns: list[str], buckets: int):
    """Give the block's rows with what is left of their texts."""

    def run(docs: pa.Table, lists: pa.Table) -> pa.Table:
        texts = iter(_remove(KEPT, lambda doc, text, kept, spans: (kept.decode("utf-8", "ignore"),), buckets)(docs, lists).column("text").to_pylist())
        out = docs.select(columns)
        at = columns.index("text")
        had = out.column(at).is_valid().to_pylist()
        return out.set_column(at, out.schema.field(at), pa.array([t if ok else None for t, ok in zip(texts, had, strict=True)], out.schema.field(at).type))

    return run


KEPT = pa.schema([("text", pa.string())])


def _lean(step):
    """The step, whose worker keeps no memory for stages to come."""

    def one(table: pa.Table) -> pa.Table:
        out = step(table)
        give_back()
        return out

    def two(table: pa.Table, lists: pa.Table) -> pa.Table:
        out = step(table, lists)
        give_back()
        return out

    return two if len(inspect.signature(step).parameters) == 2 else one


def _run(docs: DataFrame, ddl, finish) -> DataFrame:
    n = block_count(docs, BLOCK_BYTES)
    # Repeated rows and null ids spread over blocks by their text.
    by_block = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    grouped = by_block.groupBy("block")
    lists = grouped.applyInArrow(_lean(_list_minima(2 * n)), "bucket int, block int, found binary")
    shared = lists.groupBy("bucket").applyInArrow(_find_shared, "block int, bucket int, shared binary")
    sent = grouped.cogroup(shared.groupBy("block")).applyInArrow(_lean(_send_pieces(2 * n, 2 * n)), "shard int, block int, minimum binary, rest binary")
    answers = sent.groupBy("shard").applyInArrow(_lean(_answer), "block int, shard int, minimum binary, n binary, least binary")
    return grouped.cogroup(answers.groupBy("block")).applyInArrow(_lean(finish(2 * n)), ddl)


def digest_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    columns = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _run(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", lambda buckets: _remove(columns, _digests, buckets))


def remove_substrings(docs: DataFrame) -> DataFrame:
    """The table with what is left of each text; a code point of which a part went is gone. Null texts stay null."""
    # Positions for names, so that columns of any name pass through.
    names = [c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)]
    safe = docs.toDF(*names)
    return _run(safe, safe.schema, lambda buckets: _replace(names, buckets)).toDF(*docs.columns)
