"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A token sequence is the merge result of its text exactly if each neighbouring pair is: merging
the text of the two tokens alone gives those two tokens back ("compatible"). So the encoder
walks from left to right, takes the longest token that an Aho-Corasick automaton finds at a
position, and falls back to that token's next shorter prefix, or to a shorter predecessor,
where a pair is not compatible. A position that was found to be a dead end is never entered
again, which bounds the work by the length of the text.

Texts are split into pre-tokens first, as the vocabulary file asks; those repeat heavily, so
each Python worker keeps a bounded table of pre-tokens it has encoded.

Null and empty texts have no tokens. Repeated rows are encoded again with the same result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import sys
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fanframe.llm.common import str_list

#: Fixed value: the byte-level pre-token pattern that the public vocabulary was made with.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens remembered by a worker before it starts anew.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 1 << 25


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own}
    for n, b in enumerate(b for b in range(256) if b not in set(own)):
        letters[chr(256 + n)] = b
    return letters


class BacktrackingBPE:
    """The encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        # Keys are bytes shown as Latin-1, since the automaton takes strings.
        raw = {t: "".join(chr(letters[c]) for c in t) for t in spec["model"]["vocab"]}
        ids = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.ids = ids
        self.rank: dict[str, int] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            if a + b not in self.rank:
                self.rank[a + b], self.halves[a + b] = n, (a, b)
        self.pairs = {ab: n for n, ab in enumerate(self.halves.values())}
        self.auto = ahocorasick.Automaton()
        for t in ids:
            self.auto.add_word(t, len(t))
        self.auto.make_automaton()
        self.shorter: dict[str, str | None] = {}
        self.pair_table: dict[tuple[str, str], bool] = {}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_special = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.find = regex.compile(PRETOKEN).findall
        by_id = {i: raw[t].encode("latin-1") for t, i in spec["model"]["vocab"].items()} | {i: t.encode() for t, i in self.special.items()}
        self.tokens = _Strings([by_id.get(i, b"") for i in range(max(by_id) + 1)])
        self.digits = _Strings([b"%d," % i for i in range(max(by_id) + 1)])
        self.seen = _Seen(self)

    def prefix(self, token: str) -> str | None:
        """The next shorter token that starts this one."""
        if token not in self.shorter:
            n = len(token) - 1
            while n and token[:n] not in self.ids:
                n -= 1
            self.shorter[token] = token[:n] or None
        return self.shorter[token]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the joined text keeps the border between the two tokens.

        Undo merges on either side of the border, always the later one; a merge across the
        border that would have come before the undone ones breaks the pair.
        """
        known = self.pair_table.get((left, right))
        if known is not None:
            return known
        a, b = left, right
        limit, whole = len(self.rank), True  # merges of this rank or later haven't happened yet when the border is reached
        while True:
            across = self.pairs.get((a, b), limit)
            if across < limit:
                whole = False
                break
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            # A merge across the border comes before an equal one to its right, not before one to its left.
            if ra > rb:
                limit, a = ra, self.halves[a][1]
            else:
                limit, b = rb + 1, self.halves[b][0]
        if len(self.pair_table) > 2_000_000:
            self.pair_table.clear()
        self.pair_table[left, right] = whole
        return whole

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        text = piece.encode("utf-8").decode("latin-1")
        if text in self.ids:  # a token's own merges lead to it
            return [self.ids[text]]
        longest: dict[int, int] = {}
        for end, n in self.auto.iter(text):
            at = end + 1 - n
            if longest.get(at, 0) < n:
                longest[at] = n
        out: list[str] = []
        at, size, dead = 0, len(text), bytearray(len(text) + 1)
        trial: str | None = text[: longest[0]]
        while at < size:
            last = out[-1] if out else None
            while trial and (dead[at + len(trial)] or (last is not None and not self.compatible(last, trial))):
                trial = self.prefix(trial)
            if trial:
                out.append(trial)
                at += len(trial)
                trial = text[at : at + longest[at]] if at < size else None
            else:
                dead[at] = 1
                trial = out.pop()
                at -= len(trial)
        return [self.ids[t] for t in out]

    def packed(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        seen = self.seen
        seen.bound()
        if not self.at_special or not self.at_special.search(text):
            return b"".join(map(seen.__getitem__, self.find(text)))
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += map(seen.__getitem__, self.find(text[at : m.start()]))
            out.append(np.array([self.special[m[0]]], "<u4").tobytes())
            at = m.end()
        return b"".join([*out, *map(seen.__getitem__, self.find(text[at:]))])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return self.tokens.join(ids)

    def spelled(self, ids: np.ndarray) -> bytes:
        """The ids as decimals, joined by commas."""
        return self.digits.join(ids)[:-1]


class _Seen(dict):
    """Pre-tokens to packed ids."""

    def __init__(self, bpe: BacktrackingBPE):
        self.bpe, self.size = bpe, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.bpe.encode_piece(piece)
        out = self[piece] = array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()
        self.size += len(piece)
        return out

    def bound(self) -> None:
        if len(self) > REMEMBERED or self.size > REMEMBERED_CHARS:
            self.clear()
            self.size = 0


class _Strings:
    """Byte strings by number, in one array with offsets."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        """The strings of the ids in a row, gathered a slice of ids at a time."""
        out = []
        for k in range(0, len(ids), 1 << 14):
            part = ids[k : k + (1 << 14)]
            n = self.lengths[part]
            ends = np.cumsum(n)
            out.append(self.bytes[np.repeat(self.starts[part] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


@functools.lru_cache(2)
def load(path: str) -> BacktrackingBPE:
    return BacktrackingBPE(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>: the tokens of each text. A narrow map; rows in, rows out."""

    def run(batches):
        bpe = load(path)
        for b in batches:
            ids = [bpe.encode(t).astype(np.int32) for t in str_list(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the inverse of encode_documents (a null id list decodes to an empty text)."""

    def run(batches):
        bpe = load(path)
        for b in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text and return digests of both, in one pass and without a shuffle."""

    def run(batches):
        bpe = load(path)
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in str_list(b.column(1)):
                ids = bpe.encode(t)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(bpe.spelled(ids)).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
