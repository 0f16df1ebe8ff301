"""ISO media containers: probing by box walking, and storing bytes as samples of one track.

The prober walks nested boxes and decodes the sample tables (stts, stsc, stsz/stz2, stco/co64,
stss) and those of fragments (trex, tfhd, trun) into codec, duration and the byte ranges of keyframes. It reads box headers and tables
only; sample payloads are never decoded.

Defined results: a null or empty column value gives no tracks; a file cut short or with broken
tables gives what could be read and the fault in `error`; nothing raises. The duration is the
longer of the stated one and that of all samples. An empty table gives no rows, repeated rows are
rows of their own, and other columns are never read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fanframe.llm.common import utf8_list

#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
UNIT = 64  # bytes of a stored sample
PER_CHUNK = 32  # samples of a stored chunk
KEY_EVERY = 16  # each so many samples one is marked as a keyframe
TIMESCALE = 8000


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple = ()):
    """Yield (path, start, start of body, end) of each box, outer boxes before inner ones."""
    end = len(data) if end is None else end
    stack = [(start, end, path)]
    while stack:
        at, stop, over = stack.pop()
        while at + 8 <= stop:
            size, kind = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1:
                if at + 16 > stop:
                    raise ValueError(f"{kind!r} is cut short")
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            elif size == 0:
                size = stop - at
            if size < head or at + size > stop:
                raise ValueError(f"{kind!r} has size {size} at {at}")
            body = at + head
            yield (*over, kind), at, body, at + size
            if kind in CONTAINERS:
                stack.append((at + size, stop, over))
                at, stop, over = body, at + size, (*over, kind)
            else:
                at += size


def _table(data: bytes, at: int, end: int, width: int, skip: int = 0) -> np.ndarray:
    """The 32-bit entries of a full box with an entry count."""
    n = struct.unpack_from(">I", data, at + 4 + skip)[0]
    first = at + 8 + skip
    if first + 4 * width * n > end:
        raise ValueError("a table is cut short")
    return np.frombuffer(data, ">u4", n * width, first).astype(np.int64).reshape(n, width)


def _sizes(data: bytes, kind: bytes, at: int, end: int) -> np.ndarray:
    flat, n = struct.unpack_from(">II", data, at + 4)
    if kind == b"stsz" and flat:
        if n > len(data):
            raise ValueError("stsz counts more samples than the file has bytes")
        return np.full(n, flat, np.int64)
    if kind == b"stsz":
        if at + 12 + 4 * n > end:
            raise ValueError("stsz is cut short")
        return np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)
    bits = flat & 255
    if bits not in (4, 8, 16) or at + 12 + -(-n * bits // 8) > end:
        raise ValueError("stz2 is cut short")
    raw = np.frombuffer(data, np.uint8, min(end - at - 12, -(-n * bits // 8)), at + 12).astype(np.int64)
    if bits == 16:
        raw = raw[::2] * 256 + raw[1::2]
    elif bits == 4:
        raw = np.stack([raw >> 4, raw & 15], 1).ravel()
    return raw[:n]


class Track:
    def __init__(self):
        self.handler, self.codec, self.timescale, self.duration = "", "", 0, 0
        self.number, self.defaults = 0, (0, 0, 0)  # duration, size and flags of fragments' samples
        self.tables: dict[str, np.ndarray] = {}
        self.runs: list[np.ndarray] = []  # offset, size, duration and whether it is a sync sample, of fragments

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Offset and size of each sample, those of the movie before those of fragments."""
        return tuple(np.concatenate([own, *[r[:, k] for r in self.runs]]) for k, own in enumerate(self._listed()))

    def total(self) -> int:
        """The longer of the stated duration and that of all samples."""
        times = self.tables.get("time", np.zeros((0, 2), np.int64))
        return max(self.duration, int((times[:, 0] * times[:, 1]).sum()) + sum(int(r[:, 2].sum()) for r in self.runs))

    def _listed(self) -> tuple[np.ndarray, np.ndarray]:
        """Offset and size of each sample, from the chunk tables."""
        sizes, chunks, runs = (self.tables.get(k, np.zeros((0, w), np.int64)) for k, w in (("size", 1), ("chunk", 1), ("run", 3)))
        sizes, chunks = sizes.ravel(), chunks.ravel()
        if not len(sizes) or not len(chunks) or not len(runs):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = np.minimum(np.append(runs[1:, 0], len(chunks) + 1), len(chunks) + 1)
        per_chunk = np.repeat(runs[:, 1], np.maximum(last - runs[:, 0], 0))[: len(chunks)]
        # Broken counts stop at the number of samples.
        per_chunk = np.diff(np.minimum(np.cumsum(per_chunk), len(sizes)), prepend=0)
        first = np.cumsum(per_chunk) - per_chunk
        of = np.repeat(np.arange(len(per_chunk)), per_chunk)[: len(sizes)]
        sizes = sizes[: len(of)]
        before = np.cumsum(sizes) - sizes
        return chunks[of] + before - before[np.minimum(first[of], len(sizes) - 1)], sizes

    def keyframes(self) -> np.ndarray:
        """(offset, size) of each sync sample; without a table of them all samples are."""
        both = np.stack(self._listed(), 1)
        if "sync" in self.tables:
            at = self.tables["sync"].ravel() - 1
            both = both[at[(at >= 0) & (at < len(both))]]
        return np.concatenate([both, *[r[r[:, 3] > 0, :2] for r in self.runs]])


#: Flags of tfhd and trun, and the flag of samples that need others.
BASE, ENTRY, DURATION, SIZE, FLAGS, OF_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
RUN_OFFSET, RUN_FIRST, RUN_FIELDS, NO_SYNC = 0x1, 0x4, (0x100, 0x200, 0x400, 0x800), 0x10000


class Fragment:
    """Where the samples of a movie fragment's tracks lie."""

    def __init__(self, tracks: list[Track], start: int):
        self.by_number, self.start, self.next = {t.number: t for t in tracks}, start, start
        self.track, self.base, self.defaults = None, start, (0, 0, 0)

    def header(self, data: bytes, at: int, end: int) -> None:
        """tfhd: the track, the place that offsets count from, and defaults."""
        flags, number = struct.unpack_from(">II", data, at)
        self.track = self.by_number.get(number)
        if self.track is None:
            raise ValueError(f"a fragment is of track {number}, which is not there")
        at += 8
        # Without a place of its own, a track goes on where the one before it ended.
        self.base = self.start if flags & OF_MOOF else self.next
        if flags & BASE:
            self.base, at = struct.unpack_from(">Q", data, at)[0], at + 8
        at += 4 * bool(flags & ENTRY)
        found = list(self.track.defaults)
        for k, flag in enumerate((DURATION, SIZE, FLAGS)):
            if flags & flag:
                found[k], at = struct.unpack_from(">I", data, at)[0], at + 4
        if at > end:
            raise ValueError("tfhd is cut short")
        self.defaults, self.next = tuple(found), self.base

    def run(self, data: bytes, at: int, end: int) -> None:
        """trun: sizes, durations and flags of samples that follow each other."""
        if self.track is None:
            raise ValueError("trun comes before tfhd")
        flags, n = struct.unpack_from(">II", data, at)
        at += 8
        if flags & RUN_OFFSET:
            self.next, at = self.base + struct.unpack_from(">i", data, at)[0], at + 4
        first = None
        if flags & RUN_FIRST:
            first, at = struct.unpack_from(">I", data, at)[0], at + 4
        has = [bool(flags & f) for f in RUN_FIELDS]
        if n > len(data) or at + 4 * sum(has) * n > end:
            raise ValueError("trun is cut short")
        stated = iter(np.frombuffer(data, ">u4", n * sum(has), at).astype(np.int64).reshape(n, sum(has)).T)
        duration, size, kind = (next(stated) if own else np.full(n, d, np.int64) for own, d in zip(has, self.defaults, strict=False))
        if first is not None and n:
            kind = np.append(first, kind[1:])
        offset = self.next + np.cumsum(size) - size
        self.track.runs.append(np.stack([offset, size, duration, (kind & NO_SYNC) == 0], 1).astype(np.int64))
        self.next += int(size.sum())


def probe(data: bytes) -> tuple[list[Track], str]:
    """The tracks of a file, and what was wrong with it."""
    tracks: list[Track] = []
    fragment, extends = Fragment([], 0), {}
    try:
        for path, start, at, end in walk(data):
            kind = path[-1]
            if kind == b"trak":
                tracks.append(Track())
            elif kind == b"trex":  # may come before its track
                number, _, *own = struct.unpack_from(">5I", data, at + 4)
                extends[number] = tuple(own)
            elif kind == b"moof":
                for t in tracks:
                    t.defaults = extends.get(t.number, t.defaults)
                fragment = Fragment(tracks, start)
            elif kind == b"traf":
                fragment.track = None
            elif kind == b"tfhd":
                fragment.header(data, at, end)
            elif kind == b"trun":
                fragment.run(data, at, end)
            elif tracks and b"trak" in path:
                t = tracks[-1]
                if kind == b"tkhd":
                    t.number = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
                elif kind == b"mdhd":
                    wide = data[at] == 1
                    t.timescale, t.duration = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
                elif kind == b"hdlr":
                    t.handler = data[at + 8 : at + 12].decode("latin-1")
                elif kind == b"stsd":
                    t.codec = data[at + 12 : at + 16].decode("latin-1")
                elif kind == b"stts":
                    t.tables["time"] = _table(data, at, end, 2)
                elif kind == b"stsc":
                    t.tables["run"] = _table(data, at, end, 3)
                elif kind in (b"stsz", b"stz2"):
                    t.tables["size"] = _sizes(data, kind, at, end)
                elif kind == b"stco":
                    t.tables["chunk"] = _table(data, at, end, 1)
                elif kind == b"co64":
                    high_low = _table(data, at, end, 2)
                    t.tables["chunk"] = high_low[:, 0] * (1 << 32) + high_low[:, 1]
                elif kind == b"stss":
                    t.tables["sync"] = _table(data, at, end, 1)
    except (ValueError, struct.error, IndexError) as e:
        return tracks, str(e)
    return tracks, ""


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, bytes(4), *parts)


def store(payload: bytes) -> bytes:
    """An audio file whose 8-bit samples, in units of 64 bytes, are the payload (a multiple of 64 bytes)."""
    n = len(payload) // UNIT
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    wide = len(payload) + 8 >= 1 << 32
    lead = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    first = len(head) + len(lead)
    chunks = first + np.arange(-(-n // PER_CHUNK), dtype=np.int64) * (UNIT * PER_CHUNK)
    runs = [(1, PER_CHUNK, 1)] * (n >= PER_CHUNK) + [(n // PER_CHUNK + 1, n % PER_CHUNK, 1)] * (n % PER_CHUNK > 0)
    far = len(chunks) and chunks[-1] >= 1 << 32
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=np.int64)
    count = lambda k: struct.pack(">I", k)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, (TIMESCALE & 0xFFFF) << 16))
    tables = _box(
        b"stbl",
        _full(b"stsd", count(1), entry),
        _full(b"stts", count(1), struct.pack(">II", n, UNIT)),
        _full(b"stsc", count(len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", UNIT, n)),
        _full(b"co64" if far else b"stco", count(len(chunks)), chunks.astype(">u8" if far else ">u4").tobytes()),
        _full(b"stss", count(len(keys)), keys.astype(">u4").tobytes()),
    )
    self_ref = _box(b"dinf", _full(b"dref", count(1), _box(b"url ", struct.pack(">I", 1))))
    media = _box(
        b"mdia",
        _box(b"mdhd", struct.pack(">IQQIQHH", 1 << 24, 0, 0, TIMESCALE, n * UNIT, 0x55C4, 0)),
        _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
        _box(b"minf", _full(b"smhd", bytes(4)), self_ref, tables),
    )
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    track = _box(b"tkhd", struct.pack(">IQQIIQ", 1 << 24 | 7, 0, 0, 1, 0, n * UNIT), bytes(16), unity, bytes(8))
    movie = _box(b"mvhd", struct.pack(">IQQIQIHH", 1 << 24, 0, 0, TIMESCALE, n * UNIT, 0x10000, 0x100, 0), bytes(8), unity, bytes(24), struct.pack(">I", 2))
    return b"".join([head, lead, payload, _box(b"moov", movie, _box(b"trak", track, media))])


def read_samples(data: bytes, track: Track) -> bytes:
    """All samples of a track in order, by its tables; neighbours in the file are read as one range."""
    offsets, sizes = track.samples()
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts = offsets[np.concatenate([[0], breaks])]
    ends = (offsets + sizes)[np.concatenate([breaks - 1, [len(offsets) - 1]])]
    return b"".join(data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def padded(raw: bytes) -> bytes:
    """With zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def feature_of(track: Track, error: str) -> str:
    keys = track.keyframes()
    ranges = ",".join(f"{a}+{n}" for a, n in keys[:2].tolist() + keys[2:][-1:].tolist())
    return f"handler={track.handler};codec={track.codec.strip()};duration={track.total()}/{track.timescale};samples={len(track.samples()[1])};keyframes={len(keys)};key_bytes={int(keys[:, 1].sum())};ranges={ranges};ranges_crc32={zlib.crc32(keys.astype('<i8').tobytes())};error={error}"


PROBED = "tracks array<struct<handler:string,codec:string,timescale:long,duration:long,n_samples:long,keyframes:array<struct<start:long,size:long>>>>, error string"


def probe_column(df: DataFrame, key: str, data: str) -> DataFrame:
    """key, tracks, error of each container in a binary column."""

    def run(batches):
        for b in batches:
            tracks, errors = [], []
            for x in b.column(1).to_pylist():
                found, error = probe(x or b"")
                tracks.append([{"handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.total(), "n_samples": len(t.samples()[1]), "keyframes": [{"start": s, "size": n} for s, n in t.keyframes().tolist()]} for t in found])
                errors.append(error)
            yield pa.RecordBatch.from_pydict({"key": b.column(0), "tracks": tracks, "error": errors}, schema)

    range_of = pa.struct([("start", pa.int64()), ("size", pa.int64())])
    track = pa.struct([("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(range_of))])
    schema = pa.schema([("key", pa.string()), ("tracks", pa.list_(track)), ("error", pa.string())])
    return df.selectExpr(f"cast(`{key}` as string) key", f"`{data}` data").mapInArrow(run, f"key string, {PROBED}")


def store_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a container."""

    def run(batches):
        for b in batches:
            texts = utf8_list(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([store(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def digest_media(stored: DataFrame) -> DataFrame:
    """Read the stored containers back and return digests of payload and container, and the feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            rows = []
            for doc, n, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                tracks, error = probe(data)
                track = tracks[0] if tracks else Track()
                got = read_samples(data, track)
                rows.append((doc, n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(track, error)))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
