"""Media columns: ISO media containers made from and read into columns, payloads never decoded.

pack() stores bytes as the samples of one audio track of 8-bit samples: a box "ftyp", a box "moov" with the nested description and
the sample tables, a box "mdat" with the payload. inspect() walks the nested boxes of any such file, decodes the sample tables
(time to sample, sample to chunk, sample sizes, chunk offsets, sync samples) and gives codec, duration and the byte ranges of
keyframes. Movie fragments are read too: the samples of their runs follow those of the tables. A keyframe range begins at a sync
sample and ends where the next one begins; where samples between do not lie one after another (chunks of tracks take turns), it has
several pieces. Ranges that touch in the file are told as (first offset, bytes each, number).

Null texts count as empty; the empty text is stored as one block of blanks. Repeated rows come back one each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, texts

#: Bytes of a sample (a block of the payload), samples in a chunk, samples from one keyframe to the next, samples a second times block.
BLOCK, CHUNK_SAMPLES, KEY_EVERY, RATE = 192, 64, 16, 8000
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pack(payload: bytes) -> bytes:
    """A file with the payload (a multiple of BLOCK bytes) as unsigned 8-bit mono samples; a sample of the tables is one block."""
    n = len(payload) // BLOCK
    units, chunks = n * BLOCK, -(-n // CHUNK_SAMPLES)
    rest = n - (chunks - 1) * CHUNK_SAMPLES
    runs = [(1, CHUNK_SAMPLES, 1)] if chunks > 1 and rest == CHUNK_SAMPLES or chunks == 1 and rest == CHUNK_SAMPLES else [(1, rest, 1)] if chunks == 1 else [(1, CHUNK_SAMPLES, 1), (chunks, rest, 1)]
    keys = np.arange(0, n, KEY_EVERY) + 1
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))

    def moov(data_at: int) -> bytes:
        offsets = data_at + np.arange(chunks, dtype=np.int64) * CHUNK_SAMPLES * BLOCK
        wide = chunks and offsets[-1] >= 1 << 32
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, BLOCK)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", BLOCK, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
            full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
        )
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, units, 0x55C4, 0)),
            full(b"hdlr", bytes(4), b"soun", bytes(12), b"text\0"),
            box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
        )
        track = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, units), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), flags=7)
        head = full(b"mvhd", struct.pack(">IIIII", 0, 0, RATE, units, 0x10000), struct.pack(">HH", 0x100, 0), bytes(8), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", head, box(b"trak", track, media))

    ftyp = box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  isom")
    header = 8 if len(payload) + 8 < 1 << 32 else 16
    at = len(ftyp) + len(moov(0)) + header
    at = len(ftyp) + len(moov(at)) + header  # wide offsets take more room
    return ftyp + moov(at) + box(b"mdat", payload)


@dataclass
class Track:
    number: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def key_ranges(self) -> np.ndarray:
        """(offset, bytes) of the pieces from each sync sample up to the next one: a piece ends there or where the next sample lies elsewhere."""
        if not len(self.keys):
            return np.zeros((0, 2), dtype=np.int64)
        ends = self.offsets + self.sizes
        cut = np.zeros(len(self.sizes) + 1, dtype=bool)
        cut[self.keys] = cut[-1] = True
        cut[1:-1] |= self.offsets[1:] != ends[:-1]
        at = np.flatnonzero(cut)
        at = at[at >= self.keys.min()]
        return np.stack([self.offsets[at[:-1]], ends[at[1:] - 1] - self.offsets[at[:-1]]], axis=1)


def walk(data: bytes, at: int = 0, stop: int | None = None, path: tuple[bytes, ...] = ()):
    """(path of box kinds, start and end of the box's content), depth first."""
    stop = len(data) if stop is None else stop
    while at + 8 <= stop:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > stop:
                raise ValueError("a box is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = stop - at
        if size < head or at + size > stop:
            raise ValueError(f"box {kind!r} at {at} does not fit into its parent")
        yield (*path, kind), at + head, at + size
        if kind in NESTED:
            yield from walk(data, at + head, at + size, (*path, kind))
        at += size


def _numbers(data: bytes, at: int, count: int, kind: str) -> np.ndarray:
    return np.frombuffer(data, dtype=kind, count=count, offset=at).astype(np.int64)


def _half_bytes(data: bytes, at: int, count: int) -> np.ndarray:
    """Numbers of four bits each, the high half of a byte first."""
    raw = np.frombuffer(data, dtype=np.uint8, count=-(-count // 2), offset=at)
    return np.stack([raw >> 4, raw & 15], axis=1).ravel()[:count].astype(np.int64)


def _settle(t: Track, tables: dict) -> None:
    """Works out the places of a track's samples from its tables."""
    if "sizes" not in tables:
        return
    t.sizes, chunks, runs = tables["sizes"], tables.get("chunks", np.zeros(0, np.int64)), tables.get("runs", np.zeros((0, 3), np.int64))
    t.offsets = np.zeros(len(t.sizes), dtype=np.int64)
    if len(runs) and len(chunks):
        per = np.repeat(runs[:, 1], np.diff(np.concatenate([runs[:, 0], [len(chunks) + 1]])))
        chunk_of = np.repeat(np.arange(len(chunks)), per)[: len(t.sizes)]
        before = np.concatenate([[0], np.cumsum(t.sizes)])[:-1]
        first = np.concatenate([[0], np.cumsum(per)])[:-1]
        t.offsets = chunks[chunk_of] + before - before[np.minimum(first, max(len(t.sizes) - 1, 0))][chunk_of]
    t.keys = tables.get("keys", np.arange(len(t.sizes)))


#: What a fragment's header may hold, in order: flag, name, form.
HEADER = ((0x01, "base", ">Q"), (0x02, "entry", ">I"), (0x08, "duration", ">I"), (0x10, "size", ">I"), (0x20, "flags", ">I"))
#: What a run may tell of each sample, in order: flag and name; and the bit of a sample's flags that says it is no sync sample.
PER_SAMPLE = ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift"))
NO_SYNC = 0x10000


class _Fragments:
    """Samples of movie fragments: a run's defaults come from its fragment's header, that one's from the movie's."""

    def __init__(self):
        self.defaults: dict[int, dict] = {}
        self.moof = self.end = 0
        self.now: dict = {}
        self.runs: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]] = {}

    def extends(self, data: bytes, a: int) -> None:
        number, _, duration, size, flags = struct.unpack_from(">IIIII", data, a + 4)
        self.defaults[number] = {"duration": duration, "size": size, "flags": flags}

    def begin(self, at: int) -> None:
        self.moof = self.end = at

    def header(self, data: bytes, a: int) -> None:
        given, number = struct.unpack_from(">II", data, a)
        given, at = given & 0xFFFFFF, a + 8
        self.now = {"track": number, "base": self.moof if given & 0x20000 else self.end, **self.defaults.get(number, {"duration": 0, "size": 0, "flags": 0})}
        for flag, name, form in HEADER:
            if given & flag:
                self.now[name] = struct.unpack_from(form, data, at)[0]
                at += struct.calcsize(form)
        self.end = self.now["base"]

    def run(self, data: bytes, a: int) -> None:
        given, n = struct.unpack_from(">II", data, a)
        given, at = given & 0xFFFFFF, a + 8
        start = self.end
        if given & 0x01:
            start = self.now["base"] + struct.unpack_from(">i", data, at)[0]
            at += 4
        first = None
        if given & 0x04:
            first = struct.unpack_from(">I", data, at)[0]
            at += 4
        told = [name for flag, name in PER_SAMPLE if given & flag]
        table = _numbers(data, at, n * len(told), ">u4").reshape(n, len(told))
        get = lambda name: table[:, told.index(name)] if name in told else np.full(n, self.now[name], dtype=np.int64)
        sizes, flags = get("size"), get("flags").copy()
        if first is not None and n:
            flags[0] = first
        places = start + np.concatenate([[0], np.cumsum(sizes)])
        self.end = int(places[-1])
        self.runs.setdefault(self.now["track"], []).append((sizes, places[:-1], flags & NO_SYNC == 0, int(get("duration").sum())))

    def join(self, t: Track) -> None:
        for sizes, places, sync, duration in self.runs.get(t.number, []):
            t.keys = np.concatenate([t.keys, np.flatnonzero(sync) + len(t.sizes)])
            t.sizes, t.offsets = np.concatenate([t.sizes, sizes]), np.concatenate([t.offsets, places])
            t.duration += duration


def inspect(data: bytes) -> list[Track]:
    """The tracks of a file. Only boxes and tables are read, no sample."""
    tracks: list[Track] = []
    tables: list[dict] = []
    fragments = _Fragments()
    for path, a, z in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append(Track())
            tables.append({})
        elif kind == b"trex":
            fragments.extends(data, a)
        elif kind == b"moof":
            fragments.begin(a - (16 if a >= 16 and data[a - 16 : a - 8] == b"\0\0\0\1moof" else 8))
        elif kind == b"tfhd":
            fragments.header(data, a)
        elif kind == b"trun":
            fragments.run(data, a)
        elif not tracks or b"trak" not in path:
            continue
        elif kind == b"tkhd":
            tracks[-1].number = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
        elif kind == b"mdhd":
            tracks[-1].timescale, tracks[-1].duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        elif kind == b"hdlr":
            tracks[-1].handler = data[a + 8 : a + 12].decode("latin-1")
        elif kind == b"stsd":
            tracks[-1].codec = data[a + 12 : a + 16].decode("latin-1").strip()
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", data, a + 4)
            tables[-1]["sizes"] = np.full(n, same, dtype=np.int64) if same else _numbers(data, a + 12, n, ">u4")
        elif kind == b"stz2":
            bits, n = struct.unpack_from(">II", data, a + 4)
            tables[-1]["sizes"] = _half_bytes(data, a + 12, n) if bits & 0xFF == 4 else _numbers(data, a + 12, n, f">u{(bits & 0xFF) // 8}")
        elif kind in (b"stco", b"co64"):
            tables[-1]["chunks"] = _numbers(data, a + 8, struct.unpack_from(">I", data, a + 4)[0], ">u4" if kind == b"stco" else ">u8")
        elif kind == b"stsc":
            n = struct.unpack_from(">I", data, a + 4)[0]
            tables[-1]["runs"] = _numbers(data, a + 8, 3 * n, ">u4").reshape(n, 3)
        elif kind == b"stss":
            tables[-1]["keys"] = _numbers(data, a + 8, struct.unpack_from(">I", data, a + 4)[0], ">u4") - 1
    for t, mine in zip(tracks, tables, strict=True):
        _settle(t, mine)
        fragments.join(t)
    return tracks


def unpack(data: bytes, track: Track) -> bytes:
    """The track's samples in order, by the byte places that the tables give; samples that lie one after another are copied at once."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    starts = np.concatenate([[0], np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1])
    stops = np.concatenate([starts[1:], [len(ends)]])
    return b"".join(data[int(track.offsets[a]) : int(ends[z - 1])] for a, z in zip(starts, stops, strict=True))


def describe(track: Track) -> str:
    """codec;handler;seconds;samples;keyframes;ranges, equal neighbouring ranges as offset+bytesxnumber."""
    told = []
    for offset, size in track.key_ranges().tolist():
        if told and told[-1][1] == size and told[-1][0] + told[-1][1] * told[-1][2] == offset:
            told[-1][2] += 1
        else:
            told.append([offset, size, 1])
    seconds = track.duration / track.timescale if track.timescale else 0.0
    return f"{track.codec};{track.handler};{seconds:.6f};{len(track.sizes)};{len(track.keys)};" + ",".join(f"{a}+{b}x{n}" for a, b, n in told)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a file."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = [t.encode() for t in texts(b, "text")]
        return pa.record_batch([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array([pack(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_arrow(df.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), run, f"doc_id {df.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def padded(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % BLOCK if raw else BLOCK)


def features(df: DataFrame) -> DataFrame:
    """What store() writes, read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. In one pass."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in texts(b, "text"):
            raw = t.encode()
            data = pack(padded(raw))
            track = inspect(data)[0]
            back = unpack(data, track)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), describe(track)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_arrow(df.select("doc_id", "text"), run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
