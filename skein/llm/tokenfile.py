"""Token-id files: independent zstandard frames with a trailing seek table and a checksum for each frame.

A file holds consecutive documents in ascending doc_id order. Each frame is a zstandard frame of its own with the ids of some
documents, little-endian unsigned 32-bit. After the last frame stands the seek table as a skippable zstandard frame: compressed
size, decompressed size and checksum of every frame, a footer with their number, a flag byte and a magic number. A second
skippable frame before it lists the documents (number of ids of each). So any zstandard reader can unpack a file whole, and our
reader finds the frames of a document range from the last bytes and decompresses only those.

Null texts count as empty: they get the end id alone. Null doc_ids come first, repeated doc_ids keep all their rows. Other columns
are ignored. An empty table gives no file and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .bpe import Words, byte_letters
from .common import bounded_batches, null_first, shared_folder, texts

# Fixed values of the public seekable format: skippable frame numbers and the footer's magic.
SKIP_SEEK, SKIP_DOCS, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
#: Ids in a frame before it is closed, ids in a file before the next one is begun, stretches of text whose ids a worker keeps.
FRAME_IDS, FILE_IDS, KEPT_WORDS = 1 << 16, 1 << 24, 150_000


#: Printable ASCII and the accented Latin letters that are composed already and have one letter as their lower case.
_LATIN = re.compile("[!-~À-ÖØ-öø-\u012fı-\u0148\u014a-ſ]+").fullmatch


class Kept(dict):
    """What was computed first for at most KEPT_WORDS keys; other keys are computed each time."""

    def __init__(self, compute: Callable):
        self.compute = compute

    def __missing__(self, key):
        found = self.compute(key)
        if len(self) < KEPT_WORDS:
            self[key] = found
        return found


class LibraryEncoder:
    """The tokenizers library's encoding of whole texts: its normaliser, splitter and model; the ids of stretches and words seen before are kept."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words, self.model = Words(spec), self.tokenizer.model
        self.letters = "".join(byte_letters())
        self.known, self.spelled = Kept(self._chunk), Kept(self.word)

    def encode(self, batch: list[str]) -> list[bytes]:
        ids, chunks = self.known.__getitem__, self.words.chunks
        return [b"".join(map(ids, chunks(t))) for t in batch]

    def _chunk(self, chunk: str | int) -> bytes:
        """A stretch's ids. Latin ones need no normaliser: a run of letters is a word, and so is a single sign or digit after it."""
        if isinstance(chunk, int):
            return struct.pack("<I", chunk)
        spelled = self.spelled
        if chunk.isascii() or _LATIN(chunk):
            low = chunk.lower()
            if low.isalpha():
                return spelled[low]
            if low[:-1].isalpha():
                return spelled[low[:-1]] + spelled[low[-1]]
            return b"".join(map(spelled.__getitem__, self.words.find(low)))
        return b"".join(map(spelled.__getitem__, self.words.split(chunk)))

    def word(self, word: str) -> bytes:
        """A prepared word's ids by the library's model, which reads a visible letter for each byte; printable ASCII stands for itself."""
        letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()


@lru_cache(maxsize=1)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def skippable(number: int, content: bytes) -> bytes:
    return struct.pack("<II", number, len(content)) + content


class TokenFile:
    """Builds one file in memory, FILE_IDS ids or so."""

    def __init__(self, level: int = 3):
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int, int]] = []
        self.lengths: list[int] = []
        self.open: list[bytes] = []
        self.pending = self.ids = 0
        self.level = level

    def add(self, ids: bytes) -> None:
        self.open.append(ids)
        self.lengths.append(len(ids) // 4)
        self.pending += len(ids) // 4
        self.ids += len(ids) // 4
        if self.pending >= FRAME_IDS:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            frame = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(raw)
            self.frames.append(frame)
            self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.open, self.pending = [], 0

    def content(self) -> bytes:
        self.close_frame()
        docs = zstandard.compress(np.array(self.lengths, dtype="<u8").tobytes())
        seek = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        head = skippable(SKIP_DOCS, docs)
        return b"".join(self.frames) + head + skippable(SKIP_SEEK, seek)


class TokenFileReader:
    """Reads documents of a file by their number in it; only the frames that hold them are read and decompressed."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 9 - 12 * n - 8)
        number, length = struct.unpack("<II", source.read(8))
        if number != SKIP_SEEK or length != 12 * n + 9:
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(source.read(12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.begin = np.concatenate([[0], np.cumsum(self.table[:, 1])]) // 4  # in ids
        source.seek(int(self.at[-1]))
        number, length = struct.unpack("<II", source.read(8))
        if number != SKIP_DOCS:
            raise ValueError("the list of documents is missing")
        self.lengths = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read(length)), dtype="<u8").astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.at[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.table[k, 0])), max_output_size=max(1, int(self.table[k, 1])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} does not match its checksum")
        return raw

    def documents(self, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
        """The ids of documents start to stop; a document lies in one frame."""
        k, raw = -1, b""
        for d in range(start, len(self.lengths) if stop is None else stop):
            if (mine := int(np.searchsorted(self.begin, self.first[d], "right")) - 1) != k:
                k, raw = mine, self.frame(mine)
            a = int(self.first[d] - self.begin[k]) * 4
            yield raw[a : a + 4 * int(self.lengths[d])]


MANIFEST = "part int, number int, path string, n_docs long, n_ids long"


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the files and returns their manifest, one row per file. Range-partitioned by doc_id: the one shuffle of texts.

    A file's name holds its partition and number, and it is moved into place when complete: a repeated task writes the same files again.
    """
    bounded_batches(df.sparkSession)
    place, root = pafs.FileSystem.from_uri(folder)
    place.create_dir(root, recursive=True)
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, number, rows = task.partitionId(), 0, []
        current, ids = TokenFile(), []

        def put():
            nonlocal current, number, ids
            if current.lengths:
                name = f"{base}/{part:06d}-{number:06d}"
                for end, content in ((".tok", current.content()), (".ids", b"".join(ids))):
                    with store.open_output_stream(f"{name}.{task.taskAttemptId()}{end}") as out:
                        out.write(content)
                    store.move(f"{name}.{task.taskAttemptId()}{end}", name + end)
                rows.append((part, number, name, len(current.lengths), current.ids))
                number += 1
            current, ids = TokenFile(), []

        enc, end = encoder(tokenizer), struct.pack("<I", end_id)
        for b in batches:
            for key, got in zip(b.column(0).to_pylist(), enc.encode(texts(b, "text")), strict=True):
                current.add(got + end)
                ids.append(struct.pack("<?q", key is not None, key or 0))
                if current.ids >= FILE_IDS:
                    put()
        put()
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "number", "path", "n_docs", "n_ids"), r, strict=True)) for r in rows], pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    if kind != "bigint":
        raise TypeError(f"doc_id must be a long, not {kind}")
    order = [null_first("doc_id"), F.xxhash64("text")]  # rows without an id, or of one id, may fill several tasks
    ordered = df.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, MANIFEST)


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, all from the files named in the manifest. start is counted over all files in their order."""
    order = W.Window.orderBy("part", "number").rowsBetween(W.Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    schema = T._parse_datatype_string("doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for r in b.to_pylist():
                with store.open_input_stream(r["path"] + ".ids") as f:
                    keys = np.frombuffer(f.read(), dtype=[("there", "?"), ("id", "<i8")])
                with store.open_input_file(r["path"] + ".tok") as f:
                    reader = TokenFileReader(f)
                    crc = [zlib.crc32(x) for x in reader.documents()]
                ids = pa.array(keys["id"], mask=~keys["there"])
                yield pa.record_batch([ids, pa.array(reader.first[:-1] + r["before"]), pa.array(reader.lengths), pa.array(crc, pa.int64())], schema.names)

    return placed.select("path", "before").repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInArrow(run, schema)


def write_and_read(df: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """read() of what write() puts into a new folder of the shared one. The manifest is a written table, so files are made once."""
    spark = df.sparkSession
    folder = shared_folder(spark, "tokens")
    write(df, f"{folder}/files", tokenizer, end_id).write.parquet(f"{folder}/manifest")
    return read(spark, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"), f"{folder}/files")
