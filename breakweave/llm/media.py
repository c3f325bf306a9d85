"""Media columns: images in archive files, read back by a data source that plans byte ranges.

An archive holds members one after another and ends with a directory: fixed-width entries in the order of the offsets,
then a footer with the number of entries and where they start. A member is a grayscale PNG, 64 samples of 8 bits to a row.
The source lists the archive directory, cuts every file into byte ranges and gives each range to a partition; the
partition reads the file's directory, takes the members that start in its range, reads and decodes each on its own at its
offset, tries a member again (with the file reopened) if that fails or its checksum differs, and streams batches of
payloads through Arrow. A member that fails every time stops the task, so that Spark tries that range elsewhere.

Writing names an archive by its partition and moves it into place when it is whole, so a task that runs again replaces
the same file with the same bytes, and a lost executor leaves only a file without the archives' suffix.

Defined results: a null text is an empty one, stored as 64 zero bytes; a null doc_id is carried; repeated rows give
repeated members; other columns are not read; an empty table gives archives without members and no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from breakweave.llm.common import Rows, decoded, new_path, slices, text_bytes

WIDTH = 64
SUFFIX = ".mar"
#: has id, id, offset, length, bytes before padding, CRC-32 of the member
ENTRY = struct.Struct("<?qqqqI")
FOOTER = struct.Struct("<qq4s")
MAGIC = b"MAR1"
ATTEMPTS = 3
RANGE_BYTES = 32 << 20
PNG = b"\x89PNG\r\n\x1a\n"


class BadMember(Exception):
    pass


def padded(data: bytes) -> bytes:
    return data + b"\0" * (max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """A grayscale image of 8 bits with 64 samples a row and no row filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    if media[:8] != PNG:
        raise BadMember("not a PNG")
    at, data = 8, []
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise BadMember("chunk checksum")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean step from one to the next."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    n, values = len(samples), np.arange(256)
    mean = float((counts * values).sum()) / n
    deviation = float(((counts * values * values).sum() / n - mean * mean)) ** 0.5 if n else 0.0
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    step = float(np.abs(np.diff(samples.astype(np.int16))).sum()) / max(1, n - 1)
    return f"mean={mean:.4f};sd={deviation:.4f};entropy={entropy:.4f};step={step:.4f}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def write_archive(path: str, name: str, batches: Iterator[pa.RecordBatch], level: int = 1) -> int:
    """One archive of all (doc_id, text) rows of the batches; returns the number of members."""
    store, folder = opened(path)
    draft, entries, at = f"{folder}/{name}.{uuid.uuid4().hex}.draft", [], 0
    with store.open_output_stream(draft) as out:
        for part in slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                data = decoded(text).encode()
                media = to_png(padded(data), level)
                out.write(media)
                entries.append(ENTRY.pack(doc_id is not None, doc_id or 0, at, len(media), len(data), zlib.crc32(media)))
                at += len(media)
        out.write(b"".join(entries))
        out.write(FOOTER.pack(len(entries), at, MAGIC))
    store.move(draft, f"{folder}/{name}{SUFFIX}")
    return len(entries)


def write_archives(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> int:
    """Write an archive for each partition of df into the directory; returns the number of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = write_archive(path, f"part-{TaskContext.get().partitionId():08d}", batches, level)
        yield pa.RecordBatch.from_arrays([pa.array([members], pa.int64())], names=["members"])

    store, folder = opened(path)
    store.create_dir(folder, recursive=True)
    return text_bytes(df, id_col, text_col).mapInArrow(run, "members long").groupBy().sum("members").first()[0] or 0


class Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[Range]:
        store, folder = opened(self.path)
        files = sorted((x.path, x.size) for x in store.get_file_info(fs.FileSelector(folder)) if x.path.endswith(SUFFIX))
        return [Range(f, at, at + self.range_bytes) for f, size in files for at in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows = Rows(SCHEMA)
        if partition.file:
            store, _ = opened(self.path)
            file = store.open_input_file(partition.file)
            for has_id, doc_id, offset, length, n_bytes, crc in self.directory(file, partition):
                for attempt in range(self.attempts):
                    try:
                        media = self.member(file, offset, length, crc)
                        payload = from_png(media)
                        break
                    except (OSError, BadMember, zlib.error, struct.error):
                        if attempt + 1 == self.attempts:
                            raise
                        file = store.open_input_file(partition.file)
                rows.add(doc_id if has_id else None, os.path.basename(partition.file), offset, n_bytes, length, sha256(media).hexdigest(), payload, size=len(payload) + 200)
                yield from rows.take()
        yield from rows.take(force=True)

    @staticmethod
    def member(file, offset: int, length: int, crc: int) -> bytes:
        file.seek(offset)
        media = file.read(length)
        if len(media) != length or zlib.crc32(media) != crc:
            raise BadMember(f"member at {offset}")
        return media

    @staticmethod
    def directory(file, partition: Range) -> Iterator[tuple]:
        """The entries whose members start in the range; the first is found by bisection."""
        size = file.size()
        file.seek(size - FOOTER.size)
        count, start, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise BadMember("no directory")

        def entry(k: int) -> tuple:
            file.seek(start + k * ENTRY.size)
            return ENTRY.unpack(file.read(ENTRY.size))

        low, high = 0, count
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if entry(mid)[2] < partition.start else (low, mid)
        block = 4096
        while low < count:
            file.seek(start + low * ENTRY.size)
            for found in ENTRY.iter_unpack(file.read(min(block, count - low) * ENTRY.size)):
                if found[2] >= partition.stop:
                    return
                yield found
            low += block


SCHEMA = pa.schema([("doc_id", pa.int64()), ("archive", pa.string()), ("member_offset", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload", pa.binary())])


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").option("rangeBytes", n).load(directory)"""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, archive string, member_offset long, n_bytes long, media_bytes long, media_sha256 string, payload binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(**options).load(path)


def with_features(media: DataFrame, payload_col: str = "payload") -> DataFrame:
    """media with `feature` in the payload's place."""
    names = [c for c in media.columns if c != payload_col]
    fields = [media.schema[c] for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([features(x) for x in batch.column(batch.schema.get_field_index(payload_col)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), values], names=[*names, "feature"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", feature string"
    return media.mapInArrow(run, ddl)


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write df's texts as media into a new directory of the shared folder and read them back."""
    spark = df.sparkSession
    path = new_path(spark, "archives")
    write_archives(df, path, id_col, text_col)
    return read_archives(spark, path)
