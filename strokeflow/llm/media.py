"""Media columns: a Spark data source for directories of media archives.

An archive is a tar file of members, with an index file beside it that lists where each member
starts and how long it is. The reader plans byte ranges over the archives from their sizes alone;
a task takes the members whose headers start in its range and streams them as Arrow batches of
bounded size. Each member is read by its own offset and tried again on its own; one that stays
unreadable gives a row with its error (``mode`` "permissive") or ends the query ("failfast").

    spark.dataSource.register(MediaArchive)
    frame.write.format("mediaarchive").mode("append").save(path)     # columns name, media
    spark.read.format("mediaarchive").load(path)                     # archive, offset, name, media, error

Paths are opened with :mod:`pyarrow.fs`, so object stores and HDFS work as local folders do.

:func:`store_texts` keeps texts as 8-bit greyscale PNG images, 64 samples a row: the UTF-8 bytes,
filled up with zero bytes to a positive multiple of 64 (null counts as empty). Repeated rows and
equal texts give equal images; a null doc_id stays null; an empty table gives no archive members;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from strokeflow.llm.common import shared_dir

_BLOCK = 512
READ_SCHEMA = "archive string, offset long, name string, media binary, error string"
_ARROW = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("name", pa.string()), ("media", pa.binary()), ("error", pa.string())]
)


@dataclass
class ByteRange(InputPartition):
    """Members of one archive whose headers start at ``start`` <= offset < ``end``."""

    archive: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    archives: list[str]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _member_offsets(files: fs.FileSystem, archive: str, size: int) -> np.ndarray:
    """(offset, length) of each member, from the index file or else from the headers."""
    index = archive.removesuffix(".tar") + ".idx"
    if files.get_file_info(index).type != fs.FileType.NotFound:
        with files.open_input_file(index) as f:
            return np.frombuffer(f.read(), dtype="<i8").reshape(-1, 2)
    out, at = [], 0
    with files.open_input_file(archive) as f:
        while at + _BLOCK <= size:
            f.seek(at)
            head = f.read(_BLOCK)
            if not head.strip(b"\0"):
                break
            length = tarfile.TarInfo.frombuf(head, "utf-8", "surrogateescape").size
            out.append((at, length))
            at += _BLOCK + -(-length // _BLOCK) * _BLOCK
    return np.array(out, dtype="<i8").reshape(-1, 2)


class _Archive:
    """An archive that is opened when it is first read, and anew after an error."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.files, self.path, self.file = files, path, None

    def read(self, offset: int, size: int) -> bytes:
        if self.file is None:
            self.file = self.files.open_input_file(self.path)
        self.file.seek(offset)
        return self.file.read(size)

    def close(self) -> None:
        if self.file is not None:
            with contextlib.suppress(OSError):
                self.file.close()
        self.file = None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", 32 << 20))
        self.batch_bytes = int(options.get("batchbytes", 4 << 20))
        self.retries = int(options.get("retries", 3))
        self.failfast = options.get("mode", "failfast").lower() == "failfast"

    def partitions(self) -> list[ByteRange]:
        files, root = _open(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return [
            ByteRange(f.path, start, min(start + self.range_bytes, f.size))
            for f in sorted(found, key=lambda f: f.path)
            if f.type == fs.FileType.File and f.path.endswith(".tar")
            for start in range(0, f.size, self.range_bytes)
        ] or [ByteRange("", 0, 0)]

    def _member(self, archive: _Archive, offset: int, length: int):
        """(name, media, error) of one member; a further try opens the archive anew."""
        for attempt in range(self.retries):
            try:
                data = archive.read(offset, _BLOCK + length)
                head = tarfile.TarInfo.frombuf(data[:_BLOCK], "utf-8", "surrogateescape")
                if head.size != length or len(data) != _BLOCK + length:
                    raise OSError(f"member at {offset} of {archive.path} is cut short")
                return head.name, data[_BLOCK:], None
            except (OSError, tarfile.HeaderError) as x:
                error = f"{type(x).__name__}: {x}"
                archive.close()
                if attempt + 1 < self.retries:
                    time.sleep(0.05 * 2**attempt)
        if self.failfast:
            raise OSError(f"{archive.path} at {offset}, after {self.retries} tries: {error}")
        return None, None, error

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        files, _ = _open(self.path)
        size = files.get_file_info(partition.archive).size
        members = _member_offsets(files, partition.archive, size)
        rows, held, archive = [], 0, _Archive(files, partition.archive)
        for offset, length in members[(members[:, 0] >= partition.start) & (members[:, 0] < partition.end)].tolist():
            rows.append((partition.archive, offset, *self._member(archive, offset, length)))
            held += length
            if held >= self.batch_bytes:
                yield _batch(rows)
                rows, held = [], 0
        archive.close()
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW
    )


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes its own archives; the driver renames those of the tasks that count."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.archive_bytes = int(options.get("archivebytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        done, out, index, at = [], None, [], 0

        def close():
            out.write(b"\0" * 2 * _BLOCK)
            out.close()
            with files.open_output_stream(done[-1] + ".idx.part") as f:
                f.write(np.array(index, dtype="<i8").tobytes())

        for batch in iterator:
            names, media = batch.column(batch.schema.get_field_index("name")), batch.column(batch.schema.get_field_index("media"))
            for name, data in zip(names, media, strict=True):
                if out is None:
                    done.append(f"{root}/archive-{uuid.uuid4().hex}")
                    out, index, at = files.open_output_stream(done[-1] + ".tar.part"), [], 0
                body = data.as_buffer()
                head = tarfile.TarInfo(name.as_py())
                head.size = len(body) if body is not None else 0
                out.write(head.tobuf(tarfile.USTAR_FORMAT))
                if head.size:
                    out.write(body)
                out.write(b"\0" * (-head.size % _BLOCK))
                index.append((at, head.size))
                at += _BLOCK + -(-head.size // _BLOCK) * _BLOCK
                if at >= self.archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        return Written(done)

    def commit(self, messages: list[Written]) -> None:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        for archive in (a for m in messages if m for a in m.archives):
            files.move(archive + ".idx.part", archive + ".idx")
            files.move(archive + ".tar.part", archive + ".tar")

    def abort(self, messages: list[Written]) -> None:
        files, _ = _open(self.path)
        for archive in (a for m in messages if m for a in m.archives):
            for end in (".idx.part", ".tar.part"):
                if files.get_file_info(archive + end).type == fs.FileType.File:
                    files.delete_file(archive + end)


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mediaarchive"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options)


ROW = 64


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length in UTF-8 bytes, and the bytes filled up with zeros to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """8-bit greyscale PNG with a sample for each byte."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of an image that :func:`encode_png` made."""
    at, data = 8, []
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            data.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(-1, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows are supported")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, spread, entropy in bits and mean step of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(share * np.log2(share)).sum():.4f};step={step:.4f}"


def store_texts(docs: DataFrame, path: str, level: int = 6) -> None:
    """Write each text of ``docs(doc_id, text)`` as an image named ``<doc_id>/<bytes>.png``."""

    def run(parts):
        for part in parts:
            names, media = [], []
            for doc, text in zip(part.column(0), part.column(1), strict=True):
                n, payload = payload_of(text.as_py())
                names.append(f"{'' if doc.as_py() is None else doc.as_py()}/{n}.png")
                media.append(encode_png(payload, level))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary())], ["name", "media"])

    spark = docs.sparkSession
    spark.dataSource.register(MediaArchive)
    rows = docs.select("doc_id", "text").mapInArrow(run, "name string, media binary")
    rows.write.format("mediaarchive").mode("append").save(path)


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Read the stored images back and compute the features of each."""

    def run(parts):
        for part in parts:
            out = []
            for name, media in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                doc, _, n = name.removesuffix(".png").partition("/")
                payload = decode_png(media)
                out.append(
                    (int(doc) if doc else None, int(n), len(payload), hashlib.sha256(payload).hexdigest(),
                     zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload))
                )
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in FEATURES.split(", ")]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    spark.dataSource.register(MediaArchive)
    return spark.read.format("mediaarchive").load(path).select("name", "media").mapInArrow(run, FEATURES)


def media_features(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Store the texts of ``docs`` below ``path`` (default: the shared folder) and read them back."""
    path = path or shared_dir(docs.sparkSession, "media")
    store_texts(docs, path)
    return read_features(docs.sparkSession, path)
