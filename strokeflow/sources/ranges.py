"""Session logs read by byte ranges, so that a file of any size is read by many tasks.

1. Each range guesses where its first record starts: at the first place from which ``CHAIN`` plausible
   record headers follow one another. From there it walks to the first record of the next range.
2. For each file the guesses are held against the chain from its start. A range that guessed wrong is walked
   again from where the chain really enters it, until it meets a record that its guess had found.
   The number of records and of clock wraps before each range are added up on the way.
3. Each range that the chain enters yields its records, numbered and with the wraps of the clock before them.

The rows are those of reading files whole, whatever the size of a range; a file that is broken anywhere
has one row with its error and none else. A file no longer than a range is read once, whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strokeflow.sources import logs
from strokeflow.sources.scratch import spread, stored

RANGE_BYTES = 32 << 20
#: Headers in a row that make a guess.
CHAIN = 6
_HEAD, _RECORD = logs.FILE_HEADER.size, logs.RECORD_HEADER
_PAYLOAD = [name for name, _ in logs._WITH_WRAPS].index("payload")
_LONGEST = _RECORD.size + 0xFFFF
_KNOWN = frozenset((*(t.encode() for t in logs.SIZES), b"IMU "))
_PRINTABLE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_ \0")

_RANGE = "path string, length long, no int, begin long, end long"
_GUESS = f"{_RANGE}, entry long, exit long, records long, first_t long, last_t long, wraps long"
_ENTERED = "path string, length long, error string, entry long, exit long, before long, wraps_before long, t_before long"


def opened(path: str):
    """A file of any store that pyarrow knows, for reading at any place."""
    files, name = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return files.open_input_file(name)


def _wraps(t: int, last: int | None) -> bool:
    """Whether the 32-bit clock started anew between two records."""
    return last is not None and last - t > 1 << 31


class _Window:
    """The bytes of a file from ``begin`` on; what lies beyond is read when it is asked for."""

    def __init__(self, path: str, length: int, begin: int, size: int):
        self.path, self.length, self.begin = path, length, begin
        self.file = opened(path)
        self.data = self._read(begin, size)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(max(0, min(size, self.length - at)))

    def header(self, at: int):
        """(tag, length, flags, seq, t) at a place of the file, None where the file ends before."""
        if at + _RECORD.size > self.length:
            return None
        here = at - self.begin
        if here < 0 or here + _RECORD.size > len(self.data):
            return _RECORD.unpack(self._read(at, _RECORD.size))
        return _RECORD.unpack_from(self.data, here)

    def payload(self, at: int, size: int) -> bytes:
        here = at - self.begin
        return self.data[here : here + size] if 0 <= here and here + size <= len(self.data) else self._read(at, size)

    def walk(self, at: int, end: int) -> Iterator[tuple[int, tuple]]:
        """(place, header) of the records that start before ``end``; it stops before a broken one."""
        while at < end:
            head = self.header(at)
            if head is None or at + _RECORD.size + head[1] > self.length:
                return
            yield at, head
            at += _RECORD.size + head[1]

    def plausible(self, at: int) -> bool:
        """Whether a chain of records starts here, as far as its next headers tell."""
        for i in range(CHAIN):
            if at == self.length:
                return i > 0
            head = self.header(at)
            if head is None or not _PRINTABLE.issuperset(head[0]) or (i == 0 and head[0] not in _KNOWN):
                return False
            at += _RECORD.size + head[1]
            if at > self.length:
                return False
        return True

    def guess(self, begin: int, end: int) -> int | None:
        """The first place in a range from which records seem to follow."""
        if begin <= _HEAD < end:
            return _HEAD
        places: dict[bytes, int] = {}
        at = begin
        while at < end:
            found = []
            for tag in _KNOWN:
                if places.get(tag, -1) < at:
                    here = self.data.find(tag, at - self.begin, end - self.begin + len(tag) - 1)
                    places[tag] = here + self.begin if here >= 0 else end
                found.append(places[tag])
            at = min(found)
            if at < end and self.plausible(at):
                return at
            at += 1
        return None

    def close(self) -> None:
        self.file.close()


def _summary(window: _Window, entry: int, end: int) -> tuple:
    """(exit, records, first_t, last_t, wraps) of the records of a range from its entry."""
    exit_, n, first, last, wraps = entry, 0, None, None, 0
    for at, (_, size, _, _, t) in window.walk(entry, end):
        wraps += _wraps(t, last)
        first, last, n, exit_ = (t if first is None else first), t, n + 1, at + _RECORD.size + size
    return exit_, n, first, last, wraps


def _guesses(parts):
    for part in parts:
        rows = []
        for r in part.to_pylist():
            window = _Window(r["path"], r["length"], r["begin"], r["end"] - r["begin"] + _RECORD.size)
            entry = window.guess(r["begin"], r["end"])
            found = (None,) * 5 if entry is None else _summary(window, entry, r["end"])
            rows.append((*r.values(), entry, *found))
            window.close()
        yield _table(rows, _GUESS)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _rewalked(path: str, length: int, end: int, entry: int) -> tuple:
    """The summary of a range that was guessed wrong, from its true entry."""
    window = _Window(path, length, entry, end - entry + _RECORD.size)
    try:
        return _summary(window, entry, end)
    finally:
        window.close()


def _entered(path: str, guesses: Iterator[dict]) -> list[tuple]:
    """The ranges of one file that its chain of records enters, or its error.

    A file's ranges are few, one for each ``RANGE_BYTES``, and come in order; only ranges guessed wrong are read here.
    """
    error = length = None
    out, at, n, wraps, last = [], _HEAD, 0, 0, None
    for r in guesses:
        if length is None:
            length = r["length"]
            try:
                with opened(path) as f:
                    logs.read_header(f.read(_HEAD))
            except logs.LogError as x:
                error = str(x)
        if error or at >= r["end"]:
            continue
        found = tuple(r[c] for c in ("exit", "records", "first_t", "last_t", "wraps")) if r["entry"] == at else _rewalked(path, length, r["end"], at)
        exit_, records, first, last_t, inside = found
        out.append((path, length, None, at, exit_, n, wraps, last))
        if records:
            wraps += inside + _wraps(first, last)
            n, at, last = n + records, exit_, last_t
        if at < r["end"] and at < length:
            error = "trailing bytes after the last record" if at + _RECORD.size > length else "payload of the last record is cut short"
    return [(path, length, error, None, None, None, None, None)] if error or not out else out


def _chains(parts):
    """The ranges entered in the files of a partition that is sorted by path and number; many files' rows make a batch."""
    rows = []
    for path, guesses in itertools.groupby((r for part in parts for r in part.to_pylist()), key=lambda r: r["path"]):
        rows += _entered(path, guesses)
        if len(rows) >= logs.BATCH:
            yield _table(rows, _ENTERED)
            rows = []
    if rows:
        yield _table(rows, _ENTERED)


def entered_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """What the chain of each of ``files(path, length)`` enters: one row for each range, or one with an error."""
    last = F.greatest(F.ceil(F.col("length") / range_bytes) - 1, F.lit(0)).cast("int")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0), last)).alias("no"))
    begin = F.col("no").cast("long") * range_bytes
    ranges = ranges.withColumns({"begin": begin, "end": F.least(begin + range_bytes, F.col("length"))})
    guesses = spread(ranges, "path", "no").mapInArrow(_guesses, _GUESS)
    found = spread(guesses, "path").sortWithinPartitions("path", "no")
    return stored(found.mapInArrow(_chains, _ENTERED), "log-ranges")


def _framed(r: dict) -> Iterator[tuple]:
    """The records of a file, or of a range that the chain enters; one row with the error of a broken file."""
    if r["error"] is not None:
        yield (r["path"], r["error"], *[None] * (len(logs._WITH_WRAPS) - 2))
        return
    with opened(r["path"]) as f:
        first = f.read(_HEAD)
    header = logs.read_header(first)
    window = _Window(r["path"], r["length"], r["entry"], r["exit"] - r["entry"])
    n, wraps, last = r["before"], r["wraps_before"], r["t_before"]
    for at, (tag, size, flags, seq, t) in window.walk(r["entry"], r["exit"]):
        wraps, last = wraps + _wraps(t, last), t
        name = tag.decode("ascii", "replace").rstrip("\0 ")
        head = (first, r["length"]) if n == 0 else (None, None)
        yield (r["path"], None, *header, n, name, 1, flags, seq, t, window.payload(at + _RECORD.size, size), *head, wraps)
        n += 1
    window.close()


def _whole(r: dict) -> Iterator[tuple]:
    """:func:`_framed` of a file that is no longer than a range, and read once."""
    path, length = r["path"], r["length"]
    with opened(path) as f:
        data = f.read(length)
    try:
        header, found = logs.read_header(data), list(logs.walk_records(data))
    except logs.LogError as x:
        yield (path, str(x), *[None] * (len(logs._WITH_WRAPS) - 2))
        return
    wraps, last = 0, None
    for n, tag, flags, seq, t, start, end in found:
        wraps, last = wraps + _wraps(t, last), t
        head = (data[:_HEAD], length) if n == 0 else (None, None)
        yield (path, None, *header, n, tag, 1, flags, seq, t, data[start:end], *head, wraps)


def _records(framed):
    """Batches of records, which short files and ranges share."""

    def run(parts):
        rows, held = [], 0
        for row in (row for part in parts for r in part.to_pylist() for row in framed(r)):
            rows.append(row)
            held += len(row[_PAYLOAD] or b"")
            if len(rows) == logs.BATCH or held > RANGE_BYTES:
                yield logs._batch(rows, logs._WITH_WRAPS)
                rows, held = [], 0
        if rows:
            yield logs._batch(rows, logs._WITH_WRAPS)

    return run


def read_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES, failfast: bool = False) -> DataFrame:
    """The records of ``files(path, length)``, with ``wraps``: how often the clock had started anew before."""
    schema = f"{logs.RECORDS}, wraps long"
    # A broken file must be known before the first record comes out.
    longer = files if failfast else files.where(F.col("length") > range_bytes)
    entered = entered_ranges(longer, range_bytes)
    if failfast and (bad := entered.where("error is not null").select("path", "error").first()):
        raise logs.LogError(f"{bad.path}: {bad.error}")
    # A file without records has a header all the same, and no rows.
    some = spread(entered.where("error is not null or entry < exit"), "path", "entry")
    out = some.mapInArrow(_records(_framed), schema)
    if failfast:
        return out
    short = spread(files.where(F.col("length") <= range_bytes).select("path", "length"), "path")
    return out.unionByName(short.mapInArrow(_records(_whole), schema))
