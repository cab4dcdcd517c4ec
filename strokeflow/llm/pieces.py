"""SentencePiece encoding that keeps byte offsets, and decoding.

1. A text is normalised here, not by the library: at each place the longest key of the model's compiled
   character map (or a user-defined symbol) is replaced, spaces are trimmed and marked as the model
   says, and every normalised byte keeps the place in the text that it came from.
2. The normalised text is segmented by the library with its own normaliser switched off. If no piece of a
   BPE model holds the mark of a space behind another character, no merge reaches over the start of a
   word, so each distinct word of a task is segmented once.
3. A piece's place in the normalised text is projected to a byte span of the text.

The model file is read on the driver and broadcast; it is refused above ``MAX_MODEL_BYTES``.

Null texts are empty; an empty text has no ids. Bytes that are not UTF-8 become U+FFFD one by one. Rows
are independent: repeated rows get equal results, an empty table gives an empty result, and columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strokeflow.llm.shingles import slices

MAX_MODEL_BYTES = 64 << 20
#: Characters of distinct words that a task remembers, and new words that are segmented at once.
REMEMBERED, TOGETHER = 4 << 20, 500

SCHEMA = "ids array<int>, begins array<int>, ends array<int>, span_bytes long, decoded string"

# Fixed values of the model format: field numbers, kinds of pieces, the mark that stands for a space.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6
MODEL_TYPE, SUFFIX_SPACE = 3, 24
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
BPE = 2
MARK = "▁"

_MARK_BYTES = np.frombuffer(MARK.encode(), dtype=np.uint8)
_SPACE = 0x20
_BAD = "�".encode()
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialised message; fixed-width values stay bytes."""
    out, at = [], 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        out.append((key >> 3, value))
    return out


class CharMap:
    """The compiled map of a model: a double-array trie of byte strings, and what replaces them."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).astype(np.int64) if size else None
        self.values = blob[4 + size :]

    def longest(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, value) of the longest key at each of the places ``at`` that has one before its text ends.

        All places walk the trie together, one byte in each round.
        """
        length, value = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        if self.units is None:
            return at[:0], length[:0], value[:0]
        units = self.units

        def offset(unit):
            return (unit >> 10) << ((unit & 512) >> 6)

        open_ = np.arange(len(at))
        node = np.full(len(at), offset(units[0]), dtype=np.int64)
        depth = 0
        while len(open_):
            inside = at[open_] + depth < ends[open_]
            open_, node = open_[inside], node[inside]
            byte = data[at[open_] + depth].astype(np.int64)
            node = node ^ byte
            known = node < len(units)
            open_, node, byte = open_[known], node[known], byte[known]
            unit = units[node]
            fits = (unit & 0x800000FF) == byte
            open_, node, unit = open_[fits], node[fits], unit[fits]
            node = node ^ offset(unit)
            depth += 1
            leaf = (unit >> 8) & 1 == 1
            length[open_[leaf]] = depth
            value[open_[leaf]] = units[node[leaf]] & 0x7FFFFFFF
        found = length > 0
        return at[found], length[found], value[found]

    def replacement(self, value: int) -> bytes:
        return self.values[value : self.values.index(b"\0", value)]


class Normaliser:
    """Normalises whole slices of texts and keeps where each byte came from."""

    def __init__(self, spec: dict[int, int | bytes], symbols: list[bytes]):
        self.map = CharMap(spec.get(CHARSMAP, b""))
        self.prefix, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE))
        longest_first = b"|".join(map(re.escape, sorted(symbols, key=len, reverse=True)))
        self.symbols = re.compile(b"(?=(" + longest_first + b"))", re.DOTALL) if symbols else None

    def _changes(self, data: np.ndarray, bounds: np.ndarray, lead: np.ndarray) -> list[tuple[int, int, bytes]]:
        """(place, length, replacement) from left to right, without overlaps."""
        places = np.flatnonzero(lead) if self.map.units is not None else np.empty(0, dtype=np.int64)
        at, length, value = self.map.longest(data, places, bounds[np.searchsorted(bounds, places, "right")])
        found = {p: (n, self.map.replacement(v)) for p, n, v in zip(at.tolist(), length.tolist(), value.tolist(), strict=True)}
        raw = data.tobytes()
        for p in _malformed(raw):
            found[p] = (1, _BAD)
        if self.symbols:
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                found.update((a + m.start(), (len(m[1]), m[1])) for m in self.symbols.finditer(raw[a:b]))
        out, free = [], 0
        for p, (n, text) in sorted(found.items()):
            if p >= free:
                out.append((p, n, text))
                free = p + n
        return out

    def run(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
        """(normalised bytes, place in the text of each of them and of the end) of each text."""
        lead = (data & 0xC0) != 0x80
        starts = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0)) if len(data) else np.empty(0, dtype=np.int64)
        units, source, cuts, stop = data, starts, bounds, None
        if self.prefix and self.trim:
            stop = np.append(np.flatnonzero(lead), len(data))[np.cumsum(lead)] if len(data) else starts
        if changes := self._changes(data, bounds, lead):
            place, size = (np.array([x[i] for x in changes], dtype=np.int64) for i in (0, 1))
            made = np.array([len(x[2]) for x in changes], dtype=np.int64)
            count = np.ones(len(data), dtype=np.int64)
            count[_ranges(place, size)] = 0
            count[place] = made
            ends = np.cumsum(count)
            units, source = np.repeat(data, count), np.repeat(starts, count)
            inside = _ranges(ends[place] - made, made)
            units[inside] = np.frombuffer(b"".join(x[2] for x in changes), dtype=np.uint8)
            source[inside] = np.repeat(place, made)
            if stop is not None:
                stop = np.repeat(stop, count)
                stop[inside] = np.repeat(place + size, made)
            cuts = np.concatenate([[0], ends])[bounds]
        out = []
        for a, b, lo, hi in zip(cuts[:-1], cuts[1:], bounds[:-1], bounds[1:], strict=True):
            first = 0  # the mark in front of a text stands before what is not a space
            while stop is not None and a < b and units[a] == _SPACE and source[a] - lo == first and (a + 1 == b or source[a + 1] != source[a]):
                first, a = int(stop[a] - lo), a + 1
            out.append(self._spaced(units[a:b], source[a:b] - lo, first, hi - lo))
        return out

    def _spaced(self, units: np.ndarray, source: np.ndarray, first: int, size: int) -> tuple[bytes, np.ndarray]:
        """One text with its spaces trimmed and marked."""
        if first == size:
            return b"", np.full(1, size, dtype=np.int64)
        if self.trim:
            space = units == _SPACE
            keep = ~space
            keep[1:] |= ~space[:-1]
            units, source = units[keep], source[keep]
        if self.prefix:
            units = np.concatenate([[_SPACE], units]).astype(np.uint8)
            source = np.concatenate([[first], source])
        mark = _MARK_BYTES if self.escape else np.array([_SPACE], dtype=np.uint8)
        count = np.where(units == _SPACE, len(mark), 1)
        at = np.flatnonzero(units == _SPACE)
        if len(mark) > 1 and len(at):
            units, source = np.repeat(units, count), np.repeat(source, count)
            at = np.cumsum(count)[at] - len(mark)
            for i, byte in enumerate(mark):
                units[at + i] = byte
        out, end = units.tobytes(), size
        if self.trim:
            tail = mark.tobytes()
            while out.endswith(tail):
                out = out[: -len(tail)]
                end = int(source[len(out)])
        return out, np.append(source[: len(out)], end)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of ``size[0]`` numbers, then of the next."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - first, size)


def _malformed(raw: bytes) -> list[int]:
    out, at = [], 0
    while True:
        try:
            raw[at:].decode()
            return out
        except UnicodeDecodeError as e:
            out.extend(range(at + e.start, at + e.end))
            at += e.end


class PieceEncoder:
    """One task's encoder of a model, with the words that it has seen."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        top = fields(model)
        spec = {k: v for number, x in top if number == NORMALIZER for k, v in fields(x)}
        trainer = {k: v for number, x in top if number == TRAINER for k, v in fields(x)}
        pieces = [dict(fields(x)) for number, x in top if number == PIECE]
        kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(SUFFIX_SPACE):
            raise ValueError("models that put the mark of a space behind a word are not supported")
        self.normaliser = Normaliser(spec, [p[1] for p, kind in zip(pieces, kinds, strict=True) if kind == USER_DEFINED])
        self.decoder = SentencePieceProcessor(model_proto=model)
        # A message that is appended is merged into the first: it switches the normaliser's steps off.
        off = bytes([CHARSMAP << 3 | 2, 0, DUMMY_PREFIX << 3, 0, REMOVE_EXTRA << 3, 0, ESCAPE << 3, 0])
        self.segmenter = SentencePieceProcessor(model_proto=model + bytes([NORMALIZER << 3 | 2, len(off)]) + off)
        inner = re.compile(f"[^{MARK}]{MARK}")
        joins = any(inner.search(p[1].decode(errors="replace")) for p, kind in zip(pieces, kinds, strict=True) if kind in (NORMAL, USER_DEFINED, UNUSED))
        self.by_word = trainer.get(MODEL_TYPE) == BPE and not joins
        # Bytes of normalised text that a piece stands for; an unknown one has no length of its own.
        self.size = np.array([-1 if kind == UNKNOWN else 1 if kind == BYTE else len(p[1]) for p, kind in zip(pieces, kinds, strict=True)], dtype=np.int64)
        self.words: dict[str, bytes] = {}
        self.held = 0

    def _remember(self, words: list[str]) -> None:
        """The ids of new words. Words that begin with a mark and end without are segmented many at a time: none merges with the next."""
        joined = [w for w in words if w[0] == MARK and w[-1] != MARK]
        single = [w for w in words if w[0] != MARK or w[-1] == MARK]
        for at in range(0, len(joined), TOGETHER):
            some = joined[at : at + TOGETHER]
            ids = np.array(self.segmenter.encode("".join(some)), dtype=np.int32)
            size = self.size[ids]
            if (size < 0).any():
                single += some
                continue
            cuts = np.searchsorted(np.cumsum(size), np.cumsum([len(w.encode()) for w in some])) + 1
            flat, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
            self.words.update(zip(some, (flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))
        self.words.update((w, np.array(x, dtype=np.int32).tobytes()) for w, x in zip(single, self.segmenter.encode(single, num_threads=1), strict=True))
        self.held += sum(map(len, words))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(x, dtype=np.int32) for x in self.segmenter.encode(texts, num_threads=1)]
        words = [_WORD.findall(x) for x in texts]
        self._remember(list(set().union(*words).difference(self.words)))
        out = [np.frombuffer(b"".join(map(self.words.__getitem__, x)), dtype=np.int32) for x in words]
        if self.held > REMEMBERED:
            self.words, self.held = {}, 0
        return out

    def _places(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and the begin of each and the end of the last in the normalised bytes."""
        at = np.zeros(len(ids) + 1, dtype=np.int64)
        size = self.size[ids]
        np.cumsum(size, out=at[1:])
        if (size >= 0).all():
            return ids, at
        # The library alone knows how much an unknown piece covers; its offsets count code points.
        found = self.segmenter.encode(text, out_type="offset_mapping")
        at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
        return np.array(found["ids"], dtype=np.int32), at[np.array([0, *(end for _, end in found["offsets"])], dtype=np.int64)]

    def encode(self, data: np.ndarray, bounds: np.ndarray):
        """(ids, begin and end of each in the bytes of its text) of each text of a slice."""
        normal = self.normaliser.run(data, bounds)
        texts = [raw.decode() for raw, _ in normal]
        for text, (_, source), found in zip(texts, normal, self._ids(texts), strict=True):
            ids, at = self._places(text, found)
            place = source[at]
            yield ids, place[:-1], place[1:]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.decoder.decode([x.tolist() for x in ids], num_threads=1)


@functools.lru_cache(maxsize=1)
def _encoder(model: bytes) -> PieceEncoder:
    return PieceEncoder(model)


def _column(parts: list, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in parts]) if parts else np.empty(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def encode_texts(docs: DataFrame, model_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id column, then ids, begins and ends (byte spans in the text), span_bytes and decoded of each row.

    ``span_bytes`` is the number of bytes of the text that the pieces cover; ``decoded`` is what the ids decode to.
    """
    with open(model_path, "rb") as f:
        model = f.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"the model has over {MAX_MODEL_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        encoder = _encoder(shared.value)
        for part in parts:
            for lo, hi, data, bounds in slices(part.column(1)):
                ids, begins, ends = map(list, zip(*encoder.encode(data, bounds), strict=True))
                covered = [int((e - b).sum()) for b, e in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0)[lo:hi], _column(ids, pa.int32()), _column(begins, pa.int32()), _column(ends, pa.int32()),
                        pa.array(covered, pa.int64()), pa.array(encoder.decode(ids), pa.string()),
                    ],
                    ["id", "ids", "begins", "ends", "span_bytes", "decoded"],
                )

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id)
