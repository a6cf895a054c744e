"""Removal of word windows that occur in an earlier document (operator 9).

A window is `length` consecutive words of one document. A word goes if a window over it also starts in a document with
a smaller id. Two passes over the texts find the windows:

1. Every task counts its windows in a count-min sketch of two rows and hands over its counts, cut into slices of the
   rows; a slice's counts are added up across tasks and kept as bits "counted twice or more". Sketch counts are never
   too small, so no window of two documents is lost.
2. Windows with both bits set are grouped exactly, by 96 bits of two independent hashes of their words, in slices of the
   hash range. A task first groups its own windows: later documents are settled there, and only the first document's
   rows of a window travel, so a window that very many documents share sends a row per group of documents.

The sketch has at least four cells a window, as long as that stays within `max_bits` (2**29 cells, 64 MB a row); beyond,
more windows reach the exact pass, and the result is the same. The bits are read from the shared folder, not broadcast.

Defined cases: null and empty texts have no words; texts shorter than a window keep all; windows of one document do not
affect it; rows without an id keep all; rows with equal ids do not affect each other; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import new_path, ship, stored, texts
from .words import blocks, mixed, runs, spaced

LENGTH = 13
CHUNK_WINDOWS = 500_000
MAX_BITS = 29
SLICE_BITS = 20
_SPREAD = np.uint64(0xA0761D6478BD642F)

# One window in one document: 96 bits of hash, document, tag of its text, position.
_WINDOW = [("h", "<u8"), ("g", "<u4"), ("doc", "<i8"), ("tag", "<u4"), ("at", "<u4")]
_PLACE = [("doc", "<i8"), ("tag", "<u4"), ("at", "<u4")]

Columns = dict[str, np.ndarray]


def packed(columns: Columns, kind: list) -> bytes:
    """Columns one after the other, compressed."""
    import zstandard

    n = len(columns[kind[0][0]])
    body = b"".join(columns[name].astype(dtype).tobytes() for name, dtype in kind)
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def unpacked(data: bytes, kind: list) -> Columns:
    import zstandard

    n = int.from_bytes(data[:8], "little")
    body = zstandard.ZstdDecompressor().decompress(data[8:])
    out, at = {}, 0
    for name, dtype in kind:
        out[name] = np.frombuffer(body, dtype, n, at)
        at += n * np.dtype(dtype).itemsize
    return out


def joined(parts: list[Columns], kind: list) -> Columns:
    return {name: np.concatenate([np.zeros(0, dtype), *(p[name] for p in parts)]) for name, dtype in kind}


def taken(columns: Columns, at: np.ndarray) -> Columns:
    return {name: values[at] for name, values in columns.items()}


def _cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cells of a window in the rows of the sketch, from different bits of its hash."""
    return [(h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)]


def _chunks(batches: Iterator[pa.RecordBatch], length: int, both: bool) -> Iterator[Columns]:
    """Windows of the documents (doc_id, tag, text) in chunks: h, and with `both` also g, doc, tag and at."""
    parts, size = [], 0
    kind = _WINDOW if both else _WINDOW[:1]
    for batch in batches:
        ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for block in blocks(batch.column(2), spaced(), second=both):
            raw, at, document = runs(block.hashes, block.first, length)
            part = {"h": mixed(raw)}
            if both:
                other, _, _ = runs(block.others, block.first, length)
                part["g"] = (mixed(other) >> np.uint64(32)).astype(np.uint32)
                part["doc"], part["tag"] = ids[block.low + document], tags[block.low + document].astype(np.uint32)
                part["at"] = (at - block.first[document]).astype(np.uint32)
            parts.append(part)
            size += len(raw)
            if size >= CHUNK_WINDOWS:
                yield joined(parts, kind)
                parts, size = [], 0
    if size:
        yield joined(parts, kind)


class Sketch(NamedTuple):
    """Where the merged bits of the sketch lie: Parquet rows (slice, bits); slice = row * slices + part of the row."""

    path: str
    bits: int


def _slice_bits(bits: int) -> int:
    return min(bits, SLICE_BITS)


def sketch(rows: DataFrame, length: int, bits: int) -> Sketch:
    """Count all windows and write which cells were counted twice or more."""
    inner = _slice_bits(bits)
    slices = 1 << (bits - inner)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, length, both=False):
            numbers, payloads = [], []
            for row, cells in enumerate(_cells(chunk["h"], bits)):
                cells.sort()
                # Two counts of a cell are as good as more.
                third = np.zeros(len(cells), bool)
                third[2:] = cells[2:] == cells[:-2]
                cells = cells[~third]
                edges = np.searchsorted(cells, np.arange(slices + 1) << inner)
                for k in np.flatnonzero(np.diff(edges)):
                    local = cells[edges[k] : edges[k + 1]] & ((1 << inner) - 1)
                    numbers.append(row * slices + k)
                    payloads.append(packed({"step": np.diff(local, prepend=0)}, [("step", "<u4")]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary())], names=["slice", "steps"]
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts = None, None

        def done():
            bits_ = np.packbits(counts >= 2, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([bits_], pa.binary())], names=["slice", "bits"])

        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                if number != current:
                    if current is not None:
                        yield done()
                    current, counts = number, np.zeros(1 << inner, np.uint8)
                steps = unpacked(payload.as_py(), [("step", "<u4")])["step"]
                cells, times = np.unique(np.cumsum(steps, dtype=np.int64), return_counts=True)
                counts[cells] = np.minimum(counts[cells] + times, 2)
        if current is not None:
            yield done()

    parts = rows.mapInArrow(count, "slice int, steps binary")
    merged = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, bits binary")
    path = new_path(rows.sparkSession, "sketch")
    merged.write.parquet(path)
    return Sketch(path, bits)


_LOADED: dict[str, np.ndarray] = {}


def _loaded(sketch_: Sketch) -> np.ndarray:
    """The bits of both rows, once per worker."""
    if sketch_.path not in _LOADED:
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        storage, root = FileSystem.from_uri(sketch_.path)
        inner = _slice_bits(sketch_.bits)
        size = 1 << max(inner - 3, 0)
        field = np.zeros(2 * size << (sketch_.bits - inner), np.uint8)
        for batch in ds.dataset(root, filesystem=storage, format="parquet").to_batches(batch_size=64):
            for number, bits in zip(batch.column("slice").to_pylist(), batch.column("bits")):
                field[number * size : (number + 1) * size] = np.frombuffer(bits.as_buffer(), np.uint8)
        _LOADED.clear()
        _LOADED[sketch_.path] = field
    return _LOADED[sketch_.path]


def _frequent(h: np.ndarray, sketch_: Sketch) -> np.ndarray:
    """Indices of windows the sketch counts twice or more."""
    field = _loaded(sketch_)
    half = len(field) // 2
    at = np.arange(len(h))
    for row, shift in ((0, 0), (1, half)):
        cells = _cells(h[at], sketch_.bits)[row]
        at = at[(field[shift + (cells >> 3)] >> (cells & 7).astype(np.uint8)) & 1 == 1]
    return at


def _settled(windows: Columns) -> tuple[Columns, Columns]:
    """Rows of each window's first document, and the places of all later documents."""
    order = np.lexsort((windows["doc"], windows["g"], windows["h"]))
    windows = taken(windows, order)
    h, g, doc = windows["h"], windows["g"], windows["doc"]
    if not len(h):
        return windows, {name: windows[name] for name, _ in _PLACE}
    new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.flatnonzero(doc > least)
    return taken(windows, np.flatnonzero(doc == least)), {name: windows[name][later] for name, _ in _PLACE}


def _dealt(columns: Columns, kind: list, number: np.ndarray, mark: int) -> Iterator[tuple[int, int, bytes]]:
    """Pack rows by their number."""
    order = np.argsort(number, kind="stable")
    columns, number = taken(columns, order), number[order]
    edges = np.r_[np.flatnonzero(np.r_[True, number[1:] != number[:-1]]), len(number)] if len(number) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(number[a]), mark, packed(taken(columns, slice(a, b)), kind)


def _bucket(places: Columns, buckets: int) -> np.ndarray:
    return (mixed(places["doc"].astype(np.uint64) * _SPREAD) % np.uint64(buckets)).astype(np.int64)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    number, mark, payload = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(number, pa.int32()), pa.array(mark, pa.int8()), pa.array(payload, pa.binary())],
        names=["number", "mark", "rows"],
    )


DEALT = "number int, mark byte, rows binary"


def repeated_places(rows: DataFrame, length: int, sketch_: Sketch, slices: int) -> DataFrame:
    """doc_id, tag and covered word ranges (pairs of little-endian 32-bit start and end) of documents with repeats."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, length, both=True):
            first, later = _settled(taken(chunk, _frequent(chunk["h"], sketch_)))
            number = (first["h"] % np.uint64(slices)).astype(np.int64)
            # Settled places only pass through the next step.
            out = [*_dealt(first, _WINDOW, number, 0), *_dealt(later, _PLACE, _bucket(later, slices), 1)]
            yield _batch(out)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done():
            _, later = _settled(joined(held, _WINDOW))
            return _batch([*_dealt(later, _PLACE, _bucket(later, slices), 1)])

        for batch in batches:
            number, mark, payload = batch.columns
            for n, m, data in zip(number.to_pylist(), mark.to_pylist(), payload):
                if m == 1:
                    yield _batch([(n, 1, data.as_py())])
                    continue
                if n != current:
                    if held:
                        yield done()
                    current, held = n, []
                held.append(unpacked(data.as_py(), _WINDOW))
        if held:
            yield done()

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done():
            places = joined(held, _PLACE)
            order = np.lexsort((places["at"], places["tag"], places["doc"]))
            doc, tag, at = (places[name][order].astype(np.int64) for name in ("doc", "tag", "at"))
            other = np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]
            start = np.flatnonzero(other | np.r_[True, at[1:] > at[:-1] + length])
            end = np.r_[start[1:], len(at)] - 1
            ranges = np.stack([at[start], at[end] + length], 1).astype("<u4")
            edges = np.r_[np.flatnonzero(other[start]), len(start)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(doc[start[edges[:-1]]], pa.int64()),
                    pa.array(tag[start[edges[:-1]]], pa.int64()),
                    pa.array([ranges[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
                ],
                names=["doc_id", "tag", "ranges"],
            )

        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(2)):
                if n != current:
                    if held:
                        yield done()
                    current, held = n, []
                held.append(unpacked(data.as_py(), _PLACE))
        if held:
            yield done()

    dealt = rows.mapInArrow(find, DEALT)
    grouped = dealt.repartition("number").sortWithinPartitions("number").mapInArrow(group, DEALT)
    covered = grouped.repartition("number").sortWithinPartitions("number")
    return covered.mapInArrow(cover, "doc_id long, tag long, ranges binary")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, kept = [], [], []
        for text, ranges in zip(batch.column(1), batch.column(2)):
            words = (text.as_py() or "").encode().split()
            total.append(len(words))
            if ranges.is_valid:
                stay = np.ones(len(words), bool)
                for a, b in np.frombuffer(ranges.as_buffer(), "<u4").reshape(-1, 2):
                    stay[a:b] = False
                removed.append(len(words) - int(stay.sum()))
                words = compress(words, stay)
            else:
                removed.append(0)
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def deduplicated(docs: DataFrame, length: int = LENGTH, max_bits: int = MAX_BITS, bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of every document, joined by one space."""
    ship(docs.sparkSession)
    rows = texts(docs).select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("tag"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    windows = size // 6 + 1
    bits = bits or min(max_bits, max(16, (4 * windows - 1).bit_length()))
    named = rows.where("doc_id IS NOT NULL")
    found = repeated_places(named, length, sketch(named, length, bits), 8 + windows // 1_000_000)
    found = stored(found, "ranges").withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})
    placed = rows.join(found, (F.col("doc_id") == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left")
    return placed.select("doc_id", "text", "ranges").mapInArrow(
        _kept, "doc_id long, n_words long, n_removed long, kept string"
    )


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256."""
    return deduplicated(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
