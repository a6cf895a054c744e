"""Token ids in seekable binary files (operator 1).

A file holds independent zstandard frames: frames of token ids (little-endian, 2 bytes an id if the vocabulary allows,
else 4), whole documents only, then one frame with the document table, then the seek table of the public seekable
format: a skippable frame with compressed size, size and the low 32 bits of XXH64 of each frame. A reader takes the seek
table from the end of the file, then the document table, then only the frames of the documents it was asked for.

Documents are dealt to files of about `file_bytes` of text by ranges of their id, so files in order and documents inside
them ascend. Files are written under an attempt's name and then moved, so a repeated task leaves one whole file with the
same content.

Defined cases: a null text is empty (only the end id); rows without an id come first; repeated ids keep one entry per
row, ordered by a hash of the text, equal rows in any order; an empty table gives no files and an empty index.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import new_path, ship, stored, texts

FRAME_IDS = 1 << 15
CACHED_WORDS = 250_000
PORTION = 1_000_000
FILE_BYTES = 64 << 20
# How the tokenizer folds and cuts words where the short path applies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
# The same cut for folded pieces of printable ASCII and of the letters from A grave to y diaeresis.
_LETTERS = "a-z\xdf-\xf6\xf8-\xff"
_SIMPLE = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
_CUTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+").findall
# Fixed values of the public seekable zstandard format: skippable frame, footer, descriptor with checksums.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUM = 0x80

_DOCUMENT = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("frame", "<u4"), ("n_ids", "<u4")])
INDEX = "doc_id long, file int, position int, n_tokens long"
READ = "doc_id long, file int, position int, start long, n_tokens long, ids_crc32 long"


def _cuts_by_pattern(tokenizer) -> bool:
    """Whether the tokenizer folds case, drops white space and cuts by `PATTERN` into bytes for its model."""
    known = json.loads(tokenizer.to_str())
    steps = (known["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        known["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZERS}
        and len(steps) == 2
        and steps[0] == {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
        and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        and not known["post_processor"] and all(t["special"] for t in known["added_tokens"])
    )


class Recent:
    """A cache in two generations: what is used again outlives the turn, the rest goes with the older one."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Keys to be added; afterwards all others are in `new`."""
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new
        absent = keys.difference(self.new)
        again = {k: self.old[k] for k in absent if k in self.old}
        self.new.update(again)
        return [k for k in absent if k not in again]


class Encoder:
    """Encodes texts piece by piece and keeps what it has seen.

    Blanks and line feeds always end a token in tokenizers that drop white space, so a text's ids are those of its
    pieces in order. If the tokenizer cuts words by `PATTERN`, pieces of printable ASCII and the letters of `_LETTERS` are
    folded and cut here, where Python's patterns and case folding agree with the tokenizer's, and each new cut goes
    through the tokenizer's model alone. All other pieces are encoded by the whole tokenizer: new ones in one call, with
    a special token between them, which cuts the text before anything else looks at it.
    """

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        self.pieces, self.cuts = Recent(CACHED_WORDS), Recent(CACHED_WORDS)
        special = [(t.content, k) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.specials = [content for content, _ in special]
        self.cut, self.cut_id = special[-1] if special else (None, None)
        self.plain = _cuts_by_pattern(self.tokenizer) and not self.tokenizer.truncation and not self.tokenizer.padding
        # Letters as the model's alphabet spells their bytes.
        spelled = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {ord(c): spelled.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100))}

    def _ids(self, pieces: list[str]) -> Iterator[bytes]:
        if self.cut is None or any(s in p for s in self.specials for p in pieces):
            found = self.tokenizer.encode_batch(pieces, add_special_tokens=False)
            return (np.array(f.ids, dtype=self.dtype).tobytes() for f in found)
        ids = np.array(self.tokenizer.encode(self.cut.join(pieces), add_special_tokens=False).ids, dtype=self.dtype)
        cuts = np.flatnonzero(ids == self.cut_id)
        data, width = ids.tobytes(), ids.itemsize
        starts, ends = np.r_[0, cuts + 1] * width, np.r_[cuts, len(ids)] * width
        return (data[a:b] for a, b in zip(starts.tolist(), ends.tolist()))

    def _learn(self, pieces: list[str], special: bool) -> None:
        words, held, others = {}, {}, pieces
        if self.plain and not special:
            # Letters alone are one cut.
            words = {p: p.lower() for p in pieces if p.isascii() and p.isalpha()}
            others = [p for p in pieces if p not in words]
            held = {p: _CUTS(p.lower()) for p in others if _SIMPLE(p)}
            others = [p for p in others if p not in held]
        tokenize, kind = self.tokenizer.model.tokenize, self.dtype[-1] == "2"
        missing = self.cuts.missing(set(words.values()).union(*held.values()))
        known = self.cuts.new
        for cut in missing:
            spelled = cut if cut.isascii() else cut.translate(self.spelling)
            known[cut] = array("H" if kind else "I", [t.id for t in tokenize(spelled)]).tobytes()
        self.pieces.new.update((p, known[cut]) for p, cut in words.items())
        self.pieces.new.update((p, b"".join([known[cut] for cut in cuts])) for p, cuts in held.items())
        if others:
            self.pieces.new.update(zip(others, self._ids(others)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [text.replace("\n", " ").split(" ") for text in texts]
        missing = self.pieces.missing(set().union(*split))
        if missing:
            self._learn(missing, any(s in text for s in self.specials for text in texts))
        return [b"".join(map(self.pieces.new.__getitem__, pieces)) for pieces in split]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, dtype: str) -> Encoder:
    key = (path, dtype)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, dtype)
    return _ENCODERS[key]


def _portions(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `PORTION` bytes of text each."""
    total = np.cumsum(np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]))
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + PORTION, "right")))
        yield low, high
        low = high


def id_type(tokenizer_path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def _storage(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class FrameWriter:
    """Writes frames and, at the end, the document table and the seek table."""

    def __init__(self, sink, dtype: str, frame_ids: int):
        import zstandard

        self.sink, self.dtype, self.limit = sink, dtype, frame_ids * np.dtype(dtype).itemsize
        self.packer = zstandard.ZstdCompressor(level=3)
        self.seek: list[tuple[int, int, int]] = []
        self.table: list[tuple[int, int, int, int]] = []
        self.waiting: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.table.append((doc_id or 0, doc_id is not None, len(self.seek), len(ids) // np.dtype(self.dtype).itemsize))
        self.waiting.append(ids)
        self.size += len(ids)
        if self.size >= self.limit:
            self._frame(b"".join(self.waiting))
            self.waiting, self.size = [], 0

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self.packer.compress(data)
        self.sink.write(packed)
        self.seek.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.waiting:
            self._frame(b"".join(self.waiting))
        head = struct.pack("<2sQ", self.dtype[1:].encode(), len(self.table))
        self._frame(head + np.array(self.table, dtype=_DOCUMENT).tobytes())
        body = np.array(self.seek, dtype="<u4").tobytes() + struct.pack(
            "<IBI", len(self.seek), WITH_CHECKSUM, SEEKABLE_MAGIC
        )
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class Entry(NamedTuple):
    doc_id: int | None
    position: int
    start: int
    ids: np.ndarray


class TokenFile:
    """Reads documents of one file, decompressing only their frames; every frame is checked against its checksum."""

    def __init__(self, source):
        self.source, size = source, source.size()
        n_frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & WITH_CHECKSUM:
            raise ValueError("no seek table with checksums at the end")
        length = 12 * n_frames + 9
        head, body = struct.unpack("<II", self._at(size - length - 8, 8))
        if (head, body) != (SKIPPABLE_MAGIC, length):
            raise ValueError("damaged seek table")
        self.frames = np.frombuffer(self._at(size - length, 12 * n_frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        table = self.frame(n_frames - 1)
        kind, n_documents = struct.unpack("<2sQ", table[:10])
        self.dtype = "<" + kind.decode()
        self.documents = np.frombuffer(table, _DOCUMENT, n_documents, 10)
        self.start = np.concatenate([[0], np.cumsum(self.documents["n_ids"], dtype=np.int64)])

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        packed, size, checksum = (int(x) for x in self.frames[k])
        data = zstandard.ZstdDecompressor().decompress(self._at(int(self.offset[k]), packed), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} does not match its checksum")
        return data

    def read(self, positions: Iterable[int] | None = None) -> Iterator[Entry]:
        """Documents at `positions` (all by default), in order."""
        wanted = np.arange(len(self.documents)) if positions is None else np.unique(np.array([*positions], dtype=np.int64))
        frame_of = self.documents["frame"]
        at, ids, base = -1, None, 0
        for p in wanted:
            if frame_of[p] != at:
                at = int(frame_of[p])
                ids = np.frombuffer(self.frame(at), self.dtype)
                base = int(self.start[np.searchsorted(frame_of, at)])
            low, high = int(self.start[p]), int(self.start[p + 1])
            doc_id = int(self.documents["doc_id"][p]) if self.documents["has_id"][p] else None
            yield Entry(doc_id, int(p), low, ids[low - base : high - base])


def file_name(k: int) -> str:
    return f"part-{k:06d}.ids.zst"


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    folder: str | None = None,
    frame_ids: int = FRAME_IDS,
    file_bytes: int = FILE_BYTES,
) -> tuple[str, DataFrame]:
    """Encode all texts, write the files, return their folder and the index: one row per document with file and position."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or new_path(spark, "tokens")
    dtype = id_type(tokenizer_path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storage, root = _storage(folder)
        task = TaskContext.get()
        name, attempt = f"{root}/{file_name(task.partitionId())}", f"{root}/.attempt-{task.taskAttemptId()}"
        encode, end = encoder(tokenizer_path, dtype), np.array([end_id], dtype=dtype).tobytes()
        sink = writer = None
        position = 0
        for batch in batches:
            if sink is None:
                storage.create_dir(root, recursive=True)
                sink = storage.open_output_stream(attempt, compression=None)
                writer = FrameWriter(sink, dtype, frame_ids)
            ids, lengths = batch.column(0).to_pylist(), []
            for low, high in _portions(batch.column(1)):
                portion = [text or "" for text in batch.column(1).slice(low, high - low).to_pylist()]
                for doc_id, data in zip(ids[low:high], encode(portion)):
                    writer.add(doc_id, data + end)
                    lengths.append(len(data) // len(end) + 1)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([task.partitionId()] * n, pa.int32()),
                    pa.array(range(position, position + n), pa.int32()),
                    pa.array(lengths, pa.int64()),
                ],
                names=["doc_id", "file", "position", "n_tokens"],
            )
            position += n
        if sink is not None:
            writer.close()
            sink.close()
            storage.move(attempt, name)

    placed = texts(docs).withColumn("_tie", F.xxhash64("text"))
    size = placed.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    files = max(-(-size // file_bytes), spark.sparkContext.defaultParallelism)
    ordered = placed.repartitionByRange(files, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    return folder, stored(ordered.mapInArrow(write, INDEX), "index")


def read_tokens(spark: SparkSession, folder: str, index: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Read documents back from the files: all, or those whose `doc_id` is in `wanted`.

    `start` is the number of ids of all documents before it, in all files.
    """
    ship(spark)
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    before = F.sum("ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))  # one row per file
    files = files.select("file", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    if wanted is None:
        asked = files.withColumn("positions", F.lit(None).cast("array<int>"))
    else:
        picked = index.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        asked = files.join(picked.groupBy("file").agg(F.collect_list("position").alias("positions")), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            storage, root = _storage(folder)
            for row in batch.to_pylist():
                with storage.open_input_file(f"{root}/{file_name(row['file'])}") as source:
                    out = [
                        (e.doc_id, row["file"], e.position, row["base"] + e.start, len(e.ids), zlib.crc32(e.ids.astype("<u4").tobytes()))
                        for e in TokenFile(source).read(row["positions"])
                    ]
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                        names=["doc_id", "file", "position", "start", "n_tokens", "ids_crc32"],
                    )

    return asked.select("file", "base", "positions").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").mapInArrow(read, READ)
