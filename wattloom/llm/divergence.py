"""Divergence of the term distributions of sources, per language (operator 13).

1. Single-pass in-memory indexing: a task reads texts once and gathers block postings (term, source, occurrences and
   documents) per language until `block` postings are held. It then hands the block over as a run: per language and
   hash shard of the term, segments of at most `segment` terms in ascending order.
2. Runs meet per hash shard. A task gets a shard's segments in the order of their first terms, opens each when the merge
   reaches it, and merges the open ones with a heap into frequencies. More than `fan_in` runs are first merged in groups
   into longer runs, so that a bounded number of segments is open at any time. Terms of too few documents end here.
3. Sums per source and language, and the p of every occurring term, are plain aggregates and joins.
4. A pair of sources differs by V * |p0 - p0'| if neither has a term (p0: the p of count 0), plus what a source's own
   terms add while the other has none, plus a correction for terms that both have. The second part comes from the
   source's histogram of gains p - p0, which is short; the corrections are streamed term by term, in numpy, and added up
   in the task before they are shuffled.

All arithmetic is on integers. The report itself has a row for every two sources of a language; nothing larger is built.

Defined cases: null text, lang and source count as empty strings; texts without terms make their group occur; a language
without kept terms gives pairs of value 0 and no terms; rows are documents, whatever their ids; very long texts are cut
at gaps between terms; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import ship, stored

MIN_DOCUMENTS = 30
TERMS = 50
SCALE = 1_000_000_000
ADDED = 5
BLOCK = 1_000_000
TOKENS = 1_000_000
SEGMENT = 1024
ROWS = 64
FAN_IN = 256
PIECE = 1 << 22
PAIRS = 1 << 20

_SEGMENT = (
    "lang string, shard int, run long, first binary, terms array<binary>, docs array<long>, sizes array<int>, "
    "sources array<string>, codes array<int>, counts array<long>"
)
_NAMES = [x.split()[0] for x in _SEGMENT.split(", ")]
_TYPES = [
    pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32()),
    pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()),
]
_FREQUENCY = "lang string, term string, source string, n long, total long, first int"
_CORRECTION = "lang string, source string, item string, value long"


# Bytes of terms stay, A to Z as lower case; all others become spaces. Non-ASCII characters have only high bytes.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in bytes(range(256)).lower())


def terms_of(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded piece at a time."""
    folded = text.translate(_FOLD)
    low = 0
    while len(folded) - low > piece:
        cut = folded.find(b" ", low + piece)
        if cut < 0:
            break
        yield folded[low:cut].split()
        low = cut
    yield (folded[low:] if low else folded).split()


def _grouped(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The different keys, ascending, and the sums of the values over each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.r_[np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
    return [key[start], *(np.add.reduceat(v[order], start) if len(start) else v[:0] for v in values)]


class _Block:
    """Postings held in memory: (group, term, occurrences, documents), terms and groups as numbers of this block."""

    def __init__(self):
        self.terms: defaultdict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.groups: dict[tuple[str, str], int] = {}
        self.postings: list[list[np.ndarray]] = []
        self.ids: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.owners: list[int] = []
        self.tokens = self.size = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        """The terms of one document."""
        pieces = [np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words)) for words in terms_of(text)]
        ids, weights = pieces[0], np.ones(len(pieces[0]), np.int64)
        for piece in pieces[1:]:
            ids, weights = _grouped(np.concatenate([ids, piece]), np.concatenate([weights, np.ones(len(piece), np.int64)]))
        self.ids.append(ids)
        self.weights.append(weights)
        self.owners.append(self.groups.setdefault((lang, source), len(self.groups)))
        self.tokens += len(ids)
        if self.tokens >= TOKENS:
            self._condense()

    def _condense(self) -> None:
        ids, weights = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.ids, self.weights))
        document = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.ids])
        key, count = _grouped(document << 32 | ids, weights)
        group = np.array(self.owners, np.int64)[key >> 32]
        self.postings.append(_grouped(group << 32 | key & 0xFFFFFFFF, count, np.ones(len(key), np.int64)))
        self.size += len(self.postings[-1][0])
        self.ids, self.weights, self.owners, self.tokens = [], [], [], 0

    def run(self, number: int, shards: int, segment: int) -> Iterator[pa.RecordBatch]:
        """The postings as segments, by language, shard and ascending terms."""
        self._condense()
        key, count, docs = _grouped(*(np.concatenate(x) for x in zip(*self.postings)))
        if not len(key):
            return
        terms = pa.array(self.terms, pa.binary())
        order = np.array(sorted(range(len(terms)), key=list(self.terms).__getitem__))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        shard = np.array([zlib.crc32(w) % shards for w in self.terms], np.int64)
        names = list(self.groups)
        langs, sources = (sorted({n[k] for n in names}) for k in (0, 1))
        lang_of, source_of = (
            np.array([place[n[k]] for n in names], np.int64) for k, place in enumerate({x: j for j, x in enumerate(v)} for v in (langs, sources))
        )
        group, term = key >> 32, key & 0xFFFFFFFF
        lang, source = lang_of[group], source_of[group]
        place = np.lexsort((source, rank[term], shard[term], lang))
        lang, source, term, count, docs = (x[place] for x in (lang, source, term, count, docs))
        other = (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])
        start = np.flatnonzero(np.r_[True, other])
        size, docs, term, lang = np.diff(np.r_[start, len(count)]), np.add.reduceat(docs, start), term[start], lang[start]
        slot = lang * shards + shard[term]
        first = np.r_[True, slot[1:] != slot[:-1]]
        inside = np.arange(len(slot)) - np.maximum.accumulate(np.where(first, np.arange(len(slot)), 0))
        cut = np.flatnonzero(inside % segment == 0)
        # Sources of a segment are numbered inside it.
        of_segment = np.repeat(np.repeat(np.arange(len(cut)), np.diff(np.r_[cut, len(term)])), size)
        used, code = np.unique(of_segment * len(sources) + source, return_inverse=True)
        low = np.searchsorted(used, np.arange(len(cut) + 1) * len(sources))
        code -= low[of_segment]
        by_term = pa.array(np.r_[cut, len(term)], pa.int32())
        by_posting = pa.array(np.r_[start[cut], len(count)], pa.int32())
        listed = lambda edges, values: pa.ListArray.from_arrays(edges, values)
        found = pa.RecordBatch.from_arrays(
            [
                pa.array(langs, pa.string()).take(pa.array(lang[cut])), pa.array(shard[term[cut]], pa.int32()),
                pa.array(np.full(len(cut), number), pa.int64()), terms.take(pa.array(term[cut])),
                listed(by_term, terms.take(pa.array(term))), listed(by_term, pa.array(docs, pa.int64())),
                listed(by_term, pa.array(size, pa.int32())),
                listed(pa.array(low, pa.int32()), pa.array(sources, pa.string()).take(pa.array(used % len(sources)))),
                listed(by_posting, pa.array(code, pa.int32())), listed(by_posting, pa.array(count, pa.int64())),
            ],
            names=_NAMES,
        )
        for at in range(0, len(cut), ROWS):
            yield found.slice(at, ROWS)


class _Writer:
    """Gathers postings of one language and run, by shard, into segments."""

    def __init__(self, segment: int):
        self.segment = segment
        self.rows: list[tuple] = []
        self.open: dict[tuple[str, int, int], list] = {}

    def add(self, lang: str, shard: int, run: int, posting: tuple) -> None:
        held = self.open.setdefault((lang, shard, run), [])
        held.append(posting)
        if len(held) >= self.segment:
            self._close((lang, shard, run))

    def _close(self, key: tuple[str, int, int]) -> None:
        held = self.open.pop(key)
        sources = sorted({s for _, _, of in held for s in of})
        code = {s: k for k, s in enumerate(sources)}
        self.rows.append(
            (
                *key, held[0][0], [w for w, _, _ in held], [d for _, d, _ in held], [len(of) for _, _, of in held],
                sources, [code[s] for _, _, of in held for s in of], [n for _, _, of in held for n in of.values()],
            )
        )

    def done(self, all_of_it: bool = True) -> Iterator[pa.RecordBatch]:
        if all_of_it:
            for key in list(self.open):
                self._close(key)
        for low in range(0, len(self.rows), ROWS):
            part = self.rows[low : low + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), _TYPES)], names=_NAMES)
        self.rows = []


def runs(docs: DataFrame, shards: int, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """Term-sorted runs of the texts, as segments per language and shard."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, run = _Block(), TaskContext.get().partitionId() << 24
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2)):
                held.add(lang, source, text.as_buffer().to_pybytes())
                if held.size >= block:
                    yield from held.run(run, shards, segment)
                    held, run = _Block(), run + 1
        yield from held.run(run, shards, segment)

    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(index, _SEGMENT)


class _Segment:
    """One segment, read from a row; postings stay arrays until they are asked for."""

    __slots__ = ("lang", "shard", "group", "terms", "docs", "edges", "sources", "codes", "counts", "places")

    def __init__(self, batch: pa.RecordBatch, k: int):
        of = lambda name: batch.column(name)[k]
        self.lang, self.shard = of("lang").as_py(), of("shard").as_py()
        self.group = of("group").as_py() if "group" in batch.schema.names else None
        self.terms, self.docs, self.sources = (of(c).values.to_pylist() for c in ("terms", "docs", "sources"))
        self.edges = np.r_[0, np.cumsum(of("sizes").values.to_numpy())].tolist()
        self.places = None
        self.codes, self.counts = (of(c).values.to_numpy() for c in ("codes", "counts"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[_Segment]:
    for batch in batches:
        for k in range(len(batch)):
            yield _Segment(batch, k)


class _Sums:
    """Adds up the occurrences of a term per source over the segments that hold it."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.names: list[str] = []

    def _place(self, name: str) -> int:
        if name not in self.places:
            self.places[name] = len(self.names)
            self.names.append(name)
        return self.places[name]

    def __call__(self, parts: list[tuple[_Segment, int]]) -> dict[str, int]:
        codes, counts = [], []
        for segment, k in parts:
            if segment.places is None:
                segment.places = np.array([self._place(s) for s in segment.sources], np.int64)
            low, high = segment.edges[k], segment.edges[k + 1]
            codes.append(segment.places[segment.codes[low:high]])
            counts.append(segment.counts[low:high])
        found, sums = _grouped(np.concatenate(codes), np.concatenate(counts))
        return {self.names[c]: n for c, n in zip(found.tolist(), sums.tolist())}


def merged(rows: Iterator[_Segment]) -> Iterator[tuple[str, int, bytes, int, list[tuple[_Segment, int]]]]:
    """(lang, shard, term, documents, where its postings are) from segments ordered by lang, shard and first term.

    A segment is opened when the merge has come to its first term; the heap holds the next term of every open one.
    """
    heap: list[tuple] = []
    key = None

    def drained(limit: bytes | None):
        """Merge all terms below `limit`."""
        while heap and (limit is None or heap[0][0] < limit):
            term, docs, parts = heap[0][0], 0, []
            while heap and heap[0][0] == term:
                _, number, k, segment = heap[0]
                docs += segment.docs[k]
                parts.append((segment, k))
                if k + 1 < len(segment.terms):
                    heapq.heapreplace(heap, (segment.terms[k + 1], number, k + 1, segment))
                else:
                    heapq.heappop(heap)
            yield *key, term, docs, parts

    for number, segment in enumerate(rows):
        if (segment.lang, segment.shard) != key:
            yield from drained(None)
            key = (segment.lang, segment.shard)
        yield from drained(segment.terms[0])
        heapq.heappush(heap, (segment.terms[0], number, 0, segment))
    yield from drained(None)


def longer_runs(segments: DataFrame, groups: int, shards: int, segment: int = SEGMENT) -> DataFrame:
    """Runs merged into `groups` longer ones."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, sums = _Writer(segment), _Sums()
        later = _segments(batches)
        row = next(later, None)
        while row is not None:
            run = row.group

            def same():
                nonlocal row
                while row is not None and row.group == run:  # noqa: B023
                    yield row
                    row = next(later, None)

            for lang, shard, term, docs, parts in merged(same()):
                writer.add(lang, shard, run, (term, docs, sums(parts)))
                if len(writer.rows) >= ROWS:
                    yield from writer.done(all_of_it=False)
            yield from writer.done()

    grouped = segments.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("long"))
    ranged = grouped.repartition(shards, "shard", "group").sortWithinPartitions("group", "lang", "shard", "first")
    return ranged.mapInArrow(merge, _SEGMENT)


def frequencies(segments: DataFrame, shards: int, min_documents: int) -> DataFrame:
    """(lang, term, source, n) of the terms in enough documents, with their total; `first` is 1 once per term."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(6)]
        sums = _Sums()

        def batch():
            kinds = [pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            arrays[1] = arrays[1].cast(pa.string())
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _FREQUENCY.split(", ")])

        for lang, _, term, docs, parts in merged(_segments(batches)):
            if docs < min_documents:
                continue
            of = sums(parts)
            total = sum(of.values())
            for k, (source, n) in enumerate(of.items()):
                for column, value in zip(columns, (lang, term, source, n, total, int(k == 0))):
                    column.append(value)
            if len(columns[0]) >= 8192:
                yield batch()
                columns = [[] for _ in range(6)]
        yield batch()

    ranged = segments.repartition(shards, "lang", "shard").sortWithinPartitions("lang", "shard", "first")
    return ranged.mapInArrow(merge, _FREQUENCY)


def _share(count, whole) -> str:
    """1 + floor(SCALE * (count + ADDED) / whole), exactly; null where the language has no terms."""
    top = f"cast({SCALE} AS decimal(10,0)) * cast({count} + {ADDED} AS decimal(20,0))"
    return f"CASE WHEN {whole} > 0 THEN 1 + ({top}) div cast({whole} AS decimal(20,0)) END"


def groups_of(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, source, V, the divisors of the group and of the language, and p0 for every occurring group."""
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = counts.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("first").alias("v"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    groups = docs.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", zero(F.col("n")).alias("n"), zero(F.col("lang_n")).alias("lang_n"), zero(F.col("v")).alias("v"))
    groups = groups.select("lang", "source", "v", F.expr(f"n + {ADDED} * v").alias("d"), F.expr(f"lang_n + {ADDED} * v").alias("lang_d"))
    return groups.withColumn("p0", F.coalesce(F.expr(_share("0", "d")), F.lit(0)).cast("long"))


def _corrected(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Corrections of the pairs of sources that share the terms of a batch, added up per pair."""

    def batch(langs, names, first, second, value):
        keys, at = np.unique(first * len(names) + second, return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, value)
        return pa.RecordBatch.from_arrays(
            [pa.array([langs[k // len(names)] for k in keys]), pa.array([names[k // len(names)] for k in keys]),
             pa.array([names[k % len(names)] for k in keys]), pa.array(sums)],
            names=["lang", "source", "item", "value"],
        )

    for rows in batches:
        held = rows.column("held")
        sizes = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = held.flatten()
        lang_of_row = np.array(rows.column("lang").to_pylist(), object)
        # A source is told apart by its language as well.
        full: dict[tuple, int] = {}
        row = np.repeat(np.arange(len(sizes)), sizes)
        code = np.array(
            [full.setdefault((lang_of_row[r], s), len(full)) for r, s in zip(row, flat.field("source").to_pylist())], np.int64
        )
        langs, names = [k[0] for k in full], [k[1] for k in full]
        p, p0 = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("p", "p0"))
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        partners = sizes[row]
        # Entries are taken until their pairs reach the limit.
        edges, low = np.cumsum(partners), 0
        while low < len(code):
            base = edges[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(edges, base + limit, "right")))
            n = partners[low:high]
            left = np.repeat(np.arange(low, high), n)
            right = np.repeat(start[low:high], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            value = np.abs(p[left] - p[right]) - np.abs(p[left] - p0[right]) - np.abs(p0[left] - p[right]) + np.abs(p0[left] - p0[right])
            other = left != right
            yield batch(langs, names, code[left[other]], code[right[other]], value[other])
            low = high


def corrections(shares: DataFrame, limit: int = PAIRS) -> DataFrame:
    """Per ordered pair of sources, what their common terms change."""
    held = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("held"))
    return held.where(F.size("held") > 1).mapInArrow(lambda batches: _corrected(batches, limit), _CORRECTION)


def pair_values(groups: DataFrame, shares: DataFrame, limit: int = PAIRS) -> DataFrame:
    """lang, source, item and value of every two sources of a language."""
    bars = shares.groupBy("lang", "source", (F.col("p") - F.col("p0")).alias("gain")).agg(F.count(F.lit(1)).alias("m"))
    bars = bars.groupBy("lang", "source").agg(
        F.sum(F.col("gain") * F.col("m")).alias("gains"), F.collect_list(F.struct("gain", "m")).alias("bars")
    )
    own = groups.join(bars, ["lang", "source"], "left").select("lang", "source", "v", "p0", "gains", "bars")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("other_p0"))
    pairs = own.join(other, "lang").where("source <> item")
    none = F.array().cast("array<struct<gain:bigint,m:bigint>>")
    step = F.col("other_p0") - F.col("p0")
    below = F.aggregate(F.coalesce("bars", none), F.lit(0).cast("long"), lambda s, b: s + b.m * F.least(b.gain, step))
    alone = F.coalesce("gains", F.lit(0)) - F.when(step > 0, 2 * below).otherwise(0)
    pairs = pairs.select("lang", "source", "item", alone.alias("alone"), (F.col("v") * F.abs(step)).alias("base"))
    parts = pairs.select("lang", "source", "item", (F.col("alone") + F.col("base")).alias("value"))
    parts = parts.union(pairs.select("lang", "item", "source", "alone")).union(corrections(shares, limit))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    terms: int = TERMS,
    shards: int | None = None,
    block: int = BLOCK,
    segment: int = SEGMENT,
    fan_in: int = FAN_IN,
    pair_limit: int = PAIRS,
) -> DataFrame:
    """lang, source, part, item, value and rank: the distance to every other source, and the terms above the language."""
    spark = docs.sparkSession
    ship(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    held = stored(runs(plain, shards, block, segment), "runs")
    count = held.select("run").distinct().count()
    while count > fan_in:
        count = -(-count // fan_in)
        held = stored(longer_runs(held, count, shards, segment), "longer_runs")
    counts = stored(frequencies(held, shards, min_documents), "frequencies")
    groups = stored(groups_of(plain, counts), "groups")
    shares = counts.join(groups, ["lang", "source"]).select(
        "lang", "term", "source", F.expr(_share("n", "d")).cast("long").alias("p"), "p0",
        F.expr(_share("total", "lang_d")).cast("long").alias("q"),
    )
    shares = stored(shares, "shares")
    pairs = pair_values(groups, shares, pair_limit).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    above = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best))
    return ranked(pairs).unionByName(ranked(above).where(F.col("rank") <= terms))
