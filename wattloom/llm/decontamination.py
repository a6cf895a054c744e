"""Benchmark passages in documents, found with spaced seeds (operator 7).

A seed is the hash of the words at the 1-positions of a fixed mask; words at its 0-positions may differ. Seeds of all
documents meet those of the benchmark; where they agree, document and item are laid over each other along that
diagonal, and every stretch of `min_words` words with at most `max_changed` changed words is a match. The masks are
chosen so that any 13 words with up to two changed words hold at least one whole seed.

Every task looks the seeds of its documents up in a block of the benchmark of bounded size (`block_words` words,
`benchmark_blocks` of them, cut by a hash of the item id); documents are never shuffled and no pair is listed before
the verification. Words are folded runs of letters, digits and non-ASCII characters; positions are word positions.

Defined cases: every row counts for itself, also without an id or with one that others have: documents are told apart by
their text, items without an id are reported with a null id; null and empty texts match nothing. Items of 8 to 12 words
are compared by whatever masks fit and must be covered whole, with as many changed words as fall to their length. Items of
fewer than 8 words (`SHORT`) are found by one hash of all their words, unchanged; items of fewer than `LEAST` words say
too little to be a passage and only match a document that consists of them. Empty tables give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship, stored, texts, without_texts
from .words import Block, blocks, mixed, plain

MIN_WORDS = 13
MAX_CHANGED = 2
BLOCK_WORDS = 2_000_000
MASKS = ("11101111", "1111010011", "100100110111")
_FACTORS = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_FILTER_BITS = 22

# No mask fits items of fewer words; below LEAST, only whole documents count.
SHORT = 8
LEAST = 4
_HITS = 1 << 21

MATCHES = "doc_id long, digest string, item_id long, start int, end int"
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32())


class Items(NamedTuple):
    """Benchmark items: ids, word hashes, first word of each, the sorted seeds with the word they start at, and the lengths
    of items that no mask fits."""

    ids: list[int | None]
    words: np.ndarray
    first: np.ndarray
    seeds: np.ndarray
    at: np.ndarray
    maybe: np.ndarray
    short: tuple[int, ...]


def spaced_seeds(words: np.ndarray, first: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of the mask laid at every word where it fits inside one text."""
    size = len(words) - len(mask) + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(size, np.uint64(salt + 1))
    for k, used in enumerate(mask):
        if used == "1":
            out += words[k : k + size] * _FACTORS[k]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:size]
    fits = np.flatnonzero(np.arange(size) + len(mask) <= first[text + 1])
    return mixed(out[fits]), fits


def _low(seeds: np.ndarray) -> np.ndarray:
    return (seeds & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)


def _short_salt(length: int) -> int:
    return 1000 + length


def prepared(ids: list[int | None], texts_words: list[np.ndarray], masks: tuple[str, ...] = MASKS) -> Items:
    words = np.concatenate([np.zeros(0, np.uint64), *texts_words])
    first = np.concatenate([[0], np.cumsum([len(w) for w in texts_words], dtype=np.int64)]).astype(np.int64)
    found = [spaced_seeds(words, first, mask, k) for k, mask in enumerate(masks)]
    sizes = np.diff(first)
    short = tuple(int(n) for n in np.unique(sizes) if 0 < n < SHORT)
    for n in short:
        seeds, at = spaced_seeds(words, first, "1" * n, _short_salt(n))
        whole = sizes[np.searchsorted(first, at, "right") - 1] == n
        found.append((seeds[whole], at[whole]))
    seeds, at = np.concatenate([s for s, _ in found]), np.concatenate([p for _, p in found])
    order = np.argsort(seeds, kind="stable")
    maybe = np.zeros(1 << _FILTER_BITS, bool)
    maybe[_low(seeds)] = True
    return Items(ids, words, first, seeds[order], at[order], maybe, short)


def _diagonals(block: Block, items: Items, masks: tuple[str, ...]) -> np.ndarray:
    """Rows (document, item, document word minus item word) on which some seed agrees."""
    rows = []
    laid = [*((mask, k) for k, mask in enumerate(masks)), *(("1" * n, _short_salt(n)) for n in items.short)]
    for mask, salt in laid:
        seeds, at = spaced_seeds(block.hashes, block.first, mask, salt)
        hit = np.flatnonzero(items.maybe[_low(seeds)])
        low, high = (np.searchsorted(items.seeds, seeds[hit], side) for side in ("left", "right"))
        count = high - low
        hit, low, count = hit[count > 0], low[count > 0], count[count > 0]
        # Seeds that very many items share meet a bounded number of places at a time.
        edges = np.cumsum(count)
        a = 0
        while a < len(hit):
            b = max(a + 1, int(np.searchsorted(edges, (edges[a - 1] if a else 0) + _HITS, "right")))
            n = count[a:b]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            there, here = items.at[np.repeat(low[a:b], n) + inside], np.repeat(at[hit[a:b]], n)
            item = np.searchsorted(items.first, there, "right") - 1
            document = np.searchsorted(block.first, here, "right") - 1
            shift = (here - block.first[document]) - (there - items.first[item])
            rows.append(np.unique(np.stack([document, item, shift], 1), axis=0))
            a = b
    return np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, 3), np.int64)


def overlaps(a: np.ndarray, b: np.ndarray, shift: int, min_words: int, max_changed: int) -> list[tuple[int, int]]:
    """Stretches of `a`, as word positions, that `b` covers when its word 0 lies at position `shift` of `a`."""
    low, high = max(0, shift), min(len(a), shift + len(b))
    need = min(min_words, len(b))
    if high - low < need or 0 < len(b) < LEAST and len(a) != len(b):
        return []
    same = a[low:high] == b[low - shift : high - shift]
    total = np.concatenate([[0], np.cumsum(same)])
    changed = max_changed * need // min_words if need >= SHORT else 0
    good = np.flatnonzero(total[need:] - total[:-need] >= need - changed) if need else []
    if not len(good):
        return []
    breaks = np.flatnonzero(np.diff(good) > 1)
    starts, ends = good[np.r_[0, breaks + 1]], good[np.r_[breaks, len(good) - 1]] + need
    out = []
    for start, end in zip(starts, ends):
        agreed = np.flatnonzero(same[start:end])
        out.append((int(low + start + agreed[0]), int(low + start + agreed[-1] + 1)))
    return out


def _words_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for block in blocks(batch.column(1), plain()):
            out += [block.hashes[a:b].tobytes() for a, b in zip(block.first[:-1], block.first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "words"])


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, masks: tuple[str, ...] = MASKS) -> Iterator[Items]:
    """The benchmark in blocks of about `block_words` words."""
    ship(benchmark.sparkSession)
    items = texts(benchmark, "item_id").dropDuplicates(["doc_id", "text"])
    hashed = stored(items.mapInArrow(_words_of_items, "doc_id long, words binary"), "items")
    total = hashed.agg(F.sum(F.octet_length("words"))).head()[0] or 0
    n = -(-total // (8 * block_words))
    for k in range(n):
        part = hashed.where(F.pmod(F.xxhash64("doc_id", "words"), F.lit(n)) == k).collect()
        yield prepared([r.doc_id for r in part], [np.frombuffer(bytes(r.words), np.uint64) for r in part], masks)


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    min_words: int = MIN_WORDS,
    max_changed: int = MAX_CHANGED,
    block_words: int = BLOCK_WORDS,
    masks: tuple[str, ...] = MASKS,
) -> DataFrame:
    """One row per matching stretch: document with the digest of its text, item, first word and end (exclusive)."""
    spark = docs.sparkSession
    ship(spark)
    docs = texts(docs).where("text IS NOT NULL").select("doc_id", "text", F.md5("text").alias("digest"))

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                out = []
                for block in blocks(batch.column(1), plain()):
                    for d, i, shift in _diagonals(block, items, masks):
                        mine = block.hashes[block.first[d] : block.first[d + 1]]
                        theirs = items.words[items.first[i] : items.first[i + 1]]
                        for start, end in overlaps(mine, theirs, int(shift), min_words, max_changed):
                            at = block.low + int(d)
                            out.append((batch.column(0)[at].as_py(), batch.column(2)[at].as_py(), items.ids[i], start, end))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], names=["doc_id", "digest", "item_id", "start", "end"]
                    )

        return run

    found = spark.createDataFrame([], MATCHES)
    for items in benchmark_blocks(benchmark, block_words, masks):
        found = found.union(docs.mapInArrow(search(spark.sparkContext.broadcast(items)), MATCHES))
    return found


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For every document: whether it holds benchmark passages, their items, and the stretches as [item, start, end]."""
    stretch = F.struct("item_id", "start", "end")
    per_text = matches(docs, benchmark).groupBy(F.col("digest").alias("_digest")).agg(F.sort_array(F.collect_set(stretch)).alias("stretches"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("string")).alias("digest"))
    return rows.join(per_text, F.col("digest") == F.col("_digest"), "left").select(
        "doc_id",
        F.col("stretches").isNotNull().alias("contaminated"),
        F.array_compact(F.array_distinct(F.coalesce("stretches.item_id", F.array().cast("array<long>")))).alias("item_ids"),
        F.coalesce("stretches", F.array().cast("array<struct<item_id:bigint,start:int,end:int>>")).alias("stretches"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without benchmark passages, with all their columns."""
    return without_texts(docs, matches(docs, benchmark).select("digest"))
