"""Near-duplicate classes by DartMinHash (operator 2).

A document is the weighted set of its runs of five words (weight: number of occurrences). Darts fall as a Poisson
process on the plane of weight and rank, seeded by the element: an element's plane is cut into dyadic weight regions
[0, 1), [1, 2), [2, 4), ... and in each region the darts come in order of rank, drawn from hashes of element, region and
number. A document keeps the darts below its elements' weights and below a rank bound that lets about k (ln k + 2) of
them through, whatever its length. Every dart belongs to one of k coordinates; the earliest of each coordinate is the
signature, and two signatures agree there with the probability of their weighted Jaccard similarity.

Signatures are cut into `bands` of `rows` coordinates. Documents that share a band are candidates; candidates are
compared by their whole sets, and links of at least `similarity` make the classes. A band's members are first compared
with its smallest member. In a band that still holds several classes, the members outside its largest class are
compared with four members of that class (first, last, two by hash); they then go on without that class, until no band
holds several classes or a round finds no link. These rounds only make the classes large at little cost.

After them, members of different classes of a band are compared unless counts show that they are too different. Two
documents of sizes m and n are similar enough only if they share c (m + n) elements, c = similarity / (1 + similarity).
A document that shares `shared` elements with all other classes together thus has no partner above the size
reach = shared / c - size. If reach is below its own size, the document is weak, and two weak ones are never partners.
So only strong members, of which families of edited copies have few, meet the others, within their reach; what is left
out no longer counts as shared for the rest, until nothing changes. Bands are cut into blocks of members of like sizes,
and a block of strong members meets every block in reach in one task. A class with many members in a band has blocks of
its own, which never meet each other: a class meets only the members outside it. Strong members of different classes make
this step grow with the product of their numbers in a band. At similarity 0.8, 48 bands of 7 leave a pair without a
common band with probability 1.2e-5.

Defined cases: words are runs of non-white-space, taken as they are; texts of one to four words are one element, their
whole word sequence; documents without words (null, empty, blank) are classes of their own; equal texts are one class;
every row counts for itself, also without an id or with one that others have; a class is named by its smallest id, and
by null if none has an id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import WORD, packed, ship, stored, texts
from .graph import extended
from .words import Block, blocks, mixed, runs, spaced

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 48
ROWS = 7
BLOCK = 128
_DOCUMENTS = 128
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_CHOICE = np.uint64(0xC2B2AE3D27D4EB4F)
_REGION = np.uint64(0x165667B19E3779F9)


def _whole(hashes: np.ndarray) -> np.uint64:
    """Hash of a short word sequence, as one element."""
    out = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        for h in hashes:
            out = mixed(np.array([out * _GOLD + h], np.uint64))[0]
    return out


def elements(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word runs of each document in a block: (document, hash, occurrences)."""
    found, _, document = runs(block.hashes, block.first, size)
    found = mixed(found)
    count = np.diff(block.first)
    for d in np.flatnonzero((count > 0) & (count < size)):
        found = np.append(found, _whole(block.hashes[block.first[d] : block.first[d + 1]]))
        document = np.append(document, d)
    order = np.lexsort((found, document))
    found, document = found[order], document[order]
    if not len(found):
        return document, found, np.zeros(0, np.int64)
    new = np.r_[True, (found[1:] != found[:-1]) | (document[1:] != document[:-1])]
    at = np.flatnonzero(new)
    return document[at], found[at], np.diff(np.r_[at, len(found)])


def _darts(owner: np.ndarray, seeds: np.ndarray, low: np.ndarray, width: np.ndarray, weight: np.ndarray, bound: np.ndarray, k: int):
    """All darts below weight and rank bound: (owner * k + coordinate, rank, dart)."""
    slots, ranks, names = [], [], []
    reached = np.zeros(len(seeds))
    number = 0
    step = max(1, int(0.6 * float((bound * width).mean())) if len(seeds) else 1)
    while len(seeds):
        step = min(step, 1 + 250_000 // len(seeds))
        counter = np.arange(number + 1, number + step + 1, dtype=np.uint64) * _GOLD
        dart = mixed(seeds[:, None] + counter[None, :])
        wait = -np.log(((dart >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / width[:, None]
        wait[:, 0] += reached
        rank = np.cumsum(wait, axis=1)
        choice = mixed(dart ^ _CHOICE)
        height = low[:, None] + width[:, None] * ((choice >> np.uint64(32)).astype(np.float64) * 2.0**-32)
        r, c = np.nonzero((rank <= bound[:, None]) & (height < weight[:, None]))
        coordinate = ((choice[r, c] & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
        slots.append(owner[r] * k + coordinate)
        ranks.append(rank[r, c])
        names.append(dart[r, c])
        reached = rank[:, -1]
        more = reached <= bound
        owner, seeds, low, width, weight, bound = (x[more] for x in (owner, seeds, low, width, weight, bound))
        reached = reached[more]
        number += step
    if not slots:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return np.concatenate(slots), np.concatenate(ranks), np.concatenate(names)


def signatures(document: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k earliest darts of documents 0 to n - 1; `document` ascends, and each has an element."""
    regions = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    at = np.repeat(np.arange(len(weight)), regions)
    region = np.arange(len(at)) - np.repeat(np.cumsum(regions) - regions, regions)
    width = np.where(region == 0, 1.0, 2.0 ** (region - 1))
    low = np.where(region == 0, 0.0, width)
    seeds = mixed(hashes[at] ^ (region.astype(np.uint64) * _REGION))
    owner, weights = document[at], weight[at].astype(np.float64)
    total = np.bincount(document, weight, minlength=n)
    darts = k * (log(k) + 2)
    first, name = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    todo = np.arange(n)
    while len(todo):
        here = np.isin(owner, todo)
        slot, rank, dart = _darts(
            owner[here], seeds[here], low[here], width[here], weights[here], (darts / total)[owner[here]], k
        )
        np.minimum.at(first, slot, rank)
        won = rank == first[slot]
        name[slot[won]] = dart[won]
        # A coordinate without a dart: let more darts of that document through.
        todo = np.flatnonzero(~np.isfinite(first.reshape(n, k)).all(axis=1))
        darts *= 2
    return name.reshape(n, k)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _REGION, parts.shape[:2]).copy()
    for k in range(rows):
        out = mixed(out * _GOLD + parts[:, :, k])
    return out.view(np.int64)


def banded(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, digest of the text and band hashes of every document with words."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2), spaced()):
                document, found, weight = elements(block, shingle)
                present, local = np.unique(document, return_inverse=True)
                size = np.bincount(local, weight, minlength=len(present))
                # Documents of like size together, so that they need like numbers of darts.
                order = np.argsort(size, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                sort = np.argsort(place[local], kind="stable")
                rank, found, weight = place[local][sort], found[sort], weight[sort]
                for a in range(0, len(present), _DOCUMENTS):
                    b = min(a + _DOCUMENTS, len(present))
                    low, high = np.searchsorted(rank, [a, b])
                    signed = signatures(rank[low:high] - a, found[low:high], weight[low:high], b - a, bands * rows)
                    hashes = band_hashes(signed, bands, rows)
                    at = pa.array(block.low + present[order[a:b]])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(at),
                            batch.column(1).take(at),
                            pa.ListArray.from_arrays(
                                pa.array(np.arange(0, (b - a) * bands + 1, bands, dtype=np.int32)), pa.array(hashes.ravel())
                            ),
                        ],
                        names=["doc_id", "digest", "bands"],
                    )

    rows_ = texts(docs).where("text IS NOT NULL").select("doc_id", F.md5("text").alias("digest"), "text")
    return rows_.mapInArrow(run, "doc_id long, digest string, bands array<long>")


def _maybe(ids: DataFrame, bits: int = 24) -> np.ndarray:
    """A bit field of fixed size that holds every row (doc_id, digest); others may seem to be held."""
    cells = ids.select(F.pmod(F.xxhash64("doc_id", "digest"), F.lit(1 << bits)).alias("cell"))
    words = cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(cell % 64 AS int)))").alias("bits")
    )
    field = np.zeros(1 << (bits - 6), np.int64)  # at most 2**18 rows come back
    found = words.toArrow()
    field[found["word"].to_numpy()] = found["bits"].to_numpy()
    return field


def element_sets(docs: DataFrame, ids: DataFrame, shingle: int = SHINGLE, bits: int = 24) -> DataFrame:
    """rep and the sorted 32-bit hashes (each as often as it occurs) of the texts in `ids` (rep, doc_id, digest)."""
    spark = docs.sparkSession
    field = spark.sparkContext.broadcast(_maybe(ids, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(3).to_numpy()
            here = np.flatnonzero((field.value[cell >> 6] >> (cell & 63)) & 1)
            batch = batch.take(pa.array(here))
            for block in blocks(batch.column(2), spaced()):
                document, found, weight = elements(block, shingle)
                found = np.repeat((found >> np.uint64(32)).astype(np.uint32), weight)
                first = np.searchsorted(np.repeat(document, weight), np.arange(block.high - block.low + 1))
                sets = [np.sort(found[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])]
                n = block.high - block.low
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.low, n), batch.column(1).slice(block.low, n), pa.array(sets, pa.binary())],
                    names=["doc_id", "digest", "elements"],
                )

    digest = F.md5("text").alias("digest")
    rows = texts(docs).where("text IS NOT NULL").select("doc_id", digest, "text")
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(1 << bits)))
    found = rows.mapInArrow(run, "doc_id long, digest string, elements binary")
    named = ids.select("rep", F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    same = (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return found.join(named, same).select("rep", "elements").dropDuplicates(["rep"])


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted multisets: shared occurrences over all."""
    values, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    of_a = np.searchsorted(a, values, "right") - np.searchsorted(a, values, "left")
    shared = int(np.minimum(of_a, counts - of_a).sum())
    return shared / max(1, len(a) + len(b) - shared)


def _linked(pairs: DataFrame, docs: DataFrame, reps: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = stored(reps.join(ids, "rep", "left_semi"), "pair_ids")
    sets = stored(element_sets(docs, wanted, shingle), "pair_sets")
    left = sets.select(F.col("rep").alias("a"), F.col("elements").alias("of_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("elements").alias("of_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                if weighted_jaccard(x, y) >= similarity:
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64())).select([0, 1])

    sized = lambda c: F.octet_length(c)
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    # Sets of too different sizes cannot be similar enough.
    rows = rows.where(F.least(sized("of_a"), sized("of_b")) >= F.lit(similarity) * F.greatest(sized("of_a"), sized("of_b")) - 4)
    return rows.mapInArrow(run, "a long, b long")


def _with_leaders(members: DataFrame, turn: int) -> DataFrame:
    """Members outside the largest class of their band, with some members of that class as `leaders`."""
    by_hash = [F.min_by("rep", F.xxhash64("rep", F.lit(turn), F.lit(k))) for k in (0, 1)]
    kinds = members.groupBy("band", "class").agg(
        F.count(F.lit(1)).alias("n"), F.array_distinct(F.array(F.min("rep"), F.max("rep"), *by_hash)).alias("leaders")
    )
    largest = kinds.groupBy("band").agg(F.max_by(F.struct("class", "leaders"), F.struct("n", -F.col("class"))).alias("l"))
    largest = largest.select(F.col("band").alias("_b"), F.col("l.class").alias("led"), F.col("l.leaders").alias("leaders"))
    return members.join(largest, F.col("band") == F.col("_b")).where("class <> led").select("band", "rep", "leaders")


def _open(members: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Members, with their classes, of bands that hold several classes."""
    if classes is None:
        named = members.select("band", "rep", F.col("rep").alias("class"))
    else:
        named = members.join(classes, F.col("rep") == F.col("node"), "left")
        named = named.select("band", "rep", F.coalesce("class", "rep").alias("class"))
    several = named.groupBy("band").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y")
    return named.join(several.select(F.col("band").alias("_b")), F.col("band") == F.col("_b"), "left_semi")


def _occurrences(sets: DataFrame) -> DataFrame:
    """rep, class, element, its number of occurrences and the size of the document, for (rep, class, elements)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "class", "element", "n", "size"]
        for batch in batches:
            for rep, kind, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = np.frombuffer(found.as_buffer(), np.uint32)
                values, n = np.unique(found, return_counts=True)
                own = [np.full(len(values), x, np.int64) for x in (rep, kind)]
                columns = [*own, values.astype(np.int64), n.astype(np.int64), np.full(len(values), len(found), np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return sets.select("rep", "class", "elements").mapInArrow(run, "rep long, class long, element long, n long, size long")


def _reaches(rows: DataFrame, similarity: float) -> DataFrame:
    """rep, size and reach of the documents that share enough with other classes to have a partner of any fitting size."""
    several = rows.groupBy("element").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y")
    common = rows.join(several.select(F.col("element").alias("_e")), F.col("element") == F.col("_e"), "left_semi")
    found = common.groupBy("rep").agg(F.sum("n").alias("shared"), F.max("size").alias("size"))
    reach = F.col("shared") * F.lit((1 + similarity) / similarity) - F.col("size") + F.lit(1e-6)
    return found.select("rep", "size", reach.alias("reach")).where(F.col("reach") >= F.lit(similarity) * F.col("size"))


def _partnered(held: DataFrame, reaches: DataFrame) -> DataFrame:
    """(band, rep, class, size, reach) of the members that a strong member of another class of the band may reach.

    `held` has one row per document, with its class and bands.
    """
    rows = held.join(reaches, "rep").select(F.explode("bands").alias("band"), "rep", "class", "size", "reach")
    rows = stored(rows, "reaching")
    strong = F.col("reach") >= F.col("size")
    bands = rows.groupBy("band").agg(
        F.min(F.when(strong, F.col("size"))).alias("least"), F.max(F.when(strong, F.col("reach"))).alias("most"),
        F.min("class").alias("x"), F.max("class").alias("y"),
    )
    bands = bands.where("least IS NOT NULL AND x < y").select(F.col("band").alias("_b"), "least", "most")
    rows = rows.join(bands, F.col("band") == F.col("_b")).where("least <= reach AND size <= most")
    return rows.select("band", "rep", "class", "size", "reach")


def _unproven(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The members that counts do not show to be without a partner in their band; empty or stable after some rounds."""
    rows = _occurrences(sets)
    left = None
    while True:
        held = members.groupBy("rep").agg(F.min("class").alias("class"), F.collect_list("band").alias("bands"))
        found = stored(_partnered(held, _reaches(rows, similarity)), "unproven")
        count = found.select("rep").distinct().count()
        if count == 0 or left is not None and count > 0.9 * left:
            return found
        left = count
        members = found.select("band", "rep", "class")
        rows = _occurrences(sets.join(found.select("rep").distinct(), "rep", "left_semi"))


def _shared(left: list[np.ndarray], right: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """Shared occurrences of each sorted multiset in `left` with each in `right`."""
    both = [*left, *right]
    # Numbered occurrences make sets of the multisets.
    numbered = [(x.astype(np.uint64) << np.uint64(32)) + (np.arange(len(x)) - np.searchsorted(x, x)).astype(np.uint64) for x in both]
    values, at = np.unique(np.concatenate(numbered), return_inverse=True)
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    of_left = owner < len(left)
    here, there = np.zeros(len(values), bool), np.zeros(len(values), bool)
    here[at[of_left]] = True
    there[at[~of_left]] = True
    column = np.cumsum(here & there) - 1
    wanted = (here & there)[at]
    owner, at = owner[wanted], column[at[wanted]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(left), len(right)))
    for low in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(at, [low, low + width])
        held = np.zeros((len(both), width), np.float32)
        held[owner[a:b], at[a:b] - low] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def _block_links(sides, names, kinds, sizes, reaches, sets, similarity: float) -> list[tuple[int, int]]:
    """Links that connect what the similar pairs of a block pair connect; pairs within one class are left out."""
    sides, kinds, sizes, reaches = (np.array(x) for x in (sides, kinds, sizes, reaches))
    left = np.flatnonzero(sides == sides.min())
    right = np.flatnonzero(sides == sides.max())
    fit = (sizes[right][None, :] <= reaches[left][:, None]) & (sizes[left][:, None] <= reaches[right][None, :])
    fit &= kinds[left][:, None] != kinds[right][None, :]
    if not fit.any():
        return []
    shared = _shared([sets[k] for k in left], [sets[k] for k in right])
    alike = fit & (shared / np.maximum(1, sizes[left][:, None] + sizes[right][None, :] - shared) >= similarity)
    top = {}

    def root(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(alike)):
        x, y = left[x], right[y]
        a, b = root(kinds[x]), root(kinds[y])
        if a != b:
            top[a] = b
            out.append((min(names[x], names[y]), max(names[x], names[y])))
    return out


def block_pairs(members: DataFrame, block: int) -> DataFrame:
    """(band, low, high, side, rep, class, size, reach): every block of strong members with every block it may reach.

    Blocks hold about `block` members of a band, of the same strength and of like sizes. A class that fills a quarter of a
    block there has blocks of its own, the other classes share blocks; two blocks of one class are no pair. Blocks are
    numbered by strength (strong ones first) and size, and each pair of blocks gets the members of both sides.
    """
    weak = (F.col("reach") < F.col("size")).cast("int").alias("weak")
    # Sizes within a factor 1.12 are one bucket; partners lie at most two buckets apart at similarity 0.8.
    bucket = F.floor(F.log(F.col("size")) / F.lit(0.1133)).cast("long")
    rows = members.withColumns({"weak": weak, "bucket": bucket})
    like = ["band", "weak", "bucket"]
    kinds = rows.groupBy(*like, "class").agg(F.count(F.lit(1)).alias("n"))
    kinds = stored(kinds.withColumn("own", F.when(4 * F.col("n") >= block, F.col("class"))), "kinds")
    counted = kinds.groupBy(*like, "own").agg(F.ceil(F.sum("n") / F.lit(block)).alias("blocks"))
    before = Window.partitionBy("band").orderBy("weak", "bucket", "own").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0)))
    counted = counted.select(*[F.col(c).alias(f"_{c}") for c in (*like, "own")], "first", "blocks")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*like, "own")]
    named = kinds.join(counted, same[0] & same[1] & same[2] & same[3]).select(*like, "class", "first", "blocks")
    rows = rows.join(named, [*like, "class"])
    rows = rows.withColumn("side", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("blocks")))
    rows = stored(rows.select("band", "rep", "class", "size", "reach", "side", "weak"), "sides")
    sides = rows.groupBy("band", "side", "weak").agg(
        F.min("size").alias("least"), F.max("size").alias("greatest"), F.max("reach").alias("reach"),
        F.min("class").alias("x"), F.max("class").alias("y"),
    )
    other = sides.select(*[F.col(c).alias(f"o_{c}") for c in sides.columns])
    pairs = sides.where("weak = 0").join(other, F.col("band") == F.col("o_band")).where(
        "(o_weak = 1 OR side <= o_side) AND o_least <= reach AND least <= o_reach AND (x < o_y OR o_x < y)"
    )
    pairs = pairs.select("band", F.least("side", "o_side").alias("low"), F.greatest("side", "o_side").alias("high"))
    ends = pairs.select("band", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("side"))
    return ends.join(rows.drop("weak"), ["band", "side"])


def _linked_in_bands(members: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links between members (band, rep, class, size, reach) of different classes of every band, by their sets."""
    rows = block_pairs(members, block).join(sets.select("rep", "elements"), "rep")
    rows = rows.select("band", "low", "high", "side", "rep", "class", "size", "reach", "elements")
    rows = rows.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, found = None, [], []

        def close():
            sides = {g[0] for g in group}
            # Two blocks, or one with itself.
            if len(group) > 1 and (len(sides) == 2 or key[1] == key[2]) and len({g[2] for g in group}) > 1:
                found.extend(_block_links(*zip(*group), similarity))

        for batch in batches:
            plain = [batch.column(k).to_pylist() for k in range(8)]
            for band, low, high, side, *rest, held in zip(*plain, batch.column(8)):
                if key != (band, low, high):
                    close()
                    key, group = (band, low, high), []
                group.append((side, *rest, np.frombuffer(held.as_py(), np.uint32)))
        close()
        pairs = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _whole_bands(
    members: DataFrame, classes: DataFrame, docs: DataFrame, reps: DataFrame, similarity: float, shingle: int, block: int
) -> DataFrame:
    """The classes after members of different classes of a band are compared or shown to be too different."""
    members = stored(_open(members, classes), "whole_bands")
    if members.isEmpty():
        return classes
    kinds = members.select("rep", "class").distinct()
    wanted = stored(reps.join(kinds, "rep", "left_semi"), "whole_ids")
    sets = stored(element_sets(docs, wanted, shingle).join(kinds, "rep"), "whole_sets")
    members = _unproven(members, sets, similarity)
    if members.isEmpty():
        return classes
    return extended(classes, stored(_linked_in_bands(members, sets, similarity, block), "links"))


def text_classes(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    shingle: int = SHINGLE,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of every row with words, and (digest, doc_id, class) of every different text with words.

    doc_id in the second is the smallest id of the text, or null.
    """
    signed = stored(banded(docs, bands, rows, shingle), "bands")
    copies = signed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"))
    # Numbers of texts hold once they are written.
    copies = stored(copies.withColumn("rep", F.monotonically_increasing_id()), "copies")
    members = copies.select(F.explode("bands").alias("band"), "rep")
    shared = members.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    shared = stored(shared.select(F.col("band").alias("_band"), "lo"), "shared_bands")
    members = stored(members.join(shared, F.col("band") == F.col("_band")).select("band", "rep", "lo"), "members")
    reps = copies.select("rep", "doc_id", "digest")

    pairs = members.where("rep <> lo").select(F.col("lo").alias("a"), F.col("rep").alias("b")).distinct()
    members = whole = members.where("rep <> lo").select("band", "rep")
    checked = classes = None
    turn = 0
    while True:
        pairs = stored(pairs, "pairs")
        if not pairs.isEmpty():
            checked = pairs if checked is None else checked.union(pairs)
            links = stored(_linked(pairs, docs, reps, similarity, shingle), "links")
            if links.isEmpty() and turn > 0:
                break
            classes = extended(classes, links)
        if checked is None:
            break
        members = stored(_open(members, classes), "open")
        if members.isEmpty():
            break
        followers = stored(_with_leaders(members, turn), "followers")
        met = followers.select("rep", F.explode("leaders").alias("leader"))
        pairs = met.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
        pairs = pairs.join(checked, ["a", "b"], "left_anti")
        members = followers.select("band", "rep")
        turn += 1
    # The rounds only make the classes large; what they left out follows, whole.
    if classes is not None:
        classes = _whole_bands(whole, classes, docs, reps, similarity, shingle, block)
        reps = reps.join(classes, F.col("rep") == F.col("node"), "left")
        return signed.select("doc_id", "digest"), reps.select("digest", "doc_id", F.coalesce("class", "rep").alias("class"))
    return signed.select("doc_id", "digest"), reps.select("digest", "doc_id", F.col("rep").alias("class"))


def _wordless(docs: DataFrame) -> DataFrame:
    return docs.where(~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(WORD))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id and class_id (the smallest id of the class) of every document."""
    signed, classes = text_classes(docs, **options)
    named = classes.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    of_text = classes.select("digest", "class").join(named, "class").select("digest", "class_id")
    alone = _wordless(docs).select(F.col("doc_id").cast("long").alias("doc_id"))
    return signed.join(of_text, "digest").select("doc_id", "class_id").union(alone.select("doc_id", F.col("doc_id").alias("class_id")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, with all columns: the one with the smallest id (rows without an id last), and of rows that
    agree in id and text the one with the smallest hash of all columns. Rows without words all stay."""
    _, classes = text_classes(docs, **options)
    key = lambda digest: F.concat_ws(":", digest, F.col("doc_id").cast("long").cast("string"))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    kept = classes.groupBy("class").agg(F.min(first).alias("f")).select("f.doc_id", "f.digest").select(key(F.col("digest")).alias("_kept"))
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = packed(docs.where(F.col("text").cast("string").rlike(WORD)), key=key(F.md5(F.col("text").cast("string"))), hash=hashed)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("hash"))).where("rank = 1")
    return rows.join(kept, F.col("key") == F.col("_kept"), "left_semi").select("row.*").union(_wordless(docs))
