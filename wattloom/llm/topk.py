"""Exact top-k inner products by elimination with a pivot table (operator 11).

Vectors are scaled and floored to integers; the score of two is their inner product. With one more component that lifts
every candidate to the length M of the longest vector, score and distance go together: for a query q (lifted by 0),
d(q, x)^2 = |q|^2 + M^2 - 2 score. So distances to pivots bound scores: d(q, x) is at least |d(q, p) - d(x, p)| for
every pivot p, hence score <= (|q|^2 + M^2 - bound^2) / 2.

1. Pivots are chosen farthest-first from a sample of `sample` rows by hash. Every row gets its distances to them.
2. Rows are ranged by nearest pivot and distance into groups, and inside a group into blocks of `block` rows; a block is
   one row of the table (ids, vectors, distances and the interval of distances to every pivot).
3. The queries of a block are one row as well, with the k-th best score each finds inside its own block. They meet every
   group whose intervals leave room for a better score. In the task, the bounds of a query to a block's rows are computed
   from the table alone, and rows are evaluated in descending order of bound until the next bound is below the k-th best
   score so far. A query sends at most k rows per group.
4. The best k of those rows, per query.

Bounds carry a margin far above their rounding; scores are exact (float64 products while M^2 < 2^53, else int64).

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as padded
with zeros, empty ones as zero; rows are told apart even if they repeat an id, so a repeated row is a candidate of its
twin, and a repeated query id has one result per row; rows without an id are candidates only, after all ids among ties;
fewer than k other rows give fewer ranks; an empty table gives an empty result; if M^2 does not fit a long, the job fails.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import ship, stored

TOP = 5
SCALE = 256
PIVOTS = 32
SAMPLE = 1024
BLOCK = 4096
BLOCKS = 32
_FIRST_STEP = 128
# Distances are kept as float32; their error moves a bound by less than this share of |q|^2 + M^2.
_MARGIN = 1e-5

_ROWS = "uid long, vec_id long, query boolean, vector binary, norm double, distances binary, home int, near float"
_BLOCKS = (
    "part int, uids binary, ids binary, named binary, asks binary, vectors binary, norms binary, distances binary, "
    "low array<float>, high array<float>"
)
_QUERIES = (
    "asker long, q_uids binary, q_ids binary, q_vectors binary, q_norms binary, q_distances binary, q_floors binary, "
    "q_low array<float>, q_high array<float>, q_top double, q_floor double"
)
_FOUND = "query_uid long, query_id long, uid long, vec_id long, score long"


class Space(NamedTuple):
    """What all tasks know: dimensions, square of the greatest length, type of stored components, lifted pivots."""

    dims: int
    square: float
    kind: str
    pivots: np.ndarray
    lifts: np.ndarray

    @property
    def exact(self) -> str:
        """Type in which products of two vectors are exact."""
        return "<f8" if self.square < 2**53 else "<i8"


def lift(square: float, norms: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(square - norms, 0.0))


def distances(vectors: np.ndarray, norms: np.ndarray, lifted: np.ndarray, space: Space) -> np.ndarray:
    """Distances to the pivots of vectors with the given last component."""
    square = norms[:, None] + (space.pivots**2).sum(axis=1)[None, :] - 2.0 * (vectors.astype(np.float64) @ space.pivots.T)
    square += (lifted[:, None] - space.lifts[None, :]) ** 2
    return np.sqrt(np.maximum(square, 0.0)).astype(np.float32)


def farthest_first(vectors: np.ndarray, square: float, count: int) -> np.ndarray:
    """Rows, each the farthest (lifted) from those before it; fewer if the others repeat them."""
    full = np.concatenate([vectors, lift(square, (vectors**2).sum(axis=1))[:, None]], axis=1)
    chosen = [0]
    away = ((full - full[0]) ** 2).sum(axis=1)
    while len(chosen) < count and away.max() > 1e-6 * max(square, 1.0):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((full - full[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def _best(scores: np.ndarray, named: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: score, then rows with an id, then the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((uids[at], ids[at], ~named[at], -scores[at]))[:k]]


class _Asker:
    """One query: its best rows so far and the score that a row must reach."""

    def __init__(self, uid: int, vec_id: int, vector: np.ndarray, norm: float, floor: float, k: int):
        self.uid, self.vec_id, self.vector, self.norm, self.floor, self.k = uid, vec_id, vector, norm, floor, k
        self.scores, self.named = np.zeros(0, np.int64), np.zeros(0, bool)
        self.ids, self.uids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def meet(self, rows: "_Rows", bounds: np.ndarray) -> None:
        """Evaluate the rows of a block in descending order of bound, until the next cannot reach the floor."""
        order = np.flatnonzero(bounds >= self.floor)
        order = order[np.argsort(-bounds[order], kind="stable")]
        at, step = 0, _FIRST_STEP
        while at < len(order) and bounds[order[at]] >= self.floor:
            some = order[at : at + step]
            scores = (rows.vectors[some] @ self.vector).astype(np.int64)
            fit = (scores >= self.floor) & (rows.uids[some] != self.uid)
            if fit.any():
                some, scores = some[fit], scores[fit]
                self.scores = np.concatenate([self.scores, scores])
                self.named = np.concatenate([self.named, rows.named[some]])
                self.ids = np.concatenate([self.ids, rows.ids[some]])
                self.uids = np.concatenate([self.uids, rows.uids[some]])
                best = _best(self.scores, self.named, self.ids, self.uids, self.k)
                self.scores, self.named, self.ids, self.uids = (
                    x[best] for x in (self.scores, self.named, self.ids, self.uids)
                )
                if len(best) == self.k:
                    # Just below the score, since large scores are rounded here.
                    self.floor = max(self.floor, float(np.nextafter(float(self.scores[-1]), -np.inf)))
            at += step
            step *= 2


class _Rows(NamedTuple):
    """The rows of a block."""

    uids: np.ndarray
    ids: np.ndarray
    named: np.ndarray
    vectors: np.ndarray
    distances: np.ndarray


def _bounds(of_query: np.ndarray, norms: np.ndarray, of_rows: np.ndarray, space: Space) -> np.ndarray:
    """Upper bounds of the scores of every query with every row, from the pivot table alone."""
    gap = np.zeros((len(of_query), len(of_rows)), np.float32)
    for p in range(of_query.shape[1]):
        np.maximum(gap, np.abs(of_query[:, p, None] - of_rows[None, :, p]), out=gap)
    scale = norms[:, None] + space.square
    return (scale - gap.astype(np.float64) ** 2) / 2 + _MARGIN * scale + 1


def _rows_of(batch: pa.RecordBatch, k: int, space: Space) -> _Rows:
    at = {name: batch.column(name)[k].as_py() for name in ("uids", "ids", "named", "vectors", "distances")}
    uids = np.frombuffer(at["uids"], "<i8")
    return _Rows(
        uids,
        np.frombuffer(at["ids"], "<i8"),
        np.frombuffer(at["named"], bool),
        np.frombuffer(at["vectors"], space.kind).reshape(len(uids), space.dims).astype(space.exact),
        np.frombuffer(at["distances"], "<f4").reshape(len(uids), -1),
    )


def _clean(rows: DataFrame, id_column: str, vector_column: str, every: int) -> DataFrame:
    """uid, vec_id, query and the components as doubles, of the rows that take part."""
    vector = F.col(vector_column).cast("array<double>")
    finite = F.forall("components", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    picked = rows.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("components"))
    return picked.where(F.col("components").isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("uid"),
        "vec_id",
        F.coalesce(F.col("vec_id") % every == 0, F.lit(False)).alias("query"),
        "components",
    )


def space_of(rows: DataFrame, scale: int, pivots: int, sample: int) -> Space | None:
    """Dimensions, greatest length and pivots of the table; None for an empty one."""
    whole = F.transform("components", lambda x: F.rint(F.floor(x * scale).cast("double")))
    square = F.aggregate(whole, F.lit(0.0), lambda s, x: s + x * x)
    dims, top = rows.agg(F.max(F.size("components")), F.max(square)).head()
    if dims is None:
        return None
    if top >= 2.0**62:
        raise OverflowError("inner products of these vectors do not fit a long")
    hashed = rows.select("components", F.xxhash64("uid", "vec_id").alias("h")).orderBy("h").limit(sample)
    picked = np.zeros((sample, dims))
    found = hashed.select("components").collect()  # at most `sample` rows
    for k, row in enumerate(found):
        picked[k, : len(row[0])] = np.floor(np.array(row[0], np.float64) * scale)
    picked = picked[: len(found)]
    chosen = picked[farthest_first(picked, top, pivots)]
    kind = "<i2" if top < 2.0**30 else "<i4" if top < 2.0**62 else "<i8"
    return Space(dims, top, kind, chosen, lift(top, (chosen**2).sum(axis=1)))


def table_rows(rows: DataFrame, space: Space, scale: int) -> DataFrame:
    """Every row with its integer vector and its distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("components")
            sizes = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = held.flatten().to_numpy(zero_copy_only=False)
            vectors = np.zeros((len(batch), space.dims))
            row = np.repeat(np.arange(len(sizes)), sizes)
            vectors[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(flat * scale)
            norms = (vectors**2).sum(axis=1)
            away = distances(vectors, norms, lift(space.square, norms), space)
            home = away.argmin(axis=1)
            small = vectors.astype(space.kind)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in ("uid", "vec_id", "query")),
                    pa.array([x.tobytes() for x in small], pa.binary()),
                    pa.array(norms),
                    pa.array([x.tobytes() for x in away], pa.binary()),
                    pa.array(home.astype(np.int32)),
                    pa.array(away[np.arange(len(away)), home]),
                ],
                names=["uid", "vec_id", "query", "vector", "norm", "distances", "home", "near"],
            )

    return rows.mapInArrow(run, _ROWS)


def blocks_of(rows: DataFrame, space: Space, parts: int, block: int) -> DataFrame:
    """Rows of the table ranged by nearest pivot, `block` of them in one row; `part` is their group."""
    ranged = rows.repartitionByRange(parts, "home", "near", "uid").sortWithinPartitions("home", "near", "uid")

    def packed(part: int, batch: pa.Table) -> pa.RecordBatch:
        batch = batch.combine_chunks()
        ids = batch["vec_id"].to_numpy() if not batch["vec_id"].null_count else batch["vec_id"].fill_null(0).to_numpy()
        away = np.frombuffer(b"".join(batch["distances"].to_pylist()), "<f4").reshape(len(batch), -1)
        blob = {
            "uids": batch["uid"].to_numpy().astype("<i8").tobytes(),
            "ids": ids.astype("<i8").tobytes(),
            "named": batch["vec_id"].is_valid().to_numpy(zero_copy_only=False).astype(bool).tobytes(),
            "asks": batch["query"].to_numpy(zero_copy_only=False).astype(bool).tobytes(),
            "vectors": b"".join(batch["vector"].to_pylist()),
            "norms": batch["norm"].to_numpy().astype("<f8").tobytes(),
            "distances": away.tobytes(),
        }
        edges = [pa.array([x.tolist()], pa.list_(pa.float32())) for x in (away.min(axis=0), away.max(axis=0))]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in blob.values()), *edges],
            names=["part", *blob, "low", "high"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            while size >= block:
                both = pa.Table.from_batches(held)
                yield packed(part, both.slice(0, block))
                held, size = both.slice(block).to_batches(), size - block
        if size:
            yield packed(part, pa.Table.from_batches(held))

    return ranged.mapInArrow(run, _BLOCKS)


def queries_of(blocks: DataFrame, space: Space, k: int) -> DataFrame:
    """The queries of every block as one row, with the k-th best score each finds inside its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                rows = _rows_of(batch, n, space)
                asks = np.flatnonzero(np.frombuffer(batch.column("asks")[n].as_py(), bool))
                if not len(asks):
                    continue
                norms = np.frombuffer(batch.column("norms")[n].as_py(), "<f8")[asks]
                # A query is lifted by 0, not to the greatest length.
                away = distances(rows.vectors[asks].astype(np.float64), norms, np.zeros(len(asks)), space)
                bounds, floors = _bounds(away, norms, rows.distances, space), []
                for j, at in enumerate(asks):
                    asker = _Asker(int(rows.uids[at]), 0, rows.vectors[at], norms[j], -np.inf, k)
                    asker.meet(rows, bounds[j])
                    floors.append(asker.floor)
                blob = [
                    rows.uids[asks].tobytes(), rows.ids[asks].tobytes(), rows.vectors[asks].astype(space.kind).tobytes(),
                    norms.tobytes(), away.tobytes(), np.array(floors, "<f8").tobytes(),
                ]
                edges = [pa.array([x.tolist()], pa.list_(pa.float32())) for x in (away.min(axis=0), away.max(axis=0))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(rows.uids[asks[0]])]), *(pa.array([x], pa.binary()) for x in blob), *edges,
                        pa.array([float(norms.max())]), pa.array([float(min(floors))]),
                    ],
                    names=[x.split()[0] for x in _QUERIES.split(", ")],
                )

    return blocks.mapInArrow(run, _QUERIES)


def _met(queries: DataFrame, blocks: DataFrame, space: Space, parts: int) -> DataFrame:
    """Every row of queries with the blocks of the groups whose intervals leave room for a better score."""
    ends = blocks.select("part", F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "e"))
    ends = ends.groupBy("part", "pivot").agg(F.min("e.low").alias("low"), F.max("e.high").alias("high"))
    ends = ends.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("pivot", "low", "high"))).alias("ends"))
    asked = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(ends, "part")
    gaps = F.transform(
        F.arrays_zip("q_low", "q_high", "ends"),
        lambda x: F.greatest(x.q_low - x.ends.high, x.ends.low - x.q_high, F.lit(0.0)).cast("double"),
    )
    scale = F.col("q_top") + F.lit(space.square)
    room = (scale - F.pow(F.array_max(gaps), F.lit(2.0))) / 2 + F.lit(_MARGIN) * scale + 1
    asked = asked.where(room >= F.col("q_floor")).select("part", *queries.columns[:7])
    # Few bytes, much work: both sides are dealt by hand, so that no two groups are put together for their size.
    held = blocks.select("part", "uids", "ids", "named", "vectors", "distances")
    return asked.repartition(parts, "part").join(held.repartition(parts, "part").hint("merge"), "part")


def _searched(met: DataFrame, space: Space, k: int) -> DataFrame:
    def found(askers: list[_Asker]) -> pa.RecordBatch:
        sizes = [len(x.uids) for x in askers]
        named = np.concatenate([x.named for x in askers])
        columns = [
            np.repeat(np.array([x.uid for x in askers], np.int64), sizes),
            np.repeat(np.array([x.vec_id for x in askers], np.int64), sizes),
            np.concatenate([x.uids for x in askers]),
            pa.array(np.concatenate([x.ids for x in askers]), mask=~named),
            np.concatenate([x.scores for x in askers]),
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=[x.split()[0] for x in _FOUND.split(", ")]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks of one group follow each other for a row of queries, which goes on with what it has found.
        current, askers, away, norms = None, [], None, None
        for batch in batches:
            for n in range(len(batch)):
                key = (batch.column("asker")[n].as_py(), batch.column("part")[n].as_py())
                if key != current:
                    if askers:
                        yield found(askers)
                    current = key
                    of = lambda name, kind: np.frombuffer(batch.column(name)[n].as_py(), kind)  # noqa: B023, E731
                    uids, ids, norms, floors = of("q_uids", "<i8"), of("q_ids", "<i8"), of("q_norms", "<f8"), of("q_floors", "<f8")
                    vectors = of("q_vectors", space.kind).reshape(len(uids), space.dims).astype(space.exact)
                    away = of("q_distances", "<f4").reshape(len(uids), -1)
                    askers = [
                        _Asker(int(u), int(i), v, float(m), float(f), k)
                        for u, i, v, m, f in zip(uids, ids, vectors, norms, floors)
                    ]
                rows = _rows_of(batch, n, space)
                bounds = _bounds(away, norms, rows.distances, space)
                for j, asker in enumerate(askers):
                    asker.meet(rows, bounds[j])
        if askers:
            yield found(askers)

    return met.mapInArrow(run, _FOUND)


def top_inner_products(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    every: int = 50,
    k: int = TOP,
    scale: int = SCALE,
    pivots: int = PIVOTS,
    sample: int = SAMPLE,
    block: int = BLOCK,
    blocks: int = BLOCKS,
) -> DataFrame:
    """query_id, rank, vec_id and score: the k highest scores of each row whose id is divisible by `every`."""
    spark = rows.sparkSession
    ship(spark)
    clean = stored(_clean(rows, id_column, vector_column, every), "vectors")
    space = space_of(clean, scale, pivots, sample)
    if space is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = max(-(-clean.count() // (block * blocks)), spark.sparkContext.defaultParallelism)
    held = stored(blocks_of(table_rows(clean, space, scale), space, parts, block), "blocks")
    # Fewer distinct rows than parts leave some empty; under another setting there may be more.
    parts = 1 + (held.agg(F.max("part")).head()[0] or 0)
    queries = stored(queries_of(held, space, k), "queries")
    found = _searched(_met(queries, held, space, parts), space, k)
    best = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
