"""Toxicity scores by non-negative positive-unlabelled learning (operator 4).

A linear classifier over the set of words and word beginnings of a document is fitted in numpy from confirmed toxic
documents (P) and unlabelled ones (U). With class prior p, the risk of taking U as negative is corrected by what P adds to it,

    p * E_P[loss(+)] + max(0, E_U[loss(-)] - p * E_P[loss(-)]),

and where the corrected part would fall below zero, the step goes against it, so that the fit does not run away.
The prior is the share of toxic rows among the labels that may be learned from. Confirmed negatives are never used.

Fitting takes bounded samples (`max_positive`, `max_unlabelled` documents, chosen by a hash of the id); scoring covers
every whole text. Words are folded runs of letters, digits and non-ASCII characters; their first 3 to 8 bytes count as
features too, since inflected words share a stem, and what occurs twice or more in a document is a further feature.
Features are 32-bit hashes. Labels, language, source and id are no
inputs of a score.

Defined cases: a null or wordless text gets the score of the bias alone; without a learnable toxic row every score is
0; several labels of one id count as toxic if any is; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, texts, without_texts
from .words import Block, blocks, mixed, plain

MAX_POSITIVE = 3_000
MAX_UNLABELLED = 5_000
PREFIXES = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.3
HELD_OUT_REST = 2
_TWICE = np.uint32(0x9E3779B9)

SCORES = "doc_id long, score double"


class Model(NamedTuple):
    """Sorted features, their weights and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept for testing: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT_REST, F.lit(False))


def _share(ids: DataFrame, most: int) -> Column:
    """A condition that keeps about `most` of the ids, by a hash of the id."""
    rows = ids.count()
    part = 1.0 if rows <= most else most / rows
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return unit < F.lit(part)


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of all words and word beginnings of a block, not yet distinct."""
    salts = mixed(np.arange(1, len(PREFIXES) + 2, dtype=np.uint64))
    kinds = np.concatenate([block.hashes[None, :], block.prefixes])
    found = (mixed(kinds ^ salts[:, None]) >> np.uint64(32)).astype(np.uint32)
    document = np.broadcast_to(np.repeat(np.arange(block.high - block.low), np.diff(block.first)), kinds.shape)
    there = kinds != 0
    return found[there], document[there]


def _feature_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = []
        for block in blocks(batch.column(1), plain(), prefix_lengths=PREFIXES):
            found, document = features(block)
            both, count = np.unique(document.astype(np.uint64) << np.uint64(32) | found, return_counts=True)
            both = np.unique(np.concatenate([both, both[count > 1] ^ np.uint64(_TWICE)]))
            edges = np.searchsorted(both >> np.uint64(32), np.arange(block.high - block.low + 1))
            sets += [both[a:b].astype(np.uint32).tobytes() for a, b in zip(edges[:-1], edges[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["positive", "features"])


def training_sample(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int):
    """Feature sets of sampled documents, as [(positive, features)], and the class prior."""
    docs = texts(docs)
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).head()[0]
    toxic = known.where("toxic = 1").select("doc_id")
    free = docs.where(~held_out(F.col("doc_id")))
    # At most about max_positive ids, hence the hint.
    picked = F.broadcast(toxic.where(_share(toxic, max_positive)).withColumn("positive", F.lit(True)))
    sample = (
        free.withColumn("unlabelled", _share(free.select("doc_id"), max_unlabelled))
        .join(picked, "doc_id", "left")
        .where("positive OR unlabelled")
        .select(F.coalesce("positive", F.lit(False)).alias("positive"), F.coalesce("unlabelled", F.lit(False)).alias("u"), "text")
    )
    # A sampled toxic document may stand in both samples.
    both = F.array_compact(F.array(F.when(F.col("positive"), F.lit(True)), F.when(F.col("u"), F.lit(False))))
    sample = sample.select(F.explode(both).alias("positive"), "text")
    rows = sample.mapInArrow(_feature_sets, "positive boolean, features binary").toArrow()
    sets = (np.frombuffer(x.as_buffer(), np.uint32) for x in rows["features"])
    return list(zip(rows["positive"].to_pylist(), sets)), prior


def fit(
    sample: list[tuple[bool, np.ndarray]],
    prior: float,
    max_features: int = 2_000,
    min_contrast: float = 5.0,
    min_documents: int = 5,
    steps: int = 400,
    rate: float = 0.1,
    decay: float = 0.8,
    beta: float = 0.0,
    gamma: float = 1.0,
) -> Model:
    """Minimise the corrected risk with logistic loss by Adam over the whole sample.

    Copies count once. Only features enter whose shares of P and of U differ by `min_contrast` standard errors, at most
    `max_features` of them; without that, a linear model fits P by its rare words. `decay` counts per document of P.
    """
    sample = [*{(p, hash(f.tobytes())): (p, f) for p, f in sample}.values()]
    positive = np.array([p for p, _ in sample], dtype=bool)
    if not positive.any() or positive.all() or not prior:
        return Model(np.zeros(0, np.uint32), np.zeros(0), -np.inf)
    prior = float(np.clip(prior, 1e-4, 0.999))
    n, n_p, n_u = len(sample), int(positive.sum()), int((~positive).sum())
    ids, in_p, in_u = _counted(sample, min_documents)
    overall = (in_p + in_u) / n
    error = np.sqrt(np.maximum(overall * (1 - overall), 1 / n) * (1 / n_p + 1 / n_u))
    contrast = np.abs(in_p / n_p - in_u / n_u) / error
    chosen = np.sort(np.argsort(-contrast, kind="stable")[:max_features])
    ids = ids[chosen[contrast[chosen] >= min_contrast]]
    rows, columns = [], []
    for i, (_, found) in enumerate(sample):
        at = _placed(ids, found)
        rows.append(np.full(len(at), i))
        columns.append(at)
    row, column, k = np.concatenate(rows), np.concatenate(columns), len(ids)
    shrink = min(decay / n_p, 3e-3)
    most = float(np.log(prior / (1 - prior)))
    weights, bias = np.zeros(k), most
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        score = np.bincount(row, weights[column], minlength=n) + bias
        probability = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        as_negative = np.logaddexp(0, score)
        corrected = as_negative[~positive].mean() - prior * as_negative[positive].mean()
        if corrected >= -beta:
            slope = np.where(positive, -prior / n_p * (1 - probability) - prior / n_p * probability, probability / n_u)
        else:
            slope = gamma * np.where(positive, prior / n_p * probability, -probability / n_u)
        gradient = np.append(np.bincount(column, slope[row], minlength=k) + shrink * weights, slope.sum())
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        # A document without any of the features never scores above the prior.
        weights, bias = weights - move[:-1], min(bias - move[-1], most)
    return Model(ids, weights, float(bias))


def _counted(sample: list[tuple[bool, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of at least `least` documents, and how many documents of P and of U have them."""
    parts = [np.sort(np.concatenate([np.zeros(0, np.uint32), *(f for p, f in sample if p == kind)])) for kind in (True, False)]
    ids, count = np.unique(np.concatenate(parts), return_counts=True)
    ids = ids[count >= least]
    in_p, in_u = (np.searchsorted(x, ids, "right") - np.searchsorted(x, ids, "left") for x in parts)
    return ids, in_p, in_u


def _placed(ids: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Places in `ids` of those features that are there."""
    if not len(ids):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(ids, found), len(ids) - 1)
    return at[ids[at] == found]


def scores(docs: DataFrame, model: Model, by_text: bool = False) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; with `by_text` the digest of the text in place of the id."""
    ship(docs.sparkSession)

    size = max(1, len(model.features))
    maybe = np.zeros(1 << 16, bool)
    maybe[model.features >> np.uint32(16)] = True

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.full(batch.num_rows, model.bias)
            for block in blocks(batch.column(1), plain(), prefix_lengths=PREFIXES):
                if not len(model.features):
                    break
                found, document = features(block)
                for least, kind in ((1, found), (2, found ^ _TWICE)):
                    likely = np.flatnonzero(maybe[kind >> np.uint32(16)])
                    at = np.minimum(np.searchsorted(model.features, kind[likely]), size - 1)
                    there = model.features[at] == kind[likely]
                    pairs, count = np.unique(document[likely[there]] * size + at[there], return_counts=True)
                    row, at = np.divmod(pairs[count >= least], size)
                    total[block.low : block.high] += np.bincount(row, model.weights[at], block.high - block.low)
            value = 1 / (1 + np.exp(-np.clip(total, -700, 700))) if np.isfinite(model.bias) else np.zeros(len(total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64())], names=["doc_id", "score"])

    if not by_text:
        return texts(docs).mapInArrow(score, SCORES)
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.md5(whole).alias("doc_id"), whole.alias("text")).mapInArrow(score, SCORES.replace("long", "string"))
    return named.withColumnRenamed("doc_id", "digest")


def train(
    docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED
) -> Model:
    return fit(*training_sample(docs, labels, max_positive, max_unlabelled))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from `threshold` on) of every document."""
    found = scores(docs, train(docs, labels))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns; rows without an id are judged as well."""
    found = scores(docs, train(docs, labels), by_text=True)
    return without_texts(docs, found.where(F.col("score") >= threshold).select("digest"))
