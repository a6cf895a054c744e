"""Mixing sources to target sizes by weighted sampling without replacement (operator 6).

Sources share a budget by weight; no target exceeds `cap` times its source, and what is cut off goes to the others by
weight until none is above. A target's complete epochs take every document that often; the rest is filled by
Efraimidis-Spirakis sampling: each document draws an exponential key divided by its quality weight, and documents are
taken in the order of their keys while they fit the rest (the one on the border if more than half of it fits).

The draw is a hash of the id, so reruns agree. Prefix sums run over slices of the key range (`SLICES` for a source,
however large); only the slice in which the rest ends is sorted, and it holds about 1/4096 of its source.

Defined cases: a null text has size 0 and takes nothing; documents of the null source form a source, the last one;
equal rows draw equal keys and any of them may be the one on the border; sources of size 0 get target 0; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import packed, stored, words_of

SLICES = 4096
SHARE = 1.5
CAP = 2
WEIGHTS = (3, 1, 2)
SYMBOLS = "#*$%&|<>{}[]!"


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def quality(text: Column) -> Column:
    """1 for text without symbols, falling to 0.1 where at least 9 % of the characters are symbols."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    share = F.coalesce(symbols / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))
    return F.greatest(F.lit(1.0) - F.lit(10.0) * share, F.lit(0.1))


def exponential_key(doc_id: Column, weight: Column, seed: str = "mix") -> Column:
    """-ln(u) / weight with u in (0, 1] from 52 bits of a digest of the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    unit = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1).cast("double") / F.lit(float(1 << 52))
    return -F.log(unit) / weight


def targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP
) -> DataFrame:
    """source, source_size -> also target. Sources are taken by code point, null last; the weights repeat in that order.

    The windows see one row per source.
    """
    kinds = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("_rank", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))))
    ranked = ranked.withColumn("_w", F.element_at(kinds, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * cap).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = W.orderBy("_ratio", "_rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    weight_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    # Sources below the level are full; the level is set by the first that is not.
    ranked = ranked.withColumn("_level", left / weight_left)
    open_level = F.first(F.when(F.col("_ratio") > F.col("_level"), F.col("_level")), ignorenulls=True).over(everything)
    target = F.least(F.col("_cap").cast("double"), F.coalesce(open_level * F.col("_w"), F.col("_cap").cast("double")))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weight: Column | None = None,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    seed: str = "mix",
) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (complete ones) and taken (words taken, repeats counted)."""
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        n_words(text).alias("size"),
        F.md5(F.coalesce(text.cast("string"), F.lit(""))).alias("digest"),
        exponential_key(F.col("doc_id").cast("long"), quality(text) if weight is None else weight, seed).alias("_key"),
    )
    slice_ = F.floor((F.lit(1.0) - F.exp(F.col("_key") * -0.8)) * SLICES).cast("int")
    rows = stored(rows.withColumn("_slice", slice_), "mix_rows")
    sums = stored(rows.groupBy("source", "_slice").agg(F.sum("size").alias("_size")), "mix_slices")
    goals = targets(sums.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, cap)
    size = F.col("source_size")
    goals = goals.withColumn("epochs", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
    goals = goals.withColumn("_rest", F.col("target") - F.col("epochs") * size)
    ordered = W.partitionBy("source").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = sums.withColumn("_before", F.coalesce(F.sum("_size").over(ordered), F.lit(0)))
    slices = slices.withColumnRenamed("source", "_source").withColumnRenamed("_slice", "_at")
    slices = slices.join(goals, F.col("_source").eqNullSafe(F.col("source"))).drop("source")
    end = F.col("_before") + F.col("_size")
    state = F.when(end <= F.col("_rest"), "all").when(F.col("_before") >= F.col("_rest"), "none").otherwise("some")
    slices = stored(slices.withColumn("_state", state), "mix_plan")
    placed = rows.join(slices, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_at")))
    whole = placed.where("_state <> 'some'").withColumn("_picked", F.col("_state") == "all")
    inside = W.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    so_far = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    border = placed.where("_state = 'some'").withColumn("_picked", so_far + F.col("size") / 2 <= F.col("_rest"))
    taken = F.col("size") * (F.col("epochs") + F.col("_picked").cast("long"))
    columns = ["doc_id", "source", "digest", "size", "source_size", "target", "epochs", taken.cast("long").alias("taken")]
    return whole.select(*columns).union(border.select(*columns))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    A row is told apart by id, source and text; rows equal in all three are taken alike, as often as the most of them.
    """
    plan = mix(docs, **options).groupBy("doc_id", "source", "digest").agg(F.max("taken").alias("_taken"), F.max("size").alias("_size"))
    plan = plan.where("_taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("digest").alias("_digest"),
        F.round(F.col("_taken") / F.col("_size")).cast("int").alias("_copies"),
    )
    rows = packed(
        docs, id=F.col("doc_id").cast("long"), source=F.col("source").cast("string"),
        digest=F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))),
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("digest") == F.col("_digest"))
    return rows.join(plan, same).select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")
