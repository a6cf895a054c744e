"""Running sums over a sorted table, spread over its ranges; the borders of the ranges alone come to the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import stored

MASK = (1 << 62) - 1


def ranged(df: DataFrame, order: Sequence[str], parts: int) -> DataFrame:
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _schema(df: DataFrame, extra: str) -> StructType:
    return StructType([*df.schema.fields, *StructType.fromDDL(extra).fields])


def running(df: DataFrame, key: str, order: Sequence[str], values: Sequence[str], parts: int) -> DataFrame:
    """Add `run_<value>`, the sum modulo 2**62 of a value (0 to 2**62 - 1) over the rows of the same `key` up to the row.

    The table is ranged by `key` and `order`, which together should tell most rows apart: a key with very many rows then
    lies in many ranges. One row per range comes to the driver, and what a range's first key has had before goes back.
    """
    names = [f"run_{v}" for v in values]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        last, carry = None, np.zeros(len(values), np.uint64)
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column(key).to_numpy()
            new = np.r_[last is None or keys[0] != last, keys[1:] != keys[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            sums = []
            for k, value in enumerate(values):
                own = batch.column(value).to_numpy().astype(np.uint64)
                total = np.cumsum(own, dtype=np.uint64)
                before = np.where(start >= 0, total[start] - own[start], np.uint64(0) - carry[k])
                sums.append(((total - before) & np.uint64(MASK)).astype(np.int64))
            last, carry = keys[-1], np.array([s[-1] for s in sums], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, sums), pa.array(np.full(len(keys), part, np.int32)), pa.array(at + np.arange(len(keys)))],
                names=[*batch.schema.names, *names, "_part", "_at"],
            )
            at += len(keys)

    extra = ", ".join(f"{n} long" for n in [*names]) + ", _part int, _at long"
    local = stored(ranged(df, [key, *order], parts).mapInArrow(scan, _schema(df, extra)), "running")
    ends = local.groupBy("_part").agg(
        F.min(key).alias("first"), F.max(key).alias("last"), F.max_by(F.struct(*names), "_at").alias("sums")
    )
    carried, current, sums = [], None, [0] * len(names)
    for row in sorted(ends.collect()):  # a row per range
        if row["first"] == current and any(sums):
            carried.append((row["_part"], current, *sums))
        base = sums if row["first"] == row["last"] == current else [0] * len(names)
        current, sums = row["last"], [(a + b) & MASK for a, b in zip(base, row["sums"])]
    if not carried:
        return local.drop("_part", "_at")
    schema = "_of int, _key long, " + ", ".join(f"_{n} long" for n in names)
    more = F.broadcast(df.sparkSession.createDataFrame(carried, schema))  # at most a row per range
    joined = local.join(more, (F.col("_part") == F.col("_of")) & (F.col(key) == F.col("_key")), "left")
    plus = lambda n: (F.col(n) + F.coalesce(f"_{n}", F.lit(0))).bitwiseAND(F.lit(MASK))
    return joined.select(*df.columns, *[plus(n).alias(n) for n in names])


def masked(value: Column) -> Column:
    return value.bitwiseAND(F.lit(MASK))
