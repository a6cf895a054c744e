"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wattloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE on; pass `master` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder.

    The cluster names that folder in `spark.checkpoint.dir`. Only when neither the setting nor the
    context has one (a local test) does this fall back to a temporary folder.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def packed(df: DataFrame) -> DataFrame:
    """`checkpointed` with the rows as compressed Arrow batches: repeated texts hardly take disk, tasks hold what they held."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["blob"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                yield from pa.ipc.open_stream(blob.as_buffer())

    return checkpointed(df.mapInArrow(pack, "blob binary")).mapInArrow(unpack, df.schema)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back, for results that many plans scan."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/wattloom-{label}-{uuid.uuid4().hex[:12]}"
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def _shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints, set as the context's if that has none."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if shared is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            shared = tempfile.mkdtemp(prefix="wattloom-checkpoint-")
        context.setCheckpointDir(shared)
    return (shared or context.getCheckpointDir()).rstrip("/")
