"""Shared folder, written intermediate tables and input columns of the text operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, which all executors reach; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="wattloom-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let executors import this package, also where it is not installed on them."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    handle, archive = tempfile.mkstemp(prefix="wattloom-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex[:12]}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the id (as long) and the text, whatever other columns there are."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda word: word != "")


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns as one, `row`, beside some of our own, so that no name clashes; `select("row.*")` brings them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in more.items()])


def without_texts(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """Rows of `docs` whose text (null: empty) has none of the MD5 digests; every row is judged by its own text."""
    gone = digests.select(F.col(digests.columns[0]).alias("gone")).distinct()
    rows = packed(docs, own=F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return rows.join(gone, F.col("own") == F.col("gone"), "left_anti").select("row.*")


def same_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])
