"""Shared helpers: written intermediate tables, storage access and stable keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as used by every word and normalisation rule here (fixed value).
ASCII_SPACE = r"[\x20\x09-\x0D]+"
ASCII_WORD = r"[^\x20\x09-\x0D]+"


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or set as the context's checkpoint folder.

    A folder of our own only where neither is named and everything runs in this process; on a cluster that raises, as each
    executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("name a shared folder in spark.checkpoint.dir")
        base = getattr(shared_dir, "local", None)
        if base is None:
            base = shared_dir.local = "file://" + tempfile.mkdtemp(prefix="pitspark-")
    return base.rstrip("/")


_inside: ContextVar[str | None] = ContextVar("inside", default=None)


@contextmanager
def inside(spark: SparkSession, label: str) -> Iterator[str]:
    """Intermediate tables begun in this block go to one folder of the shared one, whose path is given; the caller deletes it."""
    path = f"{_inside.get() or shared_dir(spark) + '/pitspark'}/{label}-{uuid.uuid4().hex}"
    mark = _inside.set(path)
    try:
        yield path
    finally:
        _inside.reset(mark)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_inside.get() or shared_dir(spark) + '/pitspark'}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, fixes row ids and survives lost executors."""
    spark = session_of(df)
    path = path or new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pitspark_path = path
    return out


class Scratch:
    """The intermediate tables of one operator. Leaving the block deletes all but those kept for the result's plan; a failure deletes them all."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.stays, self.paths, self.made = spark, new_path(spark, label), set(), [], 0

    def path(self, name: str) -> str:
        self.made += 1
        self.paths.append(f"{self.root}/{name}-{self.made}")
        return self.paths[-1]

    def write(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        out = materialise(df, name, self.path(name))
        if keep:
            self.stays.add(out._pitspark_path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete_path(self.spark, t._pitspark_path)
            self.paths.remove(t._pitspark_path)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind or not self.stays:
            delete_path(self.spark, self.root)
        else:
            for p in self.paths:
                if p not in self.stays:
                    delete_path(self.spark, p)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str):
    """(pyarrow file system, path) for a URI: file, hdfs and object stores alike."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def words_in(text: Column) -> Column:
    """Number of ASCII-space separated words (null: 0), without building an array of them."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_WORD, "x")
    return F.length(F.translate(squeezed, " \t\n\x0b\x0c\r", "")).cast("long")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two longs, k1 and k2, that tell rows of different id or text apart (128 bits of hash), to find rows again in a stored table."""
    both = F.struct(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t"))
    return [F.xxhash64(F.lit(seed), both, both["i"].isNull(), both["t"].isNull()).alias(name) for seed, name in ((1, "k1"), (2, "k2"))]


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo `modulus` (null key: 0)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")
