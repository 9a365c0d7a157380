"""Helpers that the operators share: tokens as numpy arrays, and tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
#: Texts handled at once inside a Python worker, in bytes (a single longer text is handled alone).
SLICE_BYTES = 3 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where both are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share: {master} has none")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


_FOLDER: ContextVar[str] = ContextVar("folder", default="tables")


@contextmanager
def folder(name: str) -> Iterator[None]:
    """Within it, :func:`stored` writes to a part of the shared folder that can be cleared by itself."""
    token = _FOLDER.set(name)
    try:
        yield
    finally:
        _FOLDER.reset(token)


#: Spark drops the shuffle files of a statement once it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, and leaves no shuffle files."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{_FOLDER.get()}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` returned; their last reader must have ended."""
    for table in tables:
        _delete(table.sparkSession, _PATHS.pop(table))


def clear_scratch(spark: SparkSession, name: str | None = None) -> None:
    """Delete the tables written by :func:`stored` (in one folder, or all); call it once the results have been written."""
    _delete(spark, scratch_dir(spark) + (f"/{name}" if name else ""))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores as keep them apart from ``columns``."""
    taken, tail = {c.lower() for c in columns}, ""
    while any((n + tail).lower() in taken for n in names):
        tail += "_"
    return [n + tail for n in names]


def n_tokens(text: Column) -> Column:
    """Number of words of a text; 0 for null, empty and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one piece take about ``most`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes) // most
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def release() -> None:
    """Give memory that this process has freed back to the system, where that can be asked for."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Words:
    """Lower-cased words of some texts: ``codes`` into ``vocab`` for all words in order, ``starts`` by text."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts, "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        encoded = lists.flatten().dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        vocab = encoded.dictionary
        empty = np.flatnonzero(pc.equal(vocab, "").to_numpy(zero_copy_only=False))
        if len(empty):
            keep = codes != empty[0]
            owner = np.repeat(np.arange(len(lengths)), lengths)[keep]
            lengths = np.bincount(owner, minlength=len(lengths)).astype(np.int64)
            codes = codes[keep]
        self.codes, self.vocab, self.lengths = codes, vocab, lengths
        self.starts = np.concatenate([[0], np.cumsum(lengths)])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word of ``vocab``."""
        return hash_strings(self.vocab)


def hash_strings(strings: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(x or "") for x in strings.to_pylist()), np.uint64, len(strings))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: spreads each input bit over the result."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolling(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive token hashes; the order of the tokens counts."""
    out = np.zeros(max(0, len(tokens) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * _MIX + tokens[k : k + len(out)] + np.uint64(k + 1))
    return out
