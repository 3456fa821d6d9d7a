"""Helpers shared by the corpus operators: inputs, the shared folder, texts in Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in ``sf_dir``, by Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, which is one machine, may get one of its own."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="storelens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stash(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors. A folder for each value of ``by``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(*stashed: DataFrame | None) -> None:
    """Delete what ``stash`` wrote for these, where nothing that is still to run reads it. Others are left alone."""
    for df in stashed:
        if path := getattr(df, "__dict__", {}).get("stashed_at"):
            jvm = df.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def slim(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns (whatever their names) never clash or travel."""
    return docs.select(*[docs[n] for n in names])


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: sizes blocks and shards, never a limit."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


@cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


def tidy() -> None:
    """Give what a task has freed back to the machine: Spark keeps its Python workers for other tasks."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def batches(source: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to about ``most`` bytes each (a single longer row stays whole)."""
    for batch in source:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    tidy()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def as_longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


_held: dict[str, Callable[[], None]] = {}


def claim(owner: str, release: Callable[[], None]) -> None:
    """Called where a task begins: frees what other operators remember in this Python worker, which Spark reuses."""
    for other in [k for k in _held if k != owner]:
        _held.pop(other)()
    _held[owner] = release


#: Longer words are not remembered by any operator; together, remembered words take so many characters at most.
LONGEST, MOST_LETTERS = 1024, 16 << 20


class WordMemo(dict):
    """Values by word within one Python worker; emptied when full, by number or by length, so its memory is bounded."""

    def __init__(self, make, most: int = 200_000):
        super().__init__()
        self.make, self.most, self.letters = make, most, 0

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= LONGEST:
            if len(self) >= self.most or self.letters > MOST_LETTERS:
                self.clear()
            self.letters += len(word)
            self[word] = value
        return value

    def clear(self):
        super().clear()
        self.letters = 0


_names = WordMemo(xxhash.xxh64_intdigest)


def word_names(words: list[bytes]) -> np.ndarray:
    """64-bit names of words."""
    claim("words", _names.clear)
    return np.fromiter(map(_names.__getitem__, words), np.uint64, len(words))


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_powers: list[np.ndarray] = [np.empty(0, np.uint64)] * 2


def powers(n: int, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64; up to ``most`` of them are kept between calls."""
    found = list(_powers)
    if len(found[0]) < n:
        for k, x in enumerate((int(MULTIPLIER), pow(int(MULTIPLIER), -1, 1 << 64))):
            out = np.full(n, x, np.uint64)
            out[0] = 1
            found[k] = np.multiply.accumulate(out)
        if n <= most:
            _powers[:] = found
    return found[0][:n], found[1][:n]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial of 64-bit symbols, from which ``span_names`` names any stretch of them."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols))[0], out=out[1:])
    return out


def window_names(symbols: np.ndarray, length: int) -> np.ndarray:
    """64-bit names of every window of ``length`` symbols; symbols are scrambled 64-bit values."""
    if len(symbols) < length:
        return np.empty(0, np.uint64)
    total = prefix_sums(symbols)
    n = len(symbols) - length + 1
    return mix((total[length:] - total[:n]) * powers(len(symbols))[1][:n])
