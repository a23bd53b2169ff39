"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII blanks.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where a session of one process names none (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        import atexit

        own = shared_dir.own = tempfile.mkdtemp(prefix="specloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts lineage and survives lost executors."""
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for t in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._table_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete such tables, then what shuffles are done with."""
    drop(spark, *tables)
    release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps: it does so once their driver objects are collected."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def to_bytes(text: str | None) -> bytes:
    """UTF-8; lone surrogates, which Parquet cannot hold but Python can, become '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")


def pieces(batches, rows: int = 1000):
    """The batches in parts of at most so many rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def trim() -> None:
    """Hand memory that this Python worker no longer uses back to the system, as workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# ---- vectorised polynomial hashes modulo 2**64 ----------------------------------------------

def symbol_table(seed: int) -> np.ndarray:
    """256 fixed odd 64-bit values, one per byte."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int = _MULT):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up), 1 << 16)
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.cumprod(np.full(m - 1, self.base, np.uint64))])
            self.down = np.concatenate([one, np.cumprod(np.full(m - 1, self.inverse, np.uint64))])
        return self.up[:n], self.down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64), so that any bits of them may be compared."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(values: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """S with S[i] = sum of values[j] * base**j for j < i, and the inverse powers that align windows."""
    up, down = powers.get(len(values) + 1)
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=s[1:], dtype=np.uint64)
    return s, down


def span_hash(s: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], equal for equal contents wherever they stand."""
    return mix((s[end] - s[start]) * down[start])


# ASCII blanks that end words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_WORD_POWERS = Powers(0xD1342543DE82EF95)
_WORD_TABLE = symbol_table(11)


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets where the words of UTF-8 ``data`` start and end, and a 64-bit hash of each."""
    a = np.frombuffer(data, np.uint8)
    inside = ~BLANK[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    s, down = prefix_sums(_WORD_TABLE[a], _WORD_POWERS)
    return start, end, span_hash(s, down, start, end)


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def with_columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of any name do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])
