"""Helpers shared by the corpus operators: words, folds, tables in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words: space and U+0009 to U+000D; bytes.split() cuts at exactly these.
WORD_BREAKS = r"[\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and all runs on this machine (tests), one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own_dir.setdefault(app, tempfile.mkdtemp(prefix="spark-tallyforge-"))
    return base.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of save() that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of finished steps now, not at its next half-hourly round."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, n: int = 5) -> Column:
    """crc32 of the id's decimal text, mod n; null ids fold as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches, rows: int = 512):
    """Arrow batches cut to a few hundred rows, so that very long texts keep memory bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes (mod 2^64) of any substring of a buffer, from prefix sums."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        rng = np.random.default_rng(200)
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            size = 1 << int(n + 1).bit_length()
            for name, base in (("power", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, buffer: np.ndarray) -> np.ndarray:
        self._grow(len(buffer))
        out = np.zeros(len(buffer) + 1, dtype=np.uint64)
        np.cumsum(self.value[buffer] * self.power[: len(buffer)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        return (prefix[start + length] - prefix[start]) * self.inverse[start]

    def all(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """Of every substring of this length, in order."""
        n = len(prefix) - length
        return (prefix[length:] - prefix[:n]) * self.inverse[:n]


_rolling: list[Rolling] = []


def rolling() -> Rolling:
    if not _rolling:
        _rolling.append(Rolling())
    return _rolling[0]


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True


def batch_shingles(texts: list[bytes], n: int = 5, most: int = 8 << 20) -> list[np.ndarray]:
    """Hashes of all runs of n words (A-Z lower-cased) of each text, in order; a shorter text is one run, one
    without words none. Texts are hashed together, about `most` bytes at a time."""
    out: list[np.ndarray] = []
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= most:
            out += _shingles_of(held, n)
            held, size = [], 0
    return out + (_shingles_of(held, n) if held else [])


def _shingles_of(texts: list[bytes], n: int) -> list[np.ndarray]:
    joined = b" ".join(texts).translate(_LOWER)
    if not joined:
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    buffer = np.frombuffer(joined, dtype=np.uint8)
    apart = np.concatenate([[True], _BREAK[buffer], [True]])
    starts = np.flatnonzero(apart[:-1] & ~apart[1:])
    ends = np.flatnonzero(~apart[:-1] & apart[1:])
    roll = rolling()
    words = mix64(roll.of(roll.prefix(buffer), starts, ends - starts) + (ends - starts).astype(np.uint64))
    lengths = np.array([len(t) for t in texts]) + 1
    firsts = np.searchsorted(starts, np.append(0, np.cumsum(lengths)))
    whole = shingle_hashes(words, n)
    return [
        whole[a : b - n + 1] if b - a >= n else shingle_hashes(words[a:b], n) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)
    ]


def shingle_hashes(word_hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of all runs of n words, in order; a shorter text is one run, an empty one none."""
    size = len(word_hashes)
    if size == 0:
        return word_hashes
    width = min(n, size)
    out = np.zeros(size - width + 1, dtype=np.uint64)
    for k in range(width):
        out = (out ^ word_hashes[k : size - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix64(out + np.uint64(width))
