"""What the corpus operators share: table access, shared scratch tables, text kernels on Arrow buffers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six; they are single bytes in UTF-8.
WORD = r"[^\x20\x09-\x0D]+"
MASK64 = (1 << 64) - 1


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Bound what Spark hands to Python at a time. The default of 10 000 rows is tens of MB of text, several copies of which live
    outside the heap of each task; a smaller bound that the session has already is kept."""
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = (spark.conf.get(key, None) or "").lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= bound:
            spark.conf.set(key, str(bound))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where there is one machine (tests), an error on a cluster without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jsc.isDefined():
        return jsc.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage at a copy that outlives its executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """df, made once, in blocks on its executors' disks. For maps of a table that need no exchange: a block that is lost is made again
    from its part of the table. Unlike `materialize` it makes no file a task in the shared folder."""
    return df.persist(StorageLevel.DISK_ONLY)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that no later plan reads."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_columns(df: DataFrame, **types: str) -> DataFrame:
    """Just these columns, cast; a missing one is null. Other columns, clashing names included, are left behind."""
    small_batches(df.sparkSession)
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


# ---------------------------------------------------------------------------------------------- Arrow text kernels


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, without a copy where Arrow allows it; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return body, at - (at[0] if len(at) else 0)


def slabs(offsets: np.ndarray, most: int = 2 << 20):
    """Ranges of documents of about that many bytes together, a longer document alone: bounds the kernels' memory."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (public-domain splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return splitmix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = seeded(256, 11)
_RADIX = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.where(_SPACE, np.uint64(0), _BYTE[_LOWER])
_PLAIN = np.where(_SPACE, np.uint64(0), _BYTE)


def powers(n: int, radix: np.uint64 = _RADIX) -> np.ndarray:
    """radix ** 0 .. n-1 modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = radix
    return np.multiply.accumulate(out)


def word_hashes(body: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of all words, and for each document where its words begin (n + 1 numbers)."""
    word = ~_SPACE[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    ends = np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), bounds
    spans = np.diff(np.append(starts, len(body)))
    place = np.arange(starts[0], len(body)) - np.repeat(starts, spans)
    longest = int((ends - starts).max())
    place = np.minimum(place, longest - 1)  # spaces weigh nothing
    value = (_VALUE if lower else _PLAIN)[body[starts[0] :]] * powers(longest)[place]
    total = np.add.reduceat(value, starts - starts[0])
    return starts, ends, splitmix(total + (ends - starts).astype(np.uint64)), bounds


_STEP = seeded(64, 29)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; len(words) - k + 1 numbers, none if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += words[i : i + n] * _STEP[i]
    return splitmix(total)


def whole_hash(words: np.ndarray) -> np.ndarray:
    """One hash of fewer words than a shingle has."""
    return splitmix(np.array([(words * _STEP[: len(words)]).sum() + np.uint64(len(words))], np.uint64))


def bag(seen: np.ndarray, n: int) -> np.ndarray:
    """First places of equal neighbours in a sorted array."""
    if not n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
