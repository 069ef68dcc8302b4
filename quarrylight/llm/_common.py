"""Shared plumbing of the training-data operators.

Texts travel through a shuffle at most once, as zstd *packs*: one binary row
holds the documents that one map task sends to one bucket.  A bucket is a hash
class of ``doc_id`` (of text and place for rows without one); its size is bounded because the number of buckets follows
the measured bytes of text.  Operators that need facts about the whole corpus
(is this window repeated? what is this n-gram's probability?) send compact
sorted *requests* from buckets to shards and get *replies* back by bucket, so
that nothing that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: doc_id of rows that have none: sorts after every real id.
NULL_ID = np.iinfo(np.int64).max
#: Raw bytes of text that one bucket is meant to hold.
BUCKET_BYTES = 4 << 20
#: Raw bytes that a packing task holds before it sends its packs on.
FLUSH_BYTES = 48 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; make a folder only where it is unset and all runs in one process (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_disk(spark: SparkSession) -> None:
    """Shuffle files and checkpoints that nothing refers to any more go when the driver collects its garbage: now, not when its heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A value that holds a thousandth of all rows, and so many rows at least, is hot: there are at most a thousand of them.
HOT_SHARE, HOT_LEAST = 1000, 1000


def join_hot(rows: DataFrame, sizes: DataFrame, on: list[str], total: int, n: str = "n") -> DataFrame:
    """rows joined with `sizes`, which has one row for each value of `on` and in `n` how many of `rows` have it.

    Values that hold many rows would each land in one task: as they are at most
    HOT_SHARE by their share, they are broadcast, and only the others shuffle.
    rows are read twice: they should be a checkpoint.
    """
    least = max(HOT_LEAST, -(-total // HOT_SHARE))
    hot = F.broadcast(sizes.where(F.col(n) >= least))
    cold = rows.join(hot.select(*on), on, "left_anti").join(sizes.where(F.col(n) < least), on)
    return cold.unionByName(rows.join(hot, on))


_compressors = {level: zstandard.ZstdCompressor(level=level) for level in (1, 3)}
_decompressor = zstandard.ZstdDecompressor()


def compress(raw: bytes, level: int = 1) -> bytes:
    return _compressors[level].compress(raw)


def decompress(blob: bytes) -> bytes:
    return _decompressor.decompress(blob) if blob else b""


def release() -> None:
    """Give memory that a task has freed back to the system: workers live on and share a machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def encode_planes(values: np.ndarray) -> bytes:
    """Fixed-width integers, little-endian byte planes apart, so that zero and skewed bytes shrink."""
    return compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()) if len(values) else b""


def decode_planes(blob: bytes, dtype: type) -> np.ndarray:
    kind = np.dtype(dtype)
    if not blob:
        return np.empty(0, kind)
    planes = np.frombuffer(decompress(blob), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def encode_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as differences in byte planes."""
    return encode_planes(np.diff(values.astype(np.uint64), prepend=np.uint64(0))) if len(values) else b""


def decode_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(decode_planes(blob, np.uint64), dtype=np.uint64)


def encode_flags(flags: np.ndarray) -> bytes:
    return np.uint32(len(flags)).tobytes() + compress(np.packbits(flags).tobytes()) if len(flags) else b""


def decode_flags(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, bool)
    n = int(np.frombuffer(blob[:4], np.uint32)[0])
    return np.unpackbits(np.frombuffer(decompress(blob[4:]), np.uint8), count=n).astype(bool)


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash class below n for each id (multiplicative mixing, the same everywhere)."""
    x = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return ((x ^ (x >> np.uint64(33))) % np.uint64(n)).astype(np.int64)


def shape_of(docs: DataFrame) -> tuple[int, int]:
    """(rows, bytes of text) of the whole table, by one scan."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def bucket_bytes(n_bytes: int) -> int:
    """Text for one bucket: more for very large tables, as every bucket writes to every shard of requests."""
    return int(BUCKET_BYTES * min(8.0, max(1.0, (n_bytes / 40e9) ** 0.5)))


def bucket_count(spark: SparkSession, n_bytes: int, times: int = 1) -> int:
    """Buckets of about `times` as much text as usual, at least some for each shuffle partition."""
    return max(4 // times * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // (times * bucket_bytes(n_bytes))))


def shard_count(n_bytes: int) -> int:
    """Shards of requests: by the text alone, so that finer buckets don't multiply the pieces."""
    return max(1, -(-n_bytes // bucket_bytes(n_bytes)))


def _ids_and_texts(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes | None]]:
    ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    return ids, batch.column(1).cast(pa.large_binary()).to_pylist()


def pack_docs(docs: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, pack): documents as zstd packs, at most one text shuffle away from their bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = sorted(held)
            for at in range(0, len(keys), 64):
                part = keys[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([_pack(held.pop(k)) for k in part], pa.binary())], ["bucket", "pack"])

        for batch in batches:
            ids, texts = _ids_and_texts(batch)
            deal = ids
            if (null := np.flatnonzero(ids == NULL_ID)).size:  # rows without an id may be many: they are dealt by their text and place
                deal = ids.copy()
                deal[null] = [zlib.crc32(texts[k] or b"") + (k % 256 << 32) for k in null.tolist()]
            for k, i, t in zip(bucket_of(deal, n_buckets).tolist(), ids.tolist(), texts):
                held.setdefault(k, []).append((i, t))
                size += len(t or b"") + 64
            if size >= FLUSH_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "bucket long, pack binary")


def _pack(rows: list[tuple[int, bytes | None]]) -> bytes:
    ids = np.array([i for i, _ in rows], np.int64)
    sizes = np.array([-1 if t is None else len(t) for _, t in rows], np.int64)
    return compress(np.int64(len(rows)).tobytes() + ids.tobytes() + sizes.tobytes() + b"".join(t or b"" for _, t in rows), 3)


def unpack(packs: pa.ChunkedArray) -> tuple[np.ndarray, list[bytes | None]]:
    """ids and texts of a bucket, in an order that doesn't depend on how its packs arrived."""
    ids: list[int] = []
    texts: list[bytes | None] = []
    for pack in packs.to_pylist():
        raw = decompress(pack)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids += np.frombuffer(raw, np.int64, n, 8).tolist()
        at = 8 + 16 * n
        for size in np.frombuffer(raw, np.int64, n, 8 + 8 * n).tolist():
            texts.append(None if size < 0 else raw[at : at + size])
            at += max(size, 0)
    order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k] is not None, texts[k] or b""))
    return np.array([ids[k] for k in order], np.int64), [texts[k] for k in order]


def whole_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns (longs) of batches that are sorted by the first one, cut so that no value of it is in two pieces."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        if not len(now[0]):
            continue
        if held and held[0][0][-1] != now[0][-1] or not held and now[0][0] != now[0][-1]:
            last = int(np.searchsorted(now[0], now[0][-1]))
            yield [np.concatenate(parts) for parts in zip(*held, [x[:last] for x in now])]
            held, now = [], [x[last:] for x in now]
        held.append(now)
    if held:
        yield [np.concatenate(parts) for parts in zip(*held)]


def text_key() -> F.Column:
    """Tells rows with one doc_id apart by their text; the same as `xxhash_of` in Python."""
    return F.xxhash64(F.col("text").cast("string"))


def xxhash_of(text: bytes | None) -> int:
    """Spark's xxhash64 of a string column."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


def id_column(ids: np.ndarray | list[int]) -> pa.Array:
    """doc_id for output: the stand-in of null ids is null again."""
    x = np.asarray(ids, np.int64)
    return pa.array(x, pa.int64(), mask=x == NULL_ID)


def cut(sorted_values: np.ndarray, bits: int, n: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of ascending uint64 values below 2**bits, cut into n ranges."""
    if not len(sorted_values):
        return []
    part = part_of(sorted_values, bits, n)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return list(zip(part[starts].tolist(), starts.tolist(), np.r_[starts[1:], len(part)].tolist()))


def part_of(values: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The range, of n, that holds each value below 2**bits."""
    top = values >> np.uint64(max(0, bits - 32))
    return (top * np.uint64(n)) >> np.uint64(min(bits, 32))
