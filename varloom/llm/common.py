"""Shared helpers: scratch tables, size-checked joins, byte-level text arrays and bucketed array exchange.

Arrays that are too many to be rows travel as *blobs*: a map task sorts what it has by bucket and sends one
row of binary columns per bucket, so Spark still partitions, shuffles and retries the work, while sorting and
counting run on numpy arrays. A reducer sees one bucket at a time and needs memory for one bucket only.
"""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: Text bytes handled at once inside a task.
CHUNK_BYTES = 4 << 20
#: Ids that may be broadcast (8 bytes each) after they have been counted; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Buckets per shuffle partition: a reducer works through its partition in so many steps.
BUCKETS_PER_PARTITION = 4
#: Bytes of arrays that a reducer holds before it sends them on.
HELD_BYTES = 48 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared folder of ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is missing and everything runs in one process, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/varloom-{uuid.uuid4().hex}"


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and a lost executor costs one stage."""
    path = scratch_folder(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_ids(df: DataFrame, ids: DataFrame, *keys: str, how: str = "left_semi") -> DataFrame:
    """Rows whose key is (with how="left_anti": is not) among distinct ids.

    By broadcast where counting the ids shows that they fit, else by a shuffled join.
    """
    small = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), list(keys), how)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give the system the memory that is free: Python workers live on from task to task and would keep each stage's most."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most `limit` bytes of text (one row at least); after the last one the task's free memory is released."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and where each row starts; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


#: Random 64-bit value of each byte, the same in every task; A-Z map to the values of a-z in the lowered table.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
LOWERED_VALUES = BYTE_VALUES[LOWERED]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, inverse)
        ]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, starts: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word `[^\\x20\\x09-\\x0D]+` of all rows in order, and the words of each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts) - 1, np.int64)
    inside = ~IS_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[starts[:-1][starts[:-1] < n]] = False
    first = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    last = starts[1:][np.diff(starts) > 0] - 1
    after[last] = False
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((LOWERED_VALUES if lower else BYTE_VALUES)[data] * power[:n], out=total[1:])
    return mix((total[end] - total[first]) * inverse[first]), np.diff(np.searchsorted(first, starts))


def row_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def deal(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket present: its number and each column's values of that bucket as bytes, in given order."""
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    cut = np.flatnonzero(np.diff(sorted_bucket)) + 1
    edges = np.concatenate([[0], cut, [len(order)]]) if len(order) else np.zeros(1, np.int64)
    arrays = [pa.array(sorted_bucket[edges[:-1]].astype(np.int32))]
    for values in columns.values():
        raw = values[order]
        offsets = pa.py_buffer((edges * raw.itemsize).astype(np.int32))
        arrays.append(pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, offsets, pa.py_buffer(raw.tobytes())]))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *columns])


def together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Batches of deal() as one: a row per bucket present, its bytes in the order of the batches."""
    if len(batches) == 1:
        return batches[0]
    table = pa.Table.from_batches(batches).combine_chunks()
    bucket = table.column("bucket").to_numpy()
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
    edges = np.concatenate([first, [len(order)]])
    arrays = [pa.array(bucket[order[first]])]
    for name in table.column_names[1:]:
        _, offsets, data = pa.concat_arrays(table.column(name).chunks).take(pa.array(order)).buffers()
        cut = pa.py_buffer(np.frombuffer(offsets, np.int32)[edges])
        arrays.append(pa.Array.from_buffers(pa.binary(), len(first), [None, cut, data]))
    return pa.RecordBatch.from_arrays(arrays, names=table.column_names)


class Dealer:
    """Gathers what a reducer makes of its buckets, so that a task sends about one row per bucket and not one per pair of buckets."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, dict[str, np.ndarray]]] = []
        self.size = 0

    def add(self, bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            self.held.append((bucket, columns))
            self.size += bucket.nbytes + sum(c.nbytes for c in columns.values())
        if self.size >= HELD_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            names = list(self.held[0][1])
            yield deal(np.concatenate([b for b, _ in self.held]), {c: np.concatenate([x[c] for _, x in self.held]) for c in names})
        self.held, self.size = [], 0


def blob_schema(*columns: str) -> str:
    return ", ".join(["bucket int", *(f"{c} binary" for c in columns)])


def by_bucket(df: DataFrame, *then: str) -> DataFrame:
    """Bring the blobs of a bucket together; each partition holds as many buckets, one after the other (rows of one by ``then``)."""
    n = shuffle_partitions(df.sparkSession)
    return df.repartitionById(n, F.pmod(F.col("bucket"), F.lit(n))).sortWithinPartitions("bucket", *then)


def buckets(batches: Iterable[pa.RecordBatch], dtypes: dict[str, type]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Each bucket of a partition with its columns put together again; after the last one the task's free memory is released."""
    now, parts = None, {c: [] for c in dtypes}

    def joined() -> dict[str, np.ndarray]:
        return {c: np.frombuffer(b"".join(parts[c]), t) for c, t in dtypes.items()}

    for batch in batches:
        rows = [batch.column(c).to_pylist() for c in ("bucket", *dtypes)]
        for bucket, *values in zip(*rows, strict=True):
            if bucket != now and now is not None:
                yield now, joined()
                parts = {c: [] for c in dtypes}
            now = bucket
            for c, v in zip(dtypes, values, strict=True):
                parts[c].append(v)
    if now is not None:
        yield now, joined()
    parts.clear()
    release()
