"""Arrays packed into binary cells, so that a shuffle moves few rows instead of one per entry.

Buckets grow with the data while a batch of records does not, so entries that were cut
straight into their buckets would end up one to a row. Beyond RANGES buckets they go in two
steps: first to one of at most RANGES ranges of neighbouring buckets, then, some millions of
entries of a range at a time, into the buckets themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Ranges of the first step, and entries of a range that the second step cuts at a time.
RANGES, ENTRIES = 1024, 4_000_000


def pack(arrays: list[np.ndarray]) -> bytes:
    """Any arrays of plain numbers; their types and lengths are kept."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes) -> list[np.ndarray]:
    size = int.from_bytes(blob[:4], "little")
    at, found = 4 + size, []
    for part in blob[4:at].decode().split(";"):
        kind, n = part.split(",")
        dtype = np.dtype(kind)
        found.append(np.frombuffer(blob, dtype, int(n), at))
        at += int(n) * dtype.itemsize
    return found


def small(ids: np.ndarray) -> np.ndarray:
    """int64 ids as uint32 where they fit: half the bytes."""
    return ids.astype(np.uint32) if len(ids) and 0 <= ids.min() and ids.max() < 2**32 else ids


def cut(bucket: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """The entries of each bucket as one blob; only buckets with entries are visited."""
    for key, parts in parted(bucket, arrays):
        yield key, pack(parts)


def parted(bucket: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, arrays = bucket[order], [a[order] for a in arrays]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for lo, hi in zip(edge, [*edge[1:], len(bucket)], strict=True):
        yield int(bucket[lo]), [a[lo:hi] for a in arrays]


def joined(blobs: list[bytes]) -> list[np.ndarray]:
    """The columns of several blobs, one after the other."""
    parts = [unpack(b) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]))]


def width(buckets: int) -> int:
    """Neighbouring buckets of one range: 1 as long as there are no more than RANGES buckets."""
    return -(-buckets // RANGES)


def cut_wide(bucket: np.ndarray, arrays: list[np.ndarray], per: int) -> Iterator[tuple[int, bytes]]:
    """As ``cut``, by ranges of ``per`` buckets; the place within its range goes with each entry."""
    if per == 1:
        yield from cut(bucket, arrays)
    else:
        yield from cut(bucket // per, [(bucket % per).astype(np.uint32), *arrays])


def regroup(packed: DataFrame, parts: int, again: Callable, schema: str, key: str = "bucket") -> DataFrame:
    """The second step: ``again(range, columns) -> Iterator[row]`` cuts up to ENTRIES entries of a range at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row[key] != now or size >= ENTRIES):
                    yield from as_batches(again(now, joined(held)))
                    held, size = [], 0
                now = row[key]
                held.append(row["blob"])
                size += len(unpack(row["blob"])[0])
        if held:
            yield from as_batches(again(now, joined(held)))

    return packed.repartition(parts, key).sortWithinPartitions(key).mapInArrow(run, schema)


def as_batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    if rows:
        kinds = pa.schema([(name, pa.binary() if name == "blob" else pa.int64()) for name in rows[0]])
        yield pa.RecordBatch.from_pylist(rows, kinds)


def settled(packed: DataFrame, per: int, parts: int) -> DataFrame:
    """Rows (bucket, blob) of ranges as rows of buckets; a second shuffle only where ranges are wider than a bucket."""
    if per == 1:
        return packed

    def again(now: int, columns: list[np.ndarray]) -> Iterator[dict]:
        within, *rest = columns
        for bucket, blob in cut(now * per + within.astype(np.int64), rest):
            yield {"bucket": bucket, "blob": blob}

    return regroup(packed, parts, again, "bucket long, blob binary")


def by_bucket(packed: DataFrame, parts: int, work: Callable, schema: str, key: str = "bucket") -> DataFrame:
    """Hand all rows of each ``key`` to ``work(key, rows: list[dict]) -> Iterator[RecordBatch]``, one key at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row[key] != now:
                    yield from work(now, held)
                    held = []
                now = row[key]
                held.append(row)
        if held:
            yield from work(now, held)

    return packed.repartition(parts, key).sortWithinPartitions(key).mapInArrow(run, schema)
