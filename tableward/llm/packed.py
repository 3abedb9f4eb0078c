"""Rows of small numbers, packed by bucket so that tens of millions of them shuffle as a few thousand.

Each task sorts its records by (bucket, key), settles locally what it can, and sends one compressed row per bucket and
flush. A key that is very common therefore reaches its bucket once per flush, not once per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Records a task gathers before it packs them; bounds memory (about 60 MB), not what is sent.
FLUSH = 800_000


def squeeze(values: np.ndarray) -> bytes:
    """Type, least value and differences from it in as few bytes as they need, first bytes of all before second ones, compressed."""
    low = values.min() if len(values) else values.dtype.type(0)
    rest = values - low
    rest = rest.astype(np.min_scalar_type(rest.max() if len(rest) else 0))
    head = np.array([low]).astype(values.dtype).tobytes()
    planes = np.ascontiguousarray(rest).view(np.uint8).reshape(len(rest), rest.itemsize).T
    body = zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
    return values.dtype.char.encode() + rest.dtype.char.encode() + head + body


def unsqueeze(blob: bytes) -> np.ndarray:
    kind, small = np.dtype(blob[:1].decode()), np.dtype(blob[1:2].decode())
    low = np.frombuffer(blob[2 : 2 + kind.itemsize], kind)[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[2 + kind.itemsize :]), np.uint8)
    rest = np.ascontiguousarray(planes.reshape(small.itemsize, -1).T).view(small)[:, 0]
    return rest.astype(kind) + low


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """As ``squeeze`` for ascending keys: steps take fewer bytes than keys."""
    return squeeze(np.diff(keys, prepend=keys.dtype.type(0)))


def unsqueeze_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(blob), dtype=np.uint64)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the low half of the hash, so that the high half still tells keys of a bucket apart."""
    return (((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def gather(
    batches: Iterator[pa.RecordBatch],
    records: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]],
    flush: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]],
) -> Iterator[pa.RecordBatch]:
    """Collects the arrays that ``records`` makes of each document and hands them to ``flush`` some millions at a time."""
    parts: list[tuple[np.ndarray, ...]] = []
    n = 0
    for batch in batches:
        for part in records(batch):
            parts.append(part)
            n += len(part[0])
            if n >= FLUSH:
                yield from flush([np.concatenate(x) for x in zip(*parts)])
                parts, n = [], 0
    if parts:
        yield from flush([np.concatenate(x) for x in zip(*parts)])


def bucket_count(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def rows_of(columns: dict[str, np.ndarray | list], schema: pa.Schema, size: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size."""
    table = pa.table({name: pa.array(columns[name], schema.field(name).type) for name in schema.names}, schema=schema)
    yield from table.to_batches(max_chunksize=size)
