"""Which windows of ``length`` bytes also start in a document with a smaller id: the exchange both passes of suffix dedup use.

Every window belongs to the bucket of its smallest q-gram (its anchor). A run of consecutive windows with one anchor is one record:
(anchor, hash of the run's bytes, document, first window, windows). Documents whose runs are the same bytes are settled
by that alone; of anchors with differing runs some need their bytes compared.

A q-gram is short: in a large table most of them stand in several documents by chance. A window has either half of its other bytes before its
anchor or half of them after it. So a run also carries hashes of these two longer strings (``sequences.flanks``), and its bytes are
compared only where another document has one of them at this anchor.

A document is (doc, row): ``doc``, its id, says which is smaller; ``row`` tells different texts of one id apart (``with_rows``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableward.llm import packed
from tableward.llm import sequences as sq
from tableward.llm.names import free
from tableward.session import keep

_U = np.uint64
_OPEN = ["key", "rest", "doc", "row", "start", "count", "before", "after"]
_DONE = ["doc", "row", "start", "count"]
_BLOBS = _OPEN + [f"done_{x}" for x in _DONE]
#: Bits of the hashes of flanks that are sent.
FLANK_BITS = 24
_PACKED = pa.schema([("bucket", pa.int32())] + [(x, pa.binary()) for x in _BLOBS])
_PACKED_DDL = "bucket int, " + ", ".join(f"{x} binary" for x in _BLOBS)
#: state 0: these windows repeat; 1: compare bytes with the other runs of ``anchor``; 2: so, and the anchor is common.
FOUND = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("count", pa.int64()), ("state", pa.int32()), ("anchor", pa.int64())])
_FOUND_DDL = "doc long, row long, start long, count long, state int, anchor long"


def with_rows(docs: DataFrame, doc: str = "doc", text: str = "text", row: str = "row") -> DataFrame:
    """``docs`` with ``row``: 0 where an id has one text, else the text's hash. So it depends on id and text alone and, where ids
    do not repeat, takes no room. The ids with several texts are written down; there are none in most tables."""
    if row in docs.columns:
        return docs
    hashed = F.shiftrightunsigned(F.xxhash64(text), 1)
    name = free(docs, "several")[0]
    several = docs.select(F.col(doc).alias(name), hashed.alias("hash")).groupBy(name).agg(F.min("hash").alias("least"), F.max("hash").alias("most"))
    several = keep(several.filter("least <> most").select(name), "ids-of-several-texts")
    if several.isEmpty():
        return docs.withColumn(row, F.lit(0).cast("long"))
    joined = docs.join(several, F.col(doc) == F.col(name), "left")
    return joined.withColumn(row, F.when(F.col(name).isNotNull(), hashed).otherwise(F.lit(0).cast("long"))).drop(name)


def new_keys(*columns: np.ndarray) -> np.ndarray:
    """For rows sorted by these columns: where one differs from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def first_of(new: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For rows sorted by (key, doc): the smallest document of each row's key; ``new`` tells where keys begin."""
    return doc[new][np.cumsum(new) - 1]


def _packer(buckets: int):
    def flush(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((arrays[5], arrays[3], arrays[2], arrays[1], arrays[0]))
        bucket, key, rest, doc, row, start, count, before, after = (x[order] for x in arrays)
        done = doc > first_of(new_keys(bucket, key, rest), doc)
        ends = np.searchsorted(bucket, np.arange(buckets + 1))
        out: dict[str, list] = {x: [] for x in _PACKED.names}
        for b in range(buckets):
            part = slice(ends[b], ends[b + 1])
            if ends[b] == ends[b + 1]:
                continue
            open_, shut = ~done[part], done[part]
            out["bucket"].append(b)
            out["key"].append(packed.squeeze_sorted(key[part][open_]))
            out["rest"].append(packed.squeeze(rest[part][open_]))
            for name, values in (("doc", doc), ("row", row), ("start", start), ("count", count)):
                out[name].append(packed.squeeze(values[part][open_]))
                out[f"done_{name}"].append(packed.squeeze(values[part][shut]))
            out["before"].append(packed.squeeze(before[part][open_]))
            out["after"].append(packed.squeeze(after[part][open_]))
        yield from packed.rows_of(out, _PACKED, 64)

    return flush


def _unpack(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [
        np.concatenate([(packed.unsqueeze_sorted if n == "key" else packed.unsqueeze)(x) for x in table.column(n).to_pylist()])
        for n in names
    ]


def meeting(anchor: np.ndarray, doc: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which runs share a flank with a run of another document at their anchor; runs without flanks meet all of their anchor."""
    found = np.zeros(len(anchor), bool)
    for flank in (before, after):
        there = np.flatnonzero(flank)
        both = anchor[there] << np.int64(FLANK_BITS) | flank[there]
        order = np.argsort(both)
        own, edge = doc[there][order], np.flatnonzero(new_keys(both[order]))
        if len(edge):
            several = np.minimum.reduceat(own, edge) < np.maximum.reduceat(own, edge)
            found[there[order]] |= np.repeat(several, np.diff(np.append(edge, len(own))))
    return found | np.isin(anchor, anchor[(before == 0) & (after == 0)])


def runs_of_windows(docs: DataFrame, length: int, q: int, common: int) -> DataFrame:
    """Rows (doc, row, start, count, state, anchor) for the runs of windows that repeat or may repeat.

    ``docs`` has (doc long, text, row long). Anchors with more than ``common`` differing runs to compare get state 2.
    """
    buckets = 2 * packed.bucket_count(docs)

    def records(batch: pa.RecordBatch):
        data, at = sq.texts(batch.column(1))
        ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        for i, (doc, row) in enumerate(zip(ids, rows)):
            prefix = sq.Prefix(sq.BYTE_CODES[data[at[i] : at[i + 1]]])
            anchor, start, count, place = sq.placed_segments(prefix, length, q)
            if len(start):
                before, after = sq.flanks(prefix, length, q, start, count, place, FLANK_BITS)
                content = prefix.of(start, start + count - 1 + length)
                # half of the anchor (its other half chose the bucket) and the content, 96 bits in two columns
                key = (anchor & _U(0xFFFFFFFF00000000)) | (content >> _U(32))
                yield packed.bucket_of(anchor, buckets), key, content.astype(np.uint32), np.full(len(start), doc), np.full(len(start), row), start, count, before, after

    def settle(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        own = _unpack(table, _OPEN)
        done = _unpack(table, [f"done_{x}" for x in _DONE])
        order = np.lexsort((own[3], own[2], own[1], own[0]))
        key, rest, doc, row, start, count, before, after = (x[order] for x in own)
        fresh = new_keys(key, rest)
        repeat = doc > first_of(fresh, doc)
        high = (key >> _U(32)).astype(np.int64)
        new = new_keys(high)
        edge = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        contents = np.add.reduceat(fresh.astype(np.int64), edge)
        apart = np.minimum.reduceat(doc, edge) < np.maximum.reduceat(doc, edge)
        compare = ((contents > 1) & apart)[group] & ~repeat
        at = np.flatnonzero(compare)
        compare[at] = meeting(high[at], doc[at], before[at], after[at])
        contents = np.add.reduceat((fresh & compare).astype(np.int64), edge)
        state = np.where(compare, np.where(contents[group] > common, 2, 1), 0)
        anchor = (np.int64(bucket) << np.int64(32)) | high
        keep = repeat | compare
        cols = [doc, row, start, count, state, anchor]
        cols = [x[keep] for x in cols]
        zeros = np.zeros(len(done[0]), np.int64)
        cols = [np.concatenate([x, y]) for x, y in zip(cols, [*done, zeros, zeros])]
        return pa.table([pa.array(x, f.type) for x, f in zip(cols, FOUND)], schema=FOUND)

    sent = docs.select("doc", "text", "row").mapInArrow(
        lambda batches: packed.gather(batches, records, _packer(buckets)), _PACKED_DDL
    )
    return sent.groupBy("bucket").applyInArrow(settle, _FOUND_DDL)


def marks_of(found: DataFrame) -> DataFrame:
    """One row per document: the distinct runs that repeat, as arrays bounded by the document's own length, however often the row itself is repeated."""
    return found.groupBy("doc", "row").agg(F.collect_set(F.struct("start", "count")).alias("marks"))
