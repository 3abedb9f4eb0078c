"""Packing by concatenate and cut: all documents as one stream of tokens, cut into windows of fixed length.

1. Each task encodes its documents once and writes the ids with their place within the task's own stream.
2. The task totals, one row per task, are summed up to the global offset at which each task's stream begins.
3. Offset and place give every document its global span. Where a multiple of the window length falls inside, the
   document is cut: each window it reaches gets a boundary record, its piece.

No text and no token is shuffled; only task totals are. The ids are kept in the shared folder, so that a repeated task finds the
numbering already fixed. All windows are full but the last, whose padding is the only one (none where its length is a power of two).

Defined cases: a missing text is empty; an empty text is the end id alone; repeated rows are packed as often as they occur; long texts span as many
windows as they need; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableward.llm import sequences as sq
from tableward.llm import tokens
from tableward.llm.ship import ship
from tableward.session import keep

#: Token ids are stored in two bytes each.
ID_TYPE = np.dtype("<u2")
_PIECE = [("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
_PIECE_DDL = "start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, ids binary"


def encoded(docs: DataFrame, id_col: str, text_col: str, ranks: str, end_id: int) -> DataFrame:
    """(part, place, n, ids, doc): each document's ids and its place in the stream of task ``part``."""
    own = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    head = [("part", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, at = sq.texts(batch.column(1))
            ids, counts = [], []
            for i in range(batch.num_rows):
                own_ids = np.append(tokens.encode(data[at[i] : at[i + 1]].tobytes().decode(), ranks), np.uint32(end_id))
                ids.append(own_ids.astype(ID_TYPE).tobytes())
                counts.append(len(own_ids))
            n = np.array(counts, np.int64)
            places = place + np.cumsum(n) - n
            place += int(n.sum())
            columns = [pa.array(np.full(len(n), part)), pa.array(places), pa.array(n), pa.array(ids, pa.binary()), batch.column(0)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*head, batch.schema.field(0)]))

    kind = own.schema["doc"].dataType.simpleString()
    return own.mapInArrow(encode, f"part long, place long, n long, ids binary, doc {kind}")


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0, ranks: str | None = None, with_ids: bool = True
) -> DataFrame:
    """The pieces of all documents: document, span within it, window, place in the window, ids and their CRC-32.

    ``ids`` holds unsigned 16-bit little-endian ids; ``ids_crc32`` is of the ids as 32-bit little-endian numbers.
    """
    ship(docs.sparkSession)
    stored = keep(encoded(docs, id_col, text_col, ranks or tokens.default_ranks(), end_id), "packing-ids")
    totals = stored.groupBy("part").agg(F.sum("n").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    # one row of two numbers per task that read the input: 16 MB for a million tasks
    placed = stored.join(F.broadcast(base), "part").select(F.col("doc"), (F.col("base") + F.col("place")).alias("at"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy(zero_copy_only=False)
            blobs = batch.column(2)
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                ids = np.frombuffer(blobs[i].as_buffer(), ID_TYPE)
                begin, end = int(at[i]), int(at[i]) + len(ids)
                for lo in [begin, *range((begin // length + 1) * length, end, length)]:
                    hi = min(end, (lo // length + 1) * length)
                    own = ids[lo - begin : hi - begin]
                    rows.append((i, lo - begin, hi - lo, len(ids), lo // length, lo % length, zlib.crc32(own.astype("<u4").tobytes()), own.tobytes() if with_ids else None))
            if rows:
                row, *columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(x, t) for x, (_, t) in zip(columns, _PIECE))], schema=pa.schema([batch.schema.field(0), *_PIECE]))

    kind = stored.schema["doc"].dataType.simpleString()
    out = placed.mapInArrow(cut, f"doc {kind}, {_PIECE_DDL}").withColumnRenamed("doc", id_col)
    return out if with_ids else out.drop("ids")
