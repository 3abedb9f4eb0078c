"""Suffix-array dedup by bucket-pointer refinement: bytes that repeat an earlier document.

A byte is removed if it lies in a string of ``length`` bytes that also starts in a document with a smaller id. Matches never cross
documents, and strings are judged on the input.

1. Initial buckets. The suffixes (windows) are bucketed by their smallest q-gram. Buckets with one document are settled. Where the whole run
   of windows around it has the same bytes in an earlier document, it is settled too.
2. Refinement. The remaining suffixes are sorted into buckets by their first 8 bytes; a bucket at depth d is split by the
   bucket identifier of the suffix d bytes later, which is at depth d as well, so each round doubles the depth. The new identifiers
   serve the next round, until ``length`` bytes are compared. Suffixes alone in their bucket leave early. This compares bytes, not hashes.
3. Anchors with over ``common`` differing runs (some MB) are spread: each of their windows goes by its own full content, aggregated before it moves.

Defined cases: a missing text is empty and has no spans; texts shorter than ``length`` lose nothing; repeated rows (same id and text) get equal
results, rows with one id and different texts each their own; a missing id counts as the smallest; further columns are carried through by ``remove_repeats``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableward.llm import packed
from tableward.llm import repeated_windows as rw
from tableward.llm import sequences as sq
from tableward.llm.names import free
from tableward.llm.ship import ship
from tableward.session import keep

NULL_ID = -(2**62)
_SEGMENT = pa.schema([("route", pa.int32()), ("anchor", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("bytes", pa.binary())])
_SEGMENT_DDL = "route int, anchor long, doc long, row long, start long, windows int, bytes binary"
_RUN = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("count", pa.int64())])
_RUN_DDL = "doc long, row long, start long, count long"


def refine(data: np.ndarray, first: np.ndarray, length: int, group: np.ndarray | None = None) -> np.ndarray:
    """Bucket identifiers of the suffixes at ``first``: equal exactly where ``length`` bytes (and ``group``) are equal; -1: alone.

    ``data`` must reach ``length`` bytes beyond each suffix.
    """
    steps, depth = [], min(8, length)
    while depth < length:
        steps.append((depth, min(depth, length - depth)))
        depth += steps[-1][1]
    # the places, relative to a suffix, whose identifiers each round needs
    offsets = [{0}]
    for _, step in reversed(steps):
        offsets.insert(0, offsets[0] | {o + step for o in offsets[0]})
    base = np.zeros(len(first), np.int64) if group is None else np.unique(group, return_inverse=True)[1]
    alive = np.arange(len(first))
    ids = np.zeros(len(data), np.int64)

    def places(needed: set[int]) -> np.ndarray:
        wanted = np.zeros(len(data), bool)
        for o in needed:
            wanted[first[alive] + o] = True
        return np.flatnonzero(wanted)

    def shared() -> np.ndarray:
        """Of the suffixes alive those that still share their bucket with another."""
        pair = base[alive] * (ids.max(initial=0) + 1) + ids[first[alive]]
        _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
        return alive[count[inverse] > 1]

    at = places(offsets[0])
    code = np.zeros(len(at), np.uint64)
    for k in range(min(8, length)):
        code = (code << np.uint64(8)) | data[at + k]
    ids[at] = np.unique(code, return_inverse=True)[1]
    alive = shared()
    for (_, step), needed in zip(steps, offsets[1:]):
        at = places(needed)
        pair = ids[at] * (ids.max(initial=0) + 1) + ids[at + step]
        ids = np.zeros(len(data), np.int64)
        ids[at] = np.unique(pair, return_inverse=True)[1]
        alive = shared()
    out = np.full(len(first), -1, np.int64)
    out[alive] = base[alive] * (ids.max(initial=0) + 1) + ids[first[alive]]
    return out


def _compared(table: pa.Table, length: int) -> pa.Table:
    """Of the windows of a bucket those that an earlier document has too."""
    doc, own, start, windows, anchor = (table.column(n).to_numpy() for n in ("doc", "row", "start", "windows", "anchor"))
    data, at = sq.texts_binary(table.column("bytes"))
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    row = np.repeat(np.arange(len(doc)), windows)
    bucket = refine(data, at[:-1][row] + offset, length, anchor[row])
    live = np.flatnonzero(bucket >= 0)
    order = live[np.lexsort((doc[row[live]], bucket[live]))]
    hit = order[doc[row[order]] > rw.first_of(rw.new_keys(bucket[order]), doc[row[order]])] if len(order) else order
    d, w, s = doc[row[hit]], own[row[hit]], start[row[hit]] + offset[hit]
    order = np.lexsort((s, w, d))
    d, w, s = d[order], w[order], s[order]
    once = rw.new_keys(d, w, s)  # rows that are repeated have the same windows
    d, w, s = d[once], w[once], s[once]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1]) | (s[1:] != s[:-1] + 1)])) if len(d) else np.zeros(0, np.int64)
    return pa.table([pa.array(x, pa.int64()) for x in (d[new], w[new], s[new], np.diff(np.append(new, len(d))))], schema=_RUN)


def repeated_runs(docs: DataFrame, length: int = 50, q: int = 16, common: int = 50_000) -> DataFrame:
    """(doc, row, start, count): windows ``start .. start + count - 1`` of document ``doc`` also start in an earlier one.

    ``docs`` has (doc long, text) and may have ``row``.
    """
    ship(docs.sparkSession)
    docs = rw.with_rows(docs)
    found = keep(rw.runs_of_windows(docs, length, q, common), "suffix-buckets")
    routes = 2 * packed.bucket_count(docs)
    asked = (
        found.filter("state > 0")
        .groupBy("doc", "row")
        .agg(F.collect_set(F.struct("start", "count", "state", "anchor")).alias("asked"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = sq.texts(batch.column(1))
            lists = batch.column(2)
            rows, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            start, count, state, anchor = (rows.field(n).to_numpy() for n in ("start", "count", "state", "anchor"))
            doc, row = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False), np.diff(ends)) for k in (0, 3))
            begin = np.repeat(at[:-1], np.diff(ends)) + start
            plain = state == 1
            route = (anchor[plain] % routes).astype(np.int32)
            end = begin + count - 1 + length
            out = [pa.array([data[x:y].tobytes() for x, y in zip(begin[plain], end[plain])], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(anchor[plain]), pa.array(doc[plain]), pa.array(row[plain]), pa.array(start[plain]), pa.array(count[plain].astype(np.int32)), *out], schema=_SEGMENT)
            each = np.repeat(np.flatnonzero(~plain), count[~plain])
            if len(each):  # a window by itself, told by route -1
                shift = np.arange(len(each)) - np.repeat(np.cumsum(count[~plain]) - count[~plain], count[~plain])
                x = begin[each] + shift
                out = pa.array([data[i : i + length].tobytes() for i in x], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), -1, np.int32)), pa.array(anchor[each]), pa.array(doc[each]), pa.array(row[each]), pa.array(start[each] + shift), pa.array(np.ones(len(each), np.int32)), out], schema=_SEGMENT)

    pieces = keep(docs.join(asked, ["doc", "row"]).select("doc", "text", "asked", "row").mapInArrow(cut, _SEGMENT_DDL), "suffix-pieces")
    compared = (
        pieces.filter("route >= 0").groupBy("route").applyInArrow(lambda t: _compared(t, length), _RUN_DDL)
    )
    apart = pieces.filter("route < 0")
    least = apart.groupBy("bytes").agg(F.min("doc").alias("least"))
    spread = apart.join(least, "bytes").filter("doc > least").select("doc", "row", "start", F.lit(1).cast("long").alias("count"))
    same = found.filter("state = 0").select("doc", "row", "start", "count")
    return same.unionByName(compared).unionByName(spread)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text_col).alias("text"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Per document: its id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    keyed = rw.with_rows(_keyed(docs, id_col, text_col))
    marks = rw.marks_of(repeated_runs(keyed, length))
    schema = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, start, count in marked(batch, 1, 2):
                mask = sq.covered(len(text), start, count, length)
                rows.append((len(text), int(mask.sum()), len(sq.runs(mask)[0]), hashlib.sha256(text[~mask].tobytes()).hexdigest()))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(cols, list(schema)[1:]))], schema=schema)

    out = keyed.join(marks, ["doc", "row"], "left").select("doc", "text", "marks").mapInArrow(judge, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc", F.when(F.col("doc") != NULL_ID, F.col("doc"))).withColumnRenamed("doc", id_col)


def marked(batch: pa.RecordBatch, text: int, marks: int):
    """(bytes, starts, counts) of each row of a batch with a text and a list of runs."""
    data, at = sq.texts(batch.column(text))
    lists = batch.column(marks)
    rows = lists.flatten()
    start, count = rows.field("start").to_numpy(zero_copy_only=False), rows.field("count").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
    for i in range(batch.num_rows):
        part = slice(ends[i], ends[i + 1])
        yield data[at[i] : at[i + 1]], start[part], count[part]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """The documents with the repeated bytes cut out of ``text_col``; a missing text stays missing.

    A span that begins or ends inside a character is narrowed to whole characters, so texts stay valid.
    """
    doc, row, of_doc, of_row, marks_name = free(docs, "doc", "row", "of_doc", "of_row", "marks")
    named = rw.with_rows(docs.withColumn(doc, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))), doc, text_col, row)
    keyed = named.select(F.col(doc).alias("doc"), F.col(text_col).alias("text"), F.col(row).alias("row"))
    marks = rw.marks_of(repeated_runs(keyed, length)).withColumnsRenamed({"doc": of_doc, "row": of_row, "marks": marks_name})
    schema = docs.schema
    place = docs.columns.index(text_col)
    joined = named.join(marks, (F.col(doc) == F.col(of_doc)) & (F.col(row) == F.col(of_row)), "left").drop(doc, row, of_doc, of_row)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, start, count in marked(batch, place, batch.num_columns - 1):
                mask = sq.covered(len(text), start, count, length)
                out.append(text[~whole_characters(text, mask)].tobytes().decode())
            column = batch.column(place)
            cut_text = pc.if_else(column.is_valid(), pa.array(out, pa.string()), pa.scalar(None, pa.string()))
            columns = [cut_text.cast(column.type) if k == place else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))

    return joined.mapInArrow(cut, schema)


def whole_characters(text: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """``mask`` without the characters of which it holds only some bytes."""
    if not len(text):
        return mask
    lead = (text & 0xC0) != 0x80
    lead[0] = True
    begin = np.flatnonzero(lead)
    full = np.minimum.reduceat(mask, begin)
    return full[np.cumsum(lead) - 1]
