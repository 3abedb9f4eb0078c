"""Substring dedup on a compacted de Bruijn graph of word k-mers.

A word is removed if a window of ``length`` consecutive words covers it whose word sequence also starts in a document with a smaller
id. Windows never cross documents and are judged on the input.

1. Edges. A window (a ``length``-mer) is an edge between the (``length`` - 1)-mers at its ends. Consecutive windows with the same smallest k-gram
   (their anchor) are one edge, as in minimizer-bucketed graph construction. Edges whose anchor occurs in one document only cannot repeat.
2. Where an anchor has differing contents, the first document of each content is expanded to single windows, so that partial overlaps are found.
3. Compaction. Degrees come from grouping edges by their end nodes. Joined back, they tell the nodes with one edge in and one out; edges
   that follow each other over such a node, first seen in the same document, form one path (unitig).
4. Coordinates. Each later occurrence of an edge lies at a place of a path. Occurrences of one document on one path and diagonal are one
   span if they verify: the windows found must fill the span without a gap, otherwise each stands for itself.

Counts per edge are aggregated before they move; joins of occurrences can be split by adaptive execution where an edge is very common.
Nothing gathers the occurrences of an edge; what is gathered belongs to one document.

Defined cases: a missing or empty text has no words; texts shorter than ``length`` words lose nothing; repeated rows (same id and text) get
equal results, rows with one id and different texts each their own; a missing id counts as the smallest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableward.llm import repeated_windows as rw
from tableward.llm import sequences as sq
from tableward.llm.ship import ship
from tableward.llm.suffix_dedup import NULL_ID, marked
from tableward.session import keep

_EDGE = pa.schema([("anchor", pa.int64()), ("edge", pa.int64()), ("u", pa.int32()), ("v", pa.int32()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("count", pa.int32())])
_EDGE_DDL = "anchor long, edge long, u int, v int, doc long, row long, start int, count int"


def _node(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _edges(prefix: sq.Prefix, anchor: np.ndarray, doc: int, row: int, start: np.ndarray, count: np.ndarray, length: int):
    end = start + count - 1 + length
    return (
        anchor.view(np.int64), prefix.of(start, end).view(np.int64), _node(prefix.of(start, start + length - 1)),
        _node(prefix.of(end - length + 1, end)), np.full(len(start), doc), np.full(len(start), row), start.astype(np.int32), count.astype(np.int32),
    )


def _batches(parts: list) -> Iterator[pa.RecordBatch]:
    if parts:
        columns = [np.concatenate(x) for x in zip(*parts)]
        yield from pa.table([pa.array(x, f.type) for x, f in zip(columns, _EDGE)], schema=_EDGE).to_batches(max_chunksize=100_000)


def edges_of(docs: DataFrame, length: int, k: int) -> DataFrame:
    """One row per run of windows with the same anchor. ``docs`` has (doc long, text, row long)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = sq.texts(batch.column(1))
            parts = []
            ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            for i, (doc, row) in enumerate(zip(ids, rows)):
                prefix = sq.Prefix(sq.word_codes(data[at[i] : at[i + 1]]))
                anchor, start, count = sq.segments(prefix, length, k)
                if len(start):
                    parts.append(_edges(prefix, anchor, doc, row, start, count, length))
            yield from _batches(parts)

    return docs.select("doc", "text", "row").mapInArrow(cut, _EDGE_DDL)


def single_windows(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The runs in ``asked`` (doc, row, anchor, start, count) as edges of one window each."""
    lists = asked.groupBy("doc", "row").agg(F.collect_set(F.struct("start", "count", "anchor")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = sq.texts(batch.column(1))
            runs = batch.column(2).flatten()
            ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            start, count, anchor = (runs.field(n).to_numpy() for n in ("start", "count", "anchor"))
            parts = []
            ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 3))
            for i, (doc, row) in enumerate(zip(ids, rows)):
                own = slice(ends[i], ends[i + 1])
                prefix = sq.Prefix(sq.word_codes(data[at[i] : at[i + 1]]))
                n = count[own].astype(np.int64)
                first = np.repeat(start[own].astype(np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                parts.append(_edges(prefix, np.repeat(anchor[own], n).view(np.uint64), doc, row, first, np.ones(len(first), np.int64), length))
            yield from _batches(parts)

    return docs.join(lists, ["doc", "row"]).select("doc", "text", "asked", "row").mapInArrow(cut, _EDGE_DDL)


def occurrences(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Edges that occur in several documents: every occurrence with the first document that has the edge and its place there."""
    edges = edges_of(docs, length, k)
    shared = edges.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("anchor")
    near = keep(edges.join(shared, "anchor"), "debruijn-edges")
    firsts = near.groupBy("anchor", "edge").agg(F.min(F.struct("doc", "start")).alias("origin"))
    mixed = near.groupBy("anchor").agg(F.min("edge").alias("a"), F.max("edge").alias("b")).filter("a <> b").select("anchor")
    asked = near.join(firsts, ["anchor", "edge"]).filter("doc = origin.doc").join(mixed, "anchor").select("doc", "row", "anchor", "start", "count")
    # a run of one window is its own expansion and is already among the edges
    single = single_windows(docs, asked.filter("count > 1"), length)
    every = keep(near.unionByName(single), "debruijn-all")
    repeated = (
        every.groupBy("anchor", "edge")
        .agg(F.min(F.struct("doc", "row", "start")).alias("origin"), F.max("doc").alias("last"))
        .filter("origin.doc < last")
        .select("anchor", "edge", F.col("origin.doc").alias("first"), F.col("origin.row").alias("first_row"), F.col("origin.start").alias("place"))
    )
    return keep(every.join(repeated, ["anchor", "edge"]), "debruijn-repeated")


def paths(repeated: DataFrame) -> DataFrame:
    """(anchor, edge, first, first_row, place, path): each repeated edge and the start, in its first document, of the path it lies on."""
    edges = repeated.filter("doc = first AND row = first_row AND start = place").dropDuplicates(["anchor", "edge"])
    leaving = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n_out"))
    entering = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n_in"))
    through = leaving.join(entering, leaving.u == entering.v).filter("n_out = 1 AND n_in = 1").select("u", F.lit(True).alias("smooth"))
    by_place = Window.partitionBy("first", "first_row").orderBy("place", "count", "edge")
    joined = edges.join(through, "u", "left").withColumn("before", F.lag(F.col("place") + F.col("count")).over(by_place))
    begins = ~(F.coalesce(F.col("smooth"), F.lit(False)) & (F.coalesce(F.col("before"), F.lit(-1)) == F.col("place")))
    path = F.max(F.when(begins, F.col("place"))).over(by_place.rowsBetween(Window.unboundedPreceding, 0))
    return joined.select("anchor", "edge", "first", "first_row", "place", path.alias("path"))


def spans(docs: DataFrame, length: int = 50, k: int = 12) -> DataFrame:
    """(doc, row, marks): per document the verified spans of windows that also start in an earlier one."""
    repeated = occurrences(rw.with_rows(docs), length, k)
    later = repeated.filter("doc > first").select("anchor", "edge", "doc", "row", "start", "count")
    placed = later.join(paths(repeated), ["anchor", "edge"])
    merged = placed.groupBy("doc", "row", "first", "first_row", "path", (F.col("start") - F.col("place")).alias("diagonal")).agg(
        F.min("start").alias("begin"), F.max(F.col("start") + F.col("count")).alias("end"), F.collect_set(F.struct("start", "count")).alias("own")
    )
    one = F.array(F.struct(F.col("begin").alias("start"), (F.col("end") - F.col("begin")).alias("count")))
    filled = F.aggregate("own", F.lit(0), lambda n, x: n + x["count"]) == F.col("end") - F.col("begin")
    verified = merged.select("doc", "row", F.explode(F.when(filled, one).otherwise(F.col("own"))).alias("span"))
    return verified.groupBy("doc", "row").agg(F.collect_list("span").alias("marks"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text_col).alias("text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, k: int = 12, with_text: bool = True) -> DataFrame:
    """Per document: its id, n_words, n_removed, the SHA-256 of the kept words joined by spaces, and that text itself."""
    ship(docs.sparkSession)
    own = rw.with_rows(_keyed(docs, id_col, text_col))
    marks = spans(own, length, k)
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, start, count in marked(batch, 1, 2):
                words = text.tobytes().split()
                mask = sq.covered(len(words), start.astype(np.int64), count.astype(np.int64), length)
                kept = b" ".join(w for w, gone in zip(words, mask) if not gone)
                rows.append((len(words), int(mask.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(columns, list(schema)[1:]))], schema=schema)

    out = own.join(marks, ["doc", "row"], "left").select("doc", "text", "marks").mapInArrow(cut, "doc long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    out = out.withColumn("doc", F.when(F.col("doc") != NULL_ID, F.col("doc"))).withColumnRenamed("doc", id_col)
    return out if with_text else out.drop("kept_text")
