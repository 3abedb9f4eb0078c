"""Hard negatives for contrastive training, by a secondary sort of scored pairs.

Anchors are the rows whose id is divisible by ``EVERY``. A row's score is the inner product with the anchor, over components floor(256 x); higher
scores come first, ties by smaller id. An anchor's positives are its first ``FIRST`` other rows of its label. For each of them the first ``FIRST`` rows of
other labels count whose score is at most the positive's and at least 80 % of it.

1. Blocks. Vectors become whole numbers, packed a few thousand a row, sorted by label and id. Anchors (a stated query set) meet all rows block by block:
   the row blocks are dealt into groups, each anchor block goes once to each group, and a task scores them by matrix products.
2. Before the shuffle, a task keeps of each anchor only what can still be among the first ``FIRST``: its best rows of the same label, and, once
   the positives of all tasks are known, the best rows of other labels in each positive's window. Both are exact.
3. Secondary sort. Each pair left is a binary key (anchor, score descending, id). Rows are partitioned by anchor and sorted by key within partitions
   (``repartition`` and ``sortWithinPartitions``, the form of repartitionAndSortWithinPartitions that sorts and spills in the JVM).
4. Stream. One iterator reads each partition. It keeps the anchor's open windows and the negatives tied at the present score, at most
   ``FIRST`` of either, so no anchor is held in memory. A positive opens a window, which takes tied negatives that came before it; each later negative
   goes into all windows that are open and not full.

A negative score of a positive leaves its window empty (80 % of it is above it).

Defined cases: rows without an id, label or vector, or with a missing or non-finite component, take no part. Vectors whose components are so large that
scores would not fit 64 bits (squared norm of the scaled vector from 2^62) take no part either. Vectors of different lengths aren't scored. Repeated rows
count as often as they occur; rows of the anchor's own id aren't its partners. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableward.llm import packed
from tableward.llm.batches import text_batches
from tableward.llm.ship import ship
from tableward.session import keep

EVERY = 100
FIRST = 5
#: Whole-number scaling of components.
SCALE = 256
#: Vectors in a block; anchors scored at once in it.
BLOCK = 4096
_SLICE = 256
#: Anchor blocks a task keeps open before it hands on what it has.
_OPEN = 16
_BLOCK = pa.schema([("block", pa.int64()), ("size", pa.int64())] + [(c, pa.binary()) for c in ("id", "label", "vector")])
_BLOCK_DDL = "block long, size long, id binary, label binary, vector binary"
#: A block's number is its task's, shifted, and its place there. A row's number is its block's times its width and its place there.
_TASK = 28
_PAIR = pa.schema([("key", pa.binary()), ("anchor_id", pa.int64()), ("positive", pa.bool_())])
_PAIR_DDL = "key binary, anchor_id long, positive boolean"
_OUT = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])
_OUT_DDL = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_SIGN = np.uint64(1 << 63)


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, vector of whole numbers) of the rows that take part, with the labels of every seventh id moved on by one."""
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    own = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(finite)
    # floor of a double stays a double, so large components don't wrap
    scaled = F.transform("x", lambda c: F.rint(SCALE * c) - F.when(F.rint(SCALE * c) > SCALE * c, 1.0).otherwise(0.0))
    # floor ends at the largest long, whose square the norm rules out
    own = own.select("id", moved.alias("label"), F.transform("x", lambda c: F.floor(SCALE * c)).alias("vector"))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return own.filter(norm < 2.0**62)


def _small(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    values = values.astype(np.int64)
    return values.astype(np.result_type(*(np.min_scalar_type(v) for v in (values.min(initial=0), values.max(initial=0), -1))))


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """Rows (block, size, id, label, vector): vectors of one length, packed, by label and id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        told, waiting = TaskContext.get().partitionId() << _TASK, {}

        def block(size: int) -> pa.RecordBatch:
            nonlocal told
            full = sorted(waiting.pop(size), key=lambda r: (r[1], r[0]))
            x = _small(np.array([r[2] for r in full]).reshape(len(full), size))
            numbers = [packed.squeeze(np.array([r[k] for r in full], np.int64)) for k in (0, 1)]
            values = [told, size, *numbers, x.dtype.char.encode() + x.tobytes()]
            told += 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            ids, labels, vector = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            offsets, flat = vector.offsets.to_numpy(), vector.values.to_numpy(zero_copy_only=False)
            for i, row in enumerate(zip(ids, labels)):
                x = flat[offsets[i] : offsets[i + 1]]
                waiting.setdefault(len(x), []).append((*row, x.copy()))
                if len(waiting[len(x)]) == width:
                    yield block(len(x))
            if sum(map(len, waiting.values())) > 4 * width:  # many lengths: smaller blocks, bounded memory
                for size in list(waiting):
                    yield block(size)
        for size in list(waiting):
            yield block(size)

    return rows.select("id", "label", "vector").mapInArrow(pack, _BLOCK_DDL)


class Block:
    """An unpacked block."""

    def __init__(self, width: int, number: int, size: int, ids: bytes, labels: bytes, vector: bytes):
        self.id, self.label = packed.unsqueeze(ids), packed.unsqueeze(labels)
        self.no = number * width + np.arange(len(self.id))
        self.x = np.frombuffer(vector, np.dtype(vector[:1].decode()), offset=1).reshape(len(self.id), size).astype(np.int64)
        self.f = self.x.astype(float)
        self.norm = float((self.f**2).sum(1).max(initial=0)) ** 0.5


def scores(a: Block, mine: np.ndarray, b: Block, theirs: np.ndarray | slice) -> np.ndarray:
    """Inner products of some anchors with some rows; through doubles where those are exact."""
    if a.norm * b.norm * 1.01 < 2**53:
        return (a.f[mine] @ b.f[theirs].T).astype(np.int64)
    return a.x[mine] @ b.x[theirs].T


def first_of(anchor: np.ndarray, window: np.ndarray, score: np.ndarray, ids: np.ndarray, no: np.ndarray, first: int) -> np.ndarray:
    """Places of the first few entries of each (anchor, window), by score and id."""
    order = np.lexsort((no, ids, -score, window, anchor))
    a, w = anchor[order], window[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (w[1:] != w[:-1])]) if len(a) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    place = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    return order[place < first]


def lowest(score: np.ndarray) -> np.ndarray:
    """The least score in a positive's window: 80 % of it, rounded up."""
    return score - score // 5


def positives_of(a: Block, wanted: np.ndarray, b: Block, first: int) -> list[np.ndarray]:
    """Candidates (anchor, window 0, score, id, row) among the rows of a block with the anchors' labels."""
    none, out = np.iinfo(np.int64).min, [[np.zeros(0, np.int64)] * 5]
    for label in np.intersect1d(a.label, b.label):
        theirs, own = np.flatnonzero(b.label == label), np.flatnonzero(a.label == label)
        for at in range(0, len(own), _SLICE):
            mine = own[at : at + _SLICE]
            s = scores(a, mine, b, theirs)
            s[a.id[mine][:, None] == b.id[theirs]] = none
            place = max(0, len(theirs) - first)
            least = np.partition(s, place, axis=1)[:, place]
            i, j = np.nonzero((s >= least[:, None]) & (s > none))
            found = [mine[i], np.zeros(len(i), np.int64), s[i, j], b.id[theirs[j]], b.no[theirs[j]]]
            best = first_of(*found, first)
            out.append([x[best] for x in found])
    return [np.concatenate(x) for x in zip(*out)]


def negatives_of(a: Block, wanted: np.ndarray, b: Block, first: int) -> list[np.ndarray]:
    """Candidates (anchor, window, score, id, row) among the rows of other labels. ``wanted`` has the anchors' positive scores, -1 for none."""
    out = [[np.zeros(0, np.int64)] * 5]
    some = np.flatnonzero(wanted.max(axis=1, initial=-1) >= 0)
    for at in range(0, len(some), _SLICE):
        mine = some[at : at + _SLICE]
        top = wanted[mine]
        s = scores(a, mine, b, slice(None))
        high = top.max(axis=1)
        low = lowest(np.where(top < 0, high[:, None], top).min(axis=1))
        i, j = np.nonzero((s >= low[:, None]) & (s <= high[:, None]) & (a.label[mine][:, None] != b.label[None, :]))
        score = s[i, j]
        for w in range(wanted.shape[1]):
            p = top[i, w]
            inside = (p >= 0) & (score <= p) & (score >= lowest(p))
            found = [mine[i[inside]], np.full(inside.sum(), w), score[inside], b.id[j[inside]], b.no[j[inside]]]
            best = first_of(*found, first)
            out.append([x[best] for x in found])
    return [np.concatenate(x) for x in zip(*out)]


def keys(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys of 24 bytes that sort by anchor, then higher score, then smaller id."""
    parts = np.stack([anchor, ~score, ids], axis=1).astype(np.int64)
    return (parts.view(np.uint64) ^ _SIGN).astype(">u8")


def unkeyed(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = np.frombuffer(b"".join(raw), ">u8").reshape(-1, 3).astype(np.uint64)
    back = lambda x: np.ascontiguousarray(x ^ _SIGN).view(np.int64)
    return back(parts[:, 0]), ~back(parts[:, 1]), back(parts[:, 2])


def met(anchors: DataFrame, rows: DataFrame, parts: int) -> DataFrame:
    """Each anchor block beside each row block: anchors go once to each of the groups that the row blocks are dealt into."""
    names = [f.name for f in _BLOCK]
    dealt = F.pmod(F.col("block") + 31 * F.shiftright("block", _TASK), F.lit(parts))
    theirs = rows.select(dealt.alias("group"), F.struct(*names).alias("b"))
    groups = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    mine = anchors.select(F.struct(*names, *(c for c in anchors.columns if c == "told")).alias("a"), groups.alias("group"))
    return mine.join(theirs, "group").filter("a.size = b.size").select("a", "b")


def scored(pairs: DataFrame, find: Callable, width: int, first: int, positive: bool) -> DataFrame:
    """Keys of the pairs that ``find`` leaves, after what a task knows of an anchor is put together."""

    def block_at(side: pa.StructArray, i: int) -> Block:
        return Block(width, *(side.field(k)[i].as_py() for k in range(len(_BLOCK))))

    def told(held: dict[int, tuple[Block, np.ndarray, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for a, _, (anchor, _, value, ids, no) in held.values():
            order = np.lexsort((no, anchor))  # a row in several windows is told once
            new = np.ones(len(order), bool)
            new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (no[order][1:] != no[order][:-1])
            anchor, value, ids = (x[order[new]] for x in (anchor, value, ids))
            raw = keys(a.no[anchor], value, ids)
            key = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(len(raw) + 1, dtype=np.int32) * 24), pa.py_buffer(raw.tobytes())])
            yield from pa.table([key, pa.array(a.id[anchor]), pa.array(np.full(len(raw), positive))], schema=_PAIR).to_batches(max_chunksize=50_000)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Block, np.ndarray, list[np.ndarray]]] = {}
        for batch in batches:
            mine, theirs = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                number = mine.field(0)[i].as_py()
                if number not in held:
                    if len(held) >= _OPEN:
                        yield from told(held)
                        held.clear()
                    a = block_at(mine, i)
                    wanted = np.full((len(a.no), first), -1)
                    if not positive:
                        place, value = (mine.field(len(_BLOCK))[i].values.field(k).to_numpy() for k in range(2))
                        order = np.argsort(place, kind="stable")
                        place, value = place[order], value[order]
                        start = np.searchsorted(place, place)
                        wanted[place, np.arange(len(place)) - start] = value
                    held[number] = (a, wanted, [np.zeros(0, np.int64)] * 5)
                a, wanted, found = held[number]
                found = [np.concatenate(x) for x in zip(found, find(a, wanted, block_at(theirs, i), first))]
                best = first_of(*found, first)
                held[number] = (a, wanted, [x[best] for x in found])
        yield from told(held)

    return pairs.mapInArrow(score, _PAIR_DDL)


def sorted_keys(pairs: DataFrame) -> DataFrame:
    """The secondary sort: partitioned by the anchor's eight bytes, sorted by key within partitions."""
    return pairs.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key", F.desc("positive"))


def first_positives(pairs: DataFrame, width: int, first: int) -> DataFrame:
    """The first positives of each anchor, by one pass over sorted keys; also the anchor's block and place there, and the score."""
    schema = pa.schema([*_PAIR, ("block", pa.int64()), ("place", pa.int64()), ("score", pa.int64())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            chosen = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                n = n + 1 if key[:8] == last else 1
                last = key[:8]
                if n <= first:
                    chosen.append(i)
            some = batch.take(pa.array(chosen, pa.int64()))
            no, score, _ = unkeyed(some.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(no // width), pa.array(no % width), pa.array(score)], schema=schema)

    return sorted_keys(pairs).mapInArrow(stream, _PAIR_DDL + ", block long, place long, score long")


def windows(pairs: DataFrame, first: int) -> DataFrame:
    """The result, by one pass over sorted keys of positives and negatives."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, score, tied, opened = None, None, [], []
        for batch in batches:
            out = []
            is_positive, names = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            for a, s, vec, name, positive in zip(*(x.tolist() for x in unkeyed(batch.column(0).to_pylist())), names, is_positive):
                if a != anchor:
                    anchor, score, tied, opened = a, s, [], []
                if s != score:  # windows that ended at a higher score are closed
                    score, tied = s, []
                    opened = [w for w in opened if w[2] < first and 5 * s >= 4 * w[1]]
                if positive:
                    if s >= 0:
                        opened.append([vec, s, 0])
                        for other in tied:
                            opened[-1][2] += 1
                            out.append((name, vec, opened[-1][2], other, s, s))
                    continue
                if len(tied) < first:
                    tied.append(vec)
                for w in opened:
                    if w[2] < first:
                        w[2] += 1
                        out.append((name, w[0], w[2], vec, w[1], s))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 6, _OUT)], schema=_OUT)

    return sorted_keys(pairs).mapInArrow(stream, _OUT_DDL)


def mined(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = EVERY, first: int = FIRST,
    width: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``width`` is the number of vectors in a block."""
    spark = df.sparkSession
    ship(spark)
    rows = vectors(df, id_col, vector_col, label_col)
    with text_batches(spark, rows=width):
        packed_rows = keep(blocks(rows, width), "vectors")
        anchors = keep(blocks(rows.filter(F.col("id") % every == 0), width), "anchors")
    parts = max(1, min(packed_rows.count(), packed.bucket_count(df)))
    with text_batches(spark, rows=8):
        best = keep(scored(met(anchors, packed_rows, parts), positives_of, width, first, True), "positive-pairs")
        positives = keep(first_positives(best, width, first), "positives")
        # at most width x first entries a block
        told = positives.filter("score >= 0").groupBy("block").agg(F.collect_list(F.struct("place", "score")).alias("told"))
        asking = keep(anchors.join(told, "block"), "asking")
        negatives = keep(scored(met(asking, packed_rows, parts), negatives_of, width, first, False), "negative-pairs")
    return windows(positives.select(*negatives.columns).unionByName(negatives), first)
