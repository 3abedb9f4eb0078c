"""Merkle manifest of a document table: one hash tree per source, one over the sources, and a witness per document.

A leaf is the SHA-256 of a document's fields. Per source, leaves ascend by id; while several nodes remain, every ``FAN`` consecutive ones become the hash of
their digests (lowercase hex, concatenated), the last run with fewer, even with one. The roots of the sources, ordered by source, make the top tree likewise.

1. Leaves, and those of changed texts, are hashed inside Spark; texts don't move. A range sort by (source, id, leaf) and the numbers of rows per
   partition and source give each leaf its place, so a source with any share of the rows lies in many partitions.
2. Blocks of ``FAN`` ** ``LEVELS`` leaves begin at multiples of that, so each is a whole subtree. A block is a stream of appends: a stack
   holds the open subtrees of each level, each with the partial witnesses of its leaves; when a run is full its node completes, and each of its children's
   leaves gets the siblings. At a source's end, short runs are closed.
3. The roots of blocks are further appends: the next call works on them as on leaves, and once more, until each source has one node; then the
   sources' roots are appended to the top tree. So a level of blocks stands for ``LEVELS`` levels of the tree, and no task sees more than one block.
4. A leaf's witness is its own steps, its block's, and so on to the root. Folding it with the leaf gives the root again.

A witness step is one byte, the number of siblings on the left times ``FAN`` plus that on the right, and their 32-byte digests in order.

Defined cases: a missing source is a source of its own, before the others; a missing id comes first in its source; equal ids are ordered by leaf;
repeated rows are leaves each. An empty table has no leaves. Helper columns are made only of selected expressions, so extra columns don't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableward.llm.batches import text_batches
from tableward.llm.ship import ship
from tableward.session import keep

FAN = 3
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_GROWN = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("digest", pa.binary()), ("steps", pa.binary()), ("top", pa.bool_())])
_GROWN_DDL = "tree string, block long, pos long, digest binary, steps binary, top boolean"
_AUDIT = pa.schema([("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])


def node(digests: list[bytes]) -> bytes:
    """Hash of the digests as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def leaf(*fields: Column) -> Column:
    """Column: SHA-256, as bytes, of each field's UTF-8 length, a colon and the field, or ``-`` where it is missing."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.unhex(F.sha2(F.concat(*told).cast("binary"), 256))


class Appender:
    """Open subtrees of one block, lowest first; each node carries the witnesses of the leaves below it."""

    def __init__(self, levels: int):
        self.open: list[list[tuple[bytes, list[bytearray]]]] = [[] for _ in range(levels + 1)]
        self.levels = levels

    def append(self, digest: bytes, level: int = 0, below: list[bytearray] | None = None) -> list[bytearray]:
        below = [bytearray()] if below is None else below
        self.open[level].append((digest, below))
        if level < self.levels and len(self.open[level]) == FAN:
            self.complete(level)
        return below

    def complete(self, level: int) -> None:
        """The run of open nodes becomes a node of the next level; their leaves' witnesses get the siblings."""
        run, self.open[level] = self.open[level], []
        for k, (_, below) in enumerate(run):
            step = bytes([k * FAN + len(run) - 1 - k]) + b"".join(d for j, (d, _) in enumerate(run) if j != k)
            for witness in below:
                witness += step
        self.append(node([d for d, _ in run]), level + 1, [w for _, below in run for w in below])

    def close(self, whole: bool) -> bytes:
        """The block's root: at the block's full height if its tree has other blocks, else at the first level with one node."""
        for level in range(self.levels):
            if not whole and len(self.open[level]) == 1 and not any(self.open[level + 1 :]):
                return self.open[level][0][0]
            if self.open[level]:
                self.complete(level)
        return self.open[self.levels][0][0]


def grown(nodes: DataFrame, levels: int) -> DataFrame:
    """Rows (tree, block, pos, digest, steps, top): each node's witness inside its block, and per block its root (``top``).

    ``nodes`` has (tree, pos, n, digest): the place of a node among the n of its tree.
    """
    size = FAN**levels

    def stream(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        block, n = table.column("block")[0].as_py(), table.column("n")[0].as_py()
        appender = Appender(levels)
        digests = table.column("digest").to_pylist()
        steps = [appender.append(d)[0] for d in digests]
        root = appender.close(n > size)
        rows = len(steps) + 1
        tree = table.column("tree")[0].as_py()
        pos = table.column("pos").to_pylist() + [block]
        columns = [[tree] * rows, [block] * rows, pos, [*digests, root], [*map(bytes, steps), b""], [False] * (rows - 1) + [True]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _GROWN)], schema=_GROWN)

    blocked = nodes.select("tree", F.expr(f"pos div {size}").alias("block"), "pos", "n", "digest")
    return keep(blocked.groupBy("tree", "block").applyInArrow(stream, _GROWN_DDL), "merkle-blocks")


def witnesses(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, pos, digest, steps, root): each node's witness up to the root of its tree. ``nodes`` has (tree, pos, n, digest)."""
    size = FAN**levels
    done = grown(nodes, levels)
    tops = done.filter("top").select("tree", F.col("block").alias("pos"), "digest")
    below = done.filter("NOT top").select("tree", "block", "pos", "digest", "steps")
    counts = nodes.select("tree", "n").distinct()
    if not counts.filter(F.col("n") > size).isEmpty():
        more = counts.select("tree", F.expr(f"(n + {size - 1}) div {size}").alias("n"))
        tops = witnesses(keep(tops.join(more, "tree").select("tree", "pos", "n", "digest"), "merkle-roots"), levels)
    else:
        tops = tops.select("tree", "pos", "digest", F.lit(b"").alias("steps"), F.col("digest").alias("root"))
    above = tops.select("tree", F.col("pos").alias("block"), F.col("steps").alias("more"), "root")
    return below.join(above, ["tree", "block"]).select("tree", "pos", "digest", F.concat("steps", "more").alias("steps"), "root")


def placed(leaves: DataFrame, order: list[str], label: str) -> DataFrame:
    """``leaves`` (tree, ...) with ``pos``, its place in its tree by ``order``, and the tree's number of leaves ``n``.

    A range sort is written down, so that a retry can't renumber it. What is gathered is one row per partition and tree.
    """
    spark = leaves.sparkSession
    whole = keep(leaves, label)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = whole.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    sorted_ = keep(sorted_.withColumn("part", F.shiftright("at", 33)), label)
    heads = sorted_.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    by_tree = Window.partitionBy("tree")
    before = F.sum("rows").over(by_tree.orderBy("part")) - F.col("rows")
    heads = heads.select("part", "tree", "first", before.alias("before"), F.sum("rows").over(by_tree).alias("n"))
    return sorted_.join(heads, ["part", "tree"]).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per document row: doc_id, source, leaf, changed, subroot, root and steps, the last five as bytes.

    ``changed`` is the leaf of the same row with all line feeds deleted from its text.
    """
    spark = docs.sparkSession
    ship(spark)
    doc, source, lang, chars, text = (F.col(c) for c in FIELDS)
    tree = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))  # "n" comes before all "s..."
    own = docs.select(
        tree.alias("tree"), doc.cast("long").alias("doc"), leaf(doc, source, lang, chars, text).alias("digest"),
        leaf(doc, source, lang, chars, F.replace(text, F.lit("\n"), F.lit(""))).alias("changed"),
    )
    with text_batches(spark, rows=10_000):
        leaves = placed(own, ["doc", "digest"], "merkle-leaves")
        inner = keep(witnesses(leaves.select("tree", "pos", "n", "digest"), levels), "merkle-witnesses")
        subroots = inner.filter("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
        tops = placed(subroots, ["name"], "merkle-sources")
        outer = witnesses(tops.select("tree", "pos", "n", "digest"), levels)
        outer = tops.select("name", "pos").join(outer, "pos").select(F.col("name").alias("tree"), F.col("steps").alias("more"), F.col("root").alias("whole"))
        outer = keep(outer, "merkle-top")
    return (
        leaves.select("tree", "pos", "doc", "changed")
        .join(inner, ["tree", "pos"])
        .join(outer, "tree")
        .select(
            F.col("doc").alias("doc_id"), F.when(F.col("tree") != "n", F.expr("substring(tree, 2)")).alias("source"), F.col("digest").alias("leaf"), "changed",
            F.col("root").alias("subroot"), F.col("whole").alias("root"), F.concat("steps", "more").alias("steps"),
        )
    )


def fold(digest: bytes, steps: bytes) -> tuple[bytes, list[bytes]]:
    """(root, siblings) of a leaf and its witness."""
    at, siblings = 0, []
    while at < len(steps):
        left, right = divmod(steps[at], FAN)
        own = [steps[at + 1 + 32 * k : at + 33 + 32 * k] for k in range(left + right)]
        siblings += own
        digest = node([*own[:left], digest, *own[left:]])
        at += 1 + 32 * (left + right)
    return digest, siblings


def audited(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per document: leaf, subroot, root, the proof's hash, and the root that folds from the (partly changed) text."""
    found = manifest(docs, levels)
    told = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    now = found.select("doc_id", "leaf", "subroot", "root", "steps", F.when(told, F.col("changed")).otherwise(F.col("leaf")).alias("now"))
    names = ["doc_id", "leaf", "subroot", "root"]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in names[1:]), *_AUDIT])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            root = batch.column(3).to_pylist()
            for whole, steps, digest in zip(root, batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                again, siblings = fold(digest, steps)
                out[0].append(node(siblings).hex())
                out[1].append(again.hex())
                out[2].append(again == whole)
            hexed = [pa.array([d.hex() for d in batch.column(k).to_pylist()]) for k in (1, 2)]
            columns = [batch.column(0), *hexed, pa.array([d.hex() for d in root]), *out]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return now.mapInArrow(check, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
