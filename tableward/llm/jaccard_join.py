"""N-gram Jaccard join with PartEnum signatures, and the groups that its links form.

A document's set holds the distinct ``WORDS``-word shingles of its text, A to Z in lower case; with fewer words the whole sequence is the one
shingle. Two documents link when 100 x intersection >= ``PERCENT`` x union.

1. Sets that are equal are one class, told by size and two 64-bit sums (``similar``).
2. Signatures. Sizes fall into bands whose ends differ by the threshold, so linked sets lie in one band or in neighbouring ones, and for each
   band the sets that differ least can differ in at most k shingles. The shingle domain is hashed into parts of three subparts each. With
   more than k / 2 parts one part holds at most one difference, so two of its three subparts agree: every subset of two subparts
   of every part is a signature. A signature without shingles says nothing and is left out where a set has enough other
   parts to prove that none of its links needs it (``signatures``).
3. Candidates. Classes that share a signature are compared on their texts (``similar.linked``): with the least of them first, and
   across components where a signature joins several. Links form components. Links within a component that is already joined are not listed.
4. Chains. Across components a pair must also pass at the signature it meets in: parts form a ring, and of linked sets one shared signature begins
   ``SPAN`` parts that differ no more than parts do on average (``chain_allows``). Their odd sketch has a fixed size, whatever the text's length.

Defined cases: a missing text, or one without words, has an empty set and links with nothing; repeated rows get equal results; rows without an
id link like others, and a component without any id has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward.llm import packed, similar
from tableward.llm import sequences as sq
from tableward.llm.batches import text_batches
from tableward.llm.ship import ship
from tableward.session import keep

WORDS = 4
PERCENT = 85
#: Sets that a task remembers, so as to send copies once; beyond it starts afresh, which costs bytes only.
SEEN = 100_000
#: Parts in a chain, about nine shingles each, and the columns of its odd sketch, 64 parities each.
SPAN = 64
CHAIN = [f"chain{k}" for k in range(32)]
_U = np.uint64
_BLOBS = ["key", "doc", "paired", "more_key", "more_doc"]
_PACKED = pa.schema([("bucket", pa.int32())] + [(x, pa.binary()) for x in _BLOBS])
_PACKED_DDL = "bucket int, " + ", ".join(f"{x} binary" for x in _BLOBS)


def band_of(size: int, percent: int) -> tuple[int, int, int]:
    """(number, least, largest) of the size band: linked sets are in one band or in neighbouring ones."""
    number, low = 0, 1
    while True:
        high = low * 100 // percent
        if size <= high:
            return number, low, high
        number, low = number + 1, high + 1


def _bands(n: int, percent: int) -> Iterator[tuple[int, int, int]]:
    """(band, k, differ): the bands a set of n shingles emits for, what linked sets there may differ in, and what this set may."""
    number, low, high = band_of(n, percent)
    reach = n * 100 // percent
    for band in (number, number + 1):
        top = high
        if band > number:
            if reach <= high:
                break
            top = (high + 1) * 100 // percent
        yield band, 2 * top * (100 - percent) // (100 + percent), (n + min(top, reach)) * (100 - percent) // (100 + percent)


def _signed(own: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Per band: signatures, the part of each, the part of each shingle, parts, and the parts that one shared signature is sure to come from."""
    n = len(own)
    mixed = sq.mix(own + _U(0x1234567))
    place = sq.mix(own ^ _U(0x5851F42D4C957F2D))
    for band, k, differ in _bands(n, percent):
        parts = k // 2 + 2 if k else 1
        cell = ((place >> _U(32)) * _U(3 * parts) >> _U(32)).astype(np.int64)
        sums = np.zeros(3 * parts, _U)
        np.add.at(sums, cell, mixed)
        full = (np.bincount(cell, minlength=3 * parts) > 0).reshape(parts, 3)
        sums = sums.reshape(parts, 3)
        tag = _U(band + 1) << _U(40)
        if not k:  # linked sets of this band are equal; so one signature, of the whole set
            yield sq.mix(sums.sum(dtype=_U, keepdims=True).reshape(1) + tag), np.zeros(1, np.int64), cell // 3, 1, 1
            continue
        x, y = np.array([0, 0, 1]), np.array([1, 2, 2])
        where = tag + np.arange(3 * parts, dtype=_U).reshape(parts, 3)
        found = sq.mix(sq.mix(sums[:, x] + where) * _U(3) + sums[:, y])
        filled = full[:, x] | full[:, y]
        part = np.repeat(np.arange(parts), 3).reshape(parts, 3)
        good = int(filled.all(1).sum())
        if good > differ // 2:
            yield found[filled], part[filled], cell // 3, parts, good
        else:
            yield found.ravel(), part.ravel(), cell // 3, parts, parts


def signatures(own: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """PartEnum signatures of a set of shingle hashes.

    A set of n shingles emits for its own band and, if a partner may be there, for the next. In a band with largest size h, linked sets
    differ in at most k = floor(2 h (100 - p) / (100 + p)) shingles. There are k // 2 + 2 parts.
    At most d // 2 parts have two differences or more, where d bounds what this set may differ in. So with more than d // 2
    parts whose three subsets all hold shingles, one shared signature is not empty, whatever the partner. Only sets
    without that many send their empty signatures, and of two such sets both do.
    """
    return np.concatenate([x[0] for x in _signed(own, percent)]) if len(own) else own


def chains(own: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """Odd sketches of ``SPAN`` parts in a ring, or of all if there are no more, by the part they begin with: rows of 64-bit numbers."""
    bit = ((sq.mix(own ^ _U(0x2545F4914F6CDD1D)) >> _U(32)) * _U(64 * len(CHAIN)) >> _U(32)).astype(np.int64)
    odd = np.zeros(parts * len(CHAIN), _U)
    np.bitwise_xor.at(odd, part * len(CHAIN) + (bit >> 6), _U(1) << (bit & 63).astype(_U))
    odd = odd.reshape(parts, len(CHAIN))
    span = min(SPAN, parts)
    upto = np.bitwise_xor.accumulate(np.concatenate([np.zeros((1, len(CHAIN)), _U), odd, odd[: span - 1]]), axis=0)
    return upto[span : span + parts] ^ upto[:parts]


def with_chains(asked: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, cls, component, n, span, good, ``CHAIN``) for the signatures in ``keys`` of ``asked``, which has (cls, component, keys, text)."""
    names = ["key", "cls", "component", "n", "span", "good", *CHAIN]
    schema = pa.schema([(x, pa.int64()) for x in names])

    def of_set(own: np.ndarray, cls: int, component: int, keys: np.ndarray) -> Iterator[np.ndarray]:
        for key, start, part, parts, good in _signed(own, percent):
            at = np.flatnonzero(np.isin(key, keys))
            span = min(SPAN, parts)
            told = np.empty((len(at), len(names)), np.int64)
            told[:, 0] = key[at].view(np.int64)
            told[:, 1:6] = cls, component, len(own), span, max(good, span)
            told[:, 6:] = chains(own, part, parts)[start[at]].view(np.int64)
            yield told

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            columns = np.concatenate(ready).T
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], schema=schema)

        for batch in batches:
            data, at = sq.texts(batch.column(3))
            for i in range(batch.num_rows):
                keys = batch.column(2)[i].values.to_numpy().view(_U)
                ready += of_set(similar.shingles(data[at[i] : at[i + 1]], words), batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), keys)
                if sum(map(len, ready)) >= 20_000:
                    yield flush()
        if ready:
            yield flush()

    return asked.select("cls", "component", "keys", "text").mapInArrow(emit, ", ".join(f"{x} long" for x in names))


def chain_allows(percent: int) -> Column:
    """Column: the chains of two sets that share a signature (columns with ``_x`` and ``_y``) allow a link that shows at this signature.

    Let linked sets differ in D shingles, and take the good parts as one each and the others as nothing. Going round the ring from where the running sum of
    (differences - D / good parts) is largest, no chain has more differences than D / good times its length. Its first good part
    has less than two, so a signature of it is shared: one shared signature passes, and the others need not.
    """
    bits = sum((F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in CHAIN[1:]), F.bit_count(F.col("chain0_x").bitwiseXOR(F.col("chain0_y"))))
    return bits * F.least("good_x", "good_y") * (100 + percent) <= F.col("span_x") * (F.col("n_x") + F.col("n_y")) * (100 - percent)


def shared_signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, h1): signatures that more than one set has, and the sets' first sums. ``docs`` has (text)."""
    buckets = 2 * packed.bucket_count(docs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()

        def records(batch: pa.RecordBatch):
            data, at = sq.texts(batch.column(0))
            for i in range(batch.num_rows):
                own = similar.shingles(data[at[i] : at[i + 1]], words)
                told = similar.set_sums(own)
                if len(own) and told not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(told)
                    key = signatures(own, percent)
                    yield key, np.full(len(key), told[0]).view(_U)  # packing takes differences, which unsigned numbers always have

        yield from packed.gather(batches, records, flush)

    def flush(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, doc = arrays
        bucket = packed.bucket_of(key, buckets)
        order = np.lexsort((doc, key, bucket))
        bucket, key, doc = bucket[order], key[order], doc[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        edge = np.flatnonzero(new)
        least = np.minimum.reduceat(doc, edge)[np.cumsum(new) - 1]
        paired = (np.maximum.reduceat(doc, edge) > np.minimum.reduceat(doc, edge))[np.cumsum(new) - 1]
        first = new
        more = np.flatnonzero(doc > least)
        spread = np.arange(len(more)) % buckets  # these need no bucket any more
        ends = np.searchsorted(bucket, np.arange(buckets + 1))
        out: dict[str, list] = {x: [] for x in _PACKED.names}
        for b in range(buckets):
            part = np.arange(ends[b], ends[b + 1])
            part, own = part[first[part]], more[spread == b]
            if not len(part) and not len(own):
                continue
            out["bucket"].append(b)
            out["key"].append(packed.squeeze_sorted(key[part]))
            out["doc"].append(packed.squeeze(doc[part]))
            out["paired"].append(packed.squeeze(paired[part].astype(np.uint8)))
            out["more_key"].append(packed.squeeze_sorted(key[own]))
            out["more_doc"].append(packed.squeeze(doc[own]))
        yield from packed.rows_of(out, _PACKED, 64)

    def settle(table: pa.Table) -> pa.Table:
        blobs = {n: table.column(n).to_pylist() for n in _BLOBS}
        key, more_key = (np.concatenate([packed.unsqueeze_sorted(x) for x in blobs[n]]) for n in ("key", "more_key"))
        doc, paired, more_doc = (np.concatenate([packed.unsqueeze(x) for x in blobs[n]]) for n in ("doc", "paired", "more_doc"))
        order = np.lexsort((doc, key))
        key, doc, paired = key[order], doc[order], paired[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        edge, group = np.flatnonzero(new), np.cumsum(new) - 1
        if len(key):
            shared = (np.minimum.reduceat(doc, edge) < np.maximum.reduceat(doc, edge)) | (np.maximum.reduceat(paired, edge) > 0)
            chosen = shared[group] & np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
            key, doc = key[chosen], doc[chosen]
        return pa.table([pa.array(np.concatenate([key, more_key]).view(np.int64)), pa.array(np.concatenate([doc, more_doc]).view(np.int64))], names=["key", "h1"])

    return docs.select("text").mapInArrow(emit, _PACKED_DDL).groupBy("bucket").applyInArrow(settle, "key long, h1 long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(row, doc, n, cls, root, component) per document: its set's size, class and component."""
    ship(docs.sparkSession)
    own = similar.rows_of(docs, id_col, text_col)
    with text_batches(docs.sparkSession):
        known = similar.facts(own, words)
        reps = similar.classes(known)
        sent = keep(shared_signatures(own, words, percent), "jaccard-signatures")
        keys = sent.join(reps.select("h1", "cls"), "h1").select("key", "cls").distinct()
        finer = similar.Finer(lambda asked: with_chains(asked, words, percent), ["span", "good", *CHAIN], chain_allows(percent))
        return similar.linked(own, known, reps, keys, words, percent, finer)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, n_shingles and component_id."""
    return groups(docs, id_col, text_col).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group, that with the smallest id, with its own columns."""
    return similar.keep_first(docs, groups(docs, id_col, text_col, words, percent), id_col, text_col)
