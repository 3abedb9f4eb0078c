"""Groups of documents with similar sets of word shingles, from keys that similar sets share.

Used with keys of any making: ``linked`` takes (key, class) rows, compares what shares a key and forms components.

* Row. A document row is known by a 64-bit hash of its id and text, which Spark computes alike wherever it is needed. So ids may be missing or repeat.
* Class. Rows with equal sets, told by size and two 64-bit sums, are one class. Classes are numbered by their smallest ids. Copies are not compared.
* Pairs. Classes that share a key are compared with the first class of that key: edited copies mostly come after what they were made from, so this
  joins most groups. Where a key then joins several components, pairs across
  them are compared too, so every pair with a common key is either compared or already in one component.
* Before texts are fetched, a pair must pass its odd sketches: ``BITS`` parities of shingle counts. Each shingle that only one of two sets has
  flips one bit, so sets whose sketches differ in more bits than linked sets may differ in shingles are not linked.
* Long sets fill these parities. So pairs across components may take a finer test (``Finer``) before they are made; only classes that have
  a partner by their odd sketches, found by a semi join, are read for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward.functions.skew import with_position
from tableward.llm import sequences as sq
from tableward.llm.components import components
from tableward.llm.names import free
from tableward.session import keep

#: Parities in an odd sketch, 64 in each of its columns.
BITS = 512
ODD = [f"odd{k}" for k in range(BITS // 64)]
_U = np.uint64


def shingles(data: np.ndarray, words: int) -> np.ndarray:
    """Distinct shingle hashes of a text given as bytes, ascending; with fewer words the whole sequence is the one shingle."""
    codes = sq.word_codes(sq.lower_ascii(data))
    if not len(codes):
        return codes
    if len(codes) >= words:
        return np.unique(sq.Prefix(codes).grams(words))
    return sq.mix(sq.Prefix(codes).grams(len(codes)) + _U(len(codes)))


def set_sums(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart."""
    return int(sq.mix(own).sum(dtype=_U).view(np.int64)), int(sq.mix(own * _U(0x9FB21C651E98DF25) + _U(7)).sum(dtype=_U).view(np.int64))


def odd_sketch(own: np.ndarray) -> list[int]:
    """Parity of the number of shingles in each of ``BITS`` classes of their hashes, as 64-bit numbers."""
    place = (sq.mix(own ^ _U(0x2545F4914F6CDD1D)) >> _U(32)).astype(np.int64) * BITS >> 32
    return np.packbits(np.bincount(place, minlength=BITS) & 1).view(np.int64).tolist()


def row_key(doc: Column, text: Column) -> Column:
    return F.xxhash64(text, doc)


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc, text)."""
    doc, text = F.col(id_col).cast("long"), F.col(text_col)
    return docs.select(row_key(doc, text).alias("row"), doc.alias("doc"), text.alias("text"))


def facts(rows: DataFrame, words: int, more: Callable[[np.ndarray], list[int]] | None = None, names: list[str] | None = None) -> DataFrame:
    """Per row: size, sums and odd sketch of its set and the numbers ``names`` that ``more`` makes of it."""
    columns = ["row", "doc", "n", "h1", "h2", *ODD, *(names or [])]
    schema = pa.schema([(x, pa.int64()) for x in columns])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = sq.texts(batch.column(2))
            out = np.zeros((len(columns) - 2, batch.num_rows), np.int64)
            for i in range(batch.num_rows):
                own = shingles(data[at[i] : at[i + 1]], words)
                out[:, i] = [len(own), *set_sums(own), *odd_sketch(own), *(more(own) if more else ())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x) for x in out)], schema=schema)

    return keep(rows.select("row", "doc", "text").mapInArrow(described, ", ".join(f"{x} long" for x in columns)), "similar-facts")


def classes(known: DataFrame) -> DataFrame:
    """(n, h1, h2, row, cls): each class of equal sets that are not empty, numbered by its smallest id, and one of its rows."""
    found = known.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc").alias("low"), F.min("row").alias("row"))
    numbered = with_position(found, [F.asc_nulls_last("low"), F.asc("row"), F.asc("h1")], "cls")
    return keep(numbered.select("n", "h1", "h2", "row", "cls"), "similar-classes")


def compared(pairs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(a, b, both, either): sizes of intersection and union of each pair's sets. ``wanted`` has (cls, text)."""
    left, right = (wanted.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    schema = pa.schema([(x, pa.int64()) for x in ("a", "b", "both", "either")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, np.zeros(0, _U)
        for batch in batches:
            b, (data_a, at_a), (data_b, at_b) = batch.column(1), sq.texts(batch.column(2)), sq.texts(batch.column(3))
            both, either = [], []
            for i in range(batch.num_rows):
                own = shingles(data_a[at_a[i] : at_a[i + 1]], words)
                if last != (other := b[i].as_py()):
                    last, known = other, shingles(data_b[at_b[i] : at_b[i + 1]], words)
                common = len(np.intersect1d(own, known, assume_unique=True))
                both.append(common)
                either.append(len(own) + len(known) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), b, pa.array(both, pa.int64()), pa.array(either, pa.int64())], schema=schema)

    # joined by b last, so that rows of one b follow each other
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(count, "a long, b long, both long, either long")


class Finer(NamedTuple):
    """A finer test of pairs at a key: ``rows`` takes (cls, component, keys, text) and gives (key, cls, component, n, ``names``);
    ``allowed`` tells whether two such rows of one key, with ``_x`` and ``_y``, may link. Each linked pair must pass at one key or more."""

    rows: Callable[[DataFrame], DataFrame]
    names: list[str]
    allowed: Column


def linked(
    rows: DataFrame, known: DataFrame, reps: DataFrame, keys: DataFrame, words: int, percent: int, finer: Finer | None = None
) -> DataFrame:
    """(row, doc, n, cls, component) per row of ``known``: the smallest id that its links reach.

    ``rows`` is ``rows_of``, ``known`` is ``facts``, ``reps`` is ``classes``, ``keys`` has (key, cls) rows. A set without shingles has no class and links with nothing. Rows without an
    id link like others; a component without any id has none.
    """
    members = known.select("row", "doc", "n", "h1", "h2").join(reps.drop("row"), ["n", "h1", "h2"], "left").select("row", "doc", "n", "cls")
    heads = keep(known.select("row", "n", *ODD).join(reps.select("row", "cls"), "row").dropDuplicates(["row"]), "similar-heads")

    keys = keep(keys, "similar-keys")
    firsts = keys.groupBy("key").agg(F.min("cls").alias("head"), F.max("cls").alias("last")).filter("head < last").select("key", "head")
    shared = keep(keys.join(firsts, "key"), "similar-shared")

    def possible() -> Column:
        """Column: sizes and odd sketches of the two sides (columns with ``_x`` and ``_y``) allow a link."""
        n, m = F.col("n_x"), F.col("n_y")
        bits = sum((F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in ODD[1:]), F.bit_count(F.col("odd0_x").bitwiseXOR(F.col("odd0_y"))))
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (bits * (100 + percent) <= (n + m) * (100 - percent))

    side = lambda name, end: heads.select(F.col("cls").alias(name), *(F.col(c).alias(f"{c}_{end}") for c in ("n", *ODD)))
    near = shared.filter("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b")).distinct()
    pairs = keep(near.join(side("a", "x"), "a").join(side("b", "y"), "b").filter(possible()).select("a", "b"), "similar-pairs")

    def texts_of(some: DataFrame) -> DataFrame:
        wanted = some.join(heads.select("cls", "row"), "cls")
        return keep(rows.select("row", "text").join(wanted, "row").dropDuplicates(["row"]).select("cls", "text"), "similar-texts")

    def links_of(some: DataFrame) -> DataFrame:
        texts = texts_of(some.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        return keep(compared(some, texts, words).filter(F.col("both") * 100 >= F.col("either") * percent).select("a", "b"), "similar-links")

    links = links_of(pairs)
    part = components(links)
    # keys that join several components
    tagged = shared.join(part.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = tagged.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
    open_ = tagged.filter("cls <> head").join(mixed, "key").select("key", "cls", "component").join(heads.drop("row"), "cls")
    open_ = keep(open_, "similar-open")
    ends = lambda some, names: (some.select("key", *(F.col(c).alias(f"{c}_{end}") for c in ("cls", "component", "n", *names))) for end in "xy")
    apart, allowed = F.col("component_x") != F.col("component_y"), possible()
    x, y = ends(open_, ODD)
    if finer is not None:
        y = y.withColumnRenamed("key", "key_y")
        some = keep(x.join(y, (F.col("key") == F.col("key_y")) & apart & allowed, "left_semi").select("key", F.col("cls_x").alias("cls"), F.col("component_x").alias("component")), "similar-some")
        asked = some.groupBy("cls", "component").agg(F.collect_list("key").alias("keys"))
        open_ = keep(finer.rows(asked.join(texts_of(some.select("cls").distinct()), "cls")), "similar-finer")
        allowed = finer.allowed
        x, y = ends(open_, finer.names)
    rest = x.join(y, "key").filter((F.col("cls_x") > F.col("cls_y")) & apart & allowed).select(F.col("cls_x").alias("a"), F.col("cls_y").alias("b")).distinct()
    rest = keep(rest.join(pairs, ["a", "b"], "left_anti"), "similar-rest")
    if not rest.isEmpty():
        part = components(links.unionByName(links_of(rest)))

    named = members.join(part.select(F.col("node").alias("cls"), F.col("component").alias("root")), "cls", "left")
    named = keep(named.withColumn("root", F.coalesce("root", "cls")), "similar-members")
    lows = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc").alias("low"))
    return named.join(lows, "root", "left").select("row", "doc", "n", "cls", "root", F.when(F.col("root").isNull(), F.col("doc")).otherwise(F.col("low")).alias("component"))


def keep_first(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each component, that with the smallest id (a missing one last), whole; rows without a component's root stay.

    Of rows equal in id and text one stays. ``found`` is the result of ``linked``.
    """
    found = keep(found.select("row", "doc", "root"), "similar-found")
    by = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("row").alias("row"))
    first = found.filter("root IS NOT NULL").groupBy("root").agg(F.min(by).alias("first")).select("root", F.col("first.row").alias("chosen"))
    gone = found.join(first, "root").filter("row <> chosen").select("row").distinct()
    many = found.filter("root IS NOT NULL").groupBy("row").count().filter("count > 1").select("row")
    key = free(docs, "row_key")[0]
    keyed = docs.withColumn(key, row_key(F.col(id_col).cast("long"), F.col(text_col)))
    kept = keyed.join(gone.withColumnRenamed("row", key), key, "left_anti")
    many = keep(many.withColumnRenamed("row", key), "similar-many")
    if many.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(many, key, "left_semi").dropDuplicates([key])
    return kept.join(many, key, "left_anti").unionByName(once).select(docs.columns)
