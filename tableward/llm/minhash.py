"""Near duplicates by circulant MinHash: two permutations make all coordinates of a signature.

A document's set holds the distinct ``WORDS``-word shingles of its text, A to Z in lower case; with fewer words the whole sequence is the one
shingle. Two documents link when 100 x intersection >= ``PERCENT`` x union.

1. Signature. A first permutation puts each shingle at one of 2^32 places. Coordinate k is the least value of a second permutation, circularly shifted by
   k, over the places of the set. So ``COORDINATES`` hash functions need two permutations, not one each, and their values are about as independent.
2. Banding. ``ROWS`` coordinates in turn make a band; its hash is a key. Sets at similarity s share a given band with probability s^ROWS: at the
   threshold 32 bands of 4 all miss with probability (1 - 0.85^4)^32, below 10^-10.
3. Verification. Sets that share a key are compared on their whole texts (``similar.linked``), and links form components.

Work that can grow faster than the table: documents that share bands but are not linked are compared in pairs by their odd sketches, inside one join.

Defined cases: a missing text, or one without words, has an empty set and links with nothing; repeated rows get equal results; rows without an
id link like others, and a component without any id has none. ``kept`` tells whether a row carries its component's id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableward.llm import sequences as sq
from tableward.llm import similar
from tableward.llm.batches import text_batches
from tableward.llm.ship import ship

WORDS = 5
PERCENT = 85
COORDINATES = 128
#: Coordinates in a band.
ROWS = 4
#: Shingles taken at once, so that their values stay in a core's cache.
_STEP = 256
_U, _V = np.uint64, np.uint32


def first_permutation(own: np.ndarray) -> np.ndarray:
    """Places of shingles, 32 bits of a mixed hash."""
    return (sq.mix(own + _U(0x5D1B3A0C49E2F687)) >> _U(32)).astype(_V)


def second_permutation(place: np.ndarray) -> np.ndarray:
    """A one-to-one map of 32-bit numbers, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        place ^= place >> _V(shift)
        place *= _V(factor)
    place ^= place >> _V(16)
    return place


def signature(own: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Least values under the shifts 0, 1, ... of the second permutation. ``own`` has at least one shingle hash."""
    place = first_permutation(own)
    shift = np.arange(coordinates, dtype=_V)
    least = np.full(coordinates, 0xFFFFFFFF, _V)
    for at in range(0, len(place), _STEP):
        values = second_permutation(place[at : at + _STEP, None] - shift)
        np.minimum(least, values.min(axis=0), out=least)
    return least


def bands(own: np.ndarray, coordinates: int = COORDINATES, rows: int = ROWS) -> list[int]:
    """One 64-bit key per band; zeros for an empty set."""
    count = coordinates // rows
    if not len(own):
        return [0] * count
    parts = signature(own, count * rows).astype(_U).reshape(count, rows)
    key = np.arange(1, count + 1, dtype=_U)
    for k in range(rows):
        key = sq.mix(key * _U(0x9E3779B97F4A7C15) + parts[:, k])
    return key.view(np.int64).tolist()


def groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
    coordinates: int = COORDINATES, rows: int = ROWS,
) -> DataFrame:
    """(row, doc, n, cls, root, component) per document: its set's size, class and component."""
    ship(docs.sparkSession)
    own = similar.rows_of(docs, id_col, text_col)
    names = [f"band{k}" for k in range(coordinates // rows)]
    with text_batches(docs.sparkSession):
        known = similar.facts(own, words, lambda s: bands(s, coordinates, rows), names)
        reps = similar.classes(known)
        of_class = known.select("row", *names).join(reps.select("row", "cls"), "row").dropDuplicates(["row"])
        keys = of_class.select(F.explode(F.array(*names)).alias("key"), "cls")
        return similar.linked(own, known, reps, keys, words, percent)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, n_shingles, component_id and whether it stays."""
    return groups(docs, id_col, text_col).select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc").eqNullSafe(F.col("component")).alias("kept")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group, that with the smallest id, with its own columns."""
    return similar.keep_first(docs, groups(docs, id_col, text_col, words, percent), id_col, text_col)
