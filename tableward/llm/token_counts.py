"""Token counts of sections by offset-mapped attribution.

Each text is encoded once, as a whole. Token spans in characters follow from the ids, since a byte-level vocabulary
loses nothing: token k begins where the bytes of the tokens before it end. Sections are then joined with the tokens on
these intervals, by binary search in the sorted spans.

Tokens that cross an edge of a section are allocated by one of two rules, both additive over sections that tile a text:

* ``n_tokens``: the token goes to the section that holds its first character;
* ``token_share``: the token is divided by characters (a token within one character by equal parts of it).

Defined cases: a missing or empty text has no sections and gives no rows; repeated rows give repeated results; a section may be empty, overlap
others or leave gaps; edges outside the text are moved to its ends; a missing edge or section list gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableward.llm import packed, tokens
from tableward.llm import sequences as sq
from tableward.llm.ship import ship

OUT = pa.schema([("section", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("token_share", pa.float64()), ("n_cut", pa.int64()), ("doc_tokens", pa.int64())])
_OUT_DDL = "section long, start long, end long, n_tokens long, token_share double, n_cut long, doc_tokens long"


def spans_of(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token, from the text's bytes and the tokens' byte counts."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    return char[at[:-1]], char[at[1:] - 1] + 1


def line_sections(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a text as character spans, each with the line feed that ends it."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    char = np.cumsum((data & 0xC0) != 0x80)
    end = char[np.flatnonzero(data == 10)]
    end = end if len(end) and end[-1] == char[-1] else np.append(end, char[-1])
    return np.concatenate([[0], end[:-1]]), end


def attribute(first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray):
    """n_tokens, token_share and n_cut of sections ``start .. end`` over token spans ``first .. last``."""
    begin = np.maximum.accumulate(first) if len(first) else first

    def before(edge: np.ndarray) -> np.ndarray:
        """Tokens, whole and in part, that lie before the character at ``edge``."""
        if not len(first):
            return np.zeros(len(edge))
        k = np.searchsorted(last, edge, "right")  # the first token that ends beyond the edge
        part = np.clip(edge - first[np.minimum(k, len(first) - 1)], 0, None) / np.maximum(1, (last - first)[np.minimum(k, len(first) - 1)])
        return np.where(k < len(first), k + part, len(first)).astype(np.float64)

    n = np.searchsorted(begin, end, "left") - np.searchsorted(begin, start, "left")
    cut = np.zeros(len(start), np.int64)
    for edge in (start, end):
        k = np.searchsorted(last, edge, "right")
        k = np.minimum(k, max(0, len(first) - 1))
        cut += (first[k] < edge) & (edge < last[k]) if len(first) else 0
    return np.maximum(n, 0), np.maximum(before(end) - before(start), 0), cut


def count_sections(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, ranks: str | None = None
) -> DataFrame:
    """One row per document and section.

    ``sections_col`` names a column array<struct<start long, end long>> of character spans; without it the sections are
    the text's lines. ``section`` is the place in that list.
    """
    ship(docs.sparkSession)
    ranks = ranks or tokens.default_ranks()
    own = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), *([F.col(sections_col).alias("sections")] if sections_col else []))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = tokens.token_bytes(ranks)
        for batch in batches:
            data, at = sq.texts(batch.column(1))
            wanted = batch.column(2).to_pylist() if sections_col else None
            parts: list[tuple[np.ndarray, ...]] = []
            for i in range(batch.num_rows):
                own_bytes = data[at[i] : at[i + 1]]
                if not len(own_bytes):
                    continue
                ids = tokens.encode(own_bytes.tobytes().decode(), ranks)
                first, last = spans_of(own_bytes, sizes[ids])
                if wanted is None:
                    start, end = line_sections(own_bytes)
                    number = np.arange(len(start))
                else:
                    given = [(k, s["start"], s["end"]) for k, s in enumerate(wanted[i] or []) if s and s["start"] is not None and s["end"] is not None]
                    number, start, end = np.array(given, np.int64).reshape(-1, 3).T
                    start, end = (np.clip(x, 0, last[-1]) for x in (start, end))
                n, share, cut = attribute(first, last, start, end)
                parts.append((np.full(len(start), i), number, start, end, n, share, cut, np.full(len(start), len(ids))))
            if parts:
                row, *columns = (np.concatenate(x) for x in zip(*parts))
                table = pa.table([batch.column(0).take(pa.array(row)), *(pa.array(x, f.type) for x, f in zip(columns, OUT))], schema=pa.schema([batch.schema.field(0), *OUT]))
                yield from table.to_batches(max_chunksize=200_000)

    kind = own.schema["doc"].dataType.simpleString()
    return own.mapInArrow(counted, f"doc {kind}, {_OUT_DDL}").withColumnRenamed("doc", id_col)
