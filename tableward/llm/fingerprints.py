"""Document fingerprints: threshold-scaled sketches of word shingles. DataFrame and SQL functions only.

A sketch holds the hash of every ``WORDS``-word shingle that falls below the fraction 1 / ``SCALE`` of the hash range, and the least hash of all, so that
only a text without words has an empty one. Sizes follow the texts, the threshold is the same for all: the shingles kept of a small text are
kept of a large one that contains it, so containment can be estimated between very unequal texts, and the sketch of several texts
together is the union of theirs without the hashes above the threshold (``merged``).

Words are runs without ASCII white space, in lower case. Fewer than ``WORDS`` words are one shingle. The fingerprint is the sketch as 16 hexadecimal digits per
hash, ascending. Defined cases: a missing text is empty; two empty sketches have likeness 1, an empty and another 0; repeated rows follow each other in
the order of ids; missing ids come first; a single document is its own next one.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
SCALE = 8
LIMIT = -(2**63) + 2**64 // SCALE
_GAP = r"[\x20\x09-\x0D]+"


def sketch(text: str, words: int = WORDS, scale: int = SCALE) -> Column:
    """Column: ascending distinct hashes kept of the text in column ``text``."""
    limit = -(2**63) + 2**64 // scale
    gap = _GAP.replace("\\", "\\\\")
    listed = f"filter(split(lower({text}), '{gap}'), w -> w <> '')"
    hashed = f"""transform(array({listed}), w -> if(size(w) = 0, array(), transform(sequence(0, greatest(size(w) - {words}, 0)), i -> xxhash64(slice(w, i + 1, {words})))))[0]"""
    kept = f"transform(array(named_struct('all', h, 'least', array_min(h))), s -> filter(s.all, x -> x < {limit} OR x = s.least))[0]"
    return F.expr(f"transform(array({hashed}), h -> array_sort(array_distinct({kept})))[0]")


def fingerprint(hashes: str | Column) -> Column:
    """Column: the sketch as text."""
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(x: str, y: str) -> Column:
    """Column: estimated Jaccard similarity of the shingle sets."""
    either = F.size(F.array_union(x, y))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / either)


def containment(x: str, y: str) -> Column:
    """Column: estimated share of x's shingles that y has too; null for an empty sketch."""
    return F.size(F.array_intersect(x, y)) / F.nullif(F.size(x), F.lit(0))


def merged(hashes: str | Column, scale: int = SCALE) -> Column:
    """Aggregate: the sketch of all texts of a group together, from their sketches. The result grows with the group's distinct shingles."""
    limit = -(2**63) + 2**64 // scale
    return F.array_sort(F.filter(F.array_distinct(F.flatten(F.collect_set(hashes))), lambda x: x < limit))


def with_next(docs: DataFrame, values: list[str], derived: dict[str, Column], id_col: str = "doc") -> DataFrame:
    """Each row with columns ``derived`` of its values, and ``next_<name>`` of every value and derived column of the row after it in ascending order of ``id_col``; after the last comes the first.

    Rows are dealt to ranges of ids, about as many as shuffle partitions, cut at approximate percentiles; an id at which several cuts fall, or a
    missing one, is cut further by the hash of its values, so it has as many ranges as its share of the rows asks for. A guard row at the end of each
    range holds what the next range begins with. One window per range then sees every neighbour. Only the cut points (numbers) reach the driver.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = [k / parts for k in range(1, parts)] or [0.5]
    found = docs.agg(F.percentile_approx(id_col, at, 100 * parts).alias("c"), F.count_if(F.col(id_col).isNull()).alias("missing"), F.count(F.lit(1)).alias("n")).first()
    times = Counter(found["c"] or [])
    cuts = F.array(*(F.lit(c) for c in sorted(times))) if times else F.array().cast("array<bigint>")
    base = F.coalesce(F.size(F.filter(cuts, lambda c: c <= F.col(id_col))), F.lit(0))
    # hashes, as 31-bit numbers in their own order, cut a common id into as many ranges as cuts fall on it; higher ids follow these
    place = F.shiftrightunsigned(F.col("_order").bitwiseXOR(F.lit(-(2**63))), 33)
    of = lambda n: F.shiftright(place * n, 31)
    many = [F.lit(x) for c, n in times.items() if n > 1 for x in (c, n)]
    share = F.when(F.col(id_col).isNull(), F.lit(-(-parts * found["missing"] // max(found["n"], 1))))
    share = share.otherwise(F.try_element_at(F.create_map(*many), F.col(id_col))) if many else share
    cut = docs.select(id_col, *values, F.xxhash64(*values).alias("_order")).withColumn("_range", base * F.lit(parts + 2) + F.coalesce(of(share), F.lit(parts + 1)))

    # one row per range: the id and hash with which the next one begins; a missing id is the smallest
    whole = Window.orderBy("_range")
    heads = cut.groupBy("_range").agg(F.min(F.struct(F.col(id_col).isNotNull().alias("some"), F.col(id_col).alias("id"), "_order")).alias("_head"))
    first = F.first("_head").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("_range").alias("_of"), F.when(F.lead("_range").over(whole).isNull(), first).otherwise(F.lead("_head").over(whole)).alias("_head"))
    # one row of numbers per range, of which there are at most about twice as many as shuffle partitions
    begins = F.col(id_col).eqNullSafe(F.col("_head.id")) & (F.col("_order") == F.col("_head._order"))
    guards = cut.drop("_range").join(F.broadcast(heads), begins).groupBy("_of").agg(F.first(F.struct(id_col, *values, "_order")).alias("_row"))
    guards = guards.select("_row.*", F.col("_of").alias("_range"), F.lit(1).alias("_guard"))
    rows = cut.withColumn("_guard", F.lit(0)).unionByName(guards).withColumns(derived)
    order = Window.partitionBy("_range").orderBy("_guard", F.col(id_col).asc_nulls_first(), "_order")
    every = [*values, *derived]
    return rows.select(id_col, *every, "_guard", *(F.lead(v).over(order).alias(f"next_{v}") for v in every)).filter("_guard = 0").drop("_guard")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and likeness to the edited text's and the next document's.

    Edited: the last half of the characters, rounded down, is replaced by as many from the beginning of the next document.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = with_next(own, ["text"], {"own": sketch("text")})
    n = F.char_length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = both.withColumn("n_chars", n).withColumn("edited", F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("next_text", F.lit(1), half)))
    told = edited.select("doc", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", sketch("edited").alias("other"), F.col("next_own").alias("after"))
    return told.select(
        F.col("doc").alias(id_col),
        "n_chars",
        "edited_sha256",
        fingerprint("own").alias("fingerprint"),
        fingerprint("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"),
        likeness("own", "after").alias("near_next"),
    )
