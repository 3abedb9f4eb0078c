"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame and SQL functions only.

1. Targets. Sources in code point order (missing last) weigh ``WEIGHTS`` in turn and share the total size; a target stops at
   ``MAX_REPEATS`` times its source's size and the excess goes to the others by weight (``targets``).
2. Blocks. The documents of a source stand in a random order, by a hash; read round and round they are a stream of words, of which the source gives
   as many as its target. The stream is cut into blocks of equal size, so a source has an exact quota of blocks.
3. Tree. The output shards are halved again and again. At each node the blocks of every source are divided between the two halves by exact
   draws without replacement, filling the halves to their capacity: together a multivariate hypergeometric draw (``split``).
4. Draw. A source's blocks, permuted, go to the shards by these quotas, so no block is drawn twice. Within a shard, pieces are ordered by a hash.

The tree works on one row per node and source; its blocks are at most ``shards * blocks_per_shard`` plus one per source, whatever the size of
the input. Positions in a stream come from sums over hash ranges, so a source with a third of all rows is spread over ``RANGES`` windows.

Defined cases: a missing or empty text has size 0 and gives nothing; a source of size 0 has target 0; ids may be missing or repeat, each row
counts, and its pieces are cut out of its own text; without words every target is 0; an empty table gives no rows. All randomness is hashed from ids and ``seed``, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableward.llm.names import free
from tableward.session import keep

#: The weights of the sources in turn and the most a text may be repeated.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Hash ranges per source within which documents are put in order.
RANGES = 1024
#: Tasks among which the documents of a shard are spread.
PARTS = 16
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, place, target) from (source, source_size): one row per source.

    Filled like water: in order of the size at which a source is full, per weight, it is capped while its share of what is left reaches its cap. The
    windows run over the table of sources, which one task holds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sources.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    cap = (F.col("source_size") * most).cast("double")
    full = placed.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = full.withColumn("level", left / weight_left).withColumn("capped", F.col("ratio") <= F.col("level"))
    free = F.min(F.when(~F.col("capped"), F.struct("ratio", "place", "level"))).over(every)["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(free * F.col("weight"))
    return level.withColumn("target", target).select("source", "source_size", "place", "target")


def split(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(place, shard, n): how many of the blocks of each source go to each shard. ``quotas`` has (place, n).

    A node holds the shards ``low .. high - 1``. Its left half takes its share of the node's blocks; source after source, block after block,
    each goes left with probability (places left) / (blocks left), which is sampling without replacement.
    """
    node = quotas.select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "place", "n")
    node = node.withColumn("blocks", F.sum("n").over(Window.partitionBy("low", "high")))
    while shards > 1:
        node = keep(_halved(node, seed), "mixing-tree")
        shards = (shards + 1) // 2
    return node.select("place", F.col("low").alias("shard"), "n")


def _halved(node: DataFrame, seed: int) -> DataFrame:
    """Each node of several shards replaced by its halves. ``blocks`` are those of the node."""
    many = node.filter("high - low > 1").groupBy("low", "high", "blocks").agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("sources"))
    drawn = f"""aggregate(sources,
        named_struct('rest', blocks, 'room', blocks * ((high - low) div 2) div (high - low), 'left', cast(array() as array<bigint>)),
        (state, s) -> transform(array(aggregate(sequence(1L, s.n),
                named_struct('rest', state.rest, 'room', state.room, 'got', 0L),
                (x, i) -> if(pmod(xxhash64({seed}, low, high, s.place, i), 1000000007) * x.rest < 1000000007 * x.room,
                    named_struct('rest', x.rest - 1, 'room', x.room - 1, 'got', x.got + 1),
                    named_struct('rest', x.rest - 1, 'room', x.room, 'got', x.got)))),
            x -> named_struct('rest', x.rest, 'room', x.room, 'left', concat(state.left, array(x.got))))[0]).left"""
    halves = many.withColumn("left", F.expr(drawn)).withColumn("middle", F.expr("low + (high - low) div 2"))
    halves = halves.withColumn("went", F.expr("aggregate(left, 0L, (a, x) -> a + x)"))
    rows = halves.select("low", "middle", "high", "blocks", "went", F.explode(F.arrays_zip("sources", "left")).alias("s"))
    left = rows.select("low", F.col("middle").alias("high"), "s.sources.place", F.col("s.left").alias("n"), F.col("went").alias("blocks"))
    right = rows.select(F.col("middle").alias("low"), "high", "s.sources.place", (F.col("s.sources.n") - F.col("s.left")).alias("n"), (F.col("blocks") - F.col("went")).alias("blocks"))
    return left.unionByName(right).unionByName(node.filter("high - low = 1")).filter("n > 0")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    shards: int = 32,
    blocks_per_shard: int = 64,
    seed: int = 7,
    key: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    Documents: one row each with ``doc``, ``row`` (its key), ``source``, ``size``, ``source_size`` and ``target``. Pieces: the words the mix takes, as spans of documents:
    ``row``, ``doc``, ``epoch``, ``start``, ``length``, ``block``, ``shard`` and ``rank``, the hash that orders a shard.
    A ``key`` given is in both, as ``key``.
    """
    keys = [] if key is None else ["key"]
    own = docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), words(text_col).alias("size"), *([] if key is None else [key.alias("key")]))
    own = own.withColumn("hash", F.xxhash64(F.lit(seed), "doc", "size"))
    own = keep(own.withColumn("range", F.pmod(F.shiftright("hash", 40), F.lit(RANGES))), "mixing-sizes")
    aims = keep(targets(own.groupBy("source").agg(F.sum("size").alias("source_size"))), "mixing-targets")
    named = own.join(aims.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    ranges = named.groupBy("place", "range").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    so_far = Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("place", "range", *(F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"{c}_before") for c in ("words", "rows")))
    inside = Window.partitionBy("place", "range").orderBy("hash", "doc", "size", *keys).rowsBetween(Window.unboundedPreceding, 0)
    stream = (
        named.join(ranges, ["place", "range"])
        .withColumn("at", F.col("words_before") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("row", F.struct("place", (F.col("rows_before") + F.row_number().over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("number")))
    )
    stream = keep(stream.select("row", "doc", "source", "size", "place", "source_size", "target", "at", *keys), "mixing-stream")

    taken = F.floor(F.col("target") + 0.5).cast("long")
    block_words = aims.agg(F.greatest(F.lit(1), F.ceil(F.sum(taken) / (shards * blocks_per_shard))).cast("long")).first()[0] or 1
    quotas = aims.select("place", F.ceil(taken / block_words).cast("long").alias("n")).filter("n > 0")
    dealt = split(keep(quotas, "mixing-quotas"), shards, seed)
    turn = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = dealt.withColumn("from", F.coalesce(F.sum("n").over(turn), F.lit(0))).select("place", "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("draw"))
    blocks = quotas.select("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    permuted = Window.partitionBy("place").orderBy(F.xxhash64(F.lit(seed), "place", "block"), "block")
    shard_of = blocks.withColumn("draw", (F.row_number().over(permuted) - 1).cast("long")).join(drawn, ["place", "draw"]).select("place", "block", "shard")

    end = F.least(taken, F.col("begin") + F.col("size"))
    rounds = stream.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))))
    cut = (
        rounds.withColumn("begin", F.col("epoch") * F.col("source_size") + F.col("at"))
        .filter(F.col("begin") < taken)
        .withColumn("end", end)
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words))))
        .withColumn("first", F.greatest("begin", F.col("block") * block_words))
        .withColumn("last", F.least("end", (F.col("block") + 1) * block_words))
        .select("row", "place", "doc", "epoch", (F.col("first") - F.col("begin")).alias("start"), (F.col("last") - F.col("first")).alias("length"), "block", *keys)
    )
    pieces = cut.join(shard_of, ["place", "block"]).withColumn("rank", F.xxhash64(F.lit(seed), "shard", "row", "epoch", "start"))
    return stream, pieces


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: its id, size, source_size, target and taken, the words that the mix takes of it."""
    rows, pieces = mix(docs, id_col, text_col, source_col)
    taken = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    out = rows.join(taken, "row", "left")
    return out.select(F.col("doc").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 32) -> DataFrame:
    """The mix as rows of documents, in the order of its shards.

    One row per piece, with the columns of its document; a piece of a whole document has its text as it is, one that ends or begins at the edge of a
    block has its words joined by spaces. Rows of one shard are spread over ``PARTS`` tasks by the hash that orders them.
    """
    # a row is known by all it holds, as an id may be missing or have several texts; rows alike in all have the same pieces to give.
    # Both sides meet by this key, so that the texts, dealt by it once, stay where they are for the join
    key = F.unhex(F.sha2(F.concat(F.sha2(F.coalesce(text_col, F.lit("")), 256), F.to_json(F.struct(*(c for c in docs.columns if c != text_col)))), 256))
    _, pieces = mix(docs, id_col, text_col, source_col, shards, key=key)
    _key, _size, _start, _length, _shard, _rank, _group = free(docs, "key", "size", "start", "length", "shard", "rank", "group")
    own = docs.withColumn(_key, key).dropDuplicates([_key]).withColumn(_size, words(text_col))
    joined = own.join(pieces.select(F.col("key").alias(_key), F.col("start").alias(_start), F.col("length").alias(_length), F.col("shard").alias(_shard), F.col("rank").alias(_rank)), _key)
    listed = F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))
    part = F.array_join(F.slice(listed, (F.col(_start) + 1).cast("int"), F.col(_length).cast("int")), " ")
    cut = joined.withColumn(text_col, F.when(F.col(_length) == F.col(_size), F.col(text_col)).otherwise(part))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    group = F.col(_shard) * PARTS + F.pmod(F.shiftright(_rank, 32), F.lit(PARTS))
    return cut.withColumn(_group, group).repartition(_group).sortWithinPartitions(_group, _rank).select(*docs.columns)
