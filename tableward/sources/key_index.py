"""Idempotent loads into a table of files that keeps an index of its keys, so a batch reads only files that may hold them.

A table at ``path`` holds one folder per load (``load=1``, ``load=2``, ...). Beside it, ``path-index/load=n`` holds one row per file with the
least and greatest first key column and the number of rows, and ``path-bloom/load=n`` the file's Bloom filter: ``words`` words of 64 bits, of
which each key sets ``BITS`` bits in one word, so that a key is tested by an equi-join on the word. Words without a bit are not stored.

A load is written in the order data, Bloom filter, index. The index row is what makes it part of the table: a load that failed before it is
written anew under the same number. The batch is judged against the loads before it, so a repeated batch brings nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableward.session import keep

BITS = 4
#: Words per file: at 12 bits a key this suits files of about 350,000 rows; more rows raise the share of files read in vain, nothing else.
WORDS = 1 << 16
#: Intervals that stand for a batch's keys when file ranges are compared with them.
SLICES = 64


def _hash(key: list[str]) -> Column:
    return F.xxhash64(*key)


def _word(key: list[str], words: int) -> Column:
    return F.pmod(F.shiftright(_hash(key), 32), F.lit(words)).cast("int")


def _mask(key: list[str]) -> Column:
    """A word with the key's bits, taken from the half of the hash that does not choose the word."""
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        bit = F.shiftrightunsigned(_hash(key), 6 * k).bitwiseAND(F.lit(63)).cast("int")
        # the number of bits to shift is a column, so the shift is written in SQL form
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def _index_schema(schema: T.StructType, key: list[str]) -> T.StructType:
    kind = schema[key[0]].dataType
    fields = [("path", T.StringType()), ("lo", kind), ("hi", kind), ("rows", T.LongType()), ("load", T.IntegerType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


_BLOOM = T.StructType(
    [T.StructField(n, t) for n, t in (("path", T.StringType()), ("word", T.IntegerType()), ("bits", T.LongType()), ("load", T.IntegerType()))]
)


def _index(spark: SparkSession, path: str, schema: T.StructType, key: list[str]) -> DataFrame | None:
    """Index rows of the loads that are complete, or None before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-index")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(_index_schema(schema, key)).parquet(f"{path}-index")


def read_indexed(spark: SparkSession, path: str, schema: T.StructType, key: list[str]) -> DataFrame:
    """The table: rows of complete loads."""
    index = _index(spark, path, schema, key)
    last = index.agg(F.max("load")).first()[0] if index is not None else None
    if last is None:
        return spark.createDataFrame([], schema)
    numbered = T.StructType([*schema.fields, T.StructField("load", T.IntegerType())])
    # a later load, if there is one, has failed
    return spark.read.schema(numbered).parquet(path).filter(F.col("load") <= last).select(*schema.names)


def may_hold(index: DataFrame, bloom: DataFrame, keys: DataFrame, key: list[str], words: int = WORDS) -> DataFrame:
    """(path): files of the index that may hold one of ``keys``; every file that does is among them.

    First by range: the keys are cut into at most ``SLICES`` intervals, and a file stays if its range meets one. Then by Bloom filter, unless testing
    each key against each file left would be more work than reading the files' keys.
    """
    spread = keys.filter(F.col(key[0]).isNotNull()).repartitionByRange(SLICES, key[0])
    ends = spread.groupBy(F.spark_partition_id().alias("slice")).agg(F.min(key[0]).alias("lo"), F.max(key[0]).alias("hi"), F.count(F.lit(1)).alias("n"))
    slices = ends.collect()  # at most SLICES rows
    meets = F.lit(False)
    for s in slices:
        meets = meets | ((F.col("lo") <= F.lit(s.hi)) & (F.col("hi") >= F.lit(s.lo)))
    near = index.filter(meets)
    work = near.agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows")).first()
    if not work.files or work.files * sum(s.n for s in slices) > work.rows * BITS:
        return near.select("path")
    tested = keys.select(F.col(key[0]).alias("_key"), _word(key, words).alias("word"), _mask(key).alias("_mask"))
    held = bloom.join(near.select("path", "lo", "hi"), "path").join(tested, "word")
    hit = F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask")
    return held.filter(hit & F.col("_key").between(F.col("lo"), F.col("hi"))).select("path").distinct()


def append_indexed(batch: DataFrame, path: str, key: list[str], files: int | None = None, words: int = WORDS) -> dict[str, int]:
    """Append the batch rows whose key the table lacks; repeated keys in the batch count once, with their least row.

    Same rows as ``changes.idempotent_append``, so a key with a missing column equals no other and its rows are appended once per batch. Returns the load's
    number, rows appended, files read and files there were. ``files`` is the number of files to write (else adaptive execution chooses). One load runs at
    a time.
    """
    spark, schema = batch.sparkSession, batch.schema
    if "load" in schema.names:
        raise ValueError("a column named load would clash with the table's folders")
    index = _index(spark, path, schema, key)
    rest = [c for c in batch.columns if c not in key]
    grouped = batch.groupBy(*key)
    once = grouped.agg(F.min(F.struct(*rest)).alias("_row")).select(*key, "_row.*") if rest else batch.distinct()
    fresh = keep(once.select(*schema.names), "batch")
    number, known, read = 1, 0, []
    if index is not None:
        there = index.agg(F.max("load").alias("last"), F.count(F.lit(1)).alias("n")).first()
        number, known = (there.last or 0) + 1, there.n
        bloom = spark.read.schema(_BLOOM).parquet(f"{path}-bloom").filter(F.col("load") < number)
        read = [r.path for r in may_hold(index, bloom, fresh.select(*key), key, words).collect()]  # names, as Spark lists a table's files
        if read:
            held = spark.read.schema(schema).parquet(*read).select(*key)
            fresh = fresh.join(held, key, "left_anti").select(*schema.names)
    target = f"{path}/load={number}"
    order = [key[0], _hash(key)]
    placed = fresh.repartitionByRange(files, *order) if files else fresh.repartitionByRange(*order)
    placed.write.mode("overwrite").parquet(target)
    written = spark.read.schema(schema).parquet(target)
    entries = written.select(F.col("_metadata.file_path").alias("path"), F.col(key[0]).alias("k"), _word(key, words).alias("word"), _mask(key).alias("mask"))
    bits = entries.groupBy("path", "word").agg(F.bit_or("mask").alias("bits"))
    bits.sort("word").write.mode("overwrite").parquet(f"{path}-bloom/load={number}")
    ranges = entries.groupBy("path").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("rows"))
    ranges = keep(ranges, "index")
    added = ranges.agg(F.sum("rows")).first()[0] or 0
    ranges.coalesce(1).write.mode("overwrite").parquet(f"{path}-index/load={number}")
    return {"load": number, "added": added, "files_read": len(read), "files": known}
