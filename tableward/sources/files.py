"""Reading tables and rewriting their files. Every write goes to a new folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableward.functions.skew import with_position
from tableward.session import keep

MB = 1024 * 1024


def read_table(spark: SparkSession, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A catalog table, or a parquet folder when ``name`` is a path; no schema inference when given one."""
    if "/" in name or ":" in name:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(name)
    return spark.table(name)


def save_table(df: DataFrame, name: str, comment: str | None = None) -> None:
    """Create or replace a catalog table from a result."""
    writer = df.write.mode("overwrite").format("parquet")
    writer.saveAsTable(name)
    if comment:
        df.sparkSession.sql(f"COMMENT ON TABLE {name} IS :c", {"c": comment})


def append_table(df: DataFrame, name: str) -> None:
    df.write.mode("append").format("parquet").saveAsTable(name)


def with_comments(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """Attach column comments, kept when the result is saved as a table."""
    return described(df, {c: {"comment": text} for c, text in comments.items()})


def described(df: DataFrame, columns: dict[str, dict]) -> DataFrame:
    """Columns with their meaning: ``comment``, ``synonyms`` and, left out of the result, ``hidden``."""
    kept = [c for c in df.columns if not columns.get(c, {}).get("hidden")]
    return df.select(*[F.col(c).alias(c, metadata=columns[c]) if c in columns else F.col(c) for c in kept])


def publish_views(tables: dict[str, DataFrame]) -> None:
    """Results by name for questions in SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def table_detail(df: DataFrame) -> DataFrame:
    """Folder, number of files and bytes of a file-based table, from the files Spark reads.

    Files are reduced to one row each on the map side before they are counted.
    """
    files = df.select(
        F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
    )
    return (
        files.groupBy("folder", "path")
        .agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
        .groupBy("folder")
        .agg(
            F.count(F.lit(1)).alias("num_files"),
            F.sum("size").alias("size_bytes"),
            F.sum("n").alias("rows"),
        )
    )


def partition_detail(df: DataFrame, partition: str) -> DataFrame:
    """Files and bytes per value of a partition column."""
    files = df.select(
        F.col(partition), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")
    ).groupBy(partition, "path").agg(F.max("size").alias("size"))
    return files.groupBy(partition).agg(F.count(F.lit(1)).alias("num_files"), F.sum("size").alias("size_bytes"))


def file_sizes(df: DataFrame) -> DataFrame:
    """(folder, path, size, rows) of each file of a file-based table that has rows."""
    meta = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    files = meta.groupBy("path").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "path", "size", "rows")


def packed_groups(files: DataFrame, target: int, chunk: int = 500) -> DataFrame:
    """(folder, path, bin): files put into bins of at most ``target`` bytes by first-fit decreasing, per folder.

    ``files`` has (folder, path, size). Files of a folder are ranked by size and dealt into chunks of about ``chunk``, each with the whole range of
    sizes, so that neither the list of files nor that of bins in a cell grows with a folder.
    """
    by_size = Window.partitionBy("folder").orderBy(F.desc("size"), "path")
    per_folder = F.count(F.lit(1)).over(Window.partitionBy("folder"))
    placed = files.withColumn("_chunk", F.row_number().over(by_size) % F.ceil(per_folder / chunk))
    cells = placed.groupBy("folder", "_chunk").agg(F.sort_array(F.collect_list(F.struct("size", "path")), asc=False).alias("files"))
    start = "CAST(array() AS array<struct<used: bigint, files: array<string>>>)"
    # the first bin with room takes the file, else a new one
    room = f"array_position(transform(acc, b -> b.used + f.size <= {int(target)}), true)"
    grown = "transform(acc, (b, i) -> IF(i + 1 = p, named_struct('used', b.used + f.size, 'files', array_append(b.files, f.path)), b))"
    opened = "array_append(acc, named_struct('used', f.size, 'files', array(f.path)))"
    step = f"element_at(transform(array({room}), p -> IF(p = 0, {opened}, {grown})), 1)"
    bins = cells.select("folder", "_chunk", F.expr(f"aggregate(files, {start}, (acc, f) -> {step})").alias("bins"))
    return bins.select("folder", "_chunk", F.posexplode("bins").alias("_n", "b")).select("folder", F.explode("b.files").alias("path"), F.concat_ws("/", "_chunk", "_n").alias("bin"))


def compact(df: DataFrame, path: str, target_mb: float = 128, full: float = 0.9) -> DataFrame:
    """Rewrite the small files of a file-based table into files of at most ``target_mb``; returns the new table's files.

    Files of at least ``full`` of the target stay where they are, under their names, and so does a small file that no other fits beside. The others are
    packed per folder (``packed_groups``) and each group becomes one file. The result, also written to ``path`` as the version's list, has
    (path, size, rows, kept, sources); ``read_version`` reads the table by it. Nothing is deleted: readers of the old files go on.
    """
    spark, target = df.sparkSession, int(target_mb * MB)
    files = keep(file_sizes(df), "files")
    groups = packed_groups(files.filter(F.col("size") < full * target), target)
    several = groups.withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy("folder", "bin"))).filter("_of > 1")
    bins = several.select("folder", "bin").distinct()
    numbered = keep(with_position(bins, [F.asc("folder"), F.asc("bin")], "group"), "bins")
    chosen = keep(several.join(numbered, ["folder", "bin"]).select("path", (F.col("group") - 1).cast("int").alias("group")), "groups")
    stay = files.join(chosen, "path", "left_anti").select("path", "size", "rows", F.lit(True).alias("kept"), F.lit(1).cast("long").alias("sources"))
    n = numbered.count()
    if not n:
        stay.write.parquet(f"{path}/version")
        return spark.read.parquet(f"{path}/version")
    small = df.select("*", F.col("_metadata.file_path").alias("_path")).join(chosen.withColumnRenamed("path", "_path"), "_path")
    small.repartitionById(n, F.col("group")).drop("_path", "group").write.parquet(f"{path}/files")
    made = file_sizes(spark.read.schema(df.schema).parquet(f"{path}/files")).select("path", "size", "rows")
    # a task writes one group, so the number in its file's name is the group's
    made = made.withColumn("group", F.regexp_extract("path", "/part-([0-9]+)-[^/]*$", 1).cast("int"))
    counts = chosen.groupBy("group").agg(F.count(F.lit(1)).alias("sources"))
    made = made.join(counts, "group", "left").select("path", "size", "rows", F.lit(False).alias("kept"), "sources")
    stay.unionByName(made).write.parquet(f"{path}/version")
    return spark.read.parquet(f"{path}/version")


def read_version(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table that ``compact`` left: files that stayed and files that were written."""
    names = [r.path for r in spark.read.parquet(f"{path}/version").select("path").collect()]  # as Spark lists a table's files
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def cluster_layout(df: DataFrame, path: str, columns: list[str], partitions: int | None = None, bits: int = 8) -> DataFrame:
    """Write rows along a space-filling curve over ``columns`` so that minima and maxima of files prune scans by any of them.

    Each value becomes its rank among 2^bits quantile cuts of its column (one pass, approximate cuts only move borders), the ranks' bits are interleaved
    (Z-order), and rows are written in ranges of that number. A hash of the row ends the range key: rows with one very common value are spread over
    several files. Missing values rank first; texts rank by their first seven bytes.
    """
    cuts = _cuts(df, columns, bits)
    ranks = [_rank(df, c, cuts[c]) for c in columns]
    z = F.lit(0).cast("long")
    for bit in range(bits):
        for at, rank in enumerate(ranks):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(columns) + at))
    placed = df.select("*", z.alias("_z"))
    key = ["_z", F.xxhash64(*df.columns)]
    spread = placed.repartitionByRange(partitions, *key) if partitions else placed.repartitionByRange(*key)
    spread.sortWithinPartitions("_z").drop("_z").write.parquet(path)
    out = table_detail(df.sparkSession.read.schema(df.schema).parquet(path))
    return out.agg(F.sum("num_files").alias("files"), F.sum("rows").alias("rows"))


def _ordinal(df: DataFrame, column: str) -> Column:
    """A number that ascends with the column."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.encode(F.substring(c, 1, 7), "UTF-8")).substr(1, 14), 14, "0"), 16, 10).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def _cuts(df: DataFrame, columns: list[str], bits: int) -> dict[str, list[float]]:
    """Quantile cuts of each column, at most 2^bits - 1 of them."""
    shares = [k / 2**bits for k in range(1, 2**bits)]
    found = df.agg(*(F.percentile_approx(_ordinal(df, c), shares, 20 * 2**bits).alias(f"q{k}") for k, c in enumerate(columns))).first()
    return {c: sorted(set(found[f"q{k}"] or [])) for k, c in enumerate(columns)}


def _rank(df: DataFrame, column: str, cuts: list[float]) -> Column:
    """Number of cuts at or below the value, by halving: as many comparisons as the rank has bits."""
    value = _ordinal(df, column)

    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(value < F.lit(cuts[middle]), within(lo, middle)).otherwise(within(middle + 1, hi))

    return F.coalesce(F.when(value.isNotNull(), within(0, len(cuts))), F.lit(0))


def files_read(df: DataFrame, column: str, low, high) -> tuple[int, int]:
    """(files whose range of a column meets an interval, all files): what a filter on it has to read."""
    ends = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    row = ends.agg(F.count_if((F.col("lo") <= F.lit(high)) & (F.col("hi") >= F.lit(low))).alias("n"), F.count(F.lit(1)).alias("whole")).first()
    return row.n, row.whole


def archive(df: DataFrame, path: str, time: str) -> DataFrame:
    """Write rows by month of ``time``; returns rows per month read back from the archive.

    The rebalance hint gathers a month's rows into few files and lets adaptive execution split a large month.
    """
    monthly = df.withColumn("month", F.date_format(time, "yyyyMM").cast("int"))
    monthly.hint("rebalance", "month").write.partitionBy("month").parquet(path)
    back = df.sparkSession.read.schema(monthly.schema).parquet(path)
    return back.groupBy("month").agg(F.count(F.lit(1)).alias("archived_n"))


def export_csv(df: DataFrame, path: str) -> DataFrame:
    """CSV with a header, quotes inside values doubled; returns what was written."""
    options = {"header": True, "quote": '"', "escape": '"', "quoteAll": False}
    df.write.options(**options).csv(path)
    return df.sparkSession.read.schema(df.schema).options(**options).csv(path)


def bind(spark: SparkSession, statement: str, tables: dict[str, str], **values) -> DataFrame:
    """Run a statement whose table names (``IDENTIFIER(:name)``) and values are parameters."""
    return spark.sql(statement, args={**tables, **values})
