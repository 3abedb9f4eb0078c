"""Walks over the lineage graph and costs carried along it."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableward.functions.common import in_window
from tableward.functions.skew import with_rank_by_count
from tableward.session import keep, new_dir


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("table_id"), "target").filter("table_id <> target").distinct()


def downstream_counts(edges: DataFrame) -> DataFrame:
    """Number of distinct downstream tables one hop away, per table that has any."""
    return _pairs(edges).groupBy("table_id").agg(F.count(F.lit(1)).alias("downstream_count"))


def downstream_names(edges: DataFrame) -> DataFrame:
    """Per table: the number of distinct downstream tables one hop away, and their names (``target_name``), sorted, with commas between.

    Tables of one name in different schemas are listed each. A cell is as long as the names of the tables that depend on one table.
    """
    pairs = edges.select(F.col("source").alias("table_id"), "target", "target_name").filter("table_id <> target").distinct()
    listed = F.array_join(F.array_sort(F.collect_list("target_name")), ",")
    return pairs.groupBy("table_id").agg(F.count(F.lit(1)).alias("downstream_count"), listed.alias("downstream_names"))


def blast_radius(edges: DataFrame) -> DataFrame:
    """One row per table and distinct downstream table one hop away, with the table's count of them.

    The names stay rows: no cell grows with the number of dependents.
    """
    pairs = _pairs(edges)
    counts = pairs.groupBy("table_id").agg(F.count(F.lit(1)).alias("downstream_count"))
    return pairs.join(counts, "table_id").select("table_id", F.col("target").alias("downstream_table"), "downstream_count")


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").filter("source <> target").distinct()


class _Steps:
    """Pairs found so far, one folder per step, read back as one table: the plan does not grow with the steps."""

    def __init__(self, edges: DataFrame):
        self.spark, self.path = edges.sparkSession, new_dir(edges.sparkSession, "closure")
        self.schema = edges.select("source", "target", F.lit(1).alias("min_depth")).schema

    def add(self, pairs: DataFrame, step: int) -> None:
        pairs.select("source", "target", F.col("min_depth").cast("int").alias("min_depth")).write.parquet(f"{self.path}/step={step}")

    def known(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)

    def step(self, step: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/step={step}")


def _inner(links: DataFrame, name: str) -> DataFrame:
    """Tables with edges into and out of them, as column ``name``; paths go on only through these."""
    into, out = links.select(F.col("target").alias(name)), links.select(F.col("source").alias(name))
    return out.distinct().join(into.distinct(), name, "left_semi")


def lineage_closure(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """All reachable (source, target) pairs with the least number of hops.

    Path doubling: when all pairs up to 2^k hops are known, a shortest path of up to twice as many hops is one of exactly 2^k
    hops and a known one. So each round joins the pairs at that distance with all known pairs, and a chain of n edges takes
    log2(n) rounds; cycles end them as well. Each round is a folder of its own in the shared folder: a lost executor costs one round.
    Two paths meet in a table with edges on both sides; pairs without one at the joined end are left out of the join.

    ``start`` (table_id) limits the sources. Doubling would then compute pairs between all other tables, so the walk goes a hop at a time.
    """
    if start is not None:
        return _walk(edges, start)
    steps = _Steps(edges)
    steps.add(_edges(edges).withColumn("min_depth", F.lit(1)), 0)
    inner = keep(_inner(steps.step(0), "_middle"), "inner")
    for k in count():
        known = steps.known()
        far = known.filter(F.col("min_depth") == 2**k).select("source", F.col("target").alias("_middle")).join(inner, "_middle", "left_semi")
        if far.isEmpty():
            return known
        on = known.select(F.col("source").alias("_middle"), "target", (F.col("min_depth") + 2**k).alias("min_depth")).join(inner, "_middle", "left_semi")
        found = far.join(on, "_middle").filter("source <> target").groupBy("source", "target").agg(F.min("min_depth").alias("min_depth"))
        steps.add(found.join(known.select("source", "target"), ["source", "target"], "left_anti"), k + 1)


def _walk(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Pairs from some sources, a hop at a time; only pairs of the last step are extended.

    All edges are written once and read twice: for those out of the start, and for those out of tables that edges lead to, which any
    later hop takes. Repeated edges fall out of these two; the steps don't touch the other edges again.
    """
    links, steps = keep(edges.select("source", "target").filter("source <> target"), "links"), _Steps(edges)
    begin = keep(start.select(F.col("table_id").alias("source")).distinct(), "start")
    steps.add(links.join(begin, "source", "left_semi").distinct().withColumn("min_depth", F.lit(1)), 1)
    inner = keep(_inner(links, "source"), "inner")
    hop = links.join(inner, "source", "left_semi").distinct().select(F.col("source").alias("target"), F.col("target").alias("_next"))
    hop = keep(hop, "hops")
    for depth in count(2):
        found = steps.step(depth - 1).join(hop, "target").select("source", F.col("_next").alias("target")).filter("source <> target").distinct()
        known = steps.known()
        steps.add(found.join(known.select("source", "target"), ["source", "target"], "left_anti").withColumn("min_depth", F.lit(depth)), depth)
        if steps.step(depth).isEmpty():
            return steps.known()


def _shortest(pairs: DataFrame) -> DataFrame:
    return pairs.filter("source <> target").groupBy("source", "target").agg(F.min("min_depth").alias("min_depth"))


def closure_with(closure: DataFrame, added: DataFrame) -> DataFrame:
    """The closure after edges are added, from the stored closure before; pairs may be new or nearer.

    A path that uses added edges is an old path or none, then a part that starts with an added edge. Such parts are an added edge, with an
    old path after it or none, composed with each other until nothing gets nearer: parts with m added edges take log2(m) rounds, and only they are
    in these rounds. The stored closure is read as it is, for old paths after added edges, for those before, and for the result.
    """
    old = closure.select("source", "target", F.col("min_depth").cast("int").alias("min_depth"))
    new = keep(_edges(added).withColumn("min_depth", F.lit(1)), "added")
    after = old.select(F.col("source").alias("_to"), F.col("target").alias("_end"), F.col("min_depth").alias("_d"))
    parts = new.join(after, F.col("target") == F.col("_to")).select("source", F.col("_end").alias("target"), (F.col("min_depth") + F.col("_d")).alias("min_depth"))
    now, mark = keep(_shortest(new.unionByName(parts)), "delta"), None
    while True:
        # the sum of all hops falls, or the number of pairs grows, as long as anything changes
        total = now.agg(F.count(F.lit(1)), F.sum("min_depth")).first()
        if total == mark:
            break
        mark = total
        on = now.select(F.col("source").alias("target"), F.col("target").alias("_end"), F.col("min_depth").alias("_d"))
        longer = now.join(on, "target").select("source", F.col("_end").alias("target"), (F.col("min_depth") + F.col("_d")).alias("min_depth"))
        now = keep(_shortest(now.unionByName(longer)), "delta")
    before = old.select(F.col("source").alias("_first"), F.col("target").alias("source"), F.col("min_depth").alias("_d"))
    whole = before.join(now, "source").select(F.col("_first").alias("source"), "target", (F.col("min_depth") + F.col("_d")).alias("min_depth"))
    return _shortest(old.unionByName(now).unionByName(whole))


def pipeline_cost(runs: DataFrame, as_of, price_per_hour: float = 1.0, days: int = 90) -> DataFrame:
    """Yearly cost of failed work per pipeline.

    failure rate x average hours x runs per year x price, with runs per year scaled up from the window.
    """
    recent = runs.filter(F.col("pipeline_id").isNotNull() & in_window(runs, "start_time", as_of, days))
    total, failed = F.col("_n").cast("double"), F.col("_failed").cast("double")
    hours = F.col("_sec").cast("double") / total / F.lit(3600.0)
    yearly = total * F.lit(365.0) / F.lit(float(days))
    return (
        recent.groupBy("pipeline_id")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_if(F.col("status") == "failed").alias("_failed"),
            F.sum(F.col("duration_sec").cast("decimal(18,2)")).alias("_sec"),
        )
        .select(
            "pipeline_id",
            F.round(failed / total * hours * yearly * F.lit(float(price_per_hour)), 2)
            .cast("decimal(18,2)")
            .alias("cost_usd"),
        )
    )


def rerun_cost(runs: DataFrame, reads: DataFrame, as_of, price_per_hour: float = 1.0, days: int = 90) -> DataFrame:
    """Cost of a table: the cost of all pipelines that read it (``reads``: table_id, pipeline_id).

    Reads of pipelines without a cost go before repeated ones are looked for; a pipeline has one cost.
    """
    costs = pipeline_cost(runs, as_of, price_per_hour, days)
    return (
        reads.select("table_id", "pipeline_id")
        .join(costs, "pipeline_id")
        .distinct()
        .groupBy("table_id")
        .agg(F.sum("cost_usd").cast("decimal(18,2)").alias("rerun_cost_usd"))
    )


def maintenance_priority(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables by how often they take part in lineage, most used first (ties share a rank)."""
    degree = (
        edges.select(F.explode(F.array("source", "target")).alias("table_id"))
        .groupBy("table_id")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    used = (
        tables.select("table_id")
        .join(degree, "table_id", "left")
        .select("table_id", F.coalesce("_n", F.lit(0)).cast("bigint").alias("degree"))
    )
    return with_rank_by_count(used, "degree")
