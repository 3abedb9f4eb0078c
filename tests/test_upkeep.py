"""Ledger of findings, closures kept up to date, packed files and layouts by several columns."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tableward import model
from tableward.operators import backlog as B
from tableward.operators import ledger as N
from tableward.operators import lineage as L
from tableward.operators import runs as R
from tableward.sources import files

DAYS = ["2024-01-10", "2024-01-11", "2024-01-20", "2024-02-01"]


def found(spark, names, day, severity="high"):
    rows = spark.createDataFrame([(n,) for n in names], "asset string")
    return B.finding(rows, "rule", severity, "ETL Hygiene", "table", "asset", "text", "act", 1, F.lit(dt.date.fromisoformat(day)))


def test_ledger_over_runs(spark, tmp_path):
    """Findings that come, go, return and go again, against plain Python."""
    rng = random.Random(1)
    runs = [sorted(n for n in "abcdefghij" if rng.random() < 0.5) for _ in DAYS]
    want = {}
    for day, names in zip(DAYS, runs):
        for n in set(want) | set(names):
            first, last, gone, back = want.get(n, (day, None, None, 0))
            if n in names:
                want[n] = (first, day, None, back + (gone is not None))
            else:
                want[n] = (first, last, gone or day, back)
        ledger = N.record_run(found(spark, names + names, day), str(tmp_path), day)
    text = lambda d: None if d is None else d.isoformat()
    got = {r.asset_name: (text(r.first_seen), text(r.last_seen), text(r.resolved_at), r.reopened) for r in ledger.collect()}
    assert got == want and max(w[3] for w in want.values()) > 0
    dated = N.with_first_seen(found(spark, ["a", "new"], DAYS[-1]), ledger).collect()
    assert {r.asset_name: text(r.detected_at) for r in dated} == {"a": want["a"][0], "new": DAYS[-1]}
    # the last day again, with another outcome, replaces only itself
    again = N.record_run(found(spark, ["a"], DAYS[-1], "critical"), str(tmp_path), DAYS[-1])
    rows = {r.asset_name: r for r in again.collect()}
    assert rows["a"].severity == "critical" and all(r.status == "resolved" for n, r in rows.items() if n != "a")
    assert N.read_ledger(spark, str(tmp_path), DAYS[2]).count() <= len(want)
    with pytest.raises(ValueError):
        N.record_run(found(spark, ["a"], DAYS[0]), str(tmp_path), DAYS[0])


def test_ledger_of_no_findings(spark, tmp_path):
    none = spark.createDataFrame([], model.FINDING_SCHEMA)
    assert N.record_run(none, str(tmp_path), DAYS[0]).count() == 0
    assert [r.status for r in N.record_run(found(spark, ["a"], DAYS[1]), str(tmp_path), DAYS[1]).collect()] == ["open"]


def test_detectors_are_known(spark):
    with pytest.raises(ValueError):
        B.detector_findings({"nothing": spark.range(1)}, DAYS[0])
    (df,) = B.detector_findings({"unused_models": spark.createDataFrame([("m",), ("m",)], "model_id string")}, DAYS[0])
    assert [(r.asset_name, r.asset_type) for r in df.collect()] == [("m", "ml_model")]


def hops(pairs):
    """{(source, target): hops} by breadth-first walks."""
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    out = {}
    for start in after:
        seen, edge, n = {start}, {start}, 0
        while edge:
            n += 1
            edge = {b for a in edge for b in after.get(a, ())} - seen
            seen |= edge
            out |= {(start, b): n for b in edge}
    return out


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def as_pairs(df):
    rows = df.collect()
    assert len(rows) == len({(r.source, r.target) for r in rows})
    return {(r.source, r.target): r.min_depth for r in rows}


def test_closure_of_a_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 2000, []
    add = L._Steps.add
    monkeypatch.setattr(L._Steps, "add", lambda self, pairs, step: (rounds.append(step), add(self, pairs, step))[1])
    edges = spark.range(n).selectExpr("CAST(id AS STRING) AS source", "CAST(id + 1 AS STRING) AS target")
    got = L.lineage_closure(edges)
    assert got.count() == n * (n + 1) // 2
    assert got.filter("min_depth <> CAST(target AS INT) - CAST(source AS INT)").isEmpty()
    assert len(rounds) <= 13


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_on_graphs_with_cycles(spark, seed):
    rng = random.Random(seed)
    pairs = [(str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(55)] + [("1", "1"), ("1", "2"), ("1", "2")]
    want = hops([p for p in pairs if p[0] != p[1]])
    want = {k: v for k, v in want.items() if k[0] != k[1]}
    assert as_pairs(L.lineage_closure(edges_of(spark, pairs))) == want
    start = spark.createDataFrame([("1",), ("7",), ("x",)], "table_id string")
    assert as_pairs(L.lineage_closure(edges_of(spark, pairs), start)) == {k: v for k, v in want.items() if k[0] in ("1", "7")}
    before, added = pairs[:40], pairs[40:]
    assert as_pairs(L.closure_with(L.lineage_closure(edges_of(spark, before)), edges_of(spark, added))) == want


def test_closure_without_edges(spark):
    none = edges_of(spark, [])
    assert L.lineage_closure(none).count() == 0
    assert as_pairs(L.closure_with(L.lineage_closure(none), edges_of(spark, [("a", "b"), ("b", "c")]))) == {("a", "b"): 1, ("b", "c"): 1, ("a", "c"): 2}
    assert as_pairs(L.closure_with(L.lineage_closure(edges_of(spark, [("a", "b")])), none)) == {("a", "b"): 1}


def test_usual_growth_is_a_median(spark):
    """One huge ordinary load, which a mean would follow, doesn't hide a doubled one."""
    growth = [10, 11, 12, 5000, 10, 11]
    rows, total = [], 100
    for k, g in enumerate(growth):
        total += g
        rows.append(("p", k, dt.datetime(2024, 1, 1 + k), "succeeded", total))
    rows.append(("p", 7, dt.datetime(2024, 1, 20), "failed", total))
    rows.append(("p", 8, dt.datetime(2024, 1, 21), "succeeded", total + 40))
    got = R.duplicate_load_signal(spark.createDataFrame(rows, "pipeline_id string, run_id long, start_time timestamp, status string, target_rows long"))
    assert [(r.run_id, r.growth, r.ratio) for r in got.collect()] == [(8, 40.0, round(40 / 11, 3))]


def test_compact_reduces_files(spark, tmp_path):
    spark.range(1000).repartition(9).write.parquet(str(tmp_path / "in"))
    (row,) = files.compact(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out")).collect()
    assert (row.sources, row.rows, row.kept) == (9, 1000, False)


def test_compact_leaves_large_files(spark, tmp_path):
    """Files of mixed sizes: large ones keep their names, groups come near the target, no group exceeds it."""
    source = str(tmp_path / "in")
    noise = lambda n, k: spark.range(n).select("id", F.sha2(F.concat_ws("-", "id", F.lit(k)), 256).alias("x")).coalesce(1)
    for k in range(40):
        noise(200 + 97 * (k % 7), k).write.mode("append").parquet(source)
    for k in range(3):
        noise(9000, 100 + k).write.mode("append").parquet(source)
    df = spark.read.parquet(source)
    before = {r.path: r.size for r in files.file_sizes(df).collect()}
    target = 0.2
    version = files.compact(df, str(tmp_path / "out"), target).collect()
    large = {p for p, size in before.items() if size >= 0.9 * target * files.MB}
    assert len(large) == 3 and {r.path for r in version if r.kept} >= large
    made = [r for r in version if not r.kept]
    used = {r.sources for r in made}
    assert sum(r.sources for r in version) == len(before) and min(used) > 1
    groups = files.packed_groups(files.file_sizes(df).filter(F.col("size") < int(0.9 * target * files.MB)), int(target * files.MB))
    sums = sorted(r.s for r in groups.join(files.file_sizes(df), "path").groupBy("bin").agg(F.sum("size").alias("s")).collect())
    assert sums[-1] <= target * files.MB and all(s >= 0.9 * target * files.MB for s in sums[1:])
    back = files.read_version(spark, str(tmp_path / "out"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    # a second time nothing is left to pack but what fits nowhere
    again = files.compact(back, str(tmp_path / "again"), target)
    assert again.filter("NOT kept").count() <= 1


def test_packing_is_first_fit_decreasing(spark):
    sizes = [70, 60, 50, 40, 30, 30, 20, 10, 10]
    df = spark.createDataFrame([("f", f"p{k}", s) for k, s in enumerate(sizes)], "folder string, path string, size long")
    got = {}
    for r in files.packed_groups(df, 100).collect():
        got.setdefault(r.bin, []).append(sizes[int(r.path[1:])])
    assert sorted(sorted(g) for g in got.values()) == [[10, 10], [20, 30, 50], [30, 70], [40, 60]]
    chunks = files.packed_groups(df, 100, chunk=3)
    assert chunks.count() == len(sizes) and chunks.select("path").distinct().count() == len(sizes)


def test_layout_prunes_by_any_column(spark, tmp_path):
    """Filters on the second and third column read a fraction of the files that a sort by all columns reads."""
    cols = [F.rand(k).alias(c) for k, c in enumerate("abc")]
    df = spark.range(20000).select(*cols[:2], (cols[2] * 1e6).cast("long").alias("c"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("d"))
    df.write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    files.cluster_layout(df, str(tmp_path / "z"), ["a", "b", "c"], 64)
    df.repartitionByRange(64, "a", "b", "c").write.parquet(str(tmp_path / "lex"))
    z, lex = (spark.read.parquet(str(tmp_path / n)) for n in ("z", "lex"))
    for column, low, high in (("b", 0.1, 0.12), ("c", 200_000, 220_000)):
        (n, whole), (m, _) = files.files_read(z, column, low, high), files.files_read(lex, column, low, high)
        assert whole >= 50 and m > 0.9 * whole and n < 0.5 * m
    assert sorted(map(tuple, z.collect())) == sorted(map(tuple, df.collect()))


def test_layout_of_other_types(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + k % 9), dt.date(2024, 1, 1 + k % 5), f"n{k % 7}é", None if k % 4 else k, k % 2 == 0) for k in range(300)]
    df = spark.createDataFrame(rows, "t timestamp, d date, s string, n int, b boolean")
    assert files.cluster_layout(df, str(tmp_path / "z"), ["t", "d", "s", "n", "b"], 4).first().rows == 300
    ranks = df.select("s", files._rank(df, "s", files._cuts(df, ["s"], 4)["s"]).alias("r")).distinct().orderBy("s").collect()
    assert [r.r for r in ranks] == sorted(r.r for r in ranks) and ranks[0].r < ranks[-1].r
    assert files.cluster_layout(df.filter("n < 0"), str(tmp_path / "none"), ["t", "s"]).first().rows in (None, 0)


def kept_rows(monkeypatch):
    """{label: rows of each result that the lineage operators write}."""
    rows, keep = {}, L.keep
    monkeypatch.setattr(L, "keep", lambda df, label="kept": (kept := keep(df, label), rows.setdefault(label, []).append(kept.count()))[0])
    return rows


def test_update_of_a_closure_writes_only_paths_from_added_edges(spark, monkeypatch):
    before = [(f"p{k}", f"s{k % 20}") for k in range(500)] + [("n", "r")]
    added = [(f"s{k}", "n") for k in range(20)]
    old = L.lineage_closure(edges_of(spark, before))
    rows = kept_rows(monkeypatch)
    got = as_pairs(L.closure_with(old, edges_of(spark, added)))
    assert got == hops(before + added)
    assert max(n for counts in rows.values() for n in counts) == 40


def test_closure_does_not_extend_dead_ends(spark, monkeypatch):
    rounds, add = [], L._Steps.add
    monkeypatch.setattr(L._Steps, "add", lambda self, pairs, step: (rounds.append(step), add(self, pairs, step))[1])
    pairs = [(f"p{k}", f"s{k % 7}") for k in range(50)]
    assert as_pairs(L.lineage_closure(edges_of(spark, pairs))) == {p: 1 for p in pairs}
    assert rounds == [0]


def test_walk_joins_its_hops_with_inner_edges_only(spark, monkeypatch):
    pairs = [(f"p{k}", f"s{k % 20}") for k in range(500)] + [(f"s{k}", "n") for k in range(20)] + [("n", "r"), ("n", "r")]
    rows = kept_rows(monkeypatch)
    got = as_pairs(L.lineage_closure(edges_of(spark, pairs), spark.createDataFrame([("p3",), ("p3",), ("r",), (None,)], "table_id string")))
    assert got == {("p3", "s3"): 1, ("p3", "n"): 2, ("p3", "r"): 3}
    assert rows["hops"] == [21] and rows["inner"] == [21]
