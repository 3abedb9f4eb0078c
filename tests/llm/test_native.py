"""Mixing, sharding and tool-call linking."""

import json
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tableward.llm import mixing, sharding, tool_calls
from tests.llm import brute
from tests.llm.conftest import TEXT_SCHEMA


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_targets(spark):
    sizes = {"b": 10, "a": 1000, "Z": 3, "é": 0, None: 500, "c": 90, "": 40, "日": 700}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = brute.targets(sizes)
    rows = {r.source: r for r in got.collect()}
    assert {s: pytest.approx(want[s]) for s in sizes} == {s: r.target for s, r in rows.items()}
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert [s for s, _ in sorted(rows.items(), key=lambda x: x[1].place)] == ["", "Z", "a", "b", "c", "é", "日", None]


def test_mix_reaches_its_targets(docs, corpus):
    rows = mixing.digest(docs).collect()
    sizes = {r[0]: len(brute.words(r[1])) for r in corpus}
    per_source, source = Counter(), {r[0]: r[3] for r in corpus}
    for r in corpus:
        per_source[r[3]] += sizes[r[0]]
    want = brute.targets(dict(per_source))
    taken = Counter()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in corpus)
    for r in rows:
        assert r["size"] == sizes[r.doc_id] and r.source_size == per_source[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]]) and 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.digest(docs).collect()), key=str)


def test_blocks_are_disjoint_and_shards_even(docs):
    rows, pieces = mixing.mix(docs, shards=8, blocks_per_shard=16)
    blocks = pieces.groupBy("place", "block").agg(F.countDistinct("shard").alias("shards"), F.sum("length").alias("words"), F.first("shard").alias("shard")).collect()
    assert all(b.shards == 1 for b in blocks)
    per_shard = Counter(b.shard for b in blocks)
    assert len(per_shard) == 8 and max(per_shard.values()) - min(per_shard.values()) <= 3
    twice = pieces.groupBy("row", "epoch").agg(F.sum("length").alias("n"), (F.max(F.col("start") + F.col("length")) - F.min("start")).alias("m")).filter("n <> m")
    assert twice.count() == 0


def test_split_is_hypergeometric(spark):
    """Quotas are kept exactly; over many seeds the mean share of a shard is its fair share."""
    quotas = spark.createDataFrame([(0, 60), (1, 3), (2, 37)], "place long, n long")
    sums = Counter()
    for seed in range(12):
        rows = mixing.split(quotas, 5, seed).collect()
        by_source, by_shard = Counter(), Counter()
        for r in rows:
            by_source[r.place] += r.n
            by_shard[r.shard] += r.n
            sums[r.place, r.shard] += r.n
        assert by_source == {0: 60, 1: 3, 2: 37} and set(by_shard) == set(range(5)) and set(by_shard.values()) == {20}
    assert all(abs(sums[0, k] / 12 - 12) < 2.5 for k in range(5))


def test_mixed_documents(docs, corpus):
    unique = docs.dropDuplicates(["doc_id"])
    out = mixing.mixed_documents(unique)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(brute.words(r.text))
        assert r.n_chars == len(r.text)
    assert got == Counter({r.doc_id: r.taken for r in mixing.digest(unique).collect() if r.taken})


def test_mixed_documents_without_own_ids(spark):
    """Rows without an id, or with one id and different texts, each give their own words; so do rows alike in all."""
    rows = [(None, f"a{k} b{k} c{k} " * (k + 1), "en", "s", k) for k in range(6)] + [(7, "one text here", "en", "s", 0), (7, "quite another and longer text", "en", "s", 0)]
    rows += [(8, "same words twice", "en", "s", 0)] * 2 + [(8, "same words twice", "de", "s", 0)]
    got, want = Counter(), Counter()
    for r in mixing.mixed_documents(spark.createDataFrame(rows, TEXT_SCHEMA).repartition(3)).collect():
        got.update((r.doc_id, r.lang, w) for w in r.text.split())
    for i, text, lang, *_ in rows:
        want.update((i, lang, w) for w in text.split())
    assert got == want


def test_mix_of_odd_tables(spark, no_docs):
    assert mixing.digest(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, None)], TEXT_SCHEMA)
    assert [(r["size"], r.target, r.taken) for r in mixing.digest(odd).collect()] == [(0, 0.0, 0)] * 2
    one = spark.createDataFrame([(1, "a b c d", "x", 5, "y", "z")], "doc_id long, text string, source string, size long, row string, block string")
    assert mixing.digest(one).first().taken == 4
    assert mixing.mixed_documents(one).columns == one.columns


def test_shards(docs, corpus):
    rows = sharding.digest(docs).collect()
    by_id = {r[0]: (r[1] or "").encode() for r in corpus}
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r["size"] == len(by_id[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(by_id[r.doc_id]) and r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(rows) == len(corpus) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(load.values()) / 24
    assert max(load.values()) <= max(1.1 * mean, max(r["size"] for r in rows)) and len(load) == 24


def test_rebalancing_moves_only_into_new_shards(spark):
    totals = spark.range(4096).selectExpr("cast(id AS int) AS virtual_slot", "1000 + id % 97 AS bytes", "1L AS rows")
    first = sharding.slot_map(totals, 24)
    second = sharding.rebalanced(first, totals, 26)
    old, new = ({r.virtual_slot: r.shard for r in m.collect()} for m in (first, second))
    assert old.keys() == new.keys() and {r.version for r in second.collect()} == {2}
    assert all(new[k] == old[k] or new[k] >= 24 for k in old)
    load = Counter()
    for r in totals.collect():
        load[new[r.virtual_slot]] += r["bytes"]
    mean = sum(load.values()) / 26
    assert len(load) == 26 and max(abs(x - mean) for x in load.values()) < 0.03 * mean


def test_shards_of_odd_tables(spark, no_docs):
    assert sharding.digest(no_docs).count() == 0
    odd = spark.createDataFrame([(None, None, "a", 1), (None, "x", "b", 2), (3, "same", "c", 3), (3, "same", "c", 3)], "doc_id long, text string, shard string, slot long")
    rows = sharding.digest(odd).collect()
    assert sorted(r["size"] for r in rows) == [8, 9, 12, 12] and len({(r.shard, r.slot) for r in rows}) == 4


CALLS = "conv long, turn long, call_id string, tool string, arguments string, needs array<string>"
RESULTS = "conv long, turn long, call_id string, content string"
TOOLS = [("search", "query", "string", True), ("search", "limit", "integer", False), ("search", "deep", "object", False)]


def _linked(spark, calls, results, tools=TOOLS):
    frames = (spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(tools, "tool string, parameter string, type string, required boolean"))
    return sorted(tool_calls.linked(*frames).collect(), key=lambda r: (r.conv is None, r.conv, r.place))


def test_linking_and_order(spark):
    calls = [(1, 5, "a", "search", '{"query":"x"}', ["b"]), (1, 7, "b", "search", '{"query":"y"}', []), (1, 9, "b", "search", "{}", []), (1, 11, "lost", "search", '{"query":"z"}', ["nowhere"]),
             (1, 12, "c1", "search", '{"query":"q"}', ["c2"]), (1, 13, "c2", "search", '{"query":"q"}', ["c1"]), (2, 1, "a", "search", '{"query":"w"}', None), (None, 1, None, "search", '{"query":"w"}', [])]
    results = [(1, 6, "a", "ra"), (1, 8, "b", "rb"), (1, 10, "b", "again"), (2, 0, "z", "none"), (1, 20, None, None)]
    rows = _linked(spark, calls, results)
    first = [(r.kind, r.call_id, r.status, r.depth) for r in rows if r.conv == 1]
    assert first[:2] == [("call", "b", "linked", 0), ("result", "b", "linked", 0)]
    assert first.index(("call", "b", "linked", 0)) < first.index(("call", "a", "linked", 1)) < first.index(("result", "a", "linked", 1))
    assert Counter(x[2] for x in first) == {"linked": 4, "duplicate": 2, "unresolved": 3, "orphan": 1}
    assert [r.place for r in rows if r.conv == 1] == list(range(10))
    assert {(r.kind, r.status) for r in rows if r.conv == 2} == {("call", "pending"), ("result", "orphan")}
    assert [(r.status, r.place) for r in rows if r.conv is None] == [("pending", 0)]


def test_rows_without_a_conversation_form_one(spark):
    calls = [(None, 1, "a", "search", '{"query":"x"}', []), (None, 3, "b", "search", '{"query":"y"}', ["a"]), (None, 5, "a", "search", "{}", []), (1, 1, "a", "search", "{}", ["b"])]
    rows = _linked(spark, calls, [(None, 2, "a", "ra"), (None, 4, "b", "rb")])
    own = [(r.kind, r.call_id, r.status, r.depth) for r in rows if r.conv is None]
    assert own == [("call", "a", "linked", 0), ("result", "a", "linked", 0), ("call", "a", "duplicate", 0), ("call", "b", "linked", 1), ("result", "b", "linked", 1)]
    assert [(r.conv, r.status) for r in rows if r.conv is not None] == [(1, "unresolved")]


def test_numbers_in_one_form(spark):
    arguments = ["100", "100.0", "100.50", "1e2", "-0.0", "12345678901234567890123456789012345678"]
    calls = [(1, k, f"c{k}", "t", f'{{"n":{a}}}', []) for k, a in enumerate(arguments)]
    rows = {r.call_id: json.loads(r.json, parse_float=str, parse_int=str)["arguments"]["n"] for r in _linked(spark, calls, [])}
    assert [rows[f"c{k}"] for k in range(6)] == ["100", "100", "100.5", "100.0", rows["c4"], arguments[5]] and float(rows["c4"]) == 0


def test_long_chains_have_short_plans(spark):
    calls = spark.range(30).selectExpr("named_struct('id', 1) AS conv", "concat('c', id) AS call_id", "IF(id > 0, array(concat('c', id - 1)), array()) AS needs")
    out = tool_calls.depths(calls)
    assert {r.call_id: r.depth for r in out.collect()} == {f"c{k}": k for k in range(30)}
    assert len(_plan(out).splitlines()) < 6


def test_validation_and_canonical_json(spark):
    arguments = ['{"limit":3,"query":"é\\u0001"}', '{"query":5,"limit":"3","more":null}', "{}", "[1]", "not json", None, '{"query":"a","deep":{"z":1.50,"b":[true,null]}}', '{"query":"a","query":"b"}']
    calls = [(1, k, f"c{k}", "search", a, []) for k, a in enumerate(arguments)] + [(1, 90, "u", "nothing", "{}", [])]
    rows = {r.call_id: r for r in _linked(spark, calls, [(1, 1, "c0", 'say "hi"\n')]) if r.kind == "call"}
    assert [rows[f"c{k}"].errors for k in range(8)] == [
        [], ["unexpected more", "type limit", "type query"], ["missing query"], ["not an object"], ["not an object"], ["missing query"], [], ["not an object"],
    ]
    assert rows["u"].errors == ["unknown tool"]
    assert rows["c0"].json == '{"arguments":{"limit":3,"query":"é\\u0001"},"id":"c0","name":"search","type":"call"}'
    for r in rows.values():
        loaded = json.loads(r.json)
        assert list(loaded) == sorted(loaded)
    assert json.loads(rows["c6"].json)["arguments"] == {"deep": {"b": [True, None], "z": 1.5}, "query": "a"}


def test_deep_chains_and_hot_conversation(spark):
    calls = [(1, 2 * k, f"c{k}", "search", '{"query":"x"}', [f"c{k - 1}"] if 0 < k < 12 else []) for k in range(3000)]
    rows = _linked(spark, calls, [(1, 2 * k + 1, f"c{k}", "r") for k in range(3000)])
    assert [r.place for r in rows] == list(range(6000)) and max(r.depth for r in rows) == 11
    at = {(r.kind, r.call_id): r.place for r in rows}
    assert all(at["call", f"c{k}"] < at["result", f"c{k}"] for k in range(3000)) and all(at["result", f"c{k - 1}"] < at["call", f"c{k}"] for k in range(1, 12))


def test_conversations_against_brute_force(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = tool_calls.linked(*tool_calls.from_turns(turns)).collect()
    assistant = {(r.conv_id, r.turn) for r in turns.collect() if r.role == "assistant"}
    user = {(r.conv_id, r.turn) for r in turns.collect() if r.role == "user" and r.turn > 0}
    assert len(rows) == len(assistant) + len(user)
    for r in rows:
        if r.kind == "result":
            known = (r.conv, r.turn - 1) in assistant
            assert r.status in ({"linked", "unresolved"} if known else {"orphan"})
        elif r.status != "unresolved":
            assert (r.status == "linked") == ((r.conv, r.turn + 1) in user)
    empty = turns.filter("false")
    assert tool_calls.linked(*tool_calls.from_turns(empty)).count() == 0


def test_every_turn_is_formatted_whole(spark, folder):
    """One row for each row of the table, with the whole text in its JSON."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    conv = turns.schema["conv_id"].dataType
    odd = spark.range(1).select(F.lit(10**6).cast(conv).alias("conv_id"), F.explode(F.expr(
        """array(named_struct('turn', 0, 'role', 'system', 'text', 'rules "a"'), named_struct('turn', 1, 'role', cast(null as string), 'text', 'x'),
           named_struct('turn', 2, 'role', 'critic', 'text', 'five words are in here'), named_struct('turn', cast(null as int), 'role', 'user', 'text', 'lost'),
           named_struct('turn', 4, 'role', 'assistant', 'text', 'one  two three four five six 12345'), named_struct('turn', 5, 'role', 'user', 'text', 'yes'))"""
    )).alias("t")).select("conv_id", F.col("t.turn").cast(turns.schema["turn"].dataType).alias("turn"), "t.role", "t.text")
    turns = turns.unionByName(odd)
    rows, given = tool_calls.formatted(turns).collect(), turns.collect()
    assert len(rows) == len(given) and len({(r.conv, r.place) for r in rows}) == len(rows)
    want = Counter()
    for t in given:
        kind = "call" if t.role == "assistant" else "result" if t.role == "user" and (t.turn or 0) > 0 else "message"
        want[t.conv_id, t.turn, kind, t.role if kind == "message" else None, t.text] += 1
    got = Counter()
    for r in rows:
        own = json.loads(r.json)
        assert list(own) == sorted(own)
        text = own.get("content") if r.kind != "call" else next(own["arguments"][k] for k in ("query", "text", "phrase") if k in own["arguments"])
        got[r.conv, r.turn, r.kind, own.get("role"), text] += 1
        assert (r.kind == "message") == (r.status == "plain")
    assert got == want and not any(x in _plan(tool_calls.formatted(turns)) for x in ("Python", "Arrow", "Pandas"))


def test_no_python_in_native_plans(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    from tableward.llm import fingerprints

    for df in (mixing.digest(docs), sharding.digest(docs), fingerprints.digest(docs), tool_calls.linked(*tool_calls.from_turns(spark.read.parquet(f"{folder}/conversations.parquet")))):
        assert not any(x in _plan(df) for x in ("Python", "Arrow", "Pandas"))
