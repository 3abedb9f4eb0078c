"""The pipeline, stage by stage, against brute force."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import tokenizers
import public_tokenizers

import corpus_pipeline
from tableward.llm import oracle, quality, queries
from tests.llm import brute
from tools.check import table


@pytest.fixture(scope="module")
def stages(spark, folder, docs):
    """The documents after each stage; repeated rows are left out, as in the given tables."""
    now = docs.dropDuplicates(["doc_id"])
    out = [("documents", now.cache())]
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder).cache()
        out.append((name, now))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights", "packing"]
    assert all(df.columns == stages[0][1].columns for _, df in stages[:-1])


def test_quality_stage(stages, spark, folder):
    before, after = texts(stages[0][1]), texts(stages[1][1])
    assert after.items() <= before.items()
    failed = {i for i, t in before.items() if (c := brute.quality(t))[0] < 20 or 100 * c[4] > 30 * c[0]}
    assert not failed & after.keys()
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert after.keys() == {r.doc_id for r in quality.judged(stages[0][1], labels).filter("kept").collect()}
    good = {r.doc_id for r in labels.filter("quality = 1 AND toxic = 0").collect()} - failed
    assert len(good - after.keys()) <= 0.02 * len(good)


def test_join_stage(stages):
    before, after = texts(stages[1][1]), texts(stages[2][1])
    want = brute.jaccard(list(before.items()), 5, 80)
    assert after == {i: t for i, t in before.items() if want[i][1] == i}


def test_suffix_stage(stages):
    before, after = texts(stages[2][1]), texts(stages[3][1])
    data = {i: (t or "").encode() for i, t in before.items()}
    marks = brute.marks(data, 50)
    for i, text in before.items():
        kept, at = "", 0
        for c in text or "":
            n = len(c.encode())
            kept += "" if all(marks[i][at : at + n]) else c
            at += n
        assert (after[i] or "") == kept
    assert all(r.n_chars == len(r.text) for r in stages[3][1].collect())


def test_mixing_stage(stages):
    before = {r.doc_id: r for r in stages[3][1].collect()}
    sizes, taken = Counter(), Counter()
    for r in before.values():
        sizes[r.source] += len(brute.words(r.text))
    per_doc = Counter()
    for r in stages[4][1].collect():
        n = len(brute.words(r.text))
        taken[before[r.doc_id].source] += n
        per_doc[r.doc_id] += n
        whole = brute.words(before[r.doc_id].text)
        own = brute.words(r.text)
        assert any(whole[k : k + n] == own for k in range(len(whole) - n + 1))
    want = brute.targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    assert all(n <= 3 * len(brute.words(before[i].text)) for i, n in per_doc.items())


def test_packing_stage(stages):
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    streams = Counter()
    for r in stages[4][1].collect():
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        streams[r.doc_id, len(ids)] += 1
    rows = stages[5][1].collect()
    starts = Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert starts == streams
    total = sum(n * k for (_, n), k in streams.items())
    assert sum(r.length for r in rows) == total and len({r.sequence_id for r in rows}) == -(-total // 1024)
    assert all(0 <= r.ids_crc32 < 2**32 for r in rows) and zlib.crc32(b"") == 0


def test_packed_ids_are_returned(stages):
    """The result holds every token of the mixed texts, piece by piece."""
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, got = Counter(), Counter()
    for r in stages[4][1].collect():
        want.update([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0])
    for r in stages[5][1].collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == r.length and zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
        got.update(ids.tolist())
    assert got == want


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 100
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_twins(spark, folder, name):
    con = duckdb.connect()
    for given in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {given} AS SELECT * FROM '{folder}/{given}.parquet'")
    answer = con.execute(oracle.ORACLE[name])
    columns = [d[0] for d in answer.description]
    df = queries.QUERIES[name](spark, folder)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, answer.fetchall())


def test_every_number_is_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
