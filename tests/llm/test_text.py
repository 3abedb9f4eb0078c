"""Token counts, packing, quality rules and fingerprints."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers
import xxhash
from pyspark.sql import functions as F

from tableward.llm import fingerprints, packing, quality, token_counts
from tests.llm import brute


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_of_lines(docs, corpus, tokenizer):
    got = {(r.doc_id, r.section): tuple(r)[2:] for r in token_counts.count_sections(docs).collect()}
    want = {}
    for i, text, *_ in corpus:
        offsets = tokenizer.encode(text or "", add_special_tokens=False).offsets
        start = 0
        for k, line in enumerate(_lines(text or "")):
            end = start + len(line)
            n = sum(start <= a < end for a, _ in offsets)
            share = sum(max(0, min(b, end) - max(a, start)) / (b - a) for a, b in offsets)
            want[i, k] = (start, end, n, share, len(offsets))
            start = end
    assert got.keys() == want.keys()
    for key, (start, end, n, share, total) in want.items():
        own = got[key]
        assert own[:3] == (start, end, n) and own[5] == total
        if not any(ord(c) > 0x2000 for c in next(r[1] for r in corpus if r[0] == key[0])):
            assert own[3] == pytest.approx(share)


def _lines(text):
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def test_allocation_is_additive(docs):
    total = token_counts.count_sections(docs).groupBy("doc_id", "doc_tokens").agg(F.sum("n_tokens").alias("n"), F.sum("token_share").alias("s"), F.countDistinct("section").alias("k"), F.count("*").alias("rows"))
    for r in total.filter("k = rows").collect():
        assert r.n == r.doc_tokens and r.s == pytest.approx(r.doc_tokens)


def test_given_sections(spark):
    rows = [(1, "Hello world, hello", [(0, 5), (0, 18), (3, 8), (7, 7), (-4, 99), (None, 3)]), (2, None, [(0, 1)]), (3, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:long,end:long>>")
    got = {r.section: (r.n_tokens, r.token_share, r.n_cut) for r in token_counts.count_sections(df, sections_col="parts").collect()}
    assert got[0] == (1, 1.0, 0) and got[1][0] == got[4][0] == 4 and got[3] == (0, 0.0, 2) and 5 not in got
    assert got[2][1] == pytest.approx(2 / 5 + 3 / 6) and got[2][2] == 2


def _check_pieces(rows, texts, tokenizer, length=1024):
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts}
    spans, places = {}, {}
    for r in rows:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        spans.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in spans.items():
        copies = sum(s == 0 for s, _ in own)
        assert sum(n for _, n in own) == copies * len(ids[i])
    assert sorted(places) == list(range(len(places)))
    for k, own in places.items():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == length or k == len(places) - 1
    assert spans.keys() == ids.keys()


def test_packing_round_trip(docs, corpus, tokenizer):
    rows = packing.pack(docs).collect()
    _check_pieces(rows, [r[:2] for r in corpus], tokenizer)
    whole = [np.frombuffer(r.ids, "<u2") for r in sorted(rows, key=lambda r: (r.doc_id, r.start)) if r.doc_id == 1300]
    assert tokenizer.decode(list(np.concatenate(whole)[:-1])) == next(r[1] for r in corpus if r[0] == 1300)


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_very_long_blank_runs(spark, tokenizer, blank):
    text = f"before{blank * 2_000_000}after <|endoftext|>"
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    df = spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")
    _check_pieces(packing.pack(df).collect(), [(1, text), (2, "plain")], tokenizer)
    counts = token_counts.count_sections(df).filter("doc_id = 1").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("all")).first()
    assert counts.n == counts["all"] == len(ids)


def test_short_windows_and_empty_table(docs, corpus, no_docs, tokenizer):
    _check_pieces(packing.pack(docs, length=16).collect(), [r[:2] for r in corpus], tokenizer, 16)
    assert packing.pack(no_docs).count() == 0 and token_counts.count_sections(no_docs).count() == 0


def test_statistics_equal_brute_force(corpus):
    for _, text, *_ in corpus:
        assert quality.statistics(np.frombuffer((text or "").encode(), np.uint8))[:5] == brute.quality(text)


def test_held_out_quality(spark, folder):
    """Fitted on half of the labels, the verdict keeps the good documents of the other half and rejects most bad ones."""
    folder = folder.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter("doc_id % 2 = 1")
    got = quality.judged(docs, labels.filter("doc_id % 2 = 0")).join(held, "doc_id").filter("NOT base_failed").collect()
    good = [r.kept for r in got if r.quality == 1 and not r.toxic]
    bad = [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.7


def test_quality_verdicts(spark, docs, corpus, no_docs):
    labels = spark.createDataFrame([(k, int(k % 10 > 0), 0) for k in range(200)], "doc_id long, quality int, toxic int")
    rows = quality.judged(docs, labels).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)
    none = labels.filter("false")
    assert all(r.kept != r.base_failed for r in quality.judged(docs, none).collect())
    assert quality.judged(no_docs, labels).count() == 0 and quality.keep_good(no_docs, none).count() == 0


def test_forest_finds_outliers():
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.normal(0, 1, (500, 4)), rng.normal(9, 1, (10, 4))])
    score = quality.Forest(rows).score(rows)
    assert score[500:].min() > np.quantile(score[:500], 0.97)


def test_fingerprints(docs, corpus):
    got = {}
    for r in fingerprints.digest(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    order = sorted(corpus, key=lambda r: r[0])
    for (i, text, *_), after in zip(order, order[1:] + order[:1]):
        text, other = text or "", after[1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        r = got[i][0]
        assert r.n_chars == len(text)
        if len(got[i]) == 1:
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {}
    for i, text, *_ in corpus:
        prints.setdefault(text or "", set()).add(got[i][0].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert got[1200][0].fingerprint == "" and got[1203][0].fingerprint != ""
    assert got[1203][0].near_next == 1.0 and got[1300][0].near_next > 0.9


def _sketch(text):
    """Hashes kept of a text, from a hash library of its own: that of a list hashes each word with the hash before as its seed."""
    w = (text or "").lower().translate({ord(c): " " for c in brute.SPACE}).split(" ")
    w = [x for x in w if x]
    found = set()
    for k in range(max(1, len(w) - 4)) if w else ():
        h = 42
        for x in w[k : k + 5]:
            h = xxhash.xxh64(x.encode(), seed=h).intdigest()
        found.add(h - 2**64 if h >= 2**63 else h)
    return sorted(x for x in found if x < -(2**63) + 2**61 or x == min(found))


def test_fingerprints_equal_brute_force(docs, corpus):
    """Fingerprints and likenesses of every document, and of its edited text, against plain Python."""
    def told(sketch):
        return "".join(f"{x % 2**64:016x}" for x in sketch)

    def like(a, b):
        return len(set(a) & set(b)) / len({*a, *b}) if a or b else 1.0

    order = sorted(corpus, key=lambda r: r[0])
    want = Counter()
    for (i, text, *_), after in zip(order, order[1:] + order[:1]):
        text, other = text or "", after[1] or ""
        half = len(text) // 2
        a, b, c = _sketch(text), _sketch(text[: len(text) - half] + other[:half]), _sketch(other)
        want[i, told(a), told(b), like(a, b), like(a, c)] += 1
    got = fingerprints.digest(docs).select("doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert Counter(map(tuple, got)) == want


def test_common_ids_lie_in_several_ranges(spark):
    """A missing id with half of the rows and one id with a quarter are cut by hash; every row still sees the next one."""
    rows = [(None, f"n{k}") for k in range(400)] + [(50, f"m{k}") for k in range(200)] + [(k, f"x{k}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc long, text string").repartition(6)
    out = fingerprints.with_next(df, ["text"], {"h": F.xxhash64("text")}).withColumn("task", F.spark_partition_id())
    got = out.collect()
    assert len(got) == len(rows) and Counter(r.text for r in got) == Counter(t for _, t in rows) == Counter(r.next_text for r in got)
    order = sorted(got, key=lambda r: (r.doc is not None, r.doc, r.h))
    assert all(a.next_text == b.text and a.next_h == b.h for a, b in zip(order, order[1:] + order[:1]))
    ranges = fingerprints.with_next(df, ["text"], {})._jdf.queryExecution().analyzed().toString()
    assert "shiftrightunsigned" in ranges


def test_sketches_estimate(spark):
    """Likeness and containment are near the true values, and merged sketches are those of the texts together."""
    rng = np.random.default_rng(2)
    big = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 20000))
    small = " ".join(big.split()[:4000])
    df = spark.createDataFrame([(big, small)], "a string, b string").select(fingerprints.sketch("a").alias("a"), fingerprints.sketch("b").alias("b"))
    r = df.select(fingerprints.likeness("a", "b").alias("j"), fingerprints.containment("b", "a").alias("c")).first()
    assert r.c > 0.99 and abs(r.j - 0.2) < 0.03
    both = df.select(F.explode(F.array("a", "b")).alias("s")).agg(fingerprints.merged("s").alias("m")).first().m
    assert both == df.first().a


def test_fingerprints_of_odd_tables(spark, no_docs):
    assert fingerprints.digest(no_docs).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f", 1), (7, None, 2), (7, None, 2)], "doc_id long, text string, own long")
    assert fingerprints.digest(odd).count() == 3
    one = fingerprints.digest(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
