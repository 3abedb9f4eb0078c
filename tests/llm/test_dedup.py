"""Suffix-array dedup, substring dedup and the Jaccard join against brute force."""

import hashlib
import time

import numpy as np
import pytest

from pyspark.sql import functions as F

from tableward.llm import components, jaccard_join, minhash, mixing, packed, repeated_windows, sequences, similar, substring_dedup, suffix_dedup
from tableward.session import keep
from tests.llm import brute
from tests.llm.conftest import TEXT_SCHEMA, rows_of


def test_suffix_dedup_equals_brute_force(docs, corpus):
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.digest(docs).collect()}
    assert got == brute.suffix(corpus)


def test_suffix_dedup_with_every_anchor_common(docs, corpus):
    """Windows that are spread by their content give the same result."""
    keyed = docs.selectExpr("doc_id AS doc", "text")
    apart = rows_of(suffix_dedup.repeated_runs(keyed, common=1).selectExpr("doc", "explode(sequence(start, start + count - 1)) AS s").distinct(), "doc", "s")
    near = rows_of(suffix_dedup.repeated_runs(keyed).selectExpr("doc", "explode(sequence(start, start + count - 1)) AS s").distinct(), "doc", "s")
    assert apart == near and len(near) > 1000


@pytest.mark.parametrize("length", [9, 20, 50, 64])
def test_refinement_compares_whole_strings(length):
    rng = np.random.default_rng(length)
    data = rng.integers(97, 99, 3000, dtype=np.uint8)
    data[1000:1300] = data[200:500]
    first = np.arange(len(data) - length + 1)
    ids = suffix_dedup.refine(data, first, length)
    seen = {}
    for p in first:
        seen.setdefault(data[p : p + length].tobytes(), []).append(p)
    for places in seen.values():
        assert len(set(ids[places])) == 1
        assert (ids[places[0]] == -1) == (len(places) == 1)
    assert len(set(ids[ids >= 0])) == sum(len(p) > 1 for p in seen.values())


def test_runs_are_cut_at_the_place_of_their_anchor():
    """All windows are there once, the place is that of the first smallest gram, and equal windows have the same flank."""
    rng = np.random.default_rng(2)
    for t in range(60):
        data = rng.integers(97, 98 + t % 3, int(rng.integers(0, 300)), dtype=np.uint8)
        data = np.concatenate([data, np.resize(data[: t % 20 + 1], 90), data[: len(data) // 2]]) if len(data) else data
        for length, q in ((50, 16), (51, 16), (20, 5), (9, 9)):
            prefix = sequences.Prefix(sequences.BYTE_CODES[data])
            anchor, start, count, place = sequences.placed_segments(prefix, length, q)
            before, after = sequences.flanks(prefix, length, q, start, count, place, 24)
            grams, told = prefix.grams(q), {}
            assert [w for s, n in zip(start, count) for w in range(s, s + n)] == list(range(len(data) - length + 1))
            for a, s, n, p, x, y in zip(anchor, start, count, place, before, after):
                for w in range(s, s + n):
                    assert a == grams[w : w + length - q + 1].min() and (p < 0 or p == w + int(np.argmin(grams[w : w + length - q + 1])))
                    flank = None if p < 0 else ("before", x) if p - w >= (length - q) // 2 else ("after", y)
                    assert flank is None or flank[1] > 0
                    told.setdefault(data[w : w + length].tobytes(), set()).add(flank)
            assert all(len(x) == 1 or None in x for x in told.values())


def test_anchors_shared_by_chance_are_not_compared(spark):
    """Forty documents share 26 bytes, too few for a window; two of them share 90."""
    rng = np.random.default_rng(4)
    prose = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    phrase, passage = prose(26), prose(90)
    rows = [(k, prose(60).join([phrase] * 4) + prose(70)) for k in range(40)] + [(50, prose(80) + passage + prose(80)), (51, prose(81) + passage + prose(79))]
    rows += [(60, "=" * 400), (61, "=" * 90 + prose(60))]
    docs = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    found = repeated_windows.runs_of_windows(repeated_windows.with_rows(docs), 50, 16, 50_000)
    assert {r.doc for r in found.filter("state > 0").collect()} <= {50, 51, 60, 61}
    got = {tuple(r) for r in suffix_dedup.digest(docs.withColumnRenamed("doc", "doc_id")).collect()}
    assert got == {(i, *v) for i, v in brute.suffix(rows).items()} and {r[2] for r in got} == {0, 90}


def test_kept_results_leave_no_shuffle_files(spark):
    """Work folders go on from their files; what was shuffled for them took disk until the driver collected its garbage."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {x for x in (files.apply(k).getName() for k in range(files.size())) if x.startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, set_to = shuffled(), spark.conf.get(name, None)
    kept = keep(spark.range(5000).selectExpr("id % 700 AS k").groupBy("k").count().orderBy("count", "k"))
    for _ in range(50):  # files go in the background
        if not shuffled() - was:
            break
        time.sleep(0.1)
    assert not shuffled() - was and kept.count() == 700 and spark.conf.get(name, None) == set_to


def test_cut_texts_are_valid_and_keep_other_columns(docs, corpus):
    cut = suffix_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    by_id = {r.doc_id: r.text for r in cut.collect()}
    assert by_id[1200] is None and by_id[1203] == "one"
    assert sum(len(t or "") for t in by_id.values()) < sum(len(r[1] or "") for r in corpus)


def test_whole_characters():
    text = np.frombuffer("aé日".encode(), np.uint8)
    mask = np.array([1, 0, 1, 1, 1, 1], bool)
    assert suffix_dedup.whole_characters(text, mask).tolist() == [True, False, False, True, True, True]


def test_substring_dedup_equals_brute_force(docs, corpus):
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.remove_repeats(docs, with_text=False).collect()}
    assert got == brute.substring(corpus)


def test_paths_are_compacted(spark):
    """A long passage in many documents becomes few spans, not one per edge."""
    passage = " ".join(f"w{k}" for k in range(2000))
    rows = [(k, f"{'a ' * k}{passage} b{k}") for k in range(1, 9)]
    docs = spark.createDataFrame(rows, "doc long, text string")
    marks = substring_dedup.spans(docs).collect()
    assert len(marks) == 7 and max(len(r.marks) for r in marks) <= 6


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (2, 50)])
def test_jaccard_join_equals_brute_force(docs, corpus, n, percent):
    got = {r.doc: (r.n, r.component) for r in jaccard_join.groups(docs, words=n, percent=percent).collect()}
    assert got == brute.jaccard(corpus, n, percent)


def test_signatures_meet_at_the_threshold():
    """Sets that just reach the threshold always share a signature."""
    rng = np.random.default_rng(1)
    for size in [*range(1, 60), 100, 333, 1000]:
        for _ in range(6):
            base = rng.integers(0, 2**63, size, dtype=np.uint64)
            gone = int(rng.integers(0, size * 15 // 100 + 1))
            more = size * 100 // 85 - size if not gone else max(0, ((size - gone) * 100 // 85) - size)
            other = np.concatenate([base[gone:], rng.integers(0, 2**63, int(rng.integers(0, more + 1)), dtype=np.uint64)])
            both = len(np.intersect1d(base, other))
            if 100 * both >= 85 * len(np.union1d(base, other)):
                assert len(np.intersect1d(jaccard_join.signatures(base), jaccard_join.signatures(other)))


@pytest.mark.parametrize("percent", [80, 85])
def test_chains_let_linked_sets_pass(percent):
    """Linked sets share a signature that their chains allow, also where differences lie close together; long sets far from linked share none."""
    rng = np.random.default_rng(3)

    def allowed(own, other):
        found = []
        for p, q in zip(*(list(jaccard_join._signed(x, percent)) for x in (own, other))):
            for key, i, j in zip(*np.intersect1d(p[0], q[0], return_indices=True)):
                span, good = min(jaccard_join.SPAN, p[3]), max(min(p[4], q[4]), min(jaccard_join.SPAN, p[3]))
                sketch = [jaccard_join.chains(x, y[2], y[3])[y[1][k]] for x, y, k in ((own, p, i), (other, q, j))]
                bits = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
                found.append(bits * good * (100 + percent) <= span * (len(own) + len(other)) * (100 - percent))
        return found

    for size in [1, 2, 7, 30, 100, 400, 1000, 3000]:
        for close in (False, True):
            base = rng.integers(0, 2**63, size, dtype=np.uint64)
            gone = size * (100 - percent) // (100 + percent)  # as many come in again
            at = np.lexsort((list(jaccard_join._signed(base, percent))[0][2],))[:gone] if close else rng.permutation(size)[:gone]
            other = np.concatenate([np.delete(base, at), rng.integers(0, 2**63, gone, dtype=np.uint64)])
            assert 100 * (size - gone) >= percent * (size + gone) and any(allowed(base, other))
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    found = allowed(base, np.concatenate([base[:2250], rng.integers(0, 2**63, 750, dtype=np.uint64)]))  # 60 percent
    assert found and not any(found)


def test_long_documents_that_share_passages_make_no_pairs(spark, monkeypatch):
    """Sets of over 1200 shingles fill 512 parities: all pairs across components came to their texts."""
    rng = np.random.default_rng(8)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    common = prose(1600)
    rows = [(k, f"{prose(800)} {common}") for k in range(10)]
    rows += [(20 + k, f"{text} {prose(60)}") for k, text in rows[:4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = {}

    def counted(df, label="kept"):
        kept = keep(df, label)
        if label in ("similar-open", "similar-rest"):
            made[label] = kept.count()
        return kept

    monkeypatch.setattr(similar, "keep", counted)
    got = {r.doc: (r.n, r.component) for r in jaccard_join.groups(docs, words=5, percent=80).collect()}
    assert got == brute.jaccard(rows, 5, 80)
    assert made["similar-open"] > 0 and made["similar-rest"] == 0


def test_one_document_of_each_group_stays(docs, corpus):
    kept = [r.doc_id for r in jaccard_join.keep_one(docs).select("doc_id").collect()]
    want = brute.jaccard(corpus)
    assert sorted(set(kept)) == sorted(i for i, (_, c) in want.items() if i == c)


def test_components_of_a_long_path(spark):
    links = spark.range(300).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.range(900, 905).selectExpr("id AS a", "900L AS b"))
    got = {r.node: r.component for r in components.components(links).collect()}
    assert all(got[k] == 0 for k in range(301)) and all(got[k] == 900 for k in range(900, 905))


def test_missing_ids_and_empty_tables(spark, no_docs):
    text = "some words that are long enough to be found again in other documents, more than fifty bytes"
    odd = spark.createDataFrame([(None, text, None, None, None), (3, text, None, None, None), (None, None, None, None, None)], TEXT_SCHEMA)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.digest(odd).filter("n_bytes > 0").collect()}
    assert got == {None: 0, 3: len(text)}
    assert jaccard_join.digest(odd).count() == 3 and jaccard_join.keep_one(odd).count() == 2  # the copy without an id goes
    assert substring_dedup.remove_repeats(odd).count() == 3
    for f in (suffix_dedup.digest, suffix_dedup.remove_repeats, jaccard_join.digest, jaccard_join.keep_one, substring_dedup.remove_repeats):
        assert f(no_docs).count() == 0


def test_ids_with_several_texts(spark):
    """Two rows without an id and one id with two texts, of different lengths, share passages with other documents in differing runs."""
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    a, b = prose(130), prose(130)
    rows = [
        (None, f"{prose(3)} {a}"), (None, f"{prose(400)} {a} {prose(90)} {b}"), (None, "short"),
        (4, f"{a.rsplit(' ', 9)[0]} {prose(5)}"), (4, f"{prose(300)} {b} {prose(9)} {a}"), (4, prose(60)),
        (9, f"{prose(2)} {b} {prose(2)} {a}"), (9, f"{a} {prose(40)}"), (9, f"{a} {prose(40)}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def want(split, join, length):
        """Per row what stays, judged against all rows with a smaller id."""
        out = []
        for i, text in rows:
            s = split(text)
            seen = {tuple(o[p : p + length]) for j, t in rows if i is not None and (j is None or j < i) for o in [split(t)] for p in range(len(o) - length + 1)}
            gone = {p + k for p in range(len(s) - length + 1) if tuple(s[p : p + length]) in seen for k in range(length)}
            out.append((str(i), len(s), len(gone), join(x for k, x in enumerate(s) if k not in gone)))
        return sorted(out)

    got = substring_dedup.remove_repeats(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == want(str.split, " ".join, 50)
    whole = want(list, "".join, 50)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.digest(docs).collect()) == sorted((*w[:3], hashlib.sha256(w[3].encode()).hexdigest()) for w in whole)
    assert sorted((str(r.doc_id), r.text) for r in suffix_dedup.remove_repeats(docs).collect()) == sorted((w[0], w[3]) for w in whole)


def test_clashing_columns(spark):
    rows = [(k, "same text " * 20, "m", "a", 1, "r", "x") for k in range(3)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, marks string, doc string, start long, rep string, __marks string")
    cut = suffix_dedup.remove_repeats(odd.drop("__marks"))
    assert cut.columns == odd.columns[:-1] and {r.text for r in cut.collect() if r.doc_id} == {""}
    assert jaccard_join.keep_one(odd).count() == 1
    assert substring_dedup.remove_repeats(odd, length=10).count() == 3


def test_lists_do_not_grow_with_repeated_rows(spark):
    """Of 600 equal rows each gets the runs of one; the next text shares half of theirs and so has its bytes and words compared."""
    rng = np.random.default_rng(7)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    a, b = prose(80), prose(80)
    rows = [(1, f"{a} {b}")] + [(5, f"{a} {prose(70)} {b}")] * 600 + [(8, f"{prose(70)} {a}")]
    docs = spark.createDataFrame(rows, "doc long, text string").repartition(4)
    once = docs.distinct()
    many, few = (repeated_windows.marks_of(suffix_dedup.repeated_runs(x)).filter("doc = 5").first().marks for x in (docs, once))
    assert len(many) <= 2 * len(few) + 2
    longest = lambda x: max(len(r.marks) for r in substring_dedup.spans(x).collect())
    assert longest(docs) == longest(once)
    named = docs.withColumnRenamed("doc", "doc_id")
    got = {tuple(r) for r in suffix_dedup.digest(named).collect()}
    assert got == {(i, *v) for i, v in brute.suffix(sorted({r for r in rows})).items()}
    words = {tuple(r) for r in substring_dedup.remove_repeats(named, with_text=False).collect()}
    assert words == {(i, *v) for i, v in brute.substring(sorted({r for r in rows})).items()}


HELPERS = "doc row of_doc of_row marks several hash least most key row_key cls component root chosen first size start length shard rank group place block target epoch begin end at".split()


def test_columns_named_like_helpers(spark):
    """Whatever a caller's columns are called, they come back as they were."""
    names = [prefix + x for prefix in ("", "_", "__") for x in HELPERS]
    extra = [f"'{x}' AS `{x}`" for x in names]
    docs = spark.range(4).selectExpr("id AS doc_id", "concat(repeat('same text ', 20), if(id = 3, 'x', '')) AS text", "'a' AS source", *extra)
    docs = docs.unionByName(docs.filter("doc_id = 1").withColumn("text", F.lit("another text of the same id")))
    for f in (suffix_dedup.remove_repeats, jaccard_join.keep_one, mixing.mixed_documents, minhash.keep_one):
        out = f(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[x] == x for r in rows for x in names)


def test_packing_of_numbers():
    rng = np.random.default_rng(0)
    for values in (np.zeros(0, np.int64), rng.integers(-5, 5, 99), np.sort(rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2))):
        assert (packed.unsqueeze(packed.squeeze(values)) == values).all()
    keys = np.sort(rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2))
    assert (packed.unsqueeze_sorted(packed.squeeze_sorted(keys)) == keys).all()


def test_spans_hash_alike_wherever_they_stand():
    data = np.frombuffer(b"abcabcabcabc", np.uint8)
    p = sequences.Prefix(sequences.BYTE_CODES[data])
    assert (p.grams(3)[:3] == p.grams(3)[3:6]).all() and len(set(p.grams(3))) == 3
