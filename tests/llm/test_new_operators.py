"""Hard negatives, circulant MinHash and the Merkle manifest against brute force."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tableward.llm import hard_negatives, jaccard_join, merkle, minhash, similar
from tests.llm import brute
from tests.llm.conftest import TEXT_SCHEMA

VECTORS = "vec_id long, embedding array<float>, label int, key int, block long"


def negatives(rows, every=100, first=5):
    """All pairs, as whole numbers."""
    used = []
    for vec, x, label in rows:
        if vec is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        used.append((vec, [math.floor(256 * float(np.float32(c))) for c in x], (label + 1) % 10 if vec % 7 == 0 else label))
    out = []
    for a, x, label in used:
        if a % every:
            continue
        others = sorted((-sum(p * q for p, q in zip(x, y)), b, m) for b, y, m in used if b != a and len(y) == len(x))
        for s, p, _ in [o for o in others if o[2] == label][:first]:
            near = [(n, b) for n, b, m in others if m != label and 80 * -s <= 100 * -n <= 100 * -s][:first]
            out += [(a, p, k, b, -s, -n) for k, (n, b) in enumerate(near, 1)]
    return sorted(out)


def vectors(n, seed, dims=8, spread=2.0):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(np.float32(c)) for c in rng.normal(size=dims) * spread], int(rng.integers(0, 4))) for k in range(n)]
    for k in range(60, 130):  # ties: one vector under many ids and labels
        rows[k] = (k, rows[60][1], rows[k][2])
    rows += [(n, None, 1), (n + 1, rows[0][1], None), (None, rows[0][1], 1), (n + 2, [1.0, None] * 4, 1), (n + 3, [float("nan")] * dims, 1), (n + 4, [float("inf")] * dims, 2)]
    rows += [(700, rows[0][1][:5], 1), (800, rows[1][1][:5], 1), (801, rows[0][1][:5], 2), (900, [], 1), (901, [], 1), (902, [], 2), (903, rows[5][1], 3), (903, rows[5][1], 3)]
    return rows


@pytest.mark.parametrize("block, every", [(4096, 100), (64, 10)])
def test_hard_negatives_equal_brute_force(spark, block, every):
    rows = vectors(640, block)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS).repartition(3)
    got = sorted(tuple(r) for r in hard_negatives.mined(df, every=every, width=block).collect())
    assert got == negatives(rows, every) and len(got) > 20


def test_large_components_are_exact(spark):
    """Scores beyond 2^53, with ties that doubles would not tell apart."""
    rows = [(100, [2.0**20, 1.0], 1), (1, [2.0**20, 1.0], 1), (2, [2.0**20, 1 - 2**-8], 2), (3, [2.0**20, 1 - 2**-7], 2), (4, [2.0**30, 0.0], 2), (5, [-1.0, 0.0], 2)]
    got = hard_negatives.mined(spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS)).collect()
    assert sorted(map(tuple, got)) == negatives([r for r in rows if r[0] != 4])


def test_keys_sort_by_anchor_score_and_id():
    rng = np.random.default_rng(3)
    a, s, i = (rng.integers(-(2**62), 2**62, 300) for _ in range(3))
    a[:150], s[:80], i[:3] = 5, -7, [0, -1, 1]
    raw = [bytes(k.tobytes()) for k in hard_negatives.keys(a, s, i)]
    assert [x.tolist() for x in hard_negatives.unkeyed(raw)] == [a.tolist(), s.tolist(), i.tolist()]
    assert sorted(range(300), key=lambda k: raw[k]) == sorted(range(300), key=lambda k: (a[k], -s[k], i[k]))


def test_hard_negatives_of_an_empty_table(spark):
    assert hard_negatives.mined(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.mined(spark.createDataFrame([(1, [1.0], 1, 1, 1)], VECTORS)).count() == 0


@pytest.mark.parametrize("words, percent", [(5, 85), (3, 80)])
def test_minhash_equals_brute_force(docs, corpus, words, percent):
    got = {r.doc: (r.n, r.component) for r in minhash.groups(docs, words=words, percent=percent).collect()}
    assert got == brute.jaccard(corpus, words, percent)


def test_minhash_digest_and_rest(docs, corpus):
    want = brute.jaccard(corpus, 5, 85)
    got = minhash.digest(docs).collect()
    assert len(got) == len(corpus) and all((r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)
    kept = sorted(r.doc_id for r in minhash.keep_one(docs).collect())
    assert kept == sorted(i for i, (_, c) in want.items() if i == c)


def test_circulant_signature():
    """The second permutation is one to one, coordinates are its shifts, and equal coordinates estimate similarity."""
    values = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(minhash.second_permutation(values.copy()))) == len(values)
    rng = np.random.default_rng(1)
    own = rng.integers(0, 2**63, 700, dtype=np.uint64)
    place = minhash.first_permutation(own)
    want = [minhash.second_permutation(place - np.uint32(k)).min() for k in range(128)]
    assert minhash.signature(own).tolist() == want
    errors = []
    for both in (100, 400, 900):
        x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        y = np.concatenate([x[:both], rng.integers(0, 2**63, 1000 - both, dtype=np.uint64)])
        errors.append(abs((minhash.signature(x, 1024) == minhash.signature(y, 1024)).mean() - both / (2000 - both)))
    assert max(errors) < 0.06


def test_bands_meet_at_the_threshold():
    rng = np.random.default_rng(2)
    for size in [*range(7, 60), 100, 333, 1000]:
        for _ in range(20):
            x = rng.integers(0, 2**63, size, dtype=np.uint64)
            y = np.concatenate([x, rng.integers(0, 2**63, int(size / 0.85) - size, dtype=np.uint64)])
            assert set(minhash.bands(x)) & set(minhash.bands(y))


@pytest.mark.parametrize("module", [minhash, jaccard_join])
def test_ids_that_repeat_or_miss(spark, module):
    """One id with two texts, several rows without an id with copies among them, rows repeated whole."""
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    a, b, c = prose(80), prose(80), prose(80)
    rows = [(1, a), (2, f"{a} x"), (2, b), (None, a), (None, c), (None, c), (None, f"{c} y"), (7, b), (7, b), (8, c), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row_key int").repartition(3)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in module.digest(docs).collect())
    want = {a: 1, f"{a} x": 1, b: 2, c: 8, f"{c} y": 8, None: None, "": 9}
    assert got == sorted((str(i), str(want[t])) for i, t in rows)
    kept = module.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.text) for r in kept.collect()) == sorted(map(str, [a, b, c, None, ""]))
    assert {r.doc_id for r in kept.collect() if r.text in (a, b, c)} == {1, 2, 8}


def test_look_alikes_below_the_threshold_stay(spark):
    """A group of texts that share most shingles, none of them linked, and one link among them."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(60):
        own = list(base)
        for p in rng.choice(200, 9, replace=False):
            own[p] = f"x{k}-{p}"
        rows.append((k, " ".join(own), "en", "s", 1))
    rows.append((60, rows[30][1] + " z", "en", "s", 1))
    docs = spark.createDataFrame(rows, TEXT_SCHEMA)
    want = brute.jaccard(rows, 5, 85)
    assert want[60][1] == want[30][1]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.digest(docs).collect()} == want


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(rows, fan=3):
    """{row number: (leaf, subroot, root, proof, folded, verified)} by whole levels."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda r, text: digest(*map(field, (r[0], r[3], r[2], r[4], text)))
    leaves = [leaf_of(r, r[1]) for r in rows]
    by_source = defaultdict(list)
    for k, r in enumerate(rows):
        by_source[r[3]].append(k)

    def grow(level):
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for k, p in enumerate(at):
                run = level[p // fan * fan : p // fan * fan + fan]
                paths[k].append((run[: p % fan], run[p % fan + 1 :]))
                at[k] = p // fan
            level = [digest(*level[p : p + fan]) for p in range(0, len(level), fan)]
        return level[0], paths

    subroots, own = {}, {}
    for source, ks in by_source.items():
        ks.sort(key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaves[k]))
        subroots[source], paths = grow([leaves[k] for k in ks])
        own |= dict(zip(ks, paths))
    order = sorted(subroots, key=lambda s: (s is not None, (s or "").encode()))
    root, tops = grow([subroots[s] for s in order])
    out = {}
    for k, r in enumerate(rows):
        path = own[k] + tops[order.index(r[3])]
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
        now = leaf_of(r, r[1].replace("\n", "")) if changed else leaves[k]
        for left, right in path:
            now = digest(*left, now, *right)
        out[k] = (r[0], leaves[k], subroots[r[3]], root, digest(*(d for left, right in path for d in left + right)), now, now == root)
    return out


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_equals_brute_force(spark, docs, corpus, levels):
    got = sorted((tuple(r) for r in merkle.audited(docs, levels).collect()), key=str)
    assert got == sorted(tree(corpus).values(), key=str)
    assert any(r[6] for r in got) and not all(r[6] for r in got)


@pytest.mark.parametrize("n", [1, 7, 28])
def test_ragged_ends(spark, n):
    rows = [(k, f"a\n{k}", None, None if k % 5 == 0 else f"s{k % 2}", k) for k in range(n)] + [(None, None, None, "s1", None), (3, "again", "en", "s1", 1)]
    extra = [(*r, "x", 1) for r in rows]
    docs = spark.createDataFrame(extra, TEXT_SCHEMA + ", tree string, pos int").repartition(2)
    assert sorted(map(str, (tuple(r) for r in merkle.audited(docs, 1).collect()))) == sorted(map(str, tree(rows).values()))


def test_every_length_of_a_source():
    """Blocks of nine leaves, their roots appended again, against whole levels."""
    for n in range(1, 100):
        level = leaves = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
        while len(level) > 1:
            level = [merkle.node(level[p : p + 3]) for p in range(0, len(level), 3)]
        nodes, steps = leaves, [bytearray() for _ in leaves]
        below = [[k] for k in range(n)]
        while True:
            roots, over = [], []
            for p in range(0, len(nodes), 9):
                appender = merkle.Appender(2)
                told = [appender.append(d)[0] for d in nodes[p : p + 9]]
                roots.append(appender.close(len(nodes) > 9))
                over.append([k for own in below[p : p + 9] for k in own])
                for own, step in zip(below[p : p + 9], told):
                    for k in own:
                        steps[k] += step
            nodes, below = roots, over
            if len(nodes) == 1:
                break
        assert nodes == level and all(merkle.fold(d, bytes(s))[0] == level[0] for d, s in zip(leaves, steps))


def test_manifest_of_an_empty_table(spark, no_docs):
    assert merkle.audited(no_docs).count() == 0 and minhash.digest(no_docs).count() == 0 and minhash.keep_one(no_docs).count() == 0


def test_a_changed_sibling_is_found_out():
    appender = merkle.Appender(2)
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(8)]
    steps = [appender.append(d)[0] for d in leaves]
    root = appender.close(True)
    for d, s in zip(leaves, steps):
        assert merkle.fold(d, bytes(s))[0] == root
        broken = bytearray(s)
        broken[5] ^= 1
        assert merkle.fold(d, bytes(broken))[0] != root


def test_odd_sketches_bound_differences():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, 500, dtype=np.uint64)
    y = np.concatenate([x[40:], rng.integers(0, 2**63, 30, dtype=np.uint64)])
    bits = sum((int(p) ^ int(q) & (2**64 - 1)).bit_count() if p >= 0 <= q else ((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(similar.odd_sketch(x), similar.odd_sketch(y)))
    assert 0 < bits <= 70
