"""Whitening, periodic runs and SimHash groups against plain versions of them, and in odd cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from aisleflow.llm import catalog, q_runs, runs, simhash, whiten

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------------------------------------------------------- SimHash


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 3 else [" ".join(w[k : k + 3]) for k in range(len(w) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius):
    """Smallest id reachable, over all pairs; prints: (id, fingerprint)."""
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for i, f in prints:
        for j, g in prints:
            if (f ^ g).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in prints}


def test_masks_cover_every_pair_within_the_radius():
    for radius in (0, 1, 2, 3):
        ms = simhash.masks(radius)
        assert len(ms) == 2 ** (radius + 1) - 1 and all(0 < m < 1 << 64 for m in ms)
        rng = random.Random(radius)
        for _ in range(2000):
            differ = sum(1 << k for k in rng.sample(range(64), radius))
            assert any(not differ & m for m in ms)
    assert {m.bit_count() for m in simhash.masks(2)} == {36, 37}


def test_query_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prints = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
    want = plain_groups(prints, 2)
    got = catalog.QUERIES["op13_simhash"](spark, SF).collect()
    assert {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got} == {(i, f, want[i]) for i, f in prints}
    assert len(got) == len(prints) and all(len(r.fingerprint) == 16 for r in got) and len(set(want.values())) < len(want)


@pytest.mark.parametrize(("radius", "bucket"), [(2, 1), (2, 4), (2, 1000), (1, 1), (1, 1000), (0, 2)])
def test_links_join_all_within_the_radius(spark, radius, bucket):
    """Clusters around a few centres, of which some fill a bucket, and the same groups however buckets are worked on."""
    rng = random.Random(radius)
    found = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            found.add(centre ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))))
    prints = list(enumerate(sorted(found)))
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in prints], "node long, fp long")
    links = [(r.u, r.v) for r in simhash.links(df, radius, bucket).collect()]
    by = dict(prints)
    assert all((by[u] ^ by[v]).bit_count() <= radius and u != v for u, v in links)
    root = {i: i for i in by}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    assert {i: find(i) for i in by} == plain_groups(prints, radius)


def test_simhash_odd_rows(spark):
    rows = [(5, None), (3, "   \n\t"), (4, ""), (None, "a b c d"), (9, "a b c d"), (9, "quite another text of words"), (8, "A  b\tC D"), (7, "quite another text of words"), (6, "one"), (2, "x " * 60_000), (2, "x " * 60_000), (1, "É é x\x1cy\xa0z")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, fp int, component_id string")
    got = simhash.groups(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((int(r.fingerprint, 16), r.component_id))
    assert by[None] == {(plain_print("a b c d"), None)}
    # rows of one id join what they equal; texts without words are one group
    assert {c for i in (7, 8, 9) for _, c in by[i]} == {7} and by[3] == by[4] == by[5] == {(0, 3)}
    assert by[1] == {(plain_print("É é x\x1cy\xa0z"), 1)} and by[2] == {(plain_print("x x x"), 2)} and by[6] == {(plain_print("one"), 6)}
    assert simhash.groups(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(df, 3)


# ------------------------------------------------------------------------------------------------------------------- runs


def plain_runs(x, shortest=6, periods=4):
    out = set()
    for q in range(1, len(x) // periods + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(shortest, periods * q) and not any(all(x[t] == x[t + k] for t in range(i, i + size - k)) for k in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        letters, n = rng.choice([1, 2, 2, 3, 6]), rng.randint(0, 70)
        x = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n else 0):
            a, p = rng.randrange(n), rng.randint(1, 9)
            x = x[:a] + [x[a + k % p] if a + k % p < n else 0 for k in range(rng.randint(0, 40))] + x[a:]
        yield x


def test_grouping_gives_lyndon_words():
    for x in sequences(800, 1):
        names = sorted(set(x))
        y = [names.index(c) for c in x]
        size, group = runs.lyndon(y)
        for i in range(len(y)):
            j = i + 1
            while j < len(y) and y[j:] > y[i:]:
                j += 1
            assert size[i] == j - i
            assert all((group[i] == group[k]) == (y[i : i + size[i]] == y[k : k + size[k]]) for k in range(i))


def test_runs_equal_a_scan_of_all_periods():
    for k, x in enumerate(sequences(1500, 2)):
        shortest, periods = [(6, 4), (3, 3), (9, 3), (1, 5)][k % 4]
        assert runs.runs(x, shortest, periods) == plain_runs(x, shortest, periods)
    assert runs.runs([1, 2] * 50_000) == [(0, 100_000, 2)]
    with pytest.raises(ValueError):
        runs.runs([1, 2], periods=2)


def plain_query(doc_id, text):
    w = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *head, digest("".join(f"{s},{k},{q}\n" for s, k, q in found)), digest(" ".join(c for i, c in enumerate(w) if i not in gone)))


def test_runs_query_equals_a_plain_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    # a scan of all periods grows with the square of the words: the two longest texts are left to the other tests
    docs = sorted(docs, key=lambda r: len(r.text or ""))[:-2]
    ids = {r.doc_id for r in docs}
    got = [tuple(r)[:8] for r in catalog.QUERIES["op12_runs"](spark, SF).collect() if r.doc_id in ids]
    assert sorted(got) == sorted(plain_query(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "b a " * 5), (4, "x  x\tx\nx x x y\x1cx"), (4, "x  x\tx\nx x x y\x1cx"), (5, "É é " * 8), (6, "w " * 50_000 + "end")] + [(k, t) for k in range(100, 160) for t in (None, "", "a b c a b d")]
    df = spark.createDataFrame([(*r, 7, "c") for r in rows], "doc_id long, text string, runs int, note string")
    out = runs.find_runs(df)
    assert out.columns == ["doc_id", "text", "note", "n_words", "runs", "collapsed"]
    got = {(r.doc_id, r.text): (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()}
    assert out.count() == len(rows) and got[1, None] == (0, [], "") == got[2, ""]
    assert got[None, rows[2][1]] == (10, [(0, 10, 2)], "b a") and got[4, rows[3][1]] == (7, [(0, 6, 1)], "x y\x1cx")
    assert got[5, rows[5][1]] == (16, [(0, 16, 2)], "É é") and got[6, rows[6][1]] == (50_001, [(0, 50_000, 1)], "w end")
    assert runs.find_runs(df.limit(0)).count() == 0
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    query = [tuple(r)[:8] for r in q_runs.op12_runs(spark, str(tmp_path)).where("doc_id >= 100 OR doc_id IN (1, 2, 4)").collect()]
    assert sorted(query, key=repr) == sorted((plain_query(*r) for r in rows if (r[0] or 0) in (1, 2, 4) or (r[0] or 0) >= 100), key=repr)


# -------------------------------------------------------------------------------------------------------------- whitening


def test_eigenvectors_are_right_in_clusters_too():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    for values in (
        np.linspace(1, 5, 40),
        np.r_[np.full(5, 3.0), np.linspace(0.1, 1, 35)],
        np.r_[3 + np.arange(6) * 1e-8, np.linspace(0.1, 1, 34)],
        np.r_[3 + np.arange(6) * 1e-10, 1 + np.arange(6) * 1e-5, np.linspace(0.01, 0.5, 28)],
        np.r_[1e12, np.linspace(1, 5, 39)],
        np.r_[np.zeros(10), np.linspace(0.1, 1, 30)],
    ):
        wide = q.astype(np.longdouble)
        a = np.asarray((wide * values) @ wide.T, np.float64)
        a = (a + a.T) / 2
        got, x = whiten.eigen(a)
        assert np.all(np.diff(got) <= 0)
        high = np.longdouble
        size = np.abs(a).max()
        left = a.astype(high) @ x.astype(high) - x.astype(high) * got.astype(high)
        assert np.abs(left).max() <= 4e-15 * size
        assert np.abs(x.astype(high).T @ x.astype(high) - np.eye(40)).max() <= 1e-14
        assert np.abs(got - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * size
    # eigenvalues 1e-10 apart: each vector is the one that the matrix was made of, as closely as its rounding allows
    values = np.r_[3 + np.arange(6) * 1e-8, np.linspace(0.1, 1, 34)]
    wide = q.astype(np.longdouble)
    a = np.asarray((wide * values) @ wide.T, np.float64)
    x = whiten.eigen((a + a.T) / 2)[1]
    assert np.abs(np.abs((q[:, 5::-1] * x[:, :6]).sum(0)) - 1).max() < 1e-12
    assert whiten.eigen(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def plain_whitening(vectors):
    """By id: deviation, whitened, explained, of vectors {id: list}."""
    x = {i: [int(np.floor(256 * float(c))) for c in v] for i, v in vectors.items() if v and all(c is not None and np.isfinite(c) for c in v)}
    fit = np.array(sorted(set(map(tuple, x.values()))), object)
    n, s = len(fit), fit.sum(0)
    c = (fit - np.array([float(t) / n for t in s])).astype(float)
    e, axes = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:4]
    out = {}
    for i, v in x.items():
        d = np.array(v, float) - np.array([float(t) / n for t in s])
        out[i] = (int(sum((n * a - b) ** 2 for a, b in zip(v, s))), d @ axes[:, order] / np.sqrt(e[order]), e[order] / e.sum())
    return n, out


def test_whitening_query(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    n, want = plain_whitening({r.vec_id: r.embedding for r in v})
    got = catalog.QUERIES["op11_whitening"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 4 * len(want) and {r.n for r in got} == {n} and {r.identity_error < 1e-10 for r in got} == {True}
    sign = {}
    for r in got:
        deviation, y, explained = want[r.vec_id]
        k = r.component - 1
        side = sign.setdefault(k, 1 if r.whitened * y[k] >= 0 else -1)
        assert r.deviation == deviation and r.whitened == pytest.approx(side * y[k], rel=1e-7, abs=1e-8) and r.explained == pytest.approx(explained[k], rel=1e-9)


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=3).tolist()) for k in range(40)]
    rows += [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 0.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1e30, 0.0, 0.0]), (106, [1.0, 2.0]), (None, [0.5, -0.0, -0.5]), (7, rows[7][1]), (8, rows[9][1])]
    rows = rows + rows[:30] * 3  # copies have no weight
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<double>, n int, component string")
    got = whiten.whiten(df).collect()
    sound = [r for r in rows if r[0] is None or r[0] < 100]
    n, want = plain_whitening({k: r[1] for k, r in enumerate(sound)})
    assert len(got) == 3 * len(sound) and {r.n for r in got} == {n} == {41} and {r.component for r in got} == {1, 2, 3}
    mine = {(r.vec_id, r.deviation) for r in got}
    assert mine == {(r[0], want[k][0]) for k, r in enumerate(sound)} and got[0].identity_error < 1e-10
    assert whiten.whiten(df.limit(0)).count() == 0 and whiten.whiten(df.where("vec_id IN (100, 101)")).count() == 0
    # no variance at all, or in one direction alone
    one = whiten.whiten(df.where("vec_id = 3")).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    line = whiten.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], "vec_id long, embedding array<double>")).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-10 for r in line)
    # entries whose squares don't fit a long
    big = whiten.whiten(spark.createDataFrame([(1, [1e10, 0.0]), (2, [-1e10, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.deviation for r in big}[1] is None and {r.n for r in big} == {3}
    assert sum(r.whitened for r in big if r.component == 1) == pytest.approx(0, abs=1e-9)
