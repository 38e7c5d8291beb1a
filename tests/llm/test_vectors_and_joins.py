"""Vector codes, whitening and the Jaccard join against plain versions, with nulls, ties, repeated rows and empty tables."""

import hashlib
import re
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import jaccard_join, vector_codes, whitening

FIELDS = "vec_id long, embedding array<float>, label int, code string, x double"
RNG = np.random.default_rng(11)


def rows_of(vectors, ids=None):
    return [(i, v, None if n % 7 == 3 else n % 4, "clash", 1.0) for n, (i, v) in enumerate(zip(ids or range(len(vectors)), vectors))]


GOOD = [list(map(float, v)) for v in (RNG.normal(size=(150, 32)) * RNG.choice([0.02, 0.3, 3.0], (150, 1))).astype(np.float32)]
GOOD += [[0.0] * 32, [0.0] * 32, GOOD[3], GOOD[3], [-0.001] * 32]  # ties, copies, floors below zero
BAD = [None, [None] + [0.0] * 31, [float("nan")] + [0.0] * 31, [float("inf")] * 32, [1.0] * 31 + [float("-inf")]]
IDS = [*range(150), 150, 151, 3, 3, None]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_of(GOOD, IDS) + [(900 + i, v, 1, "clash", 1.0) for i, v in enumerate(BAD)], FIELDS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], FIELDS)


def plain_codes(rows, entries, parts=16, rounds=2):
    """Every entry is evaluated for every part."""
    kept = [(r[0], [int(np.floor(256 * c)) for c in r[1]], r[2], r[1]) for r in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    w = len(kept[0][1]) // parts
    cut = [[x[p * w : (p + 1) * w] for p in range(parts)] for _, x, _, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    near = lambda: [[min((far(c[p], e), i) for i, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        found = near()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found = near()
    out = [(k[0], "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f), k[2]) for k, f in zip(kept, found)]
    by = {}
    for _, _, e, label in out:
        by[label] = by.get(label, 0) + e
    return sorted(((i, c, e, by[label]) for i, c, e, label in out), key=repr), books


@pytest.mark.parametrize("entries", [64, 5, 256])
def test_codes(table, entries):
    want, books = plain_codes(rows_of(GOOD, IDS), entries)
    got, learned = vector_codes.compressed(table, entries=entries)
    assert learned == books
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()), key=repr) == want
    numbers = ",".join(str(x) for b in books for e in b for x in e)
    assert vector_codes.digest(learned) == hashlib.sha256(numbers.encode()).hexdigest()


def test_nearest_is_exact_with_ties_and_equal_norms():
    for trial in range(200):
        rng = np.random.default_rng(trial)
        top = int(rng.choice([2, 5, 300, 1 << 26]))
        book, parts = rng.integers(-top, top + 1, (int(rng.integers(1, 40)), 3)), rng.integers(-top, top + 1, (60, 3))
        book = np.r_[book, book[: len(book) // 2], -book[:2]]
        far = ((parts[:, None] - book[None]) ** 2).sum(2)
        name, d = vector_codes.Codebook(book).nearest(parts)
        assert (name == far.argmin(1)).all() and (d == far.min(1)).all()


def test_vectors_without_rows_or_of_unlike_lengths(spark, none):
    got, books = vector_codes.compressed(none)
    assert got.count() == 0 and books == [[]] * 16
    assert whitening.whitened(none).count() == 0
    bad = spark.createDataFrame([(i, v, 1, "", 1.0) for i, v in enumerate(BAD)], FIELDS)
    assert vector_codes.compressed(bad)[0].count() == 0 and whitening.whitened(bad).count() == 0
    unlike = spark.createDataFrame([(1, [1.0] * 16, 1, "", 1.0), (2, [1.0] * 32, 1, "", 1.0)], FIELDS)
    for f in (vector_codes.compressed, whitening.whitened):
        with pytest.raises(ValueError, match="length"):
            f(unlike)


def plain_whitening(vectors):
    """Exact fractions up to the covariance; numpy's decomposition of it in twice the digits is not needed for these."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    s = [sum(c) for c in zip(*fit)]
    cov = [[sum(Fraction(n * r[i] - s[i]) * (n * r[j] - s[j]) for r in fit) / n**3 for j in range(d)] for i in range(d)]
    return x, n, s, cov


def test_whitening(table):
    x, n, s, cov = plain_whitening(GOOD)
    v = np.array([[float(c) for c in r] for r in cov])
    trace = float(sum(cov[i][i] for i in range(len(cov))))
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    want = {}
    for i, row in zip(IDS, x):
        far = sum((n * c - t) ** 2 for c, t in zip(row, s))
        want.setdefault((i, far), np.array([float(Fraction(n * c - t, n)) for c, t in zip(row, s)]) @ axes / np.sqrt(values))
    got = whitening.whitened(table).collect()
    assert len(got) == 16 * len(GOOD) and {(r.vec_id, int(r.deviation)) for r in got} == set(want)
    signs = {}
    for r in got:
        w = want[r.vec_id, int(r.deviation)][r.component - 1]
        if abs(w) > 1e-6:
            signs.setdefault(r.component, set()).add(np.sign(w) == np.sign(r.whitened))
        assert abs(abs(w) - abs(r.whitened)) <= 1e-9 * max(1, abs(w))
        assert r.n == n and abs(r.explained - values[r.component - 1] / trace) <= 1e-10 * r.explained and r.identity_error < 1e-9
    assert all(len(x) == 1 for x in signs.values())


def test_gram_is_exact_for_any_size():
    rng = np.random.default_rng(3)
    for top in (1, 900, 1 << 20, 1 << 33, 1 << 61):
        y = rng.integers(-top, top, (300, 4))
        want = y.astype(object).T @ y.astype(object)
        assert (whitening.exact_gram(y) == want).all()
    long = np.full((3 * whitening.ROWS + 5, 2), (1 << 20) - 1)
    assert int(whitening.exact_gram(long)[0, 1]) == len(long) * ((1 << 20) - 1) ** 2


def test_small_variances_beside_a_large_one():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(80, 12))
    base -= base.mean(0)
    scale = np.ones(12)
    scale[5] = 1e8
    cov = (base * scale).T @ (base * scale) / 80
    values, axes = whitening.principal(cov)
    rest = [i for i in range(12) if i != 5]
    c = base.T @ base / 80
    small = np.linalg.eigvalsh(c[np.ix_(rest, rest)] - np.outer(c[rest, 5], c[rest, 5]) / c[5, 5])[::-1]
    assert np.allclose(values[1:], small, rtol=1e-7) and np.abs(axes.T @ axes - np.eye(12)).max() < 1e-13


def test_no_variance_gives_zero(spark):
    same = spark.createDataFrame([(i, [0.5] * 16, 1, "", 1.0) for i in range(5)], FIELDS)
    got = whitening.whitened(same).collect()
    assert len(got) == 5 * 16 and {(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, 0.0, 0.0, 0.0)}
    flat = spark.createDataFrame([(i, [float(i % 9)] * 3 + [1.0], 1, "", 1.0) for i in range(20)], FIELDS)
    got = whitening.whitened(flat).collect()
    assert {r.component for r in got} == {1, 2, 3, 4} and {r.whitened for r in got if r.component > 1} == {0.0}
    assert all(abs(r.explained - 1) < 1e-12 for r in got if r.component == 1)


WORDS = ["".join(RNG.choice(list("abcdefgh"), 3)) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def changed(text, k):
    w = text.split()
    for i in RNG.choice(len(w), k, replace=False):
        w[i] = prose(1)
    return " ".join(w)


def plain_components(rows, percent, k):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().lower().decode())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)), key=lambda r: (rows[r][0], r))
                top[y] = x
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = d if r not in low or low[r] is None else min(low[r], d)
    return sorted(((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.fixture(scope="module")
def texts():
    base = [prose(n) for n in (4, 5, 6, 8, 9, 12, 20, 40, 80, 150, 400, 1500)]
    passage = prose(60)
    out = [None, "", " \n", "one", "one two three", "ONE two THREE", *base, *[b.upper() for b in base[:4]]]
    for b in base:  # near copies at all distances, in chains
        t = b
        for k in range(12):
            t = changed(t, max(1, len(t.split()) // 60))
            out.append(t)
        out += [b + " " + prose(max(1, len(b.split()) // 9)), " ".join(b.split()[: max(1, len(b.split()) * 85 // 100 + 2)])]
    out += [prose(int(n)) + " " + passage + " " + prose(int(n)) for n in RNG.integers(1, 60, 60)]  # a frequent passage
    out += ["\x00 nul \x00 word here and some more words " + prose(30), "é ü " + prose(20), "word " * 500]
    return out


@pytest.mark.parametrize(("percent", "k"), [(85, 4), (60, 2), (100, 5)])
def test_jaccard_join(spark, texts, percent, k):
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[20]), (7, texts[8]), (7, texts[8]), (None, texts[9]), (None, None)]
    df = spark.createDataFrame([(d, t, 3, "x", "y") for d, t in rows], "doc_id long, text string, n long, bucket string, row string").repartition(6)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(df, percent, k).collect()), key=repr)
    assert got == plain_components(rows, percent, k)


def test_jaccard_join_without_rows(spark):
    assert jaccard_join.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bits_bound_the_sets():
    rng = np.random.default_rng(8)
    for n in (3, 60, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[: len(a) * 9 // 10], rng.integers(0, 1 << 63, len(a) // 8, dtype=np.uint64)])
        parity, wide = jaccard_join.parities(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]))
        apart = len(np.setxor1d(a, b))
        assert int(np.bitwise_count((parity[0] ^ parity[1]).view(np.uint64)).sum()) <= apart
        if wide[0] and wide[1]:
            p, q = sorted((np.frombuffer(x, np.uint8) for x in wide), key=len)
            assert int(np.bitwise_count(p ^ np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0)).sum()) <= apart
