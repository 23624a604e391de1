"""Whitening and hard negatives next to plain forms."""

import math
from collections import defaultdict

import numpy as np
import pytest

from gridsift.llm import catalog, negatives, spectrum, whitening

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id long, embedding array<float>, label int, id string, key int, vector int, n int, component int, anchor int, x int"
EXTRA = ("a", 1, 2, 3, 4, 5, 6)


def vectors(spark, rows):
    """Rows with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(5) if rows else spark.createDataFrame([], SCHEMA)


def invented(n, size, seed, labels=3, spread=0.2):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(c)) for c in rng.normal(0, spread, size)], int(rng.integers(labels))) for i in range(n)]


ODD = [
    (9001, None, 1), (9002, [], 1), (9003, [0.1, None, 0.2, 0.3], 1), (9004, [0.1, NAN, 0.2, 0.3], 1), (9005, [INF, 0.0, 0.0, 0.0], 1),
    (9006, [0.5, 0.5], 1), (9007, [0.1] * 9, 2), (None, [0.25, 0.5, -0.5, 0.1], 1), (9009, [0.1, 0.2, 0.3, 0.4], None),
]


def plain_levels(rows):
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = defaultdict(int)
    for _, x in good:
        lengths[len(x)] += 1
    size = max(lengths, key=lambda k: (lengths[k], k), default=0)
    return [(i, x) for i, x in good if len(x) == size]


def check_whitening(spark, rows, components=16):
    kept = plain_levels(rows)
    out = whitening.whiten(vectors(spark, rows), components=components).collect()
    fit = sorted({tuple(x) for _, x in kept})
    n, size = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(size)]
    centred = np.array([[n * x[k] - sums[k] for k in range(size)] for x in fit], np.float64) / n
    cov = centred.T @ centred / n
    e = np.linalg.eigvalsh(cov)[::-1]
    rank = min(components, int((e > 1e-9 * max(e[0], 1e-300)).sum()))
    assert len(out) == len(kept) * rank
    far = defaultdict(list)
    for i, x in kept:
        far[i].append(sum((n * x[k] - sums[k]) ** 2 for k in range(size)))
    by_row = defaultdict(list)
    for r in out:
        by_row[r["component"]].append((r["vec_id"] is None, r["vec_id"], r["whitened"], int(r["deviation"])))
        assert r["n"] == n and int(r["deviation"]) in far[r["vec_id"]]
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) <= 1e-9
        assert r["identity_error"] <= 1e-9
    assert sorted(by_row) == list(range(1, rank + 1))
    return kept, fit, by_row


def test_whitening_of_odd_rows(spark):
    rows = invented(300, 4, 1)
    rows += rows[:40] + [(7, rows[0][1], 1)] * 200 + ODD
    kept, fit, by_row = check_whitening(spark, rows)
    # Whitened values over the fit list: mean 0, covariance the identity.
    mean = np.mean(fit, axis=0)
    x = np.array([v for _, v in kept]) - mean
    cov = np.cov(np.array(fit).T, bias=True)
    e, v = np.linalg.eigh(cov)
    ids = [i for i, _ in kept]
    for c, got in by_row.items():
        want = x @ v[:, -c] / math.sqrt(e[-c])
        pairs = sorted(zip([i is None for i in ids], [i or 0 for i in ids], want, strict=True))
        found = sorted((none, i or 0, w) for none, i, w, _ in got)
        flipped = sorted((none, i or 0, -w) for none, i, w, _ in got)
        assert any(np.allclose([p[2] for p in pairs], [f[2] for f in side], atol=1e-8) for side in (found, flipped))


def test_whitening_of_few_dimensions_and_equal_eigenvalues(spark):
    # Entries on a line, and corners of a square, whose two eigenvalues are equal.
    check_whitening(spark, [(i, [i / 64, 2 * i / 64, 0.0], 0) for i in range(20)])
    _, _, by_row = check_whitening(spark, [(i, [(i % 2) / 8, (i // 2) / 8], 0) for i in range(4)])
    w = np.array([[x[2] for x in sorted(by_row[c])] for c in (1, 2)])
    assert np.allclose(w @ w.T / 4, np.eye(2))


def test_whitening_without_rows_or_spread(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, ODD[:5])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)])).count() == 0


def test_whitening_of_far_entries_is_exact(spark):
    rows = [(i, [float(np.float32(10.0 ** (i % 7) * (i - 11))), float(i), 1e30 if i == 3 else 0.25], 0) for i in range(24)]
    out = {(r["vec_id"], r["component"]): r for r in whitening.whiten(vectors(spark, rows)).collect()}
    held = [[max(min(math.floor(64 * c), 2.0**60), -(2.0**60)) for c in np.array(v, np.float32).astype(float)] for _, v, _ in rows]
    held = [[int(c) for c in v] for v in held]
    n, sums = len(set(map(tuple, held))), [sum(x[k] for x in held) for k in range(3)]
    for (i, _), r in out.items():
        far = sum((n * held[i][k] - sums[k]) ** 2 for k in range(3))
        assert r["deviation"] == (far if far < 10**38 else None)
        assert r["identity_error"] < 1e-4


def test_polynomial_and_roots_are_exact():
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 7):
        b = rng.integers(-50, 50, (size, size + 2)).astype(object)
        m = (b @ b.T).tolist()
        p = spectrum.characteristic_polynomial(m)
        # p(k) is the determinant of k - m, by fractions.
        for k in (-3, 0, 11):
            a = [[spectrum.Fraction(k * (i == j) - m[i][j]) for j in range(size)] for i in range(size)]
            det = spectrum.Fraction(1)
            for c in range(size):
                r = next((r for r in range(c, size) if a[r][c]), None)
                if r is None:
                    det = spectrum.Fraction(0)
                    break
                if r != c:
                    a[c], a[r], det = a[r], a[c], -det
                det *= a[c][c]
                for r in range(c + 1, size):
                    f = a[r][c] / a[c][c]
                    a[r] = [x - f * y for x, y in zip(a[r], a[c], strict=True)]
            assert sum(x * k**d for d, x in enumerate(p)) == det
    # (x - 2)^2 (x - 3) x, and a zero pivot on the way to Hessenberg form.
    assert [(round(float(r), 12), n) for r, n in spectrum.greatest_roots([0, -12, 16, -7, 1], 9)] == [(3.0, 1), (2.0, 2)]
    values, v = spectrum.leading([[4, 0, 0, 2], [0, 3, 0, 0], [0, 0, 3, 0], [2, 0, 0, 4]], 4)
    assert [round(float(x), 12) for x in values] == [6, 3, 3, 2] and np.allclose(v @ v.T, np.eye(4))


def plain_negatives(rows, step=100, floor=(80, 100), k=5):
    lengths = defaultdict(int)
    good = [(i, v, label) for i, v, label in rows if label is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    for _, v, _ in good:
        lengths[len(v)] += 1
    size = max(lengths, key=lambda k: (lengths[k], k), default=0)
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v], label) for i, v, label in good if len(v) == size]
    out = []
    order = lambda s, i: (-s, i is None, i or 0)
    for a, (i, x, label) in enumerate(good):
        if i is None or i % step:
            continue
        scored = [(sum(p * q for p, q in zip(x, y, strict=True)), j, m) for b, (j, y, m) in enumerate(good) if b != a]
        for s, j, _ in sorted((r for r in scored if r[2] == label), key=lambda r: order(r[0], r[1]))[:k]:
            window = [r for r in scored if r[2] != label and floor[0] * s <= floor[1] * r[0] <= floor[1] * s]
            for rank, r in enumerate(sorted(window, key=lambda r: order(r[0], r[1]))[:k], 1):
                out.append((i, j, rank, r[1], s, r[0]))
    return out


def both(rows_df, rows, **more):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(map(tuple, rows_df.collect()), key=key), sorted(plain_negatives(rows, **more), key=key)


@pytest.mark.parametrize("blocks", [(4096, 512), (7, 2)])
def test_negatives(spark, monkeypatch, blocks):
    monkeypatch.setattr(negatives, "ROWS", blocks[0])
    monkeypatch.setattr(negatives, "ANCHORS", blocks[1])
    rows = invented(150, 4, 2)
    # Many equal vectors, repeated ids (an anchor's too), null ids, rows that take no part.
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(60)] + rows[:12] + [(200, rows[3][1], 0)] * 3 + ODD
    got, want = both(negatives.hard_negatives(vectors(spark, rows), anchor_step=10), rows, step=10)
    assert got == want and len({r[0] for r in want}) > 10 and any(r[3] is None or r[1] is None for r in want)


def test_negatives_of_few_rows(spark):
    assert negatives.hard_negatives(vectors(spark, [])).count() == 0
    assert negatives.hard_negatives(vectors(spark, ODD)).count() == 0
    assert negatives.hard_negatives(vectors(spark, [(5, [1.0], 1), (6, [1.0], 2)])).count() == 0
    rows = [(100, [1.0, 0.5], 1), (1, [0.9, 0.4], 1), (2, [0.9, 0.3], 2), (3, [-1.0, 0.0], 1)]
    got, want = both(negatives.hard_negatives(vectors(spark, rows)), rows)
    assert got == want and len(got) == 1


@pytest.mark.parametrize("far", [3, 255, 1 << 20, 1 << 29])
def test_scores_are_exact(far):
    rng = np.random.default_rng(far)
    left, right = (rng.integers(-far, far + 1, (n, 13)) for n in (9, 14))
    assert (negatives.scores(left, right) == (left.astype(object) @ right.T.astype(object)).astype(np.int64)).all()
    assert (negatives.orders(negatives.scores(left, right)).argsort(axis=1) >= 0).all()


def test_components_beyond_the_limit(spark):
    rows = [(i, [float(np.float32(1e30 * (i % 3 - 1))), 0.5], i % 2) for i in range(20)]
    out = negatives.hard_negatives(vectors(spark, rows), anchor_step=5).collect()
    top = negatives.limit_of(2)
    assert out and all(abs(r["positive_score"]) <= top * top + 128 * 128 for r in out)


def test_queries_leave_nothing_out(spark):
    from tests.conftest import SF

    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    out = catalog.QUERIES["op11_whitening"](spark, SF)
    assert out.count() == 16 * n and dict(out.dtypes)["deviation"] == "bigint"
