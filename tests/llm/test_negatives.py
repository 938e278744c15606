"""Products in residues against big integers, and hard negatives against brute force."""

import math
import random

import numpy as np
import pytest

from tablesmith.llm import negatives


@pytest.mark.parametrize("width, size", [(1, 3), (7, 100), (64, 300), (300, 5000), (700, 1 << 20), (3, 1 << 26)])
def test_products_are_exact(width, size):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-size, size, (n, width), np.int64, endpoint=True) for n in (23, 31))
    a[0], b[0], b[1] = size, size, -size
    bound = width * size * size
    assert (negatives.products(a, b, bound) == a @ b.T).all()


def test_primes():
    assert all(p < 512 and all(p % d for d in range(2, p)) for p in negatives.PRIMES)
    assert (max(negatives.PRIMES) // 2) ** 2 * negatives.CHUNK < 1 << 24
    assert math.prod(negatives.moduli(1 << 55)) > 1 << 56
    assert len(negatives.moduli(60_000)) == 2


def brute(rows, positives=5, count=3):
    use = []
    for i, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        use.append((i, [math.floor(256 * c) for c in x], label))
    out = []
    for k, (i, v, label) in enumerate(use):
        if i is None or i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, l, m) for m, (j, w, l) in enumerate(use) if m != k)
        for s, _, p, l, _ in [x for x in scored if x[3] == label][:positives]:
            good = [x for x in scored if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            for rank, (t, none, q, _, _) in enumerate(good[:count], 1):
                out.append((i, p, rank, None if none else q, -s, -t))
    return sorted(out, key=str)


def table():
    rnd = random.Random(4)
    rows = []
    centres = [[rnd.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    for i in range(400):
        c = rnd.choice(centres)
        x = [float(np.float32(round(a + rnd.gauss(0, 0.7), rnd.choice([0, 1, 6])))) for a in c]
        rows.append((i, x, rnd.choice([0, 0, 0, 1, 2, 9])))
    rows += [(1000, None, 1), (1050, [0.5] * 12, None), (1100, [0.1, None], 0), (1150, [float("nan")] * 12, 0), (1200, [float("inf")] * 12, 0)]
    rows += [(1250, [1.0, 2.0], 0), (1300, [], 0), (1350, [1.0] * 15, 1), (None, centres[0], 3), (-50, centres[1], 2)]
    return rows + [rows[3], rows[3], rows[100], (1400, rows[50][1], 0), (1401, rows[50][1], 9)]


@pytest.mark.parametrize("groups", [(1024, 2048), (3, 40)])
def test_hard_negatives(spark, groups):
    rows = table()
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS row", "'x' AS v", "0 AS rank")
    got = negatives.hard_negatives(negatives.flipped(negatives.integer_vectors(docs)), anchor_group=groups[0], row_group=groups[1]).collect()
    # float components, as the table holds them
    want = brute([(i, x and [c if c is None else float(np.float32(c)) for c in x], l) for i, x, l in rows])
    assert sorted((tuple(r) for r in got), key=str) == want
    assert len(want) > 50


def test_few_rows(spark):
    kind = "vec_id long, label long, v array<long>"
    assert negatives.hard_negatives(spark.createDataFrame([], kind)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, 1, [3])], kind)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(0, 1, [3]), (50, 1, [])], kind)).count() == 0
    rows = [(0, 1, [2]), (1, 1, [10]), (2, 2, [5]), (3, 2, [9]), (4, 3, [4]), (5, 3, [-8])]
    got = {tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(0, 1, 1, 3, 20, 18), (0, 1, 2, 2, 20, 10)}
    with pytest.raises(ValueError):
        negatives.hard_negatives(spark.createDataFrame([(0, 1, [1 << 30]), (1, 2, [1])], kind))
