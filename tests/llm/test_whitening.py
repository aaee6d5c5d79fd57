"""Whitening against exact fractions and a plain eigen-solve."""

from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest
from nearkey.llm import whitening
from pyspark.sql import functions as F

from tests.llm.conftest import SF

VECTORS = "vec_id long, embedding array<float>"


def exact_fit(vectors):
    """Of equally long lists of floats: different integer vectors, exact sums, exact covariance."""
    xs = sorted({tuple(floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors})
    n, dim = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(dim)]
    d = [[Fraction(n * x[i] - sums[i], n) for i in range(dim)] for x in xs]
    return xs, n, sums, [[sum(r[i] * r[j] for r in d) / n for j in range(dim)] for i in range(dim)]


def by_vector(df):
    out = {}
    for r in whitening.whiten(df).collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.2] @ rng.normal(size=(6, 6))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    return rows + [(1000 + i, v) for i, v in rows[:40]] + [(5, rows[5][1])]


def test_covariance_is_that_of_fractions(spark, wide):
    _, n, sums, v = exact_fit([x for _, x in wide])
    fit = whitening.integers(spark.createDataFrame(wide, VECTORS)).select("dim", "x").distinct().repartition(7)
    model = whitening._counts(fit)[6]
    assert (model.n, model.sums) == (n, sums)
    high, low = whitening.outer_sums(fit, {6: model}, False)[6]
    for got_high, got_low, i, j in zip(high, low, *np.triu_indices(6)):
        got, want = (Fraction(got_high) + Fraction(got_low)) / n, v[i][j]
        assert abs(got - want) <= abs(want) * Fraction(1, 10**27) + Fraction(1, 10**24)


def test_rows_equal_a_plain_whitening(spark, wide):
    xs, n, sums, v = exact_fit([x for _, x in wide])
    values, axes = np.linalg.eigh(np.array([[float(c) for c in row] for row in v]))
    values, axes = values[::-1], axes[:, ::-1].T
    found = by_vector(spark.createDataFrame(wide, VECTORS).withColumns({"n": F.lit("x"), "component": F.lit(9)}))
    assert len(found) == len({i for i, _ in wide}) and all(sorted(c) == list(range(1, 7)) for c in found.values())
    signs = {}
    for vec_id, vector in wide:
        x = [floor(64 * float(c)) + 1_000_000 for c in vector]
        d = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        for k in range(6):
            got, want = found[vec_id][k + 1], float(axes[k] @ d / np.sqrt(values[k]))
            signs.setdefault(k, np.sign(got["whitened"] * want))
            assert abs(got["whitened"] * signs[k] - want) < 1e-8
            assert got["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums)) and got["n"] == n
            assert abs(got["explained"] - values[k] / values.sum()) < 1e-12 and got["identity_error"] < 1e-10
    whole = np.array([[found[i][k]["whitened"] for k in range(1, 7)] for i in {x: i for i, x in reversed([(i, tuple(v)) for i, v in wide])}.values()])
    assert len(whole) <= n + 40


def test_vectors_without_a_direction_odd_lengths_and_bad_entries(spark):
    rows = [
        (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 2.0]), (None, [4.0, 2.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
        (9, [0.5]), (10, [0.5]), (11, [1.0, 2.0, 3.0]), (12, [0.0, 0.0]), (13, [-0.01, 1e30]),
    ]
    found = by_vector(spark.createDataFrame(rows[:-1], VECTORS))
    assert set(found) == {1, 2, 3, None, 9, 10, 11, 12}
    # the second entry of the pairs varies with the first only through the zero vector
    assert all(len(found[i]) == 2 and found[i][1]["n"] == 4 for i in (1, 2, 3, None, 12))
    assert [found[i][1][c] for i in (9, 11) for c in ("n", "deviation", "whitened", "explained", "identity_error")] == [1, 0, None, None, None] * 2
    lone = by_vector(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], VECTORS))
    assert lone[1][2]["whitened"] is None and lone[1][2]["explained"] == 0 and abs(lone[1][1]["whitened"]) == 1 and lone[1][1]["identity_error"] == 0
    huge = by_vector(spark.createDataFrame([rows[0], rows[-1]], VECTORS))
    assert huge[13][1]["deviation"] is None and abs(abs(huge[1][1]["whitened"]) - 1) < 1e-12


def test_no_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], VECTORS)).count() == 0


def test_sums_are_exact_transformations():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200) * 10.0 ** rng.integers(-9, 9, 200), rng.normal(size=200)
    for op, (high, low) in ((lambda x, y: x + y, whitening.two_sum(a, b)), (lambda x, y: x * y, whitening.two_product(a, b))):
        assert all(op(Fraction(x), Fraction(y)) == Fraction(h) + Fraction(l) for x, y, h, l in zip(a, b, high, low))


def test_query_whitens_the_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [r["embedding"] for r in table.collect()]
    _, n, _, v = exact_fit(vectors)
    found = whitening.query(spark, SF).toPandas()
    assert len(found) == 16 * len(vectors) and set(found["n"]) == {n} and found["identity_error"].max() < 1e-10
    values = np.linalg.eigvalsh(np.array([[float(c) for c in row] for row in v]))[::-1]
    assert np.abs(found.groupby("component")["explained"].first().to_numpy() - values[:16] / values.sum()).max() < 1e-12
