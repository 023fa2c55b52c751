"""Whitening against a full eigen-decomposition of the covariance."""

import math

import numpy as np
import pytest

from dialex.llm import whitening


def brute_force(rows, components=16):
    """{(id, component): (n, deviation, |whitened|, explained)} of rows (id, vector)."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=np.int64)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    mean = np.array([s / n for s in sums])
    centred = fit - mean
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:components] > 1e-12 * values[0]).sum())
    out = []
    for i, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        for j in range(k):
            out.append((i, j + 1, n, deviation, abs(float((np.array(x) - mean) @ vectors[:, j])) / math.sqrt(values[j]), values[j] / np.trace(cov)))
    return out


def check(got, rows, close=1e-6):
    order = lambda r: (str(r[0]), r[1], r[3], round(r[4], 4))
    mine = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=order)
    want = sorted(brute_force(rows), key=order)
    assert [m[:4] for m in mine] == [w[:4] for w in want]
    assert np.allclose([m[4] for m in mine], [w[4] for w in want], atol=close) and np.allclose([m[5] for m in mine], [w[5] for w in want], rtol=1e-9)
    assert len({r.identity_error for r in got}) <= 1 and all(r.identity_error < 1e-9 for r in got)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<float>").repartition(3)


def spectrum(n, scales, seed=1):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((len(scales), len(scales))))[0]
    return (rng.standard_normal((n, len(scales))) * scales) @ turn


def test_flat_spectrum_is_expanded_to_the_full_dimension(spark):
    data = spectrum(400, np.linspace(3, 1, 40))
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    vectors = table(spark, rows)
    model = whitening.fit(vectors.select(whitening.whole_numbers(vectors.embedding).alias("x")))
    assert model.expanded and model.passes == whitening.PASSES + 2
    check(whitening.whiten(vectors).collect(), rows)


def test_steep_spectrum_needs_no_expansion(spark):
    """Whole numbers bring noise of a third of a step, so the scales are large beside it."""
    data = np.rint(spectrum(300, [*(2.0 ** np.arange(20, 0, -1)), *[0.0] * 20], 2))
    data[:, 20:] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    vectors = table(spark, rows)
    x = vectors.select(whitening.whole_numbers(vectors.embedding).alias("x"))
    model = whitening.fit(x, components=4, passes=12)
    assert not model.expanded and model.passes < 14 and len(model.values) == 4
    full = whitening.fit(x, components=4, passes=1)
    assert full.expanded and np.allclose(full.values, model.values, rtol=1e-12) and np.allclose(np.abs((full.vectors * model.vectors).sum(0)), 1, atol=1e-10)


def test_nulls_repeats_and_odd_entries(spark):
    data = spectrum(60, np.linspace(4, 1, 5), 3)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(100, None), (101, []), (102, [1, None, 1, 1, 1]), (103, [float("nan")] * 5), (104, [1, 2, float("inf"), 0, 0]), (None, data[3].tolist()), (5, data[5].tolist()), (200, data[7].tolist())]
    check(whitening.whiten(table(spark, rows)).collect(), rows)


def test_few_dimensions_and_directions(spark):
    rows = [(i, [i % 5, 0.0, 2.0 * (i % 5)]) for i in range(50)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r.component for r in got} == {1} and {r.n for r in got} == {5}
    check(got, rows)
    for same in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitening.whiten(table(spark, same)).count() == 0


def test_errors_instead_of_wrong_numbers(spark):
    with pytest.raises(ValueError, match="from 1 to 2"):
        whitening.whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    big = table(spark, [(i, [1e8 * i, 1.0]) for i in range(20)])
    with pytest.raises(Exception, match="deviation"):
        whitening.whiten(big).collect()


def test_clashing_columns(spark):
    data = [(i, v.tolist()) for i, v in enumerate(spectrum(30, [2.0, 1.0], 4))]
    odd = spark.createDataFrame([(i, [float(c) for c in v], 1, 2.0, 3) for i, v in data], "x long, v array<float>, n int, `a.b` double, vec_id int")
    got = whitening.whiten(odd, "x", "v").collect()
    assert {r.vec_id for r in got} == set(range(30))
    check(got, data)


def test_registered_query_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(whitening.op13_whitening(spark, sf_dir).collect(), rows)
