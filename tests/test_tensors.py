import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfed.functions import elementwise as E
from loomfed.operators import coo, joins
from loomfed.operators.coo import ShapeError

NAN, INF = float("nan"), float("inf")


def column(spark, expr, *values):
    rows = [tuple(float(x) if x is not None else None for x in v) for v in values]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in "abc"[: len(rows[0])]))
    return [r[0] for r in df.select(expr).collect()]


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None and w is None) or (g is not None and w is not None and (math.isnan(g) and math.isnan(w) or g == pytest.approx(w))), (got, want)


def test_division_and_logarithm_follow_ieee(spark):
    A, B = F.col("a"), F.col("b")  # noqa: N806
    same(column(spark, E.div(A, B), (1, 0), (-1, 0), (0, 0), (1, -0.0), (NAN, 0), (6, 3), (None, 0), (INF, 2)), [INF, -INF, NAN, -INF, NAN, 2, None, INF])
    same(column(spark, E.log(A), (0,), (-1,), (1,), (NAN,), (None,), (INF,)), [-INF, NAN, 0, NAN, None, INF])
    same(column(spark, E.sqrt(A), (-1,), (4,)), [NAN, 2])
    same(column(spark, E.pow(A, B), (-8, 1 / 3), (2, 10)), [NAN, 1024])


def test_comparisons_with_nan_are_false(spark):
    A, B = F.col("a"), F.col("b")  # noqa: N806
    pairs = [(1, 1), (NAN, NAN), (2, 1), (NAN, 1), (1, NAN), (None, 1)]
    same(column(spark, E.equal(A, B), *pairs), [1, 0, 0, 0, 0, None])
    same(column(spark, E.greater(A, B), *pairs), [0, 0, 1, 0, 0, None])
    same(column(spark, E.less(A, B), *pairs), [0, 0, 0, 0, 0, None])


def test_activations(spark):
    A, B = F.col("a"), F.col("b")  # noqa: N806
    xs = [(-2,), (0,), (3,), (NAN,), (None,)]
    same(column(spark, E.relu(A), *xs), [0, 0, 3, NAN, None])
    same(column(spark, E.leaky_relu(A), *xs), [-0.02, 0, 3, NAN, None])
    same(column(spark, E.sigmoid(A), (0,)), [0.5])
    same(column(spark, E.gelu(A), (0,), (1,)), [0, 0.841192])
    same(column(spark, E.where(A, B, -B), (1, 5), (0, 5), (None, 5)), [5, -5, -5])


def test_arrays_are_aligned_broadcast_or_refused(spark):
    A, B = F.col("a"), F.col("b")  # noqa: N806
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [10.0], [1.0, 2.0, 3.0])], "a array<double>, b array<double>, s array<double>, w array<double>")
    r = df.select(E.over_arrays(E.add, A, B), E.over_arrays(E.mul, A, F.col("s")), E.over_arrays(E.sub, F.col("s"), A), E.dot_arrays(A, B), E.softmax_array(A)).first()
    assert r[0] == [4, 6] and r[1] == [10, 20] and r[2] == [9, 8] and r[3] == 11 and sum(r[4]) == pytest.approx(1)
    with pytest.raises(Exception, match="shapes differ"):
        df.select(E.over_arrays(E.add, A, F.col("w"))).collect()


def dense(t):
    out = np.full(t.dims, np.nan)
    for r in t.df.collect():
        out[tuple(r[c] for c in t.index)] = r["v"]
    return out


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    a, b = rng.normal(size=(4, 6)), rng.normal(size=(6, 3))
    return a, b, coo.constant(spark, a.ravel().tolist(), a.shape), coo.constant(spark, b.ravel().tolist(), b.shape)


def test_linear_algebra(spark, pair):
    a, b, x, y = pair
    np.testing.assert_allclose(dense(coo.matmul(x, y)), a @ b)
    c = coo.constant(spark, [1.0, 2.0, 3.0], (3,))
    np.testing.assert_allclose(dense(coo.gemm(x, y, c, alpha=2, beta=0.5)), 2 * a @ b + 0.5 * np.array([1, 2, 3]))
    np.testing.assert_allclose(dense(coo.gemm(x, x, trans_b=True)), a @ a.T)
    np.testing.assert_allclose(dense(coo.dot(x, x)), (a * a).sum(1))
    with pytest.raises(ShapeError):
        coo.matmul(y, x)
    with pytest.raises(ShapeError):
        coo.dot(x, y)


def test_reductions_and_softmax(pair):
    a, _, x, _ = pair
    np.testing.assert_allclose(dense(coo.reduce_sum(x, [0])), a.sum(0))
    np.testing.assert_allclose(dense(coo.reduce_mean(x, [-1], keepdims=True)), a.mean(1, keepdims=True))
    np.testing.assert_allclose(dense(coo.reduce_max(x)), a.max())
    np.testing.assert_allclose(dense(coo.reduce_min(x, [1])), a.min(1))
    for axis in (0, 1):
        e = np.exp(a - a.max(axis, keepdims=True))
        np.testing.assert_allclose(dense(coo.softmax(x, axis)), e / e.sum(axis, keepdims=True))
    np.testing.assert_allclose(dense(coo.global_average_pool(coo.reshape(x, (2, 3, 4)))), a.reshape(2, 3, 4).mean(2, keepdims=True))


def test_nan_poisons_reductions(spark):
    t = coo.constant(spark, [1.0, NAN, 3.0, 4.0], (2, 2))
    for fn in (coo.reduce_min, coo.reduce_max, coo.reduce_sum):
        got = dense(fn(t, [1]))
        assert math.isnan(got[0]) and not math.isnan(got[1])


def test_shape_operators(spark, pair):
    a, _, x, _ = pair
    np.testing.assert_allclose(dense(coo.transpose(coo.transpose(x))), a)
    np.testing.assert_allclose(dense(coo.reshape(x, (3, -1))), a.reshape(3, 8))
    np.testing.assert_allclose(dense(coo.concat(coo.split(x, [1, 2, 3], 1), 1)), a)
    np.testing.assert_allclose(dense(coo.slice(x, [1, -5], [99, -1], steps=[2, 1])), a[1:99:2, -5:-1])
    np.testing.assert_allclose(dense(coo.squeeze(coo.unsqueeze(x, [0, -1]))), a)
    np.testing.assert_allclose(dense(coo.cast(coo.unary(x, lambda v: v * 10), "int")), np.trunc(a * 10))
    picks = spark.createDataFrame([(0, 2), (1, 2), (2, -4)], "pos int, idx int")
    np.testing.assert_allclose(dense(coo.gather(x, picks, 3, axis=1)), a[:, [2, 2, 0]])
    with pytest.raises(Exception, match="out of range"):
        coo.gather(x, spark.createDataFrame([(0, 6)], "pos int, idx int"), 1, axis=1).df.collect()
    for bad in (lambda: coo.reshape(x, (5, -1)), lambda: coo.split(x, [1, 1], 1), lambda: coo.squeeze(x, [0]), lambda: coo.concat([x, coo.zeros(spark, (1, 5))]), lambda: coo.transpose(x, [0, 0])):
        with pytest.raises(ShapeError):
            bad()


def test_broadcast_and_creation(spark, pair):
    a, _, x, _ = pair
    row = coo.constant(spark, list(range(6)), (6,))
    np.testing.assert_allclose(dense(coo.binary(x, row, E.add)), a + np.arange(6))
    np.testing.assert_allclose(dense(coo.binary(x, coo.ones(spark, (1,)), E.sub)), a - 1)
    assert (dense(coo.zeros(spark, (2, 2))) == 0).all()
    with pytest.raises(ShapeError):
        coo.binary(x, coo.zeros(spark, (4, 5)), E.add)


def test_normalisation_pooling_convolution_scatter(spark, pair):
    a, _, x, _ = pair
    np.testing.assert_allclose(dense(coo.layer_normalization(x)), (a - a.mean(1, keepdims=True)) / np.sqrt(a.var(1, keepdims=True) + 1e-5))
    np.testing.assert_allclose(dense(coo.max_pool(x, 3, 2)), np.stack([a[:, 0:3].max(1), a[:, 2:5].max(1)], 1))
    np.testing.assert_allclose(dense(coo.average_pool(x, 2)), a.reshape(4, 3, 2).mean(2))
    kernel = np.array([[[1.0, 2.0, -1.0]], [[0.5, 0.0, 1.0]]])
    out = dense(coo.conv(coo.unsqueeze(x, [1]), coo.constant(spark, kernel.ravel().tolist(), kernel.shape), coo.constant(spark, [0.5, -0.5], (2,)), pads=1))
    padded = np.pad(a, ((0, 0), (1, 1)))
    for o in range(2):
        want = sum(padded[:, k : k + 6] * kernel[o, 0, k] for k in range(3)) + (0.5, -0.5)[o]
        np.testing.assert_allclose(out[:, o], want)
    updated = a.copy()
    updated[1:3] = 7
    np.testing.assert_allclose(dense(coo.overwrite(x, coo.slice(x, [1], [3], axes=[0]).df.selectExpr("i0 + 1 AS i0", "i1", "7D AS v"))), updated)
    grown = coo.loop(9, x, lambda k, t: coo.unary(t, lambda v: v + 1), lambda k, t: k < 9, cut_every=4)
    np.testing.assert_allclose(dense(grown), a + 9)


def _convolved(x, w, bias, strides, pads, dilations, group):
    """Two-dimensional convolution, one output element at a time."""
    n, c, _, _ = x.shape
    o, wc, kh, kw = w.shape
    p = np.pad(x, ((0, 0), (0, 0), (pads[0], pads[2]), (pads[1], pads[3])))
    lengths = [(p.shape[2 + k] - dilations[k] * (w.shape[2 + k] - 1) - 1) // strides[k] + 1 for k in (0, 1)]
    out = np.zeros((n, o, *lengths))
    for b, f, i, j in np.ndindex(out.shape):
        own = p[b, f // (o // group) * wc :][:wc, i * strides[0] :, j * strides[1] :]
        out[b, f, i, j] = bias[f] + sum(own[ch, a * dilations[0], d * dilations[1]] * w[f, ch, a, d] for ch, a, d in np.ndindex(wc, kh, kw))
    return out


@pytest.mark.parametrize(("strides", "pads", "dilations", "group"), [((1, 1), (0, 0, 0, 0), (1, 1), 1), ((2, 1), (1, 0, 2, 1), (1, 2), 2), ((1, 2), (3, 3, 3, 3), (2, 2), 4)])
def test_convolution_in_two_dimensions(spark, strides, pads, dilations, group):
    rng = np.random.Generator(np.random.PCG64(4))
    x, w, b = rng.normal(size=(2, 4, 5, 6)), rng.normal(size=(4, 4 // group, 2, 3)), rng.normal(size=4)
    own = [coo.constant(spark, a.ravel().tolist(), a.shape) for a in (x, w, b)]
    np.testing.assert_allclose(dense(coo.conv(*own, strides, pads, dilations, group)), _convolved(x, w, b, strides, pads, dilations, group))
    with pytest.raises(ShapeError):
        coo.conv(own[0], own[1], group=3)


def test_convolution_is_dealt_by_its_products(spark, monkeypatch):
    monkeypatch.setattr(joins, "PART_ROWS", 1_000)
    rng = np.random.Generator(np.random.PCG64(5))
    w, b = rng.normal(size=(4, 1, 2, 3)), rng.normal(size=4)
    for samples in (400, 2):  # whole samples in a part, and parts of samples
        x = rng.normal(size=(samples, 2, 5, 6))
        own = [coo.constant(spark, a.ravel().tolist(), a.shape) for a in (x, w, b)]
        out = coo.conv(*own, (2, 1), (2, 3, 2, 3), (1, 1), 2)
        plan = out.df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_g" not in plan and "SortMergeJoin" not in plan  # two channels were two tasks
        assert plan.count("hashpartitioning(i0#") == 1 and f", {-(-samples * 60 * 12 // 1_000)})" in plan.replace(", REPARTITION_BY_NUM", ")")
        np.testing.assert_allclose(dense(out), _convolved(x, w, b, (2, 1), (2, 3, 2, 3), (1, 1), 2), atol=1e-12)
    assert coo.zeros(spark, (50, 200)).df.rdd.getNumPartitions() == 10


def test_pooling_over_two_axes_with_pads(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    x = rng.normal(size=(2, 3, 5, 6)) - 5
    t = coo.constant(spark, x.ravel().tolist(), x.shape)
    padded = {fill: np.pad(x, ((0, 0), (0, 0), (1, 0), (2, 1)), constant_values=fill) for fill in (-np.inf, 0.0, np.nan)}
    lengths = (2, 4)

    def windows(a, fn):
        return np.stack([np.stack([fn(a[:, :, 2 * i : 2 * i + 3, 2 * j : 2 * j + 3]) for j in range(lengths[1])], -1) for i in range(lengths[0])], -2)

    own = ((3, 3), (2, 2), (1, 2, 0, 1))
    np.testing.assert_allclose(dense(coo.max_pool(t, *own)), windows(padded[-np.inf], lambda a: a.max((2, 3))))
    np.testing.assert_allclose(dense(coo.average_pool(t, *own)), windows(padded[np.nan], lambda a: np.nanmean(a, (2, 3))))
    np.testing.assert_allclose(dense(coo.average_pool(t, *own, count_include_pad=True)), windows(padded[0.0], lambda a: a.mean((2, 3))))
    with pytest.raises(ShapeError):
        coo.max_pool(t, (2, 2), (1, 1), (2, 0, 0, 0))


def test_scatter_and_layer_normalisation_by_tensors(spark, pair):
    a, _, x, _ = pair
    to = np.array([[0, -1], [3, 3], [1, 0], [5, 2]])
    new = np.arange(8.0).reshape(4, 2)
    want = a.copy()
    for i, j in np.ndindex(4, 2):
        want[i, to[i, j]] = new[i, j]
    own = [coo.constant(spark, v.ravel().tolist(), v.shape) for v in (to, new)]
    np.testing.assert_allclose(dense(coo.scatter(x, *own, axis=1)), want)
    with pytest.raises(Exception, match="out of range"):
        coo.scatter(x, coo.constant(spark, [6.0], (1, 1)), coo.ones(spark, (1, 1)), axis=1).df.collect()
    with pytest.raises(ShapeError):
        coo.scatter(x, own[0], coo.ones(spark, (2, 2)))
    scale, bias = np.arange(6.0), np.arange(6.0)[::-1].copy()
    row = [coo.constant(spark, v.tolist(), v.shape) for v in (scale, bias)]
    np.testing.assert_allclose(dense(coo.layer_normalization(x, *row)), (a - a.mean(1, keepdims=True)) / np.sqrt(a.var(1, keepdims=True) + 1e-5) * scale + bias)
    with pytest.raises(ShapeError):
        coo.layer_normalization(x, coo.ones(spark, (5,)))
