"""Element-wise tensor arithmetic and activations as Column expressions.

A rank-1 tensor is a column; aligned tensors are columns of one row.  All
functions follow IEEE-754 where Spark's own operators do not: division by zero
gives an infinity or NaN, the logarithm of zero is ``-inf``, and comparisons
with NaN are false.  A null is a missing element and stays null.

:func:`over_arrays` and :func:`over_array` lift the same functions to rows
that hold a whole tensor as an array; unequal lengths raise, and a scalar
(an array of one element) is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
GELU_CUBIC = 0.044715
GELU_SCALE = 0.7978845608028654  # sqrt(2 / pi)


def _d(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def add(a: Column, b: Column) -> Column:
    return _d(a) + _d(b)


def sub(a: Column, b: Column) -> Column:
    return _d(a) - _d(b)


def mul(a: Column, b: Column) -> Column:
    return _d(a) * _d(b)


def div(a: Column, b: Column) -> Column:
    """IEEE division, for signed zeros too: the sign of ``1/-0.0`` is taken from its text form."""
    a, b = _d(a), _d(b)
    negative_zero = b.cast("string") == "-0.0"
    down = (a < 0) != negative_zero
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(down, F.lit(-INF)).otherwise(F.lit(INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def pow(a: Column, b: Column) -> Column:  # noqa: A001
    return F.pow(_d(a), _d(b))


def neg(a: Column) -> Column:
    return -_d(a)


def abs(a: Column) -> Column:  # noqa: A001
    return F.abs(_d(a))


def sqrt(a: Column) -> Column:
    return F.sqrt(_d(a))


def exp(a: Column) -> Column:
    return F.exp(_d(a))


def log(a: Column) -> Column:
    a = _d(a)
    return F.when(F.isnan(a) | (a < 0), F.lit(NAN)).when(a == 0, F.lit(-INF)).otherwise(F.ln(a))


def identity(a: Column) -> Column:
    return a


def _compare(a: Column, b: Column, test: Callable[[Column, Column], Column]) -> Column:
    a, b = _d(a), _d(b)
    ordered = ~F.isnan(a) & ~F.isnan(b) & test(a, b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(ordered.cast("double"))


def equal(a: Column, b: Column) -> Column:
    return _compare(a, b, lambda x, y: x == y)


def greater(a: Column, b: Column) -> Column:
    return _compare(a, b, lambda x, y: x > y)


def less(a: Column, b: Column) -> Column:
    return _compare(a, b, lambda x, y: x < y)


def where(cond: Column, then: Column, otherwise: Column) -> Column:
    """``then`` where the mask is neither 0 nor null, else ``otherwise``."""
    return F.when(_d(cond) != 0, _d(then)).otherwise(_d(otherwise))


def relu(x: Column) -> Column:
    x = _d(x)
    return F.when(F.isnan(x) | (x > 0), x).when(x.isNull(), x).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_d(x)))


def tanh(x: Column) -> Column:
    return F.tanh(_d(x))


def gelu(x: Column) -> Column:
    """The tanh approximation."""
    x = _d(x)
    return F.lit(0.5) * x * (F.lit(1.0) + F.tanh(F.lit(GELU_SCALE) * (x + F.lit(GELU_CUBIC) * x * x * x)))


def leaky_relu(x: Column, alpha: float = 0.01) -> Column:
    x = _d(x)
    return F.when(F.isnan(x) | (x >= 0), x).otherwise(x * F.lit(alpha))


def over_array(fn: Callable[[Column], Column], a: Column) -> Column:
    """``fn`` on each element of an array."""
    return F.transform(a, fn)


def over_arrays(fn: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    """``fn`` on the elements of two arrays of one length; an array of one element is broadcast."""
    n, m = F.size(a), F.size(b)
    aligned = F.zip_with(a, b, fn)
    spread_b = F.transform(a, lambda x: fn(x, F.get(b, F.lit(0))))
    spread_a = F.transform(b, lambda y: fn(F.get(a, F.lit(0)), y))
    wrong = F.raise_error(F.concat(F.lit("shapes differ: "), n.cast("string"), F.lit(" and "), m.cast("string")))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(n == m, aligned).when(m == 1, spread_b).when(n == 1, spread_a).otherwise(wrong)


def softmax_array(a: Column) -> Column:
    """Softmax of an array, shifted by its maximum; an empty array stays empty."""
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(_d(x) - _d(top)))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def dot_arrays(a: Column, b: Column) -> Column:
    """The inner product of two arrays of one length."""
    products = over_arrays(lambda x, y: _d(x) * _d(y), a, b)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def zeros_array(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def ones_array(n: int) -> Column:
    return F.array_repeat(F.lit(1.0), n)
