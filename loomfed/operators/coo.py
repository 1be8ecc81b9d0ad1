"""Tensors in long form: one row per element, ``i0 .. i{r-1}`` and ``v``.

A :class:`Coo` has its dimensions on the driver and its elements in a
DataFrame, so index arithmetic is a projection, a contraction is an equi-join
with a partial aggregation, and a reduction is a ``groupBy`` over the axes that
stay.  Tensors are dense: every index has a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elementwise as E
from .joins import parts_of
from .lineage import cut

#: Kernels and biases of up to so many elements are broadcast.
BROADCAST_TAPS = 65_536


class ShapeError(ValueError):
    """The shapes or axes of an operation do not fit."""


@dataclass(frozen=True)
class Coo:
    """A tensor: ``df`` has the index columns and ``v``."""

    df: DataFrame
    dims: tuple[int, ...]

    @property
    def rank(self) -> int:
        return len(self.dims)

    @property
    def index(self) -> list[str]:
        return [f"i{k}" for k in range(self.rank)]

    def axis(self, axis: int) -> int:
        """The axis counted from the front; a negative one counts from the back."""
        if not -self.rank <= axis < self.rank:
            raise ShapeError(f"axis {axis} of a tensor of rank {self.rank}")
        return axis % self.rank


def _take(df: DataFrame, columns: Sequence[Column], v: Column, dims: Sequence[int]) -> Coo:
    return Coo(df.select(*[c.cast("long").alias(f"i{k}") for k, c in enumerate(columns)], v.cast("double").alias("v")), tuple(dims))


def from_arrays(df: DataFrame, array_col: str, order_col: str, rows: int, width: int) -> Coo:
    """A matrix whose rows are the arrays; ``order_col`` holds the row index from 0."""
    flat = df.select(F.col(order_col).alias("r"), F.posexplode(array_col).alias("c", "x"))
    return _take(flat, [F.col("r"), F.col("c")], F.col("x"), (rows, width))


def constant(spark: SparkSession, values: Sequence[float], dims: Sequence[int]) -> Coo:
    """A literal tensor, row-major."""
    if math.prod(dims) != len(values):
        raise ShapeError(f"{len(values)} values for {tuple(dims)}")
    flat = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k long, x double")
    return _take(flat, _unflat(F.col("k"), dims), F.col("x"), dims)


def fill(spark: SparkSession, dims: Sequence[int], value: float) -> Coo:
    size = math.prod(dims)
    flat = spark.range(0, size, 1, max(parts_of(size), spark.sparkContext.defaultParallelism)).withColumnRenamed("id", "k")
    return _take(flat, _unflat(F.col("k"), dims), F.lit(value), dims)


def zeros(spark: SparkSession, dims: Sequence[int]) -> Coo:
    return fill(spark, dims, 0.0)


def ones(spark: SparkSession, dims: Sequence[int]) -> Coo:
    return fill(spark, dims, 1.0)


def _small(df: DataFrame, dims: Sequence[int]) -> DataFrame:
    """The table of a kernel or bias, broadcast if it is small: as a key, a few channels would be a few tasks."""
    return F.broadcast(df) if math.prod(dims) <= BROADCAST_TAPS else df


def _flat(t: Coo) -> Column:
    return fold(lambda k, ax: k * t.dims[ax] + F.col(f"i{ax}"), range(t.rank), F.lit(0).cast("long"))


def _unflat(k: Column, dims: Sequence[int]) -> list[Column]:
    out, step = [], math.prod(dims)
    for d in dims:
        step //= max(d, 1)
        out.append(F.floor(k / F.lit(max(step, 1))) % F.lit(max(d, 1)))
    return out


def unary(t: Coo, fn: Callable[[Column], Column]) -> Coo:
    return _take(t.df, [F.col(c) for c in t.index], fn(F.col("v")), t.dims)


def binary(a: Coo, b: Coo, fn: Callable[[Column, Column], Column]) -> Coo:
    """``fn`` on two tensors of one shape; a scalar or a last-axis row is broadcast."""
    right = b.df.select(*[F.col(c).alias(f"_{c}") for c in b.index], F.col("v").alias("_v"))
    if a.dims == b.dims:
        on = [F.col(c) == F.col(f"_{c}") for c in a.index]
    elif b.rank == 1 and a.rank >= 1 and b.dims[0] == a.dims[-1]:
        on = [F.col(f"i{a.rank - 1}") == F.col("_i0")]
    elif math.prod(b.dims) == 1:
        return _take(_beside(a.df, right), [F.col(c) for c in a.index], fn(F.col("v"), F.col("_v")), a.dims)
    else:
        raise ShapeError(f"{a.dims} and {b.dims}")
    joined = a.df.join(right, fold(lambda x, y: x & y, on)) if on else _beside(a.df, right)
    return _take(joined, [F.col(c) for c in a.index], fn(F.col("v"), F.col("_v")), a.dims)


def _beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Each row with the columns of a table of one row, so broadcasting has a proven bound."""
    key = F.lit(0).alias("_one")
    return df.select("*", key).join(F.broadcast(one_row.select("*", key)), "_one").drop("_one")


def _with_stats(t: Coo, by: Sequence[str], *stats: Column) -> DataFrame:
    """The elements with aggregates over each group of the index columns ``by``."""
    if not by:
        return _beside(t.df, t.df.agg(*stats))
    return t.df.join(t.df.groupBy(*by).agg(*stats), list(by))


def matmul(a: Coo, b: Coo) -> Coo:
    """The product of two matrices: an equi-join on the inner index and a partial sum."""
    if a.rank != 2 or b.rank != 2 or a.dims[1] != b.dims[0]:
        raise ShapeError(f"{a.dims} x {b.dims}")
    left = a.df.select("i0", F.col("i1").alias("k"), F.col("v").alias("x"))
    right = b.df.select(F.col("i0").alias("k"), "i1", F.col("v").alias("y"))
    out = left.join(right, "k").groupBy("i0", "i1").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    return Coo(out, (a.dims[0], b.dims[1]))


def gemm(a: Coo, b: Coo, c: Coo | None = None, alpha: float = 1.0, beta: float = 1.0, trans_a: bool = False, trans_b: bool = False) -> Coo:
    """``alpha * op(a) op(b) + beta * c``; ``c`` has the full shape or is a row."""
    product = unary(matmul(transpose(a) if trans_a else a, transpose(b) if trans_b else b), lambda v: v * F.lit(alpha))
    return product if c is None else binary(product, c, lambda x, y: x + F.lit(beta) * y)


def dot(a: Coo, b: Coo) -> Coo:
    """Contracts the last axis of two tensors of one shape."""
    if not a.rank or a.dims != b.dims:
        raise ShapeError(f"{a.dims} and {b.dims}")
    return reduce_sum(binary(a, b, E.mul), [a.rank - 1])


def _reduce(t: Coo, axes: Sequence[int] | None, keepdims: bool, agg: Callable[[Column], Column]) -> Coo:
    if not math.prod(t.dims):
        raise ShapeError("reduction of an empty tensor")
    gone = set(range(t.rank)) if axes is None else {t.axis(a) for a in axes}
    stay = [k for k in range(t.rank) if k not in gone]
    out = t.df.groupBy(*[f"i{k}" for k in stay]).agg(agg(F.col("v")).alias("v"))
    if keepdims:
        return _take(out, [F.lit(0) if k in gone else F.col(f"i{k}") for k in range(t.rank)], F.col("v"), [1 if k in gone else t.dims[k] for k in range(t.rank)])
    return _take(out, [F.col(f"i{k}") for k in stay], F.col("v"), [t.dims[k] for k in stay])


def reduce_sum(t: Coo, axes: Sequence[int] | None = None, keepdims: bool = False) -> Coo:
    return _reduce(t, axes, keepdims, F.sum)


def reduce_mean(t: Coo, axes: Sequence[int] | None = None, keepdims: bool = False) -> Coo:
    return _reduce(t, axes, keepdims, F.avg)


def reduce_max(t: Coo, axes: Sequence[int] | None = None, keepdims: bool = False) -> Coo:
    """NaN poisons: Spark orders it above every number."""
    return _reduce(t, axes, keepdims, F.max)


def nan_min(v: Column) -> Column:
    """The least value; NaN if there is one."""
    return F.when(F.max(F.isnan(v)), F.lit(E.NAN)).otherwise(F.min(v))


def reduce_min(t: Coo, axes: Sequence[int] | None = None, keepdims: bool = False) -> Coo:
    return _reduce(t, axes, keepdims, nan_min)


def global_average_pool(t: Coo) -> Coo:
    """The mean over the axes from 2 on, each kept with length 1."""
    if t.rank < 3:
        raise ShapeError("global average pooling needs rank 3 at least")
    return reduce_mean(t, list(range(2, t.rank)), keepdims=True)


def softmax(t: Coo, axis: int = -1) -> Coo:
    """Max-shifted softmax along an axis: two aggregations joined back on the other axes."""
    ax = t.axis(axis)
    others = [c for k, c in enumerate(t.index) if k != ax]
    e = _with_stats(t, others, F.max("v").alias("_top")).select(*t.index, F.exp(F.col("v") - F.col("_top")).alias("v"))
    return Coo(_with_stats(Coo(e, t.dims), others, F.sum("v").alias("_sum")).select(*t.index, (F.col("v") / F.col("_sum")).alias("v")), t.dims)


def reshape(t: Coo, dims: Sequence[int]) -> Coo:
    """Row-major; one dimension may be -1."""
    dims, total = list(dims), math.prod(t.dims)
    if dims.count(-1) > 1:
        raise ShapeError("more than one dimension to infer")
    if -1 in dims:
        rest = math.prod(d for d in dims if d != -1)
        if not rest or total % rest:
            raise ShapeError(f"{t.dims} to {tuple(dims)}")
        dims[dims.index(-1)] = total // rest
    if math.prod(dims) != total:
        raise ShapeError(f"{t.dims} to {tuple(dims)}")
    return _take(t.df.withColumn("_k", _flat(t)), _unflat(F.col("_k"), dims), F.col("v"), dims)


def transpose(t: Coo, perm: Sequence[int] | None = None) -> Coo:
    """A projection: the index columns change places."""
    perm = list(perm) if perm is not None else list(range(t.rank))[::-1]
    if sorted(perm) != list(range(t.rank)):
        raise ShapeError(f"permutation {perm} of rank {t.rank}")
    return _take(t.df, [F.col(f"i{p}") for p in perm], F.col("v"), [t.dims[p] for p in perm])


def _moved(t: Coo, ax: int, by: Column) -> list[Column]:
    return [by if k == ax else F.col(c) for k, c in enumerate(t.index)]


def concat(tensors: Sequence[Coo], axis: int = 0) -> Coo:
    ax = tensors[0].axis(axis)
    if len({t.dims[:ax] + t.dims[ax + 1 :] for t in tensors}) > 1:
        raise ShapeError("concat of unequal shapes")
    parts, at = [], 0
    for t in tensors:
        parts.append(_take(t.df, _moved(t, ax, F.col(f"i{ax}") + at), F.col("v"), t.dims).df)
        at += t.dims[ax]
    dims = list(tensors[0].dims)
    dims[ax] = at
    return Coo(fold(DataFrame.unionByName, parts), tuple(dims))


def slice(t: Coo, starts: Sequence[int], ends: Sequence[int], axes: Sequence[int] | None = None, steps: Sequence[int] | None = None) -> Coo:  # noqa: A001
    """A range of each named axis, clamped to it; negative bounds count from the end."""
    axes = [t.axis(a) for a in (axes if axes is not None else range(len(starts)))]
    out = t
    for ax, start, end, step in zip(axes, starts, ends, steps or [1] * len(axes), strict=True):
        if step < 1:
            raise ShapeError("steps are 1 at least")
        d = out.dims[ax]
        low, high = (min(max(x + d if x < 0 else x, 0), d) for x in (start, end))
        c = F.col(f"i{ax}")
        dims = list(out.dims)
        dims[ax] = max(0, -(-(high - low) // step))
        kept = out.df.filter((c >= low) & (c < high) & ((c - low) % step == 0))
        out = _take(kept, _moved(out, ax, F.floor((c - low) / step)), F.col("v"), dims)
    return out


def split(t: Coo, sizes: Sequence[int], axis: int = 0) -> list[Coo]:
    ax = t.axis(axis)
    if sum(sizes) != t.dims[ax]:
        raise ShapeError(f"sizes {list(sizes)} of {t.dims[ax]}")
    at = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
    return [slice(t, [a], [b], [ax]) for a, b in zip(at, at[1:], strict=False)]


def squeeze(t: Coo, axes: Sequence[int] | None = None) -> Coo:
    gone = {k for k, d in enumerate(t.dims) if d == 1} if axes is None else {t.axis(a) for a in axes}
    if any(t.dims[k] != 1 for k in gone):
        raise ShapeError("only axes of length 1 can go")
    stay = [k for k in range(t.rank) if k not in gone]
    return _take(t.df, [F.col(f"i{k}") for k in stay], F.col("v"), [t.dims[k] for k in stay])


def unsqueeze(t: Coo, axes: Sequence[int]) -> Coo:
    rank = t.rank + len(axes)
    new = {a % rank for a in axes}
    if len(new) != len(axes):
        raise ShapeError("an axis is named twice")
    old = iter(range(t.rank))
    source = [None if k in new else next(old) for k in range(rank)]
    return _take(t.df, [F.lit(0) if s is None else F.col(f"i{s}") for s in source], F.col("v"), [1 if s is None else t.dims[s] for s in source])


def cast(t: Coo, to: str) -> Coo:
    """A real cast of the values, for example to ``int`` or ``float``."""
    return Coo(t.df.withColumn("v", F.col("v").cast(to)), t.dims)


def gather(t: Coo, indices: DataFrame, count: int, axis: int = 0) -> Coo:
    """Slices at ``indices`` (columns ``pos``, ``idx``); repeats are allowed, an index out of range raises."""
    ax = t.axis(axis)
    picks = indices.select(
        F.col("pos").cast("long").alias("_pos"),
        F.when(F.col("idx") >= t.dims[ax], F.raise_error(F.lit("index out of range"))).otherwise(F.greatest(F.floor("idx"), F.lit(0))).cast("long").alias("_idx"),
    )
    joined = t.df.join(picks, F.col(f"i{ax}") == F.col("_idx"))
    dims = list(t.dims)
    dims[ax] = count
    return _take(joined, _moved(t, ax, F.col("_pos")), F.col("v"), dims)


def overwrite(t: Coo, updates: DataFrame) -> Coo:
    """Replaces the elements that ``updates`` (the index columns and ``v``) has rows for."""
    new = updates.select(*[F.col(c).alias(f"_{c}") for c in t.index], F.col("v").alias("_v"))
    on = fold(lambda x, y: x & y, [F.col(c) == F.col(f"_{c}") for c in t.index])
    return _take(t.df.join(new, on, "left"), [F.col(c) for c in t.index], F.coalesce("_v", "v"), t.dims)


def scatter(t: Coo, indices: Coo, updates: Coo, axis: int = 0) -> Coo:
    """Puts each element of ``updates`` where it stands, but at ``indices`` along ``axis``.

    Both have one shape, at most that of ``t`` on the other axes.  Negative
    indices count from the end and one out of range raises; of several updates
    of one element the last one in row-major order counts.
    """
    ax = t.axis(axis)
    fits = indices.dims == updates.dims and updates.rank == t.rank and all(u <= d for k, (u, d) in enumerate(zip(updates.dims, t.dims, strict=True)) if k != ax)
    if not fits:
        raise ShapeError(f"indices {indices.dims} and updates {updates.dims} into {t.dims}")
    length = t.dims[ax]
    placed = updates.df.withColumn("_at", _flat(updates)).join(indices.df.withColumnRenamed("v", "_to"), updates.index)
    outside = (F.col("_to") < -length) | (F.col("_to") >= length)
    to = F.when(outside, F.raise_error(F.lit("index out of range"))).otherwise(F.pmod(F.floor("_to"), F.lit(length))).cast("long")
    moved = placed.select(*[to.alias(c) if k == ax else F.col(c) for k, c in enumerate(t.index)], "_at", "v")
    return overwrite(t, moved.groupBy(*t.index).agg(F.max_by("v", "_at").alias("v")))


def batch_normalization(t: Coo, params: DataFrame, epsilon: float = 1e-5) -> Coo:
    """Per-channel (axis 1) normalisation; ``params`` has ``c, scale, bias, mean, var``."""
    joined = t.df.join(params, F.col("i1") == F.col("c"))
    y = (F.col("v") - F.col("mean")) / F.sqrt(F.col("var") + epsilon) * F.col("scale") + F.col("bias")
    return _take(joined, [F.col(c) for c in t.index], y, t.dims)


def layer_normalization(t: Coo, scale: Coo | float = 1.0, bias: Coo | float = 0.0, axis: int = -1, epsilon: float = 1e-5) -> Coo:
    """Normalises over the axes from ``axis`` on; ``scale`` and ``bias`` are numbers or tensors of those axes."""
    ax = t.axis(axis)
    df = _with_stats(t, t.index[:ax], F.avg("v").alias("_mean"), F.var_pop("v").alias("_var"))
    values = []
    for name, of in (("_scale", scale), ("_bias", bias)):
        if isinstance(of, Coo):
            if of.dims != t.dims[ax:]:
                raise ShapeError(f"{of.dims} for the axes {t.dims[ax:]}")
            df = df.join(of.df.select(*[F.col(f"i{k}").alias(f"i{ax + k}") for k in range(of.rank)], F.col("v").alias(name)), t.index[ax:])
        values.append(F.col(name) if isinstance(of, Coo) else F.lit(of))
    y = (F.col("v") - F.col("_mean")) / F.sqrt(F.col("_var") + epsilon) * values[0] + values[1]
    return Coo(df.select(*t.index, y.alias("v")), t.dims)


def _per_axis(value: int | Sequence[int] | None, n: int, default: int) -> list[int]:
    out = [default] * n if value is None else [value] * n if isinstance(value, int) else list(value)
    if len(out) != n:
        raise ShapeError(f"{value} for {n} axes")
    return out


def _pads(pads: int | Sequence[int] | None, n: int) -> tuple[list[int], list[int]]:
    """What is added before and after each axis: one number, one an axis, or all the befores and then all the afters."""
    if isinstance(pads, Sequence) and len(pads) == 2 * n:
        return list(pads[:n]), list(pads[n:])
    both = _per_axis(pads, n, 0)
    return both, both


def conv(
    t: Coo,
    weight: Coo,
    bias: Coo | None = None,
    strides: int | Sequence[int] | None = None,
    pads: int | Sequence[int] | None = None,
    dilations: int | Sequence[int] | None = None,
    group: int = 1,
) -> Coo:
    """``t``: (n, c, x, ...); ``weight``: (o, c / group, k, ...), over any number of axes.

    Each element meets only the kernel taps of its channel: an equi-join on
    the group and the channel, and a partial sum by output position.  Elements
    are dealt into parts of a fixed number of products, whole samples together
    where there are samples enough.
    """
    n, c, *sizes = t.dims
    o, wc, *ks = weight.dims
    axes = len(sizes)
    if len(ks) != axes or group < 1 or c % group or o % group or c // group != wc:
        raise ShapeError(f"{t.dims} and kernel {weight.dims} in {group} groups")
    stride, dilation = _per_axis(strides, axes, 1), _per_axis(dilations, axes, 1)
    before, after = _pads(pads, axes)
    lengths = [(d + a + b - e * (k - 1) - 1) // s + 1 for d, a, b, e, k, s in zip(sizes, before, after, dilation, ks, stride, strict=True)]
    if min(lengths, default=1) < 1:
        raise ShapeError(f"kernel {weight.dims} does not fit {t.dims}")
    taps = weight.df.select(F.col("i0").alias("o"), F.floor(F.col("i0") / (o // group)).alias("_g"), F.col("i1").alias("_c"), *[F.col(f"i{2 + k}").alias(f"k{k}") for k in range(axes)], F.col("v").alias("w"))
    parts = parts_of(math.prod(t.dims) * (o // group) * math.prod(ks))
    own = t.df.repartition(parts, *(t.index[:1] if n >= 16 * parts else t.index)) if parts > 1 else t.df
    own = own.withColumn("_g", F.floor(F.col("i1") / wc)).withColumn("_c", F.col("i1") % wc)
    met = own.join(_small(taps, weight.dims), ["_g", "_c"])
    for k in range(axes):
        at = F.col(f"i{2 + k}") + before[k] - F.col(f"k{k}") * dilation[k]
        met = met.withColumn(f"a{k}", at).filter((F.col(f"a{k}") >= 0) & (F.col(f"a{k}") % stride[k] == 0) & (F.col(f"a{k}") < lengths[k] * stride[k]))
    places = [F.floor(F.col(f"a{k}") / stride[k]).alias(f"p{k}") for k in range(axes)]
    products = met.select(F.col("i0").alias("n"), "o", *places, (F.col("v") * F.col("w")).alias("v"))
    dims = (n, o, *lengths)
    if any(e > 1 or a >= k or b >= k for e, a, b, k in zip(dilation, before, after, ks, strict=True)):  # windows may lie in the padding alone
        zeros_of = fill(t.df.sparkSession, dims, 0.0).df
        products = products.unionByName(zeros_of.select(*[F.col(f"i{k}").alias(x) for k, x in enumerate(["n", "o", *[f"p{k}" for k in range(axes)]])], "v"))
    out = products.groupBy("n", "o", *[f"p{k}" for k in range(axes)]).agg(F.sum("v").alias("v"))
    if bias is not None:
        out = out.join(_small(bias.df.select(F.col("i0").alias("o"), F.col("v").alias("_b")), bias.dims), "o").withColumn("v", F.col("v") + F.col("_b"))
    return _take(out, [F.col(x) for x in ("n", "o", *[f"p{k}" for k in range(axes)])], F.col("v"), dims)


def _pool(t: Coo, kernel: int | Sequence[int], strides: int | Sequence[int] | None, pads: int | Sequence[int] | None, agg: Callable[[Column, int], Column]) -> Coo:
    """``agg`` of each window of the last axes, as many as the kernel has; its second argument is the kernel's size."""
    ks = [kernel] if isinstance(kernel, int) else list(kernel)
    axes = len(ks)
    first_axis = t.rank - axes
    stride = ks if strides is None else _per_axis(strides, axes, 1)
    before, after = _pads(pads, axes)
    if first_axis < 0 or any(a >= k or b >= k for a, b, k in zip(before, after, ks, strict=True)):
        raise ShapeError(f"kernel {ks} with pads {before}, {after} over {t.dims}")
    dims, spread = list(t.dims), t.df
    for k in range(axes):
        ax = first_axis + k
        length = (t.dims[ax] + before[k] + after[k] - ks[k]) // stride[k] + 1
        x = F.col(f"i{ax}") + before[k]
        first = F.greatest(F.lit(0), F.ceil((x - (ks[k] - 1)) / stride[k])).cast("long")
        last = F.least(F.lit(length - 1), F.floor(x / stride[k])).cast("long")
        spread = spread.filter(first <= last).withColumn(f"_p{k}", F.explode(F.sequence(first, last)))
        dims[ax] = length
    keys = [*t.index[:first_axis], *[f"_p{k}" for k in range(axes)]]
    out = spread.groupBy(*keys).agg(agg(F.col("v"), math.prod(ks)).alias("v"))
    return _take(out, [F.col(c) for c in keys], F.col("v"), dims)


def max_pool(t: Coo, kernel: int | Sequence[int], strides: int | Sequence[int] | None = None, pads: int | Sequence[int] | None = None) -> Coo:
    """The maximum of each window of the last axes; windows may overlap, and padding never wins."""
    return _pool(t, kernel, strides, pads, lambda v, size: F.max(v))


def average_pool(t: Coo, kernel: int | Sequence[int], strides: int | Sequence[int] | None = None, pads: int | Sequence[int] | None = None, count_include_pad: bool = False) -> Coo:
    """The mean of each window, over what it has of the tensor or over its whole size."""
    return _pool(t, kernel, strides, pads, lambda v, size: F.sum(v) / size if count_include_pad else F.avg(v))


def if_(condition: bool, then_branch: Callable[[], Coo], else_branch: Callable[[], Coo]) -> Coo:
    """The branch is chosen while the plan is built."""
    return then_branch() if condition else else_branch()


def loop(trips: int, state: Coo, body: Callable[[int, Coo], Coo], keep_going: Callable[[int, Coo], bool] | None = None, cut_every: int = 8) -> Coo:
    """``body`` up to ``trips`` times; the lineage is cut by a checkpoint every few trips."""
    for k in range(trips):
        if keep_going is not None and not keep_going(k, state):
            break
        state = body(k, state)
        if (k + 1) % cut_every == 0:
            state = Coo(cut(state.df), state.dims)
    return state
