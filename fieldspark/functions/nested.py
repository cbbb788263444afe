"""Arithmetic on nested columns: structs, arrays and string-keyed maps of numbers, to any depth.

A builder walks the column's type and emits struct, transform and zip_with expressions, so everything stays in one
projection. Different structures are a TypeError when the plan is built; arrays of different lengths raise at run time.
Nulls inside give nulls at their place. Division by zero gives inf or nan as in IEEE arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Leaf = T.NumericType | T.BooleanType


def _fields(t: T.StructType, build: Callable[[T.StructField], Column]) -> Column:
    return F.struct(*(build(f).alias(f.name) for f in t.fields))


def elementwise(op: Callable[[Column], Column], u: Column, t: T.DataType) -> Column:
    """op on every number of u, whose type is t."""
    if isinstance(t, T.StructType):
        return _fields(t, lambda f: elementwise(op, u[f.name], f.dataType))
    if isinstance(t, T.ArrayType):
        return F.transform(u, lambda x: elementwise(op, x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(u, lambda _k, x: elementwise(op, x, t.valueType))
    return op(u)


def _same_shape(t: T.DataType, s: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return isinstance(s, T.StructType) and sorted(t.names) == sorted(s.names) and all(_same_shape(f.dataType, s[f.name].dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return isinstance(s, T.ArrayType) and _same_shape(t.elementType, s.elementType)
    if isinstance(t, T.MapType):
        return isinstance(s, T.MapType) and _same_shape(t.valueType, s.valueType)
    return not isinstance(s, (T.StructType, T.ArrayType, T.MapType))


def binary(op: Callable[[Column, Column], Column], u: Column, v: Column, t: T.DataType, s: T.DataType | None = None) -> Column:
    """op on the numbers of u and v at the same places; t and s are their types (s like t if left out)."""
    s = s or t
    if not _same_shape(t, s):
        raise TypeError(f"different structures: {t.simpleString()} and {s.simpleString()}")
    if isinstance(t, T.StructType):
        return _fields(t, lambda f: binary(op, u[f.name], v[f.name], f.dataType, s[f.name].dataType))
    if isinstance(t, T.ArrayType):
        same = F.size(u) == F.size(v)
        zipped = F.zip_with(u, v, lambda x, y: binary(op, x, y, t.elementType, s.elementType))
        return F.when(same | u.isNull() | v.isNull(), zipped).otherwise(F.raise_error(F.lit("arrays of different lengths")))
    if isinstance(t, T.MapType):
        return F.map_zip_with(u, v, lambda _k, x, y: binary(op, x, y, t.valueType, s.valueType))
    return op(u, v)


def _leaves(leaf: Callable[[Column], Column], u: Column, t: T.DataType) -> Column:
    """Array of leaf(x) for the numbers of u in container order, in which u stands once a field."""
    none = F.array()
    if isinstance(t, T.StructType):
        parts, run = [], []
        for f in t.fields:
            if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
                parts += [F.array(*run)] if run else []
                run = []
                parts.append(_leaves(leaf, u[f.name], f.dataType))
            else:
                run.append(leaf(u[f.name]))
        parts += [F.array(*run)] if run else []
        return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else none
    items, kind = (u, t.elementType) if isinstance(t, T.ArrayType) else (F.map_values(u), t.valueType)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.coalesce(F.flatten(F.transform(items, lambda x: _leaves(leaf, x, kind))), none)
    return F.coalesce(F.transform(items, leaf), none)


def reduce(leaf: Callable[[Column], Column], combine: Callable[[Column, Column], Column], u: Column, t: T.DataType) -> Column:
    """Left fold of combine over leaf(x) in container order; nulls are left out, and a tree without leaves gives null.

    The leaves are folded as one array, so that each is worked out once whatever the depth.
    """
    if not isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
        return leaf(u)
    leaves = _leaves(leaf, u, t)
    start = F.when(F.lit(False), F.get(leaves, F.lit(0)))  # a null of the leaves' type; the optimizer drops the rest
    return F.aggregate(leaves, start, lambda s, x: F.when(s.isNull(), x).when(x.isNull(), s).otherwise(combine(s, x)))


def leafwise(fold: Callable[[Column], Column], u: Column, t: T.DataType) -> Column:
    """fold of each numeric array of a tree, keeping the structure above it; a bare number folds as an array of one."""
    if isinstance(t, T.StructType):
        return _fields(t, lambda f: leafwise(fold, u[f.name], f.dataType))
    if isinstance(t, T.ArrayType) and not isinstance(t.elementType, T.StructType | T.MapType):
        flat, kind = u, t.elementType
        while isinstance(kind, T.ArrayType):
            flat, kind = F.flatten(flat), kind.elementType
        return fold(flat)
    if isinstance(t, T.ArrayType):
        return F.transform(u, lambda x: leafwise(fold, x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(u, lambda _k, x: leafwise(fold, x, t.valueType))
    return fold(F.array(u))


def _d(c: Column) -> Column:
    return c.cast("double")


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + _d(x))


def divide(x: Column, y: Column) -> Column:
    x, y = _d(x), _d(y)
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return F.when(y != 0, F.try_divide(x, y)).when((x == 0) | F.isnan(x), nan).when(x > 0, inf).otherwise(-inf)


add = lambda u, v, t, s=None: binary(lambda x, y: x + y, u, v, t, s)
sub = lambda u, v, t, s=None: binary(lambda x, y: x - y, u, v, t, s)
mult = lambda u, v, t, s=None: binary(lambda x, y: x * y, u, v, t, s)
div = lambda u, v, t, s=None: binary(divide, u, v, t, s)
scale = lambda u, c, t: elementwise(lambda x: x * c, u, t)
power = lambda u, p, t: elementwise(lambda x: F.pow(x, F.lit(p)), u, t)
absolute = lambda u, t: elementwise(F.abs, u, t)
sqrt = lambda u, t: elementwise(F.sqrt, u, t)
inverse = lambda u, t: elementwise(lambda x: divide(F.lit(1.0), x), u, t)
leaf_sum = lambda u, t: leafwise(_total, u, t)
leaf_normsquared = lambda u, t: leafwise(lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + _d(x) * _d(x)), u, t)
leaf_norm = lambda u, t: leafwise(lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + _d(x) * _d(x))), u, t)
leaf_dot = lambda u, v, t: leafwise(_total, mult(u, v, t), t)
_sum2 = lambda a, b: a + b
total = lambda u, t: reduce(_d, _sum2, u, t)
dot = lambda u, v, t: total(mult(u, v, t), t)
normsquared = lambda u, t: reduce(lambda x: _d(x) * _d(x), _sum2, u, t)
norm = lambda u, t: F.sqrt(normsquared(u, t))
_true = lambda x: x.cast("boolean")
every = lambda u, t: reduce(_true, lambda a, b: a & b, u, t)
some = lambda u, t: reduce(_true, lambda a, b: a | b, u, t)
isnan = lambda u, t: elementwise(lambda x: F.isnan(_d(x)), u, t)
isinf = lambda u, t: elementwise(lambda x: F.abs(_d(x)) == float("inf"), u, t)
isbad = lambda u, t: reduce(lambda x: F.isnan(_d(x)) | (F.abs(_d(x)) == float("inf")), lambda a, b: a | b, u, t)
logical_or = lambda u, v, t: binary(lambda x, y: _true(x) | _true(y), u, v, t)
logical_and = lambda u, v, t: binary(lambda x, y: _true(x) & _true(y), u, v, t)
logical_not = lambda u, t: elementwise(lambda x: ~_true(x), u, t)


def _ordered(op: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """A comparison that is false for NaN on either side."""
    return lambda x, y: op(x, y) & ~F.isnan(_d(x)) & ~F.isnan(_d(y))


_COMPARE = {"eq": lambda x, y: x == y, "lt": lambda x, y: x < y, "le": lambda x, y: x <= y, "gt": lambda x, y: x > y, "ge": lambda x, y: x >= y}


def compare(name: str, u: Column, v: Column, t: T.DataType) -> Column:
    """eq, lt, le, gt or ge at each place."""
    return binary(_ordered(_COMPARE[name]), u, v, t)


def compare_scalar(name: str, u: Column, c, t: T.DataType) -> Column:
    return elementwise(lambda x: _ordered(_COMPARE[name])(x, F.lit(c)), u, t)


def ones(u: Column, t: T.DataType) -> Column:
    return elementwise(lambda x: F.when(x.isNotNull(), F.lit(1.0)), u, t)


def zeros(u: Column, t: T.DataType) -> Column:
    return elementwise(lambda x: F.when(x.isNotNull(), F.lit(0.0)), u, t)


def _uniform(*keys: Column) -> Column:
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _random(u: Column, t: T.DataType, make: Callable[[list[Column]], Column], keys: list[Column]) -> Column:
    if isinstance(t, T.StructType):
        return _fields(t, lambda f: _random(u[f.name], f.dataType, make, [*keys, F.lit(f.name)]))
    if isinstance(t, T.ArrayType):
        return F.transform(u, lambda x, i: _random(x, t.elementType, make, [*keys, i]))
    if isinstance(t, T.MapType):
        return F.transform_values(u, lambda k, x: _random(x, t.valueType, make, [*keys, k]))
    return F.when(u.isNotNull(), make(keys))


def rand(u: Column, t: T.DataType, row: Column, seed: int = 0) -> Column:
    """Uniform numbers in (0, 1) shaped like u, from a hash of (seed, row, place): re-runs agree."""
    return _random(u, t, lambda k: _uniform(*k), [F.lit(seed), row])


def randn(u: Column, t: T.DataType, row: Column, seed: int = 0) -> Column:
    """Standard normal numbers shaped like u (Box-Muller on two hashes)."""
    return _random(u, t, lambda k: F.sqrt(-2 * F.log(_uniform(*k))) * F.cos(2 * 3.141592653589793 * _uniform(*k, F.lit("b"))), [F.lit(seed), row])
