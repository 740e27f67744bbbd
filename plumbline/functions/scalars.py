"""One formula, three uses: the same code over scalars runs on Spark columns, NumPy arrays and dual numbers.

Formulas take an object of scalar functions (``m``) and plain lists of scalars.  ``SPARK``
builds column expressions for short formulas; ``GRAPH`` builds a graph for ``on_frame``;
``NUMPY`` evaluates arrays; ``DUAL`` carries exact derivatives.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _Spark:
    sqrt, sin, cos, tan, asin, acos, abs, floor = (staticmethod(f) for f in (F.sqrt, F.sin, F.cos, F.tan, F.asin, F.acos, F.abs, F.floor))
    atan2 = staticmethod(F.atan2)

    @staticmethod
    def num(x) -> Column:
        return F.lit(float(x))

    @staticmethod
    def div(a, b) -> Column:
        """Null where b is 0, as ANSI mode raises otherwise."""
        return F.try_divide(a if isinstance(a, Column) else F.lit(float(a)), b if isinstance(b, Column) else F.lit(float(b)))

    @staticmethod
    def where(c, a, b) -> Column:
        return F.when(c, a).otherwise(b)

    @staticmethod
    def both(a, b) -> Column:
        return a & b

    @staticmethod
    def take(table: tuple[float, ...], at: Column) -> Column:
        return F.get(F.lit(list(table)), at.cast("int"))


class _Numpy:
    sqrt, sin, cos, tan, abs, floor, where = (staticmethod(f) for f in (np.sqrt, np.sin, np.cos, np.tan, np.abs, np.floor, np.where))
    asin, acos, atan2 = staticmethod(np.arcsin), staticmethod(np.arccos), staticmethod(np.arctan2)

    @staticmethod
    def num(x):
        return np.float64(x)

    @staticmethod
    def div(a, b):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(np.equal(b, 0), np.nan, np.divide(a, np.where(np.equal(b, 0), 1.0, b)))

    @staticmethod
    def both(a, b):
        return np.logical_and(a, b)

    @staticmethod
    def take(table: tuple[float, ...], at):
        """A table's entry at a whole number."""
        return np.take(np.asarray(table), np.nan_to_num(at).astype(np.int64))


class Sym:
    """A node of a formula's graph; equal nodes are one object, so shared parts are found by identity."""

    __slots__ = ("args", "op")
    _all: dict[tuple, Sym] = {}

    def __new__(cls, op: str, *args):
        key = (op, *[id(a) if isinstance(a, Sym) else a for a in args])
        if (node := cls._all.get(key)) is None:
            node = object.__new__(cls)
            node.op, node.args = op, args
            cls._all[key] = node
        return node


def _sym(x) -> Sym:
    return x if isinstance(x, Sym) else Sym("num", float(x))


def _operator(op: str, flip: bool = False):
    def f(self, other):
        a, b = (_sym(other), self) if flip else (self, _sym(other))
        if op == "+" and 0.0 in (*a.args, *b.args) and "num" in (a.op, b.op):
            return b if a is _sym(0.0) else a if b is _sym(0.0) else Sym(op, a, b)
        return Sym(op, a, b)

    return f


for _name, _op in (("add", "+"), ("sub", "-"), ("mul", "*")):
    setattr(Sym, f"__{_name}__", _operator(_op))
    setattr(Sym, f"__r{_name}__", _operator(_op, True))
for _name, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    setattr(Sym, f"__{_name}__", _operator(_op))
Sym.__neg__ = lambda self: Sym("neg", self)


class _Graph:
    """Builds graphs, for ``on_frame``."""

    num = staticmethod(_sym)

    @staticmethod
    def div(a, b):
        return Sym("/", _sym(a), _sym(b))

    @staticmethod
    def where(c, a, b):
        return Sym("where", c, _sym(a), _sym(b))

    @staticmethod
    def both(a, b):
        return Sym("and", a, b)

    @staticmethod
    def take(table: tuple[float, ...], at):
        return Sym("take", tuple(table), _sym(at))


_CALLS = ("sqrt", "sin", "cos", "tan", "asin", "acos", "abs", "floor", "atan2")
for _name in _CALLS:
    setattr(_Graph, _name, staticmethod(lambda *a, n=_name: Sym(n, *map(_sym, a))))

_LEAVES = ("in", "num")


def _levels(outputs: list[Sym]) -> list[list[Sym]]:
    """Nodes used more than once, grouped so that each needs only those of earlier groups."""
    uses: dict[int, int] = {}
    order: list[Sym] = []
    stack: list[tuple[Sym, bool]] = [(o, False) for o in outputs]
    done: set[int] = set()
    while stack:
        node, leaving = stack.pop()
        if leaving:
            order.append(node)
            continue
        uses[id(node)] = uses.get(id(node), 0) + 1
        if id(node) in done:
            continue
        done.add(id(node))
        stack.append((node, True))
        stack += [(a, False) for a in node.args if isinstance(a, Sym)]
    level: dict[int, int] = {}
    groups: list[list[Sym]] = []
    for node in order:
        n = max([0, *(level[id(a)] for a in node.args if isinstance(a, Sym))])
        if uses[id(node)] > 1 and node.op not in _LEAVES:
            while len(groups) <= n:
                groups.append([])
            groups[n].append(node)
            n += 1
        level[id(node)] = n
    return groups


def _column(node: Sym, names: dict[int, str], inputs: dict[str, Column]) -> Column:
    if id(node) in names:
        return F.col(names[id(node)])
    if node.op == "in":
        return inputs[node.args[0]]
    if node.op == "num":
        return F.lit(node.args[0])
    if node.op == "take":
        return _Spark.take(node.args[0], _column(node.args[1], names, inputs))
    a = [_column(x, names, inputs) for x in node.args]
    match node.op:
        case "+":
            return a[0] + a[1]
        case "-":
            return a[0] - a[1]
        case "*":
            return a[0] * a[1]
        case "/":
            return F.try_divide(a[0], a[1])
        case "<":
            return a[0] < a[1]
        case "<=":
            return a[0] <= a[1]
        case ">":
            return a[0] > a[1]
        case ">=":
            return a[0] >= a[1]
        case "neg":
            return -a[0]
        case "and":
            return a[0] & a[1]
        case "where":
            return F.when(a[0], a[1]).otherwise(a[2])
        case "floor":
            return F.floor(a[0]).cast("double")
    return getattr(F, node.op)(*a)


def graph(formula, sizes: list[int]) -> list[Sym]:
    """A formula's outputs over inputs named ``i<argument>_<component>``."""
    out = formula(_Graph, *[[Sym("in", f"i{k}_{j}") for j in range(n)] for k, n in enumerate(sizes)])
    return [_sym(x) for x in (out if isinstance(out, list) else [out])]


def on_frame(df: DataFrame, formula, arguments: list[list[Column]], names: list[str] | None = None, out: str | None = None) -> DataFrame:
    """``df`` with a formula's outputs: one column each (``names``), or one array column (``out``).

    Shared parts become columns of their own in a chain of projections, which generated code
    computes once; a plain nested expression would repeat them without bound.
    """
    keep = [c for c in df.columns if c not in (names or []) and c != out]
    inputs = {f"i{k}_{j}": c for k, cs in enumerate(arguments) for j, c in enumerate(cs)}
    outputs = graph(formula, [len(cs) for cs in arguments])
    df = df.select(*keep, *[c.cast("double").alias(f"__{n}") for n, c in inputs.items()])
    inputs = {n: F.col(f"__{n}") for n in inputs}
    known: dict[int, str] = {}
    for group in _levels(outputs):
        new = {id(n): f"__t{len(known) + k}" for k, n in enumerate(group)}
        df = df.select("*", *[_column(n, known, inputs).alias(new[id(n)]) for n in group])
        known |= new
    cols = [_column(o, known, inputs) for o in outputs]
    return df.select(*keep, F.array(*cols).alias(out)) if out else df.select(*keep, *[c.alias(n) for c, n in zip(cols, names, strict=True)])


class Dual:
    """A value with derivatives: ``g`` has one more axis than ``x``, one entry a direction."""

    __array_priority__ = 1000

    def __init__(self, x, g):
        self.x, self.g = np.asarray(x, float), g

    @staticmethod
    def of(x, like: Dual) -> Dual:
        return x if isinstance(x, Dual) else Dual(x, np.zeros((1,) * np.ndim(x) + like.g.shape[-1:]))

    def _both(self, o, x, da, db) -> Dual:
        g = self.g * np.asarray(da)[..., None]
        return Dual(x, g + o.g * np.asarray(db)[..., None] if isinstance(o, Dual) else g + np.zeros(np.shape(x) + (1,)))

    def __add__(self, o):
        return self._both(o, self.x + _x(o), np.ones_like(self.x), 1.0)

    def __mul__(self, o):
        return self._both(o, self.x * _x(o), _x(o) + 0 * self.x, self.x)

    def __neg__(self):
        return Dual(-self.x, -self.g)

    def __sub__(self, o):
        return self + (-o)

    def __rsub__(self, o):
        return (-self) + o

    __radd__, __rmul__ = __add__, __mul__

    def __lt__(self, o):
        return self.x < _x(o)

    def __le__(self, o):
        return self.x <= _x(o)

    def __gt__(self, o):
        return self.x > _x(o)

    def __ge__(self, o):
        return self.x >= _x(o)


def _x(a):
    return a.x if isinstance(a, Dual) else np.asarray(a, float)


def _lift(f, d):
    def g(a):
        return Dual(f(a.x), a.g * np.asarray(d(a.x))[..., None]) if isinstance(a, Dual) else f(a)

    return staticmethod(g)


class _Dual:
    with np.errstate(all="ignore"):
        sqrt = _lift(np.sqrt, lambda x: np.divide(0.5, np.sqrt(x), out=np.zeros_like(np.asarray(x, float)), where=np.asarray(x) > 0))
        sin, cos = _lift(np.sin, np.cos), _lift(np.cos, lambda x: -np.sin(x))
        tan = _lift(np.tan, lambda x: 1 / np.cos(x) ** 2)
        asin, acos = _lift(np.arcsin, lambda x: 1 / np.sqrt(1 - x * x)), _lift(np.arccos, lambda x: -1 / np.sqrt(1 - x * x))
        abs, floor = _lift(np.abs, np.sign), _lift(np.floor, np.zeros_like)
    num = staticmethod(np.float64)

    @staticmethod
    def both(a, b):
        return np.logical_and(a, b)

    @staticmethod
    def div(a, b):
        bx = np.where(_x(b) == 0, np.nan, _x(b))
        if isinstance(a, Dual):
            return a._both(b, a.x / bx, 1 / bx + 0 * a.x, -a.x / bx**2)
        return Dual(_x(a) / bx, b.g * (-_x(a) / bx**2)[..., None]) if isinstance(b, Dual) else _x(a) / bx

    @staticmethod
    def atan2(a, b):
        n = _x(a) ** 2 + _x(b) ** 2
        n = np.where(n == 0, 1.0, n)
        like = a if isinstance(a, Dual) else b
        a, b = Dual.of(a, like), Dual.of(b, like)
        return a._both(b, np.arctan2(a.x, b.x), b.x / n, -a.x / n)

    @staticmethod
    def where(c, a, b):
        like = a if isinstance(a, Dual) else b
        if not isinstance(like, Dual):
            return np.where(c, a, b)
        a, b = Dual.of(a, like), Dual.of(b, like)
        return Dual(np.where(c, a.x, b.x), np.where(np.asarray(c)[..., None], a.g, b.g))


SPARK, NUMPY, GRAPH, DUAL = _Spark, _Numpy, _Graph, _Dual


def dual_inputs(*arrays: np.ndarray) -> list[list[Dual]]:
    """Arrays of shape (..., n) as lists of n dual scalars, each component a direction of its own."""
    total, at, out = sum(a.shape[-1] for a in arrays), 0, []
    for a in arrays:
        row = []
        for i in range(a.shape[-1]):
            g = np.zeros((1,) * (a.ndim - 1) + (total,))
            g[..., at] = 1
            row.append(Dual(a[..., i], g))
            at += 1
        out.append(row)
    return out


def values(xs: list) -> np.ndarray:
    return np.stack(np.broadcast_arrays(*[_x(x) for x in xs]), -1)


def jacobian(xs: list[Dual]) -> np.ndarray:
    """(..., outputs, directions)"""
    shape = np.broadcast_shapes(*[x.x.shape for x in xs])
    return np.stack([np.broadcast_to(x.g, shape + x.g.shape[-1:]) for x in xs], -2)


def on_columns(formula, *sizes: int, params: tuple = ()):
    """A formula over lists of scalars as a function of array columns that gives an array column (or one scalar column)."""

    def f(*columns) -> Column:
        args = [[(F.col(c) if isinstance(c, str) else c)[i] for i in range(n)] for c, n in zip(columns, sizes, strict=True)]
        out = formula(SPARK, *params, *args)
        return F.array(*out) if isinstance(out, list) else out

    return f


def on_arrays(formula, *, params: tuple = ()):
    def f(*arrays: np.ndarray) -> np.ndarray:
        out = formula(NUMPY, *params, *[[a[..., i] for i in range(a.shape[-1])] for a in map(np.asarray, arrays)])
        return np.stack(np.broadcast_arrays(*out), -1) if isinstance(out, list) else out

    return f


def with_gradients(formula, *, params: tuple = ()):
    """(values, gradients): gradients are split by argument."""

    def f(*arrays: np.ndarray):
        arrays = [np.asarray(a, float) for a in arrays]
        out = formula(DUAL, *params, *dual_inputs(*arrays))
        out, scalar = (out, False) if isinstance(out, list) else ([out], True)
        like = next(x for x in out if isinstance(x, Dual))
        out = [Dual.of(x, like) for x in out]
        j = np.split(jacobian(out), np.cumsum([a.shape[-1] for a in arrays])[:-1], axis=-1)
        v = values(out)
        return (v[..., 0], *[x[..., 0, :] for x in j]) if scalar else (v, *j)

    return f
