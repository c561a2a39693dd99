"""Piecewise-linear membership shapes as column expressions.

Every shape maps a number to a degree in [0, 1]. A boundary point belongs to the
earlier branch. NaN fails every comparison and so takes the last branch; null
gives null. Breakpoints are literals, so a segment of no width is left out when
the expression is built and nothing is ever divided by zero.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chain(x: Column, steps: list[tuple[float, Column | float]], last: float) -> Column:
    """``steps``: (upper bound, value up to it), ascending; ``last`` beyond."""
    out = None
    for bound, value in steps:
        value = value if isinstance(value, Column) else F.lit(float(value))
        out = F.when(x <= F.lit(float(bound)), value) if out is None else out.when(x <= F.lit(float(bound)), value)
    return F.when(x.isNotNull(), out.otherwise(F.lit(float(last))))


def _up(x: Column, low: float, high: float) -> list[tuple[float, Column]]:
    return [(high, (x - F.lit(float(low))) / F.lit(float(high - low)))] if high > low else []


def _down(x: Column, low: float, high: float) -> list[tuple[float, Column]]:
    return [(high, (F.lit(float(high)) - x) / F.lit(float(high - low)))] if high > low else []


def z_shape(x: Column, low: float, high: float) -> Column:
    """1 up to ``low``, falling to 0 at ``high``."""
    return _chain(x, [(low, 1), *_down(x, low, high)], 0)


def s_shape(x: Column, low: float, high: float) -> Column:
    """0 up to ``low``, rising to 1 at ``high``."""
    return _chain(x, [(low, 0), *_up(x, low, high)], 1)


def lambda_shape(x: Column, low: float, middle: float, high: float) -> Column:
    """A triangle: 0 up to ``low``, 1 at ``middle``, 0 from ``high``."""
    return _chain(x, [(low, 0), *_up(x, low, middle), *_down(x, middle, high)], 0)


def pi_shape(x: Column, low: float, first: float, last: float, high: float) -> Column:
    """A trapezoid: 0 up to ``low``, 1 from ``first`` to ``last``, 0 from ``high``."""
    return _chain(x, [(low, 0), *_up(x, low, first), (last, 1), *_down(x, last, high)], 0)


@dataclass(frozen=True)
class Kind:
    """How a shape is computed, and which point is typical of it."""

    degree: Callable[..., Column]
    n_points: int
    typical: Callable[..., float]


#: Shapes by name; :func:`register_shape` adds to them.
SHAPES: dict[str, Kind] = {
    "Z": Kind(z_shape, 2, lambda low, high: low),
    "S": Kind(s_shape, 2, lambda low, high: high),
    "Lambda": Kind(lambda_shape, 3, lambda low, middle, high: middle),
    "Pi": Kind(pi_shape, 4, lambda low, first, last, high: (first + last) / 2),
}


def register_shape(name: str, degree: Callable[..., Column], n_points: int, typical: Callable[..., float]) -> None:
    """Add a shape of one's own: ``degree(column, *points)`` and ``typical(*points)``."""
    SHAPES[name] = Kind(degree, n_points, typical)


@dataclass(frozen=True)
class Shape:
    """A shape with its breakpoints. Descending ones are used as they are, with a warning."""

    kind: str
    points: tuple[float, ...]

    def __post_init__(self) -> None:
        if self.kind not in SHAPES or len(self.points) != SHAPES[self.kind].n_points:
            raise ValueError(f"{self.kind} does not take the points {self.points}")
        if list(self.points) != sorted(self.points):
            warnings.warn(f"breakpoints of {self.kind} descend: {self.points}", stacklevel=3)

    def degree(self, x: Column) -> Column:
        return SHAPES[self.kind].degree(x, *self.points)

    @property
    def typical(self) -> float:
        return float(SHAPES[self.kind].typical(*self.points))
