"""Precision policy: which type a level, a grid or a residual asks for. Decisions are made on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import Grid

NAMES = {"single": "float", "float32": "float", "float": "float", "double": "double", "float64": "double", "mixed": "mixed"}


def parse(name: str) -> str:
    """float, double or mixed from any usual name, in any case."""
    if not isinstance(name, str):
        raise TypeError(f"a precision is a name, not {type(name).__name__}")
    if name.lower() not in NAMES:
        raise ValueError(f"no such precision: {name}")
    return NAMES[name.lower()]


def storage(precision: str) -> str:
    """The column type; mixed is stored as double."""
    return "float" if parse(precision) == "float" else "double"


def cast(frame: DataFrame, precision: str, *columns: str) -> DataFrame:
    """Columns in the precision's type; aggregates of floats give doubles, so cast after each."""
    return frame.withColumns({c: F.col(c).cast(storage(precision)) for c in columns})


@dataclass
class Policy:
    """Chooses, and remembers what it chose and why."""

    threshold: float = 1e-6
    memory_limit: int = 4 << 30
    large: int = 500_000
    now: str = "double"
    changes: list[tuple[str, str, str]] = field(default_factory=list)

    def _to(self, precision: str, why: str) -> str:
        if precision != self.now:
            self.changes.append((self.now, precision, why))
            self.now = precision
        return self.now

    def observe(self, grid: Grid, residual: float) -> str:
        """Down for memory or far from the goal, up near it."""
        if grid.memory_bytes() > self.memory_limit:
            return self._to("float", "memory")
        if self.now == "double" and residual > 100 * self.threshold:
            return self._to("float", "far from the goal")
        if self.now == "float" and residual < 10 * self.threshold:
            return self._to("double", "near the goal")
        return self.now

    def for_level(self, level: int, size: int) -> str:
        """Double on the finest, on 1 and 2 unless large, single below."""
        return "double" if level == 0 or (level <= 2 and size <= self.large) else "float"

    @staticmethod
    def mixed_level(level: int, levels: int) -> str:
        """Single on the coarser half."""
        return "float" if level >= levels // 2 else "double"
