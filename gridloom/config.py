"""Settings as validated dataclasses with JSON and, where installed, YAML round trips."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass
class GridSettings:
    nx: int = 65
    ny: int = 65
    domain: tuple[float, float, float, float] = (0.0, 1.0, 0.0, 1.0)
    dtype: str = "double"

    def validate(self) -> None:
        if self.nx < 3 or self.ny < 3:
            raise ValueError("a grid needs at least 3 points a side")
        if self.domain[0] >= self.domain[1] or self.domain[2] >= self.domain[3]:
            raise ValueError("an empty domain")
        if self.dtype not in ("float", "double"):
            raise ValueError(f"no such field type: {self.dtype}")


@dataclass
class SolverSettings:
    method: str = "V"
    tolerance: float = 1e-8
    most: int = 100
    before: int = 2
    after: int = 2
    levels: int = 20

    def validate(self) -> None:
        from .operators.solvers import METHODS

        if self.method not in METHODS:
            raise ValueError(f"no such method: {self.method}")
        if not self.tolerance > 0 or self.most < 1 or self.levels < 1 or min(self.before, self.after) < 0:
            raise ValueError("tolerance, iterations and levels are positive, smoothing steps not negative")


@dataclass
class PrecisionSettings:
    precision: str = "double"
    adaptive: bool = False
    threshold: float = 1e-6

    def validate(self) -> None:
        from .functions.precision import parse

        parse(self.precision)
        if not self.threshold > 0:
            raise ValueError("the threshold is positive")


@dataclass
class SparkSettings:
    tile: int = 512
    shuffle_partitions: int = 0
    checkpoint_every: int = 1

    def validate(self) -> None:
        if self.tile < 8 or self.shuffle_partitions < 0 or self.checkpoint_every < 1:
            raise ValueError("tiles have at least 8 points a side; partitions and steps are not negative")


@dataclass
class Settings:
    grid: GridSettings = field(default_factory=GridSettings)
    solver: SolverSettings = field(default_factory=SolverSettings)
    precision: PrecisionSettings = field(default_factory=PrecisionSettings)
    spark: SparkSettings = field(default_factory=SparkSettings)

    def validate(self) -> Settings:
        for f in fields(self):
            getattr(self, f.name).validate()
        return self

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, given: dict) -> Settings:
        kinds = {"grid": GridSettings, "solver": SolverSettings, "precision": PrecisionSettings, "spark": SparkSettings}
        if unknown := set(given) - set(kinds):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        made = {}
        for name, kind in kinds.items():
            part = dict(given.get(name, {}))
            if "domain" in part:
                part["domain"] = tuple(part["domain"])
            made[name] = kind(**part)
        return cls(**made).validate()

    def write(self, path: str) -> None:
        text = _yaml().safe_dump(json.loads(json.dumps(self.to_dict()))) if path.endswith((".yaml", ".yml")) else json.dumps(self.to_dict(), indent=2)
        Path(path).write_text(text)

    @classmethod
    def read(cls, path: str) -> Settings:
        text = Path(path).read_text()
        return cls.from_dict(_yaml().safe_load(text) if path.endswith((".yaml", ".yml")) else json.loads(text))


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML settings need the yaml package; JSON works without") from e
    return yaml
