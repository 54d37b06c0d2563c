"""Settings files of the jobs: small JSON objects, checked against what a job knows."""

from __future__ import annotations

import json
from dataclasses import fields
from pathlib import Path


def read(kind: type, path: str | None = None):
    """Settings of a dataclass from a JSON file, or its defaults; unknown names are an error."""
    given = json.loads(Path(path).read_text()) if path else {}
    if unknown := set(given) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    made = kind(**given)
    made.validate()
    return made
