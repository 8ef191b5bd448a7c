"""Settings of a corpus run as JSON, on the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class CorpusConfig:
    tool: str = "docs"
    n_examples: int = 1500
    threshold: float = 0.6
    held_share: float = 0.1
    seed: str = "42"
    max_length: int = 512

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2), encoding="utf-8")

    @classmethod
    def load(cls, path: str) -> CorpusConfig:
        """Settings of a file; those that it lacks keep their defaults, unknown ones are an error."""
        found = json.loads(Path(path).read_text(encoding="utf-8"))
        unknown = set(found) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**found)
