"""Settings from the environment, else from a file of KEY=VALUE lines, else defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "WEFTLINE_"


@dataclass(frozen=True)
class Config:
    store: str = "graph-store"
    model: str = "flash"
    model_key: str = ""
    cores: str = "8"
    memory: str = "8g"

    @classmethod
    def load(cls, path: str | Path | None = None, environment: dict[str, str] | None = None) -> Config:
        """WEFTLINE_STORE, WEFTLINE_MODEL, ...; empty values count as unset. Lines without `=` and comments are skipped."""
        env = os.environ if environment is None else environment
        known = {}
        if path and Path(path).exists():
            for line in Path(path).read_text(encoding="utf-8").splitlines():
                key, equals, value = line.strip().partition("=")
                if equals and not key.startswith("#"):
                    known[key.strip()] = value.strip()
        found = {f.name: env.get(PREFIX + f.name.upper()) or known.get(PREFIX + f.name.upper()) for f in fields(cls)}
        return cls(**{k: v for k, v in found.items() if v})
