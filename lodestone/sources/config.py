"""Where the parts of a project lie: from the environment, a .env file beside it, or defaults; relative paths begin at its root."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "LODESTONE_"


@dataclass(frozen=True)
class Paths:
    corpus: str = "corpus"
    queries: str = "queries.json"
    rankings: str = "rankings"
    features: str = "features"
    statistics: str = "statistics"
    cache: str = "cache"


def env_file(path: str | os.PathLike) -> dict[str, str]:
    """NAME=value lines; blank lines, comments and quotes around a value go."""
    out = {}
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, equals, value = line.partition("=")
            if equals and not line.lstrip().startswith("#"):
                out[name.strip()] = value.strip().strip("\"'")
    return out


def load(root: str | os.PathLike = ".", environment: dict[str, str] | None = None) -> Paths:
    """The environment wins over the file, the file over the defaults."""
    root = Path(root).resolve()
    given = env_file(root / ".env") | dict(os.environ if environment is None else environment)
    chosen = {f.name: given.get(PREFIX + f.name.upper()) or f.default for f in fields(Paths)}
    return Paths(**{k: v if "://" in v else str(root / v) for k, v in chosen.items()})
