"""Engine settings, passed explicitly."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class EngineConf:
    """Limits and versions of indexing and retrieval."""

    chunk_max_lines: int = 80
    embedding_dimension: int = 768
    chunking_version: str = "1.0"
    parser_version: str = "1"
    embedding_model: str = "hash-embedder"
    embedding_batch: int = 32
    query_top_k: int = 5
    global_top_k: int = 10
    min_score: float = 0.70
    symbols_per_query: int = 8
    calls_kept: int = 20
    calls_embedded: int = 10
    max_tries: int = 3
    retry_delay_s: int = 30
    result_horizon: str = "1 hour"

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, env_file: str | None = None) -> EngineConf:
        """From an ``.env`` file and the environment, the latter first; names without regard to case, unknown ones ignored."""
        values: dict[str, str] = {}
        if env_file and Path(env_file).exists():
            for line in Path(env_file).read_text(encoding="utf-8").splitlines():
                name, sign, value = line.partition("=")
                if sign and not name.lstrip().startswith("#"):
                    values[name.strip().lower()] = value.strip().strip("\"'")
        values |= {k.lower(): v for k, v in (os.environ if env is None else env).items()}
        kinds = {"int": int, "float": float, "str": str}
        return cls(**{f.name: kinds[str(f.type)](values[f.name]) for f in fields(cls) if f.name in values})
