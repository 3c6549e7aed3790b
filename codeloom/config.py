"""Settings: defaults, then a TOML file, then the environment, each value checked."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace

PREFIX = "CODELOOM_"
RANGES = {"max_results": (1, 200), "min_score": (0.0, 1.0), "token_budget": (256, 32768), "vector_dims": (1, 4096), "embed_batch": (1, 2048)}
TEST_PATTERNS = {
    "python": ["test_*.py", "*_test.py", "tests/"], "go": ["*_test.go"], "typescript": ["*.test.ts", "*.spec.ts", "__tests__/"],
    "javascript": ["*.test.js", "*.spec.js"], "java": ["*Test.java", "src/test/"], "rust": ["tests/"], "ruby": ["*_spec.rb", "*_test.rb", "spec/"], "bash": ["*_test.sh"],
}


@dataclass(frozen=True)
class Config:
    root: str = "."
    max_results: int = 10
    min_score: float = 0.15
    token_budget: int = 4096
    vector_dims: int = 768
    embed_batch: int = 128
    query_prefix: str = ""
    project_id: int = 1

    def checked(self) -> Config:
        for name, (low, high) in RANGES.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie in {low}..{high}, not {getattr(self, name)}")
        return self


def load(path: str | None = None, environ: dict[str, str] | None = None, **flags) -> Config:
    config, environ = Config(), os.environ if environ is None else environ
    known = {f.name: type(f.default) for f in fields(Config)}
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            read = tomllib.load(f)
        config = replace(config, **{k: known[k](v) for k, v in read.items() if k in known})
    config = replace(config, **{k: t(environ[PREFIX + k.upper()]) for k, t in known.items() if PREFIX + k.upper() in environ})
    return replace(config, **{k: v for k, v in flags.items() if v is not None}).checked()


def test_patterns() -> list[str]:
    return sorted({p for ps in TEST_PATTERNS.values() for p in ps})
