"""Settings, read from YAML where PyYAML is installed, else from keyword arguments."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Settings:
    """corpus_dir: folder of article files; the environment variable LECTERN_CORPUS names it if set."""

    corpus_dir: str = field(default_factory=lambda: os.environ.get("LECTERN_CORPUS", os.path.expanduser("~/article_corpus")))
    default_model: str = "echo"
    per_subfield: int = 2
    seed: int = 42
    min_year: int = 2010
    max_year: int = 2026


def load_settings(path: str) -> Settings:
    """Known keys of a YAML file, at its top or in its sections."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    flat = {k: v for k, v in found.items() if not isinstance(v, dict)}
    for section in found.values():
        if isinstance(section, dict):
            flat |= section
    names = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in flat.items() if k in names and v is not None})
