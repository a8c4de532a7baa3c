"""Settings: built-in defaults, under a file's, under what is given on the command line."""

from __future__ import annotations

import json
import os
from typing import Any

#: Files that are looked for, the first that is there counts.
PLACES = ("docketry.json", "docketry.yaml", "docketry.yml", "configs/docketry.json")
DEFAULTS: dict[str, dict[str, Any]] = {
    "chunking": {"target_tokens": 800, "max_tokens": 1200, "overlap_tokens": 100},
    "keyword": {"max_features": None, "stop_words": None},
    "search": {"top_k": 10, "mode": "hybrid"},
    "enrichment": {"backend": "none", "case_type": "patent", "parties": [], "force": False},
    "pagination": {"enabled": True},
    "stamps": {"patterns": None},
}


def load(path: str) -> dict[str, Any]:
    """The settings of a JSON or YAML file. A missing file, another format or a broken file is an error: ValueError."""
    try:
        with open(path, encoding="utf-8") as file:
            text = file.read()
    except OSError as e:
        raise ValueError(f"no settings at {path}") from e
    try:
        if path.endswith(".json"):
            found = json.loads(text)
        elif path.endswith((".yaml", ".yml")):
            import yaml

            found = yaml.safe_load(text)
        else:
            raise ValueError(f"settings are JSON or YAML, not {path}")
    except ImportError as e:
        raise ValueError("YAML settings need the yaml package") from e
    except (json.JSONDecodeError, AttributeError) as e:
        raise ValueError(f"{path} cannot be read: {e}") from e
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no sections")
    return found


def merged(below: dict[str, Any], above: dict[str, Any]) -> dict[str, Any]:
    """above over below, section by section; null above is not given."""
    out = dict(below)
    for key, value in above.items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = merged(out[key], value)
        elif value is not None or key not in out:
            out[key] = value
    return out


def settings(path: str | None = None, given: dict[str, Any] | None = None, folder: str = ".") -> dict[str, Any]:
    """Defaults, then the file (the one named, or the first of PLACES in folder), then what is given."""
    if path is None:
        path = next((p for p in (os.path.join(folder, name) for name in PLACES) if os.path.exists(p)), None)
    return merged(merged(DEFAULTS, load(path) if path else {}), given or {})
