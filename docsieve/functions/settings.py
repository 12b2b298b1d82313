"""Settings as nested maps: dotted lookup, merging, and removal of secrets before they are shown."""

from __future__ import annotations

import re
from typing import Any

# Fixed value: names of keys whose values are secret.
SECRET = re.compile(r"(?:api[_-]?key|secret|token|password|passwd|authorization|credential|bearer)", re.I)
HIDDEN = "***REDACTED***"


def lookup(settings: dict, path: str, default: Any = None) -> Any:
    """The value at a dotted path; ``default`` where it leads nowhere."""
    at: Any = settings
    for part in path.split("."):
        if not isinstance(at, dict) or part not in at:
            return default
        at = at[part]
    return at


def merged(base: dict, over: dict) -> dict:
    """``base`` with ``over`` laid upon it: maps key by key, lists and all else replaced whole. Neither argument is changed."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def shown(value: Any, name: str = "") -> Any:
    """``value`` with secrets hidden at any depth: an empty one becomes null, any other a mark."""
    if isinstance(value, dict):
        return {k: shown(v, str(k)) for k, v in value.items()}
    if isinstance(value, list):
        return [shown(v, name) for v in value]
    return (HIDDEN if value else None) if SECRET.search(name) else value


def locked(settings: dict, rules: dict[str, Any]) -> list[str]:
    """The dotted paths of ``rules`` at which ``settings`` has another value than the one required; missing ones count as kept."""
    return sorted(p for p, want in rules.items() if (have := lookup(settings, p, want)) != want)
