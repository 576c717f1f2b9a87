"""Settings: YAML-like dictionaries with references to the environment and to secrets."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping

_REFERENCE = re.compile(r"\$\{(?:(?P<secret>secret:)(?P<scope>[^/}]+)/(?P<key>[^:}]+)|(?P<name>\w+))(?::-(?P<default>[^}]*))?\}")

DEFAULTS: dict = {
    "validation": {"min_bytes": 1024, "max_bytes": 52_428_800, "stale_days": 14, "drop_ratio": 0.3, "max_error_rate": 0.2},
    "silver": {"min_text_chars": 200, "max_pages": 400},
    "gate": {"max_quarantine_rate": 0.25, "max_chunk_tokens": 800},
    "search": {"k": 6, "candidates": 20, "window": 1},
    "answers": {"ttl_seconds": 86_400},
}


def interpolate(value, env: Mapping[str, str] | None = None, secret: Callable[[str, str], str | None] | None = None):
    """Replace ``${NAME:-default}`` and ``${secret:scope/key:-default}`` in all strings of a nested value.

    A reference without a value and without a default is an error that names it.
    """
    env = os.environ if env is None else env

    def one(m: re.Match) -> str:
        found = secret(m["scope"], m["key"]) if m["secret"] and secret else None if m["secret"] else env.get(m["name"])
        found = m["default"] if not found else found
        if found is None:
            raise KeyError(f"no value for {m[0]}")
        return found

    if isinstance(value, str):
        return _REFERENCE.sub(one, value)
    if isinstance(value, Mapping):
        return {k: interpolate(v, env, secret) for k, v in value.items()}
    if isinstance(value, list):
        return [interpolate(v, env, secret) for v in value]
    return value


def settings(given: Mapping | None = None, **sources) -> dict:
    """The defaults with the given sections laid over them."""
    own = interpolate(dict(given or {}), **sources)
    return {k: {**DEFAULTS.get(k, {}), **own.get(k, {})} for k in {*DEFAULTS, *own}}


def resolve(path: str, root: str) -> str:
    """Relative paths are below ``root``; URLs and absolute paths stay."""
    return path if os.path.isabs(path) or "://" in path else f"{root.rstrip('/')}/{path}"
