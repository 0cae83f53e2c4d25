"""Nested configuration with dotted overrides."""

from __future__ import annotations

import copy
import json
from typing import Any


def override(config: dict[str, Any], changes: list[str]) -> dict[str, Any]:
    """A copy with each "a.b=value" applied; values are JSON or plain text, and a key that is not there is an error."""
    out = copy.deepcopy(config)
    for change in changes:
        path, sign, text = change.partition("=")
        if not sign:
            raise ValueError(f"not key=value: {change}")
        at, keys = out, path.split(".")
        for k in keys[:-1]:
            at = at[k] if isinstance(at, dict) and k in at else None
        if not isinstance(at, dict) or keys[-1] not in at:
            raise KeyError(path)
        try:
            at[keys[-1]] = json.loads(text)
        except json.JSONDecodeError:
            at[keys[-1]] = text
    return out
