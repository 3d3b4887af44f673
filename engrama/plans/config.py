"""The one switch that a running store has: whether recalls look beyond their ranking."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path

VARIABLE = "ENGRAMA_FIELD"


def field_on(path: str, environment: Mapping[str, str] | None = None) -> bool:
    """The file's word if it has one, else the environment's; read anew each time. A missing or broken file says nothing."""
    environment = os.environ if environment is None else environment
    try:
        said = json.loads(Path(path).read_text()).get("field")
    except (OSError, ValueError, AttributeError):
        said = None
    return said if isinstance(said, bool) else environment.get(VARIABLE, "").lower() in ("1", "true", "yes")


def set_field(path: str, on: bool) -> None:
    """Writes the switch beside the file's other settings, all in one step."""
    try:
        settings = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        settings = {}
    temp = Path(f"{path}.new")
    temp.write_text(json.dumps({**(settings if isinstance(settings, dict) else {}), "field": on}))
    temp.replace(path)
