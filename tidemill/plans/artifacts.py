"""Run artifacts that are written once and never over."""

from __future__ import annotations

import json
import os
from pathlib import Path

from ..errors import ArtifactExistsError


def write_once(path: str | Path, content: dict) -> Path:
    """Create a JSON file durably; an existing one is refused."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    try:
        fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o644)
    except FileExistsError as e:
        raise ArtifactExistsError(str(path)) from e
    with os.fdopen(fd, "w") as f:
        json.dump(content, f, indent=1, sort_keys=True, default=str)
        f.flush()
        os.fsync(f.fileno())
    folder = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)
    return path
