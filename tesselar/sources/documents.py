"""JSON findings in, and JSON receipts and tables out."""

from __future__ import annotations

import json
import os
import tempfile
from typing import Any

REQUIRED = ["id", "title", "relevance_category"]


class FindingError(ValueError):
    def __init__(self, reason: str, message: str):
        super().__init__(message)
        self.reason = reason


def load_finding(finding: dict | str) -> dict[str, Any]:
    """A finding: an object, or an absolute path of a JSON file with the object or with one under `findings`."""
    if isinstance(finding, str):
        if not finding.endswith(".json"):
            raise FindingError("unsupported_format", "a finding is an object or a .json file")
        if not os.path.isabs(finding) or ".." in finding.split("/"):
            raise FindingError("unsafe_path", "the path must be absolute")
        with open(finding, encoding="utf-8") as f:
            finding = json.load(f)
    if isinstance(finding, dict) and isinstance(finding.get("findings"), list):
        if len(finding["findings"]) != 1:
            raise FindingError("ambiguous_finding", f"{len(finding['findings'])} findings; one is needed")
        finding = finding["findings"][0]
    if not isinstance(finding, dict):
        raise FindingError("invalid_finding", "a finding is an object")
    for key in REQUIRED:
        if not str(finding.get(key) or "").strip():
            raise FindingError(f"missing_{key}", f"the finding has no {key}")
    return finding


def write_json(path: str, value: Any) -> int:
    """Writes a small receipt whole or not at all; gives its bytes."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    data = json.dumps(value, indent=2, ensure_ascii=False).encode()
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".", suffix=".tmp")
    with os.fdopen(handle, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)
    return len(data)


def read_json(path: str) -> Any | None:
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)
