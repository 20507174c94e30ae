"""Policy lists: delimiter-joined text -> literal values."""

from __future__ import annotations

from collections.abc import Sequence


def parse_policy_list(text: str | Sequence[str], delimiter: str = ",") -> list[str]:
    """Split on ``delimiter`` and drop empty parts.  Parts are **not** trimmed: ``" c"`` stays
    ``" c"`` and only matches that exact value.  An all-empty list is an error."""
    if isinstance(text, str):
        if not delimiter:
            raise ValueError("delimiter must not be empty")
        parts = [p for p in text.split(delimiter) if p]
    else:
        parts = [p for p in text if p]
    if not parts:
        raise ValueError(f"policy list {text!r} has no entries")
    return parts


def unique_policies(parts: Sequence[str]) -> list[str]:
    """Order-preserving de-duplication (``IN`` is idempotent, a join is not)."""
    return list(dict.fromkeys(parts))
