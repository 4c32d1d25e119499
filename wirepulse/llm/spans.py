"""Spans of a text as ``(start, end, kind)`` in code points, and their digest."""

from __future__ import annotations

import hashlib

Span = tuple[int, int, str]

BASE_COLUMNS = "base_sha256 string, spans string"


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def base_columns(found: list[list[Span]], kinds: tuple[str, ...]) -> dict[str, list]:
    """Counts per base kind, the base digest and all spans of each text.

    The spans must stand in order of start, then kind.
    """
    base = [[span for span in spans if span[2] in kinds] for spans in found]
    counts = {f"n_{kind}": [sum(span[2] == kind for span in spans) for spans in base] for kind in kinds}
    digests = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]
    return {**counts, "base_sha256": digests, "spans": [joined(spans) for spans in found]}
