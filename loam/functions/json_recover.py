"""Lenient JSON: what a language model returns, as JSON text again, or null."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

FENCE = re.compile(r"^\s*```[A-Za-z]*\s*|\s*```\s*$")


def recover(text: str | None, kind: str = "any") -> str | None:
    """Fence off, then the whole, then the outermost bracket pair of the kind, then that without trailing commas.

    kind: `array`, `object` or `any` (whichever opens first)."""
    if not text or not text.strip():
        return None
    body = FENCE.sub("", text.strip())
    first = {"array": "[", "object": "{"}.get(kind) or next((c for c in body if c in "[{"), "")
    last = {"[": "]", "{": "}"}.get(first, "")
    inner = body[body.find(first) : body.rfind(last) + 1] if first and first in body and last in body else ""
    want = {"array": list, "object": dict}.get(kind, (list, dict))
    for candidate in (body, inner, re.sub(r",(\s*[\]}])", r"\1", inner)):
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, want):
            return json.dumps(found, ensure_ascii=False, separators=(",", ":"))
    return None


def json_recover(col, kind: str = "any"):
    """Column of recovered JSON text. Brackets that nest are beyond regular expressions, hence Arrow batches of Python."""

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda x: recover(x, kind))

    run.__name__ = "json_recover"
    return run(F.col(col) if isinstance(col, str) else col)
