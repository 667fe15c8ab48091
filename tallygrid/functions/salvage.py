"""Items out of loosely formed JSON answers."""

from __future__ import annotations

import json
import re

#: Confidences that are given as words.
WORDS = {"very high": 0.9, "high": 0.9, "medium": 0.7}


def parse(text: str | None):
    """The JSON value in an answer: the whole, a fenced block, an array, an object, or the complete objects of a cut-off list."""
    if not text or not text.strip():
        return None
    tries = [text, *re.findall(r"```(?:json)?\s*(.*?)```", text, re.DOTALL)]
    for a, b in (("[", "]"), ("{", "}")):
        i, j = text.find(a), text.rfind(b)
        if 0 <= i < j:
            tries.append(text[i : j + 1])
    for t in tries:
        try:
            return json.loads(t.strip())
        except ValueError:
            continue
    out, at, decoder = [], 0, json.JSONDecoder()
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        if isinstance(value, dict):
            out.append(value)
        at = end
    return out or None


def confidence(value) -> float:
    """A confidence as a number from 0 to 1; words count, anything else is 0.5."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return min(1.0, max(0.0, float(value)))
    return WORDS.get(str(value).strip().lower(), 0.5)


def items(text: str | None) -> list[dict]:
    """Line items of an answer, under ``items`` or ``line_items`` or bare, with defaults for what is missing."""
    value = parse(text)
    if isinstance(value, dict):
        value = value.get("items", value.get("line_items", [value] if "description" in value else []))
    out = []
    for x in value if isinstance(value, list) else []:
        if isinstance(x, dict) and x.get("description"):
            quantity = x.get("quantity")
            try:
                quantity = None if quantity is None else float(str(quantity).replace(",", ""))
            except ValueError:
                quantity = None
            out.append({"description": str(x["description"]), "trade": str(x.get("trade") or ""), "quantity": quantity, "unit": x.get("unit"), "confidence": confidence(x.get("confidence"))})
    return out
