"""Strict settings: "key = value" lines with comments, checked against bounds before anything runs."""

from __future__ import annotations

import math
from typing import NamedTuple


class Bound(NamedTuple):
    low: float
    high: float
    whole: bool = False


def parse(text: str, known: dict[str, Bound], origin: str = "settings") -> dict[str, float]:
    """The values of a text. An unknown or repeated key, and a value that is no number or outside its bound, are errors
    that name the line."""
    out: dict[str, float] = {}
    for number, raw in enumerate(text.split("\n"), 1):
        line = raw.partition("#")[0].strip(" \t\r")
        if not line:
            continue
        key, sign, value = (part.strip(" \t\r") for part in line.partition("="))
        why = problem(key, sign, value, known, out)
        if why:
            raise ValueError(f"{origin}:{number}: {why}")
        out[key] = int(float(value)) if known[key].whole else float(value)
    return out


def problem(key: str, sign: str, value: str, known: dict[str, Bound], had: dict) -> str | None:
    if not sign:
        return "expected key = value"
    if key not in known:
        return f"unknown key {key}"
    if key in had:
        return f"repeated key {key}"
    try:
        v = float(value) if "_" not in value else math.nan
    except ValueError:
        v = math.nan
    if not math.isfinite(v):
        return f"not a number: {key} = {value}"
    b = known[key]
    if b.whole and v != math.floor(v):
        return f"{key} must be an integer"
    return None if b.low <= v <= b.high else f"{key} = {value} outside [{b.low:g}, {b.high:g}]"
