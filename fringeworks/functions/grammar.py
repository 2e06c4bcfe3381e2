"""Selections as text: ranges of indices and bins with units."""

from __future__ import annotations

import re

from pyspark.sql import Column

_UNITS = {"": 1.0, "s": 1.0, "m": 60.0, "h": 3600.0, "hz": 1.0, "khz": 1e3, "mhz": 1e6, "ghz": 1e9, "thz": 1e12}


def parse_range(spec: str | int | None, size: int) -> range:
    """'5' one index; '5~7' inclusive; '5:8' exclusive; '5:' and '~9' open; a further ':2' is a step; empty selects all."""
    text = "" if spec is None else str(spec).strip()
    if text in ("", ":", "~"):
        return range(size)
    if re.fullmatch(r"\d+", text):
        return range(int(text), int(text) + 1)
    m = re.fullmatch(r"(\d*)([~:])(\d*)(?::(\d+))?", text)
    if not m:
        raise ValueError(f"no range: {text!r}")
    lo = int(m[1] or 0)
    hi = int(m[3]) + (m[2] == "~") if m[3] else size
    return range(lo, min(hi, size), int(m[4] or 1))


def in_range(column: Column, spec: str | int | None, size: int) -> Column:
    """A filter that reaches the scan: bounds, and the remainder of a step."""
    r = parse_range(spec, size)
    out = (column >= r.start) & (column < r.stop)
    return out if r.step == 1 else out & ((column - r.start) % r.step == 0)


def parse_bin(spec: str | int) -> tuple[int, float | None]:
    """(count, None) for a bare number, (0, value in s or Hz) for a number with a unit."""
    m = re.fullmatch(r"([0-9.eE+-]+?)\s*([a-zA-Z]*)", str(spec).strip())
    if not m or m[2].lower() not in _UNITS:
        raise ValueError(f"no bin: {spec!r}")
    return (int(m[1]), None) if not m[2] else (0, float(m[1]) * _UNITS[m[2].lower()])


def globbed(column: Column, pattern: str) -> Column:
    """Whether names match a pattern of file names (*, ?, [...], [!...]) as a whole."""
    parts, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        end = pattern.find("]", at + 2) if c == "[" else -1
        if end > 0:
            inner = re.sub(r"([\\\[&])", r"\\\1", pattern[at + 1 : end])
            parts.append(f"[{'^' + inner[1:] if inner[0] == '!' else inner}]")
            at = end
        else:
            parts.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        at += 1
    return column.rlike(f"(?s)^{''.join(parts)}$")
