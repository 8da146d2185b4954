"""Rules on formulas that need a stack, over Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIDES = re.compile(r"\\(left|right)\b")
_OUTER = re.compile(r"(?s)\$\$(.*)\$\$|\\\[(.*)\\\]|\\\((.*)\\\)")
_INLINE = re.compile(r"(?s)\\\((.*?)\\\)")
_BLANK = re.compile(r"(?<!\S)_{3,}(?!\S)")
_BRACE = re.compile(r"(\\+)|[{}]")


def balance_sides(value: str) -> str:
    r"""A ``\left.`` before each ``\right`` without its partner, ``\right.`` at the end for each ``\left`` without."""
    if len(re.findall(r"\\begin\s*\{", value)) != len(re.findall(r"\\end\s*\{", value)):
        return value
    depth = 0

    def side(m: re.Match) -> str:
        nonlocal depth
        if m[1] == "left":
            depth += 1
            return m[0]
        alone, depth = depth == 0, max(0, depth - 1)
        return "\\left." * alone + m[0]

    out = _SIDES.sub(side, value)
    return out + "\\right." * depth


def drop_unmatched_braces(value: str) -> str:
    """Braces without a partner go; those behind an odd run of backslashes are text."""
    open_, drop, escaped_at = [], set(), -1
    for m in _BRACE.finditer(value):
        if m[1]:
            escaped_at = m.end() if len(m[1]) % 2 else -1
        elif m.start() != escaped_at:
            if m[0] == "{":
                open_.append(m.start())
            elif open_:
                open_.pop()
            else:
                drop.add(m.start())
    drop.update(open_)
    return "".join(c for i, c in enumerate(value) if i not in drop)


def normalise(value: str) -> str:
    value = value.strip()
    while m := _OUTER.fullmatch(value):
        value = next(g for g in m.groups() if g is not None).strip()
    return drop_unmatched_braces(balance_sides(value))


def move_blanks(value: str) -> str:
    r"""Blanks to fill in (three underscores or more) out of inline formulas with something on both sides."""

    def one(m: re.Match) -> str:
        inner = m[1]
        blanks = list(_BLANK.finditer(inner))
        if not blanks or not inner[: blanks[0].start()].strip() or not inner[blanks[-1].end() :].strip():
            return m[0]
        parts = _BLANK.split(inner)
        out = []
        for text, blank in zip(parts, [b[0] for b in blanks] + [None], strict=True):
            if text.strip():
                out.append(f"\\({text.strip()}\\)")
            if blank:
                out.append(blank)
        return " ".join(out)

    return _INLINE.sub(one, value)


def period(value: str, least_chars: int = 8, times: int = 3, scan: int = 16 << 10) -> bool:
    """Whether the text is one fragment over and over."""
    data = value.strip().encode()[:scan]
    while data and (data[-1] & 0xC0) == 0x80 and len(value.strip().encode()) > scan:
        data = data[:-1]
    if len(data) < least_chars * times:
        return False
    at = _shortest_period(data)
    return len(data) // at >= times and len(data[:at].decode(errors="ignore")) >= least_chars


def _shortest_period(data: bytes) -> int:
    """The least p with data[p:] == data[:-p]; candidates are where the first bytes come again."""
    head, at = data[:8], data.find(data[:8], 1)
    while at != -1:
        if data[at:] == data[: len(data) - at]:
            return at
        at = data.find(head, at + 1)
    for at in range(max(1, len(data) - 7), len(data)):
        if data[at:] == data[: len(data) - at]:
            return at
    return len(data)


def _series(f, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore")

    return run


balance_sides_udf = _series(balance_sides, T.StringType())
drop_unmatched_braces_udf = _series(drop_unmatched_braces, T.StringType())
normalise_udf = _series(normalise, T.StringType())
move_blanks_udf = _series(move_blanks, T.StringType())
period_udf = _series(period, T.BooleanType())
