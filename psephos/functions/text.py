"""Text expressions: keyword matching and number formats."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = re.compile(r"[\\^$.|?*+()\[\]{}]")
_PLAIN_START = re.compile(r"\w(?![*+?{])")


def _literal(pattern: str) -> str | None:
    """The text a pattern stands for, or None if it is more than escaped dots and text."""
    text = pattern.replace("\\.", "\0")
    return None if _META.search(text) else text.replace("\0", ".")


def _by_first_letter(patterns: Sequence[str]) -> str:
    """One alternation, grouped by first letter."""
    groups: dict[str, list[str]] = {}
    others = []
    for pattern in patterns:
        if _PLAIN_START.match(pattern):
            groups.setdefault(pattern[0], []).append(pattern[1:])
        else:
            others.append(pattern)
    return "|".join([f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items()] + others)


def one_pattern(patterns: Sequence[str]) -> str:
    """A regular expression that is found in a text if one of ``patterns`` is.

    A matcher tries each alternative at each position of the text.  So keywords that a
    shorter one covers are left out, those at the start share one anchor, and the
    rest is grouped by first letter: a position fails after a few comparisons.
    """
    anchored, free, mixed = [], [], []
    for pattern in dict.fromkeys(patterns):
        if "|" in pattern or "(?" in pattern:
            mixed.append(pattern)
        elif pattern.startswith("^"):
            anchored.append(pattern[1:])
        else:
            free.append(pattern)
    parts = [text for text in map(_literal, free) if text is not None]

    starts = [text for text in map(_literal, anchored) if text is not None]

    def kept_free(pattern: str) -> bool:
        text = _literal(pattern)
        return text is None or not any(part != text and part in text for part in parts)

    def kept_anchored(pattern: str) -> bool:
        text = _literal(pattern)
        return text is None or not (
            any(part in text for part in parts)
            or any(start != text and text.startswith(start) for start in starts)
        )

    free = list(filter(kept_free, free))
    anchored = list(filter(kept_anchored, anchored))
    joined = [f"^(?:{_by_first_letter(anchored)})"] if anchored else []
    if free:
        joined.append(_by_first_letter(free))
    return "|".join(joined + mixed)


def matches_any(column: Column, patterns: Sequence[str]) -> Column:
    """Whether a regular expression of the list is found in the text; null for null."""
    return column.rlike(one_pattern(patterns)) if patterns else F.lit(False)


def fixed_text(column: Column, decimals: int) -> Column:
    """A number with so many decimals, at most 8, rounded on its exact binary value; ties go to the even digit.

    The number is split into halves of 26 bits.  Each times the scale is exact, and so is what the upper one
    lies beside the middle between two results, so the sign of the rest is too.
    """
    scale = float(10**decimals)
    size = F.abs(column)
    spread = size * 134217729.0  # 2**27 + 1
    high = spread - (spread - size)
    below = F.floor(size * scale).cast("double")
    rest = (high * scale - (below + 0.5)) + (size - high) * scale
    up = (rest > 0) | ((rest == 0) & (below % 2 == 1))
    whole = F.when(up, below + 1).otherwise(below).cast("bigint")
    base = 10**decimals
    text = F.floor(whole / base).cast("bigint").cast("string") if decimals else whole.cast("string")
    if decimals:
        text = F.concat(text, F.lit("."), F.lpad((whole % base).cast("string"), decimals, "0"))
    signed = F.concat(F.when(column < 0, "-").otherwise(""), text)
    # From 2**53 / scale on every double is exact to the decimals asked for, or has no such digits.
    text = F.when(size < 2.0**53 / scale / 2, signed).otherwise(F.format_string(f"%.{decimals}f", column))
    return F.when(column.isNotNull(), text)


def percent_text(column: Column, decimals: int) -> Column:
    """A share as percent text, for example 0.125 as ``12.5%``, rounded on the binary value."""
    return F.concat(fixed_text(column * 100, decimals), F.lit("%"))


def significant_text(column: Column, digits: int = 3) -> Column:
    """A number with so many significant digits and no trailing zeros, for example ``0.05``."""
    text = F.format_string(f"%.{digits}g", column)
    text = F.regexp_replace(text, r"(\.\d*?)0+(e|$)", "$1$2")
    return F.regexp_replace(text, r"\.(e|$)", "$1")
