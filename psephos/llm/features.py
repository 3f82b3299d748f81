"""Rates that describe a text, from the counts of ``text.statistics``."""
from __future__ import annotations

import numpy as np

from psephos.llm.text import Texts, statistics

#: Words of an average text that are added to each, so that rates of very short texts are calm.
PRIOR_WORDS = 20

RATES = (
    "symbols", "dup_lines", "repeats", "distinct", "stutters", "upper", "marks", "shouts", "digits", "beyond",
    "short", "long", "word_length", "line_words",
)

#: The first of them, which depend little on the language.
RULE_RATES = RATES[:8]


def rates(s: dict[str, np.ndarray]) -> np.ndarray:
    """One row of rates, in the order of ``RATES``, for each text."""
    s = {name: np.asarray(values, np.float64) for name, values in s.items()}
    words, chars = s["n_words"], s["word_chars"]
    letters = s["n_upper"] + s["n_lower"]
    p = float(PRIOR_WORDS)

    def excess(part: np.ndarray, whole: np.ndarray, usual: float, prior: float) -> np.ndarray:
        """How much the share of ``part`` exceeds the usual one; near 0 where ``whole`` is small."""
        return (part - usual * whole) / (whole + prior)

    # Longer texts repeat more of their words; the power takes that out.
    distinct = s["n_distinct"] * np.maximum(words, 1) ** 0.15
    return np.stack(
        [
            excess(s["n_symbols"], chars, 0.0, 5 * p),
            excess(s["n_dup_lines"], s["n_lines"], 0.0, 2.0),
            excess(s["n_repeat_words"], words, 0.0, p),
            excess(distinct, words, 1.5, p),
            excess(s["n_stutters"], words, 0.005, p),
            excess(s["n_upper"], letters, 0.03, 5 * p),
            excess(s["n_marks"], chars, 0.04, 5 * p),
            excess(s["n_shouts"], words, 0.0, p),
            excess(s["n_digits"], chars, 0.0, 5 * p),
            excess(s["n_beyond"], chars, 0.03, 5 * p),
            excess(s["n_short"], words, 0.25, p),
            excess(s["n_long"], words, 0.02, p),
            excess(chars, words, 5.5, p),
            excess(words, s["n_lines"], 30.0, 2.0),
        ],
        axis=1,
    )


def rates_of(texts: Texts) -> np.ndarray:
    return rates(statistics(texts))
