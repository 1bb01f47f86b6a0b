"""What a rule is: data for the detectors."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a Java pattern; ``swap`` maps lower-case matches to replacements; ``exceptions`` are matches to leave alone."""

    rule: str
    pattern: str
    message: str
    severity: str = "warning"
    swap: tuple[tuple[str, str], ...] = ()
    exceptions: tuple[str, ...] = ()
    replacement: str | None = None
    literal: str | None = None
    source: str = "style"


def words_rule(rule: str, words: tuple[str, ...], message: str, severity: str = "warning", ignorecase: bool = True) -> Rule:
    """Whole words, in any case or as they are written."""
    flags = "(?iu)" if ignorecase else ""
    return Rule(rule, flags + r"(?<![\p{L}\p{N}_])(?:" + "|".join(map(re.escape, words)) + r")(?![\p{L}\p{N}_])", message, severity)


def swap_rule(rule: str, swap: dict[str, str], message: str, severity: str = "warning", ignorecase: bool = True) -> Rule:
    made = words_rule(rule, tuple(swap), message, severity, ignorecase)
    return Rule(rule, made.pattern, message, severity, swap=tuple({k.lower(): v for k, v in swap.items()}.items()))
