"""Predicates over classes, ops and lines."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Opcode names.
INVOKES = [f"Invoke{kind}{form}" for kind in ("Virtual", "Super", "Interface", "Direct", "Static", "Polymorphic") for form in ("", "Range")]
BRANCHES = [f"If{test}{zero}" for test in ("Eq", "Ne", "Lt", "Ge", "Gt", "Le") for zero in ("", "z")] + ["Goto", "Goto16", "Goto32", "PackedSwitch", "SparseSwitch"]


class InvalidPattern(ValueError):
    """A pattern that can't be compiled; raised on the driver, before anything is planned."""


def compile_patterns(patterns: Iterable[str] | None) -> str | None:
    """One pattern that matches where any of ``patterns`` does, with Unicode classes; None for no patterns. An empty pattern
    is legal and matches everything (F1, F3). Patterns are compiled by the engine's own regex library."""
    each = list(patterns or ())
    if not each:
        return None
    session = SparkSession.getActiveSession()
    for p in each:
        try:
            if session is not None:
                session.sparkContext._jvm.java.util.regex.Pattern.compile(p)
            else:
                re.compile(p)
        except Exception as e:
            raise InvalidPattern(f"invalid pattern {p!r}") from e
    return "(?U)" + "|".join(f"(?:{p})" for p in each)


def class_filter(class_java: Column, patterns: Iterable[str] | None) -> Column:
    """True where the class name matches any pattern, or there are none (F1)."""
    joined = compile_patterns(patterns)
    return F.lit(True) if joined is None else class_java.rlike(joined)


def is_invoke(opcode: Column) -> Column:
    """F4."""
    return opcode.isin(INVOKES)


def is_branch(opcode: Column) -> Column:
    """F5."""
    return opcode.isin(BRANCHES)


def filtered_lines(text: Column, patterns: Iterable[str] | None) -> Column:
    """The lines of ``text`` that match any pattern, joined by line feeds; the whole text without patterns (F2). A line feed
    at the end doesn't open a further line, nor does a carriage return belong to its line."""
    joined = compile_patterns(patterns)
    if joined is None:
        return text
    whole = F.regexp_replace(text, r"\r?\n\z", "")
    lines = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(whole, r"\r?\n"))
    return F.array_join(F.filter(lines, lambda x: x.rlike(joined)), "\n")
