"""Wildcards and restricted regular expressions, checked and put as Java patterns."""

from __future__ import annotations

import re

from quarry.plans.nodes import QueryError

_SPECIAL = set("\\.[]{}()<>*+-=!?^$|&~#@\"")
LONGEST = 1024


def _checked(pattern: str) -> str:
    if not pattern:
        raise QueryError("an empty pattern")
    if len(pattern.encode()) > LONGEST:
        raise QueryError(f"a pattern has at most {LONGEST} bytes")
    return pattern


def wildcard(pattern: str) -> str:
    """As an anchored regular expression over whole tokens."""
    out, i, pattern = [], 0, _checked(pattern)
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            if i == len(pattern):
                raise QueryError("a backslash at the end quotes nothing")
            c = pattern[i]
            out.append("\\" + c if c in _SPECIAL else c)
        elif c in "*?":
            out.append(".*" if c == "*" else ".")
        else:
            out.append("\\" + c if c in _SPECIAL else c)
        i += 1
    return f"^(?s:{''.join(out)})$"


def regex(pattern: str) -> str:
    """Literals, classes, groups, alternation and repetition; everything else is refused."""
    i, inside, pattern = 0, False, _checked(pattern)
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            if i == len(pattern):
                raise QueryError("a backslash at the end quotes nothing")
            if pattern[i].isalnum():
                raise QueryError(f"\\{pattern[i]} is not in the language")
        elif inside:
            if c == "[" or pattern.startswith("&&", i) or pattern.startswith("--", i) or pattern.startswith("~~", i):
                raise QueryError("classes don't nest")
            inside = c != "]"
        elif c == "[":
            inside = True
            if pattern[i + 1 : i + 2] == "^":
                i += 1
        elif c in "^$&~#@<>\"":
            raise QueryError(f"{c} is not in the language")
        elif c == "(" and pattern[i + 1 : i + 2] == "?":
            raise QueryError("groups have no flags")
        elif c in "*+?}" and pattern[i + 1 : i + 2] in ("?", "+"):
            raise QueryError("repetition is neither lazy nor possessive")
        i += 1
    try:
        re.compile(pattern)
    except re.error as e:
        raise QueryError(f"{pattern!r}: {e}") from e
    return f"^(?s:{pattern})$"
