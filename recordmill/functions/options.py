"""Checks for option values given by the caller on the driver."""

from __future__ import annotations

import re

_WORD = re.compile(r"""(?:[^\s"']|"[^"]*"|'[^']*')+""")
_PIECE = re.compile(r'''"([^"]*)"|'([^']*)'|([^\s"']+)''')


def split_words(text: str) -> list[str]:
    """Split a command line on white space; quotes group, nothing escapes.

    A word whose quote is never closed is dropped.
    """
    words = []
    rest = text
    while rest := rest.lstrip():
        match = _WORD.match(rest)
        end = match.end() if match else 0
        if end < len(rest) and rest[end] in "\"'":
            break
        words.append("".join("".join(p) for p in _PIECE.findall(rest[:end])))
        rest = rest[end:]
    return words


def positive_int(text: str | int, name: str = "value") -> int:
    if not re.fullmatch(r"\s*\+?[0-9]+", str(text)) or int(text) <= 0:
        raise ValueError(f"{name} must be a positive whole number, got {text!r}")
    return int(text)
