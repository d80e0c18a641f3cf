"""Cutting texts before spaces, where byte-level BPE patterns always cut, so that pieces can be cached."""

from __future__ import annotations

import re

#: White space of either regex engine, a superset of both; a space before one of these is not a cut.
_SPACE = frozenset(chr(c) for c in range(0x110000) if chr(c).isspace()) | frozenset("\x1c\x1d\x1e\x1f\x85᠎​⁠﻿")
_ODD = re.compile(f" (?:[{re.escape(''.join(sorted(_SPACE)))}]|$)")


def cut(text: str) -> list[str]:
    """Pieces whose concatenation is `text`, cut before each space that a non-space character follows.

    The pattern's alternatives take at most one space, and only in front, so a match always starts at such a
    space and none crosses it. Encoding the pieces one by one equals encoding the text.
    """
    if "\0" not in text and not _ODD.search(text):
        out = text.replace(" ", "\0 ").split("\0")
        return out if out[0] else out[1:]
    parts = text.split(" ")
    out = [parts[0]]
    for p in parts[1:]:
        if p and p[0] not in _SPACE:
            out.append(" " + p)
        else:  # a run of white space stays with the piece before it
            out[-1] += " " + p
    return out if out[0] else out[1:]
