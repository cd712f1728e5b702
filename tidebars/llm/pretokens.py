"""Cutting texts into parts that merges never cross.

A part is a stretch of white space and what follows up to the next. A pre-token
lies within one part and depends on that part only: before a word the pattern
leaves the last white space apart from the rest, and it never looks back. So the
pattern needs to run once per distinct part only.
"""

from __future__ import annotations

import re

import regex

# The characters that the pattern takes as white space.
SPACES = "\t-\r \x85\xa0  -     　"
PARTS = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")


def cut_part(part: str, pattern: regex.Pattern, special: list[str]) -> list[str]:
    """Pre-tokens of a part; strings of ``special`` stand for themselves."""
    for s in special:
        if s in part:
            pieces = part.split(s)
            out = cut_part(pieces[0], pattern, special)
            for p in pieces[1:]:
                out += [s, *cut_part(p, pattern, special)]
            return out
    return pattern.findall(part)
